"""The nearest vectors against brute force, on rows that a sample says little about."""

import numpy as np
import pytest

from procgraph.llm import ann

COLS = "vec_id long, embedding array<double>"


def brute(rows, k=20, every=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = np.zeros(len(x))
        for c in range(x.shape[1]):
            s += x[:, c] * x[q, c]
        by = np.lexsort((ids, -s))
        out[int(ids[q])] = [(int(i), float(v)) for i, v in zip(ids[by], s[by], strict=True) if i != ids[q]][:k]
    return out


def answers(df, **how):
    out = {}
    for r in ann.search(df, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def rows_of(kind, n=3000, d=24):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, d))
    if kind == "norms":  # lengths over four powers of ten
        x *= 10 ** rng.uniform(-2, 2, (n, 1))
    elif kind == "apart":  # those asked lie where few others do
        x[::20] += 8 * np.eye(d)[0]
        x[rng.choice(np.flatnonzero(np.arange(n) % 20), 200)] += 5 * np.eye(d)[0]
    elif kind == "near copies":
        x[: n // 2] = x[0] + 0.001 * x[: n // 2]
    elif kind == "copies":
        x[rng.random(n) < 0.4] = x[0]
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(n), x, strict=True)] if kind != "apart" else [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["plain", "norms", "apart", "near copies", "copies"])
def test_none_is_missed(spark, kind):
    rows = rows_of(kind)
    assert answers(spark.createDataFrame(rows, COLS).repartition(3), sample_rows=512, block=256) == brute(rows)


def test_repeated_ids_among_copies(spark):
    """An id with several vectors, each with copies: no row of the query's id is found, and each row has ranks of its own."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12, 6))
    rows = [(40, x[i % 12].tolist()) for i in range(60)] + [(i, x[i % 12].tolist()) for i in range(100, 400)]
    got = ann.search(spark.createDataFrame(rows, COLS).repartition(3)).where("query_id = 40").collect()
    ids, v = np.array([r[0] for r in rows[60:]]), np.array([r[1] for r in rows[60:]])
    want = sorted((rank, int(ids[i])) for q in x for rank, i in enumerate(np.lexsort((ids, -np.round(v @ q, 9)))[:20], 1))
    assert sorted((r["rank"], r["vec_id"]) for r in got) == want


def test_rows_of_a_cell_stay_few(spark):
    """Of a group of near copies each query takes a row for each of its ranks, not all that are as near."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=16) + 0.01 * rng.normal(size=(400, 16))
    ix = ann.fit(x, 400, 20, 0.96)
    lists, codes = ix.encode(x)
    away, err = ix.errors(x, lists, codes)
    m = ann.Members.of(ann.pd.DataFrame({"list": lists, "ids": [[i] for i in range(400)], "x": list(x), "codes": [c.tobytes() for c in codes], "away": away, "err": err}))
    q = x[::20]
    i, ids, score = ann.scan(ix, q, np.full(20, ann.NONE), np.full(20, -np.inf), np.ones((20, len(m.lists)), bool), m, 21)
    assert np.bincount(i).tolist() == [21] * 20
    assert sorted(ids[i == 3].tolist()) == sorted(np.argsort(-(x @ q[3]))[:21].tolist())
