"""No text may take an executor down: long runs of whatever the expressions repeat, and dense texts, in proportionate time."""

import time

import numpy as np
import pytest

from procgraph.llm import ann, licenses, quality, secrets, suffix

RUNS = {
    "marks": "- " * 50_000 + " foo",
    "dashes": "-" * 100_000,
    "comments": "rem dnl <!-- " * 8_000,
    "headers": "-----BEGIN PRIVATE KEY-----" + "\nProc-Type: 4,E" * 3_000,
    "begins": "-----BEGIN " * 9_000 + "PRIVATE KEY-----",
    "web tokens": "eyJ" * 33_000 + " .eyJ",
    "hex": "0123456789abcdef01234567 " * 20_000,
    "blanks": "token" + " " * 100_000 + "=",
    "lines": "\n" * 100_000,
    "items": "(a) " * 25_000,
}


@pytest.mark.parametrize("name", RUNS)
def test_long_runs(spark, name):
    df = spark.createDataFrame([(1, RUNS[name], "s")], "doc_id long, text string, source string")
    for f in (licenses.scan, quality.assess, secrets.scan, secrets.redact):
        began = time.perf_counter()
        assert len(f(df).collect()) == 1
        assert time.perf_counter() - began < 30, f.__name__


def test_dense_spans(spark):
    """More spans than a group: places and the redacted text."""
    token = "0123456789abcdef01234567"
    text = "é " + f"{token} x" * 700 + "password=abcdef0123456789abcdef0123" + token
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row, out = secrets.scan(df).first(), secrets.redact(df).first()
    spans = [tuple(map(int, s.split(":")[1:])) for s in row["spans"].split(",")]
    hexes = [s for s in row["spans"].split(",") if s.startswith("hex")]
    assert row["n_hex"] == len(hexes) == 701 and all(int(h.split(":")[1]) < int(h.split(":")[2]) for h in hexes)
    assert all(text[a:b] == token for a, b in spans[:700])
    assert out["text"] == "é " + "[SECRET] x" * 700 + "[SECRET]"


def test_buckets_of_hashes():
    """Many more buckets than 65,536 still rise with the hash."""
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 100_000, dtype=np.uint64))
    for parts in (1, 7, 100_000, (1 << 32) - 1):
        b = suffix.hash_bucket(h, parts)
        assert (np.diff(b.astype(np.int64)) >= 0).all() and int(b.max()) < parts


def test_repeated_vectors(spark):
    """A tenth of the rows, queries too, occur twice; one id has two vectors."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += rows[::10] + [(40, rng.normal(size=8).tolist()), (7, rng.normal(size=8).tolist())]
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    want = []
    for i, q in distinct:
        if i % 20 == 0:
            near = sorted((-float(np.dot(q, v)), j) for j, v in distinct if j != i)[:20]
            want += [(i, k + 1, j) for k, (_, j) in enumerate(near)]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert len(got) == len(want) and len(set(want) & set(got)) >= 0.9 * len(set(want))
    for q in {g[0] for g in got} - {40}:
        found = [g[2] for g in got if g[0] == q]
        assert len(found) == 20 and len(found) - len(set(found)) <= 2
