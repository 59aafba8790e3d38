"""The vector index and the language model on however many partitions; recall over many distinct vectors."""

import numpy as np
from pyspark.sql import functions as F

from procgraph.llm import ann, langid


def grouped(n=20_000, d=32, groups=300, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(groups, d)) * 2
    return at[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.5


def test_recall_and_share_scanned(spark, monkeypatch):
    x = grouped()
    model = []
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a, **k: model.append(fit(*a, **k)) or model[-1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumns({c: F.lit("q") for c in ("id", "x", "cell", "list", "rank", "score", "n", "guess")})
    hits = {}
    for r in ann.search(df).collect():
        hits.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        found += len(hits[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert len(hits) == 1000 and found >= 0.9 * 20 * 1000
    (ix,) = model
    share = ix.probes / len(ix.centroids)
    print(f"recall {found / 20_000:.3f}, {ix.probes} of {len(ix.centroids)} lists probed, {ix.depth} reranked")
    assert share < 0.4 and ix.depth < 0.05 * len(x)


def test_partitions_make_no_difference(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    a, b = ([tuple(r) for r in ann.search(v.repartition(n)).orderBy("query_id", "rank").collect()] for n in (2, 7))
    assert a == b
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = ([tuple(r) for r in langid.identify(d.repartition(n), max_rows=80).orderBy("doc_id").collect()] for n in (2, 7))
    assert a == b


def test_many_equal_vectors(spark):
    """A third of all vectors are one and the same: the smallest ids win."""
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(3000)]
    got = [r["vec_id"] for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64).where("query_id = 60").orderBy("rank").collect()]
    assert len(got) == 20
    x = np.array([r[1] for r in rows])
    s = x @ x[60]
    s[60] = -np.inf
    assert got == np.lexsort((np.arange(len(x)), -s))[:20].tolist()


def test_decoding_by_hand():
    """The loss of each codeword, bit by bit."""
    rng = np.random.default_rng(3)
    texts = {"de": "der die das und nicht", "en": "the of and to not", "fr": "le la les des pas"}
    m = langid.fit([(k, langid.features(" ".join(rng.permutation(t.split())))) for k, t in texts.items() for _ in range(8)])
    x = langid.features("und das nicht")
    loss = []
    for word in m.code:
        bits = [sum(float(x[i]) * float(m.weights[i, b]) for i in range(len(x))) + float(m.bias[b]) for b in range(len(word))]
        loss.append(sum(float(w) * np.log1p(np.exp(-f * c)) for w, f, c in zip(m.bit_weights, bits, word)) / float(m.bit_weights.sum()))
    assert m.losses(x[None])[0].tolist() == np.array(loss).round(9).tolist() or np.allclose(m.losses(x[None])[0], loss, atol=1e-5)
    assert m.predict(["und das nicht"])[0] == [m.langs[int(np.argmin(loss))]] == ["de"]
