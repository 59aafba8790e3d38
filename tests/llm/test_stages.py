"""The stages on null ids, repeated rows and equal texts; packing under three capacities that all bind."""

import collections

import pytest

import corpus_pipeline
from procgraph.llm import common, packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def body(i, n=80):
    return " ".join(f"w{i}x{j}" for j in range(n))


@pytest.fixture
def docs(spark):
    rows = [(1, body(1)), (1, body(1)), (None, body(2)), (None, body(2)), (None, body(3)), (4, body(4)), (5, body(4)), (6, body(6) + " password=abcdef123"), (7, None), (8, ""), (9, body(9) + " " + body(4)[:300]), (6, body(10))]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def test_nothing_unique_is_lost(spark, docs, sf_dir):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, now, sf_dir)
        assert nxt.columns == docs.columns, name
        now = spark.createDataFrame(nxt.collect(), COLUMNS)
        if name == "near_dedup":
            assert collections.Counter(r["text"] for r in now.collect()) == collections.Counter([body(1), body(2), body(3), body(4), body(6) + " password=abcdef123", body(9) + " " + body(4)[:300], body(10)])
    texts = {r["text"] for r in now.collect()}
    assert {body(1), body(2), body(3), body(4), body(6) + " [SECRET]", body(10)} < texts and len(texts) == 7
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).count() == 7


def test_tables_of_stages_go(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).count() == 7
    left = {p.name.split("-")[0] for p in (tmp_path / "shared").iterdir() if any(p.glob("*.parquet"))}
    assert "secret_scan" in left and not left & {"quality_rules", "near_dedup", "suffix_dedup"}


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Cluster:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)


def brute_best_fit(lengths, cap):
    """One piece at a time: the longest opens a sequence, then the largest dot product with what is left."""
    left, out = collections.Counter(lengths), []
    total = [sum(lengths) / cap[0], len(lengths) / cap[1], sum(x * x for x in lengths) / cap[2]]
    weights = [t / max(total) for t in total]
    while +left:
        room, got = list(cap), []
        pick = max(+left)
        while pick:
            left[pick] -= 1
            got.append(pick)
            room = [r - n for r, n in zip(room, (pick, 1, pick * pick))]
            fits = [x for x in sorted(+left) if x <= room[0] and 1 <= room[1] and x * x <= room[2]]
            dot = lambda x: sum(n / c * r / c * w for n, c, r, w in zip((x, 1, x * x), cap, room, weights))
            pick = max(fits, key=dot) if fits else 0
        out.append(got)
    return out


@pytest.mark.parametrize("cap", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 2_600), (100, 4, 3_000)])
def test_as_few_sequences_as_one_at_a_time(cap):
    import random

    rng = random.Random(8)
    lengths = [rng.randint(1, 50) for _ in range(600)]
    ours = packing.best_fit(collections.Counter(lengths), cap).n_sequences
    assert abs(ours - len(brute_best_fit(lengths, cap))) <= 0.03 * ours + 1


def test_all_three_capacities_bind(spark):
    texts = ["word " * n for n in [30] * 40 + [3] * 200 + [12] * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few = {k: packing.pack(docs, 64, **how).select("sequence_id").distinct().count() for k, how in {"tokens": {}, "docs": {"max_docs": 4}, "attention": {"max_attention": 1500}, "all": {"max_docs": 4, "max_attention": 1500}}.items()}
    assert few["tokens"] < min(few["docs"], few["attention"]) and few["all"] > few["tokens"]
    for seq in packing.pack(docs, 64, max_docs=4, max_attention=1500).groupBy("sequence_id").agg({"length": "sum", "doc_id": "count"}).collect():
        assert seq["sum(length)"] <= 64 and seq["count(doc_id)"] <= 4
    with pytest.raises(ValueError):
        packing.pack(docs, 64, max_docs=0)
