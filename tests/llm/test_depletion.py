"""Lines above the limit, and documents that keep too little, by the operator and by its SQL."""

import pyarrow as pa

from procgraph.llm import quality


def corpus():
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    footer = " ".join(f"shared{j}" for j in range(40))
    texts = [f"{own(i, 30)}\n{footer}" for i in range(12)]  # 30 of 70 words stay: depleted
    texts += [f"{own(i, 90)}\n{footer.upper()}." for i in range(12, 16)]  # 90 of 130 stay
    texts += [own(i, 60) for i in range(16, 20)]
    return [(i, t, "big") for i, t in enumerate(texts)] + [(100 + i, f"{own(i, 30)}\n{footer}", "small") for i in range(5)]


def test_depleted_documents_go(spark, duck):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.assess(docs, min_docs=10).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == set(range(12))
    assert {i for i, r in got.items() if r["n_words_removed"] == 40} == set(range(16))
    kept = {r["doc_id"]: r["text"] for r in quality.clean(docs, min_docs=10).collect()}
    assert set(kept) == set(range(12, 20)) | set(range(100, 105)) and kept[12] == " ".join(f"w12x{j}" for j in range(90))
    con = duck.cursor()
    con.register("own", pa.table({"doc_id": [r[0] for r in corpus()], "text": [r[1] for r in corpus()], "source": [r[2] for r in corpus()]}))
    con.sql("CREATE TEMP VIEW documents AS SELECT * FROM own")
    rel = con.sql(quality.oracle(10))
    assert {r[rel.columns.index("doc_id")]: r for r in rel.fetchall()} == {i: tuple(r[c] for c in rel.columns) for i, r in got.items()}


def test_a_large_host_is_treated_alike(spark):
    more = [(1000 + i, " ".join(f"v{i}x{j}" for j in range(60)), "big") for i in range(400)]
    docs = spark.createDataFrame(corpus() + more, "doc_id long, text string, source string")
    assert {r["doc_id"] for r in quality.assess(docs, min_docs=10).where("NOT kept").collect()} == set(range(12))
