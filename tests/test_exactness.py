"""What depends neither on the order of rows, nor on caps, nor on ids being unique over processes."""

import random

from pyspark.sql import functions as F

from procgraph.functions import jsonx, similarity
from procgraph.operators import graph, layout, model, resolve
from procgraph.sources import files


def test_ids_that_occur_again_in_other_processes(spark):
    acts = spark.createDataFrame([("p", "a", 0), ("p", "b", 1), ("q", "b", 0), ("q", "c", 1)], "process_id string, id string, seq long")
    edges = spark.createDataFrame([("p", "a", "b"), ("q", "b", "c")], "process_id string, src string, dst string")
    pairs = graph.predecessors(acts, edges)
    assert {tuple(r) for r in pairs.collect()} == {("p", "b", "a"), ("q", "c", "b")}
    fields = spark.createDataFrame([("p", "a", "x"), ("p", "b", "y"), ("q", "b", "z")], "process_id string, activity string, ref string")
    got = {tuple(r) for r in model.input_refs(pairs, fields, fields.where("false")).select("process_id", "activity", F.array_join("refs", ",")).collect()}
    assert got == {("p", "b", "x"), ("q", "c", "z")}


def test_layers_whatever_the_order_of_edges(spark):
    nodes = spark.createDataFrame([("p", x, 0, i) for i, x in enumerate("abcde")], "process_id string, id string, lane int, seq long")
    edges = [("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "a", "d"), ("p", "d", "c"), ("p", "c", "e")]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(edges)
        rows = layout.layered(nodes, spark.createDataFrame(edges, "process_id string, src string, dst string")).collect()
        seen.add(tuple(sorted(map(tuple, rows))))
    assert len(seen) == 1


def test_paths_and_charts_of_any_depth(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(105)], "src string, dst string")
    got = graph.paths(chain).agg(F.max("hops"), F.count(F.lit(1))).first()
    assert tuple(got) == (105, 105 * 106 // 2)
    deep = [(f"n{i}", f"n{i - 1}" if i else None, i == 0) for i in range(60)] + [("x", "y", False), ("y", "x", True)]
    members = {tuple(r) for r in model.org_members(spark.createDataFrame(deep, "id string, parent_id string, is_team boolean")).collect()}
    assert members == {("n0", f"n{i}") for i in range(1, 60)}


def test_images():
    assert ".webp" in files.IMAGES and ".gif" not in files.IMAGES


def test_fences_in_any_case(spark):
    df = spark.createDataFrame([("```JSON\n{\"a\": 1}\n```",)], "t string")
    assert df.select(jsonx.json_part(F.col("t"))).first()[0] == '{"a": 1}'


def test_containment_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice("ab c") for _ in range(rng.randint(a, b)))
    texts, names = [word(0, 60) for _ in range(60)] + ["x" * 5000 + "needle in a long text" + "y" * 5000], [word(0, 8) for _ in range(40)] + [word(16, 20) for _ in range(10)] + ["needle in a long text", "xy", "yy"]
    texts.append(names[45] + "tail")
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    n = spark.createDataFrame([(k, x) for k, x in enumerate(names)], "k int, n string")
    want = {(i, k) for i, x in enumerate(texts) for k, y in enumerate(names) if y and y in x}
    for small in (10_000, 1):
        assert {tuple(r) for r in resolve.containing(t, n, "t", "n", small).select("i", "k").collect()} == want
    assert resolve.containing(t, n.where("false"), "t", "n").count() == 0


def test_jaccard_against_all_pairs(spark):
    rng = random.Random(6)
    names = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(150)})
    df = spark.createDataFrame([(x,) for x in names], "name string")
    want = {(a, b) for a in names for b in names if a < b and len(set(a) & set(b)) / len(set(a) | set(b)) > 0.6}
    assert {(r["a"], r["b"]) for r in resolve.jaccard_pairs(df).collect()} == want
    assert similarity is not None


def test_most_similar_in_blocks(spark):
    rng = random.Random(7)
    rows = [(i, "k", [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, kind string, v array<double>")
    new, old = df.where("id % 2 = 1"), df.where("id % 2 = 0")
    one = {r["id"]: (r["match_id"], round(r["similarity"], 9)) for r in resolve.similar_entity(new, old).collect()}
    assert one == {r["id"]: (r["match_id"], round(r["similarity"], 9)) for r in resolve.similar_entity(new, old, block=7).collect()} and len(one) == 60
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for i, _, v in rows[1::2]:
        assert one[i][0] == max(rows[::2], key=lambda r: cos(v, r[2]))[0]


def test_no_nested_loops(spark, sf_dir):
    from procgraph.plans.catalog import QUERIES

    for name in ("char_jaccard_pairs", "core_word_pairs", "infer_role_contains_first", "endpoint_resolution_priority", "pick_user_tiered", "similar_entity_action"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
