"""Nested maps and charts against loops over dictionaries; agents against one list that grows."""

import copy
import json
import random
import time

from pyspark.sql import functions as F

from procgraph.operators import agents, trees
from procgraph.operators.graph import checkpointed


def put_in_map(value, new):
    """One process put into a map, as a loop over dictionaries does it."""
    value = value if isinstance(value, dict) else {}
    megas = value["mega_proc_list"] if isinstance(value.get("mega_proc_list"), list) else []
    value["mega_proc_list"] = megas

    def group(items, key, below):
        for x in items:
            if isinstance(x, dict) and (x.get("id") == key or x.get("name") == "미분류"):
                break
        else:
            x = {"id": key, "name": "미분류", below: []}
            items.append(x)
        x[below] = x[below] if isinstance(x.get(below), list) else []
        return x[below]

    subs = group(group(megas, "unclassified", "major_proc_list"), "unclassified_major", "sub_proc_list")
    if not any(isinstance(s, dict) and s.get("id") == new[0] for s in subs):
        subs.append({"id": new[0], "name": new[1], "path": new[0], "new": True})
    return value


MAPS = {
    "a": {"mega_proc_list": [{"id": "m", "name": "Sales", "extra": [1, {"z": None}]}, {"id": "x", "name": "미분류", "major_proc_list": [{"id": "unclassified_major", "name": "else", "sub_proc_list": [{"id": "p1", "name": "old", "n": 2.5}]}, {"name": "미분류"}]}], "kept": True},
    "b": {"mega_proc_list": None, "other": "text"},
    "c": {},
    "d": {"mega_proc_list": ["odd", None, {"id": "unclassified", "major_proc_list": 7}]},
    "untouched": {"z": 1, "a": 2},
    "list": [1, 2],
}
FRESH = [("a", "p1", "one", 1), ("a", "p2", "two", 2), ("a", "p2", "again", 3), ("b", "p1", "one", 1), ("c", "p9", None, 1), ("d", "p3", "ü\"", 1), ("none", "p4", "four", 1), ("list", "p5", "five", 1), ("bad", "p6", "six", 1), (None, "p7", "x", 1), ("a", None, "x", 1)]


def test_process_maps(spark):
    rows = [(t, json.dumps(v)) for t, v in MAPS.items()] + [("bad", "{not json"), ("null", None)]
    fresh = spark.createDataFrame(FRESH, "tenant string, id string, name string, seq int")
    once = checkpointed(trees.process_maps(spark.createDataFrame(rows, "tenant string, value string"), fresh))
    got = {r["tenant"]: r["value"] for r in once.collect()}
    assert got.pop("null") is None and got["untouched"] == json.dumps(MAPS["untouched"])
    want = copy.deepcopy(MAPS)
    for t, i, name, _ in FRESH:
        if t is not None and i is not None:
            want[t] = put_in_map(want.get(t), (i, name or ""))
    assert {t: json.loads(v) for t, v in got.items()} == want
    twice = trees.process_maps(once, fresh).collect()
    assert {r["tenant"]: json.loads(r["value"]) for r in twice if r["value"]} == want


def test_many_processes_in_a_full_group(spark):
    """Linear in both: before, each new process went through the whole group, and this took minutes."""
    n = 30_000
    old = json.dumps({"mega_proc_list": [{"name": "미분류", "major_proc_list": [{"name": "미분류", "sub_proc_list": [{"id": f"p{i}", "name": "old"} for i in range(0, n, 3)]}]}]})
    fresh = spark.range(n).select(F.lit("a").alias("tenant"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.lit("x").alias("name"), (-F.col("id")).alias("seq"))
    maps, began = spark.createDataFrame([("a", old)], "tenant string, value string"), time.time()
    subs = json.loads(trees.process_maps(maps, fresh).collect()[0]["value"])["mega_proc_list"][0]["major_proc_list"][0]["sub_proc_list"]
    took = time.time() - began
    assert [s["id"] for s in subs] == [f"p{i}" for i in range(0, n, 3)] + [f"p{i}" for i in range(n - 1, -1, -1) if i % 3]
    assert trees.process_map_rows(maps, fresh).groupBy("new").count().orderBy("new").collect() == [(False, n // 3), (True, n - n // 3)]
    assert took < 60


def test_rows_of_maps(spark):
    """Rows made without the text are those of the text; groups keep names of their own; the sizes of pieces don't matter."""
    maps = spark.createDataFrame([(t, json.dumps(v)) for t, v in MAPS.items()] + [("bad", "{not json"), ("null", None), (None, json.dumps(MAPS["a"]))], "tenant string, value string")
    fresh = spark.createDataFrame(FRESH + [("a", f"q{i}", f"n{i}", i) for i in range(9)] + [("a", "p1", "all there", 1)], "tenant string, id string, name string, seq int")
    texts = checkpointed(trees.process_maps(maps, fresh, 2))
    assert texts.exceptAll(trees.process_maps(maps, fresh)).count() == 0
    rows = sorted(map(tuple, trees.process_map_rows(maps, fresh).collect()), key=repr)
    assert rows == sorted(map(tuple, trees.map_rows(texts).collect()), key=repr)
    assert ("a", "미분류", "else", "q8", "n8", True) in rows and ("d", None, "미분류", "p3", 'ü"', True) in rows and (None, "미분류", "else", "p1", "old", False) in rows


def chart(rng, depth, ids):
    node = {"id": rng.choice(ids), "data": {"name": rng.choice(["A", "B"]), "isTeam": rng.random() < 0.5}, "x": rng.choice([None, 1, [2, {"y": "z"}]])}
    if depth and rng.random() < 0.9:
        node["children"] = [chart(rng, depth - 1, ids) if rng.random() < 0.9 else rng.choice([None, "odd", 3, []]) for _ in range(rng.choice([0, 1, 2, 3]))]
    elif rng.random() < 0.3:
        node["children"] = rng.choice([None, "odd", {}])
    return node


def nodes(node):
    if isinstance(node, dict):
        yield node
        for c in node["children"] if isinstance(node.get("children"), list) else []:
            yield from nodes(c)


def test_add_members(spark):
    """Random charts, with ids that occur again, and a second time nothing is added."""
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(12)]
    charts = {f"t{i}": chart(rng, rng.choice([0, 1, 3, 4]), ids) for i in range(12)} | {"list": [1], "other": {"a": 1}}
    asked = [(rng.choice([*charts, None, "unknown"]), rng.choice([*ids, None, ""]), rng.choice([*ids, "m1", "m2", "m3", None]), k) for k in range(120)]
    want = copy.deepcopy(charts)
    for t, team, i, k in asked:
        if t in charts and team and i:
            # a team is looked up in the given chart, whose nodes stand at the same places in the other
            for old, new in zip(nodes(charts[t]), [n for n in nodes(want[t]) if "k" not in n]):
                if old["id" if "id" in old else "a"] == team:
                    kids = new["children"] if isinstance(new.get("children"), list) else []
                    new["children"] = kids
                    if not any(isinstance(c, dict) and c.get("id") == i for c in kids):
                        kids.append({"id": i, "k": k})
                    break
    given = spark.createDataFrame([(t, json.dumps(c)) for t, c in charts.items()] + [("bad", "{"), ("null", None)], "tenant string, chart string")
    members = spark.createDataFrame([(*r, json.dumps({"id": r[2], "k": r[3]})) for r in asked], "tenant string, team_id string, id string, seq int, node string")
    once = trees.add_members(given, members)
    got = {r["tenant"]: r["chart"] for r in once.collect()}
    assert got.pop("bad") == "{" and got.pop("null") is None
    assert {t: json.loads(c) for t, c in got.items()} == want and want != charts
    assert got["other"] == json.dumps(charts["other"])
    people = members.where("id LIKE 'm%'")  # who isn't a team in the second chart, either
    first = checkpointed(trees.add_members(given, people))
    assert sorted(map(tuple, trees.add_members(first, people).collect()), key=repr) == sorted(map(tuple, first.collect()), key=repr)
    assert trees.add_members(given.where("false"), members).count() == 0


def test_chart_nodes_and_member_node(spark):
    users = spark.createDataFrame([("u1", "Kim", None, "agent", "sell")], "id string, username string, role string, agent_type string, goal string")
    for c in set(trees.PROFILE) - {"goal"}:
        users = users.withColumn(c, F.lit(None).cast("string"))
    node = json.loads(users.select(trees.member_node().alias("n")).first()["n"])
    assert node["id"] == "u1" and node["name"] == "Kim" and node["data"]["goal"] == "sell" and node["data"]["role"] == "" and node["data"]["tools"] is None and node["data"]["isAgent"] is True and node["data"]["type"] == "agent"
    charts = spark.createDataFrame([("t", json.dumps({"id": "r", "data": {"isTeam": True, "name": "All"}, "children": [{"id": 5}, 3, node]}))], "tenant string, chart string")
    assert sorted(map(tuple, trees.chart_nodes(charts).collect()), key=repr) == [("t", "r", 0, "5", None, False), ("t", "r", 2, "u1", "Kim", False), ("t", None, 0, "r", "All", True)]
    assert trees.chart_nodes(charts.where("false")).count() == 0


def grown(there, asked):
    """Proposals one after the other against a list that grows."""
    key = lambda x: "".join((x or "").lower().split())
    listed = [(u, key(n), key(r)) for u, n, r, _ in sorted(there, key=lambda x: (x[3], x[0]))]
    same = lambda a, b: bool(a and b) and (a == b or ((a in b or b in a) and max(len(a), len(b)) >= 4))
    out = []
    for i, name, role, _ in sorted(asked, key=lambda x: (x[3], x[0])):
        n, r = key((name or "").strip() or "자동생성 에이전트"), key(role)
        hit = next((u for u, a, b in listed if same(n, a) or same(r, b)), None)
        out.append((i, hit or i, hit is None))
        if hit is None:
            listed.append((i, n, r))
    return sorted(out)


def test_insert_agents(spark):
    rng = random.Random(11)
    for letters, n in [("ab", 60), ("abcdefg", 150)]:
        word = lambda: rng.choice([None, "", " ", *["".join(rng.choices(letters, k=rng.choice([1, 3, 4, 5, 7]))).title() for _ in range(20)]])  # noqa: B023, E731
        there = [(f"u{k}", word(), word(), rng.randrange(5)) for k in range(4)]
        asked = [(f"p{k:03}", word(), word(), rng.randrange(n)) for k in range(n)]
        schema = "string, username string, role string, seq int"
        got = agents.insert_agents(spark.createDataFrame(there, f"user_id {schema}"), spark.createDataFrame(asked, f"id {schema}"))
        assert sorted(map(tuple, got.collect())) == grown(there, asked)
    none = spark.createDataFrame([], f"user_id {schema}")
    few = [("p1", "one", "x", 1), ("p2", "one two", "y", 2)]
    got = agents.insert_agents(none, spark.createDataFrame(few, f"id {schema}"))
    assert sorted(map(tuple, got.collect())) == [("p1", "p1", True), ("p2", "p1", False)]
    assert agents.insert_agents(none, spark.createDataFrame([], f"id {schema}")).count() == 0
