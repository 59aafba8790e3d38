"""Operators against plain Python on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from procgraph.functions import jsonx, similarity, text
from procgraph.operators import graph, layout, merge, model, render, resolve, sections
from procgraph.sources import files
from procgraph.streaming import jobs


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], " , ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "line, level",
    [("# A", 1), ("## A", 2), ("### A", None), ("1. 가나", 1), ("1. Ab", 1), ("1. ab", None), ("1.1 x", 2), ("1.1.1 x", 3), ("제 1 장 총칙", 1), ("제2절 목적", 2), ("제2조 목적", None), ("IV. Scope", 1), ("B. Part", 2), ("plain", None), ("  # A ", 1), ("", None)],
)
def test_heading_level(spark, line, level):
    assert one(spark, text.heading_level("a"), a=line) == level


def test_text_functions(spark):
    assert one(spark, text.snake_id("a"), a=" Ab  C-d_ ") == "ab_c_d"
    assert one(spark, text.snake_id("a"), a="한글") == ""
    assert one(spark, text.name_key("a"), a="　Ab \n") == "ab"
    assert one(spark, text.text_key("a"), a=" A b\tC ") == "abc"
    assert one(spark, text.clean_text("a"), a=" a \n\n b ") == "a b"
    assert one(spark, text.left_dots("a", 3), a="abcd") == "abc…"
    assert one(spark, text.or_else("a", "d"), a="") == "d"
    assert one(spark, text.xml_escape("a"), a="<a & 'b'>") == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, text.form_id("a", "b", "c"), a="formHandler:x/y", b="P", c="A") == "x#y"
    assert one(spark, text.form_id("a", "b", "c"), a="", b="P", c="A") == "P_A_form"
    assert one(spark, text.form_id("a", "b", "c"), a="formHandler:defaultform", b="P", c="A") == "P_a_form"
    assert one(spark, text.procedure_steps("a"), a="1. one 2) two") == ["one", "two"]
    assert one(spark, text.procedure_steps("a"), a="- one • two") == ["one", "two"]
    assert one(spark, text.procedure_steps("a"), a="A sentence. No. Another one") == ["A sentence", "Another one"]
    assert one(spark, text.procedure_steps("a"), a="") == ["작업을 수행합니다."] and one(spark, text.procedure_steps("a"), a="short") == ["short"]
    assert one(spark, text.keyword_class("a"), a="신청서 자동 작성") == "agent" and one(spark, text.keyword_class("a"), a="신청서 작성") == "human"
    assert one(spark, text.is_uuid("a"), a="123E4567-e89b-12d3-a456-426614174000")


def test_similarity(spark):
    assert one(spark, similarity.char_jaccard(F.col("a"), F.col("b")), a="abc", b="abd") == pytest.approx(2 / 4)
    assert one(spark, similarity.core_words_agree(F.col("a"), F.col("b")), a="구매 및 승인", b="승인") and not one(spark, similarity.core_words_agree(F.col("a"), F.col("b")), a="구매 승인", b="승인")
    assert one(spark, similarity.action(F.col("a").cast("double")), a="0.85") == "review"
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(similarity.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]


@pytest.mark.parametrize(
    "broken, whole",
    [('{"a": 1', {"a": 1}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "x', None), ('note {"a": 1} tail', {"a": 1}), ('note {"a": [1, {"b": 2', {"a": [1, {"b": 2}]}), ('{"a": "x  \t y", ', None), ('{"a": 1} tail', {"a": 1}), ('{"a": "x\ny"}', {"a": "x y"}), ("{}", {}), ("nothing", None)],
)
def test_json_repair(broken, whole):
    got = jsonx.repaired(broken)
    assert (json.loads(got) if got else None) == whole
    assert jsonx.repaired(None) is None


def test_json_and_names(spark):
    assert one(spark, jsonx.json_part(F.col("a")), a='x ```json\n{"a":1}\n``` y') == '{"a":1}'
    assert one(spark, jsonx.disposition_name(F.col("a")), a="attachment; filename*=UTF-8''a%20b.pdf") == "a b.pdf"
    assert one(spark, jsonx.disposition_name(F.col("a")), a='attachment; filename="c d.pdf"') == "c d.pdf"
    assert one(spark, files.download_name(F.col("a"), F.col("b"), F.col("c")), a="", b="http://h/x/y", c="application/pdf; q=1") == "y.pdf"
    df = spark.createDataFrame([(1, "[InputData] pdf_file_url: http://h/a%20b.pdf"), (2, '{"pdf_url":"http://h/c.pdf","pdf_name":"n"}'), (3, "see http://h/d.pdf now"), (4, None), (5, '[InputData] {"fullPath": "http://h/e", "originalFileName": "e.pdf"}')], "id int, q string")
    got = {r["id"]: (r["url"], r["name"]) for r in files.requests(df, "q").collect()}
    assert got == {1: ("http://h/a%20b.pdf", "a b.pdf"), 2: ("http://h/c.pdf", "n"), 3: ("http://h/d.pdf", "d.pdf"), 4: (None, None), 5: ("http://h/e", "e.pdf")}


def fold(paras, size, overlap):
    cur, out = "", []
    for p in paras:
        if len(cur) + len(p) <= size:
            cur = cur + "\n\n" + p if cur else p
        else:
            if cur:
                out.append(cur)
            cur = (cur[-overlap:] if len(cur) > overlap else cur) + " " + p
    return out + [cur] if cur else out


def test_fixed_chunks(spark):
    paras = [("x" * n) + str(i) for i, n in enumerate((30, 60, 500, 10, 90, 5))]
    pages = spark.createDataFrame([(1, 1, "\n\n".join(paras)), (2, 1, ""), (3, 1, "y" * 300)], "doc_id int, page int, text string")
    got = sections.fixed_chunks(pages, 100, 20).orderBy("doc_id", "chunk_no").collect()
    assert [r["text"] for r in got if r["doc_id"] == 1] == fold(paras, 100, 20)
    assert [r["text"] for r in got if r["doc_id"] == 3] == [" " + "y" * 300] and not [r for r in got if r["doc_id"] == 2]
    assert {r["span"] for r in got if r["doc_id"] == 3} == {"0:301"}


def test_sections(spark):
    pages = spark.createDataFrame([(1, 1, "before\n# A\na"), (1, 2, "b\n## B\nc"), (1, 3, "d"), (2, 1, "only text")], "doc_id int, page int, text string")
    got = [tuple(r) for r in sections.sections(pages).orderBy("doc_id", "section_no").collect()]
    assert got == [(1, 1, "# A", 1, 1, 1, "# A\na\nb\n"), (1, 2, "## B", 2, 2, 3, "## B\nc\nd\n"), (2, 0, "Document Content", 1, 1, 1, "only text")]


def test_semantic_chunks(spark):
    text_ = "# A\n\n" + "a" * 60 + "\n\n# B\n\n" + "b" * 30
    pages = spark.createDataFrame([(1, 1, text_)], "doc_id int, page int, text string")
    got = [r["text"] for r in sections.semantic_chunks(pages, 100, 10).orderBy("chunk_no").collect()]
    assert got == ["# A\n\n" + "a" * 60, "a" * 10 + "\n\n# B\n\n" + "b" * 30]


def test_closure_and_predecessors(spark):
    edges = spark.createDataFrame([("p", "a", "g"), ("p", "g", "b"), ("p", "b", "a")], "process_id string, src string, dst string")
    assert {tuple(r) for r in graph.closure(edges).collect()} == {(x, y) for x in "agb" for y in "agb"}
    acts = spark.createDataFrame([("p", "a", 0), ("p", "b", 1), ("q", "c", 0), ("q", "d", 1)], "process_id string, id string, seq long")
    got = {tuple(r) for r in graph.predecessors(acts, edges).collect()}
    assert got == {("p", "a", "b"), ("p", "b", "a"), ("q", "d", "c")}
    assert graph.paths(edges.select("src", "dst")).count() == 9  # no edge twice


def test_graph_upserts(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, v string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "id string, v string")
    assert sorted(map(tuple, graph.upsert(old, new, ["id"]).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    assert sorted(map(tuple, graph.update_columns(old, new, ["id"], ["v"]).collect())) == [("a", "1"), ("b", "3")]
    assert graph.assert_unique(old.unionByName(old), ["id"]).count() == 2
    edges = spark.createDataFrame([("R", "a", "c", ""), ("R", "a", "z", ""), ("R", "a", "c", "x")], graph.EDGE)
    assert [tuple(r) for r in graph.linked(edges, old, new).collect()] == [("R", "a", "c", "")]
    assert graph.rejected(edges, old, new).count() == 1
    g = graph.PropertyGraph({}, edges).upsert_nodes("T", old, "id").upsert_nodes("T", new, "id")
    assert g.nodes["T"].count() == 3 and g.upsert_edges(edges.limit(0)).rel("R").count() == 3


def test_merge_tasks(spark):
    rows = [("1", "p", "r", "Review order", "x", 0, 0), ("2", "p", "r", "Review order now", "y", 1, 1), ("3", "p", "r", "Ship", "z", 5, 2), ("5", "p", "r", "Hips", "v", 9, 3), ("4", "q", "r", "Review order", "w", 3, 3)]
    got = {r["old_id"]: (r["task_id"], r["description"]) for r in merge.merge_tasks(spark.createDataFrame(rows, "task_id string, process_id string, role_id string, name string, description string, order int, seq long")).collect()}
    assert got == {"1": ("2", "x | y"), "2": ("2", "x | y"), "3": ("3", "z"), "5": ("5", "v"), "4": ("4", "w")}


def test_contains_join_beyond_broadcast(spark):
    texts = spark.createDataFrame([(1, "the buyer asks"), (2, "nothing"), (3, "ab")], "i int, t string")
    names = spark.createDataFrame([("buyer",), ("hi",), ("a",), ("",), ("longer than all",)], "n string")
    want = {(1, "buyer"), (1, "a"), (2, "hi"), (3, "a")}
    for small in (100, 1):
        assert {tuple(r) for r in resolve.containing(texts, names, "t", "n", small).select("i", "n").collect()} == want


def test_element_types(spark):
    rows = [("Activity", "ServiceTask"), ("Event", "start"), ("Event", "Odd"), ("Event", "odd"), ("Event", ""), ("Gateway", "PARALLEL_GATEWAY"), ("Gateway", None), ("Gateway", "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "k string, t string").coalesce(1).select(model.element_type("k", "t")).collect()]
    assert got == ["UserActivity", "StartEvent", "Odd", "IntermediateCatchEvent", "IntermediateCatchEvent", "ParallelGateway", "ExclusiveGateway", "x"]


def test_merge_lines(spark):
    assert one(spark, merge.merge_lines(F.col("a"), F.col("b")), a="x\n y \nx", b="y\nz\nz") == "x\ny\nx\nz"
    assert one(spark, merge.merge_lines(F.col("a"), F.col("b")), a=" x ", b=" \n") == " x "


def test_pick_user(spark):
    roles = spark.createDataFrame([("Buyer",), ("Chief",), ("none",)], "role string")
    users = spark.createDataFrame([("1", "x", "buyers", "", False, 0), ("2", "y", "the buyer", "", True, 1), ("3", "chief", "", "", False, 2), ("4", "chief two", "", "", True, 3)], "user_id string, username string, role string, alias string, is_agent boolean, seq int")
    assert {tuple(r) for r in resolve.pick_user(roles, users).collect()} == {("Buyer", "2", 1), ("Chief", "4", 1)}
    assert {(r["role"], r["user_id"], r["score"]) for r in resolve.candidates(roles, users).collect()} == {("Buyer", "2", 0.8), ("Chief", "4", 0.8), ("none", "2", 0.0), ("none", "4", 0.0)}


def test_repair_and_collapse(spark):
    nodes = spark.createDataFrame([("p", i, k) for k, i in enumerate("abgc")], "process_id string, id string, seq long")
    flows = spark.createDataFrame([("p", "a", "b"), ("p", "b", "g"), ("p", "g", "c")], "process_id string, src string, dst string")
    assert model.repair(nodes, flows).where("made").count() == 0
    got = {tuple(r)[1:] for r in model.collapse_gateways(spark.createDataFrame([("p", "g")], "process_id string, id string"), flows).collect()}
    assert got == {("a", "b"), ("b", "c")}


def test_layers_and_routes():
    assert layout.layers(list("abcd"), [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")]) == {"a": 0, "b": 1, "c": 2, "d": 0}
    assert layout.simplify([(0, 0), (1, 0), (2, 0), (2, 5)]) == [(0, 0), (2, 0), (2, 5)]
    way = layout.route((0, 0), (200, 0), [(80, -40, 40, 80)])
    assert way[0] == (0, 0) and way[-1] == (200, 0)
    assert all(a[0] == b[0] or a[1] == b[1] for a, b in zip(way, way[1:]))
    assert not any(80 < x < 120 and -40 < y < 40 for x, y in way)


def test_bpmn_round_trip_escapes(spark):
    p = spark.createDataFrame([("p", "a <b>")], "proc_id string, name string")
    n = spark.createDataFrame([("p", "t1", "userTask", 'say "hi" & go', "r&d", 0), ("p", "g1", "exclusiveGateway", "", None, 1)], "proc_id string, id string, kind string, name string, role string, seq long")
    f = spark.createDataFrame([("p", "t1", "g1", "x > 1")], "proc_id string, src string, dst string, condition string")
    got = {r["id"]: (r["tag"], r["name"], r["role"]) for r in render.read_bpmn(render.bpmn_xml(p, n, f)).collect()}
    assert got == {"t1": ("userTask", 'say "hi" & go', "r&d"), "g1": ("exclusiveGateway", "", ""), "Flow_t1_g1": ("sequenceFlow", "x > 1", "")}
    bad = spark.createDataFrame([("x", "<no"), ("y", None)], "proc_id string, xml string")
    assert render.read_bpmn(bad).count() == 0


def test_form_fields(spark):
    html = """<text-field name="a" alias="A" disabled="true"></text-field><select-field v-model="f['b']" type="list"></select-field><div name="c">"""
    got = [tuple(r)[2:] for r in render.form_fields(spark.createDataFrame([(1, html)], "form_id int, html string")).orderBy("n").collect()]
    assert got == [("text-field", "a", "A", "text", "true", "false"), ("select-field", "b", "", "list", "false", "false")]


def test_providers(spark):
    df = files.provided(spark.createDataFrame([("s1",)], "section_id string"), files.no_extraction, "section_id string, payload string, status string, error string")
    assert files.parse_extraction(df).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [("j", 0, "run", 1), ("j", 1, "run", 1), ("j", 2, "run", 2), ("k", 0, "run", 1), ("j", 3, "completed", 100), ("k", 1, "run", 1)]
    events = spark.createDataFrame(rows, jobs.EVENT)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo in (0, 2, 3, 5):
        hi = {0: 2, 2: 3, 3: 5, 5: 6}[lo]
        spark.createDataFrame(rows[lo:hi], jobs.EVENT).coalesce(1).write.mode("append").parquet(src)
    q = jobs.write_stream(jobs.change_stream(jobs.read_events(spark, src, per_trigger=10)), out, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, jobs.changes(events).select("job_id", "seq", "status", "progress").collect()))


def test_claim(spark):
    store = spark.createDataFrame([("a", "x", "done", "")], jobs.JOB)
    batch = spark.createDataFrame([("a", "x", "pending", ""), ("b", "x", "pending", ""), ("b", "x", "pending", ""), ("c", "y", "pending", "")], jobs.JOB)
    once = jobs.claim(store, batch, "x")
    assert sorted((r["job_id"], r["status"]) for r in jobs.claim(once, batch, "x").collect()) == [("a", "done"), ("b", "running")]
