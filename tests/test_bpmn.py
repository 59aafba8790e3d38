"""Process diagrams: what is written is read back, whatever is in the names; texts of all kinds are read without failing."""

from xml.etree import ElementTree as ET

from procgraph.operators import bpmn

ODD = 'a<b> & "c"\n\td\' ü 한글 ]]> &amp;'


def model(spark, width=8):
    df = spark.createDataFrame
    return bpmn.Model(
        df([("p", ODD), ("empty", None)], "proc_id string, name string"),
        df([("p", "r1", "Clerk", 0), ("p", "r2", ODD, 1)], "proc_id string, role_id string, name string, seq int"),
        df([("p", "aaaaaaaa-1", ODD, ODD, "r2", 2, 0), ("p", "bbbbbbbb-1", "second", None, "r1", 1, 1), ("p", "cccccccc-1", None, "x\x00y", None, 3, 2), ("p", "dddddddd-1", "other", "", "gone", 4, 3)], "proc_id string, task_id string, name string, description string, role_id string, order int, seq int"),
        df([("p", "eeeeeeee-1", "inclusive", "", ODD, 0), ("p", "ffffffff-1", "odd", "why", "c", 1)], "proc_id string, gateway_id string, kind string, description string, condition string, seq int"),
        df([("p", "aaaaaaaa-1", "Task", "eeeeeeee-1", "Gateway", None, 0), ("p", "eeeeeeee-1", "Gateway", "cccccccc-1", "Task", ODD, 1), ("p", "aaaaaaaa-1", "Task", "nowhere", "Task", "", 2), ("p", "bbbbbbbb-1", "Task", "aaaaaaaa-1", "Task", "first", 3), ("p", "bbbbbbbb-1", "Task", "aaaaaaaa-1", "Task", "again", 4)], "proc_id string, src string, src_type string, dst string, dst_type string, condition string, seq int"),
        df([("p", "v", "", "number", 0)], "proc_id string, name string, description string, type string, seq int"),
        width,
    )


def test_flows(spark):
    got = [(r["src"], r["dst"], r["condition"]) for r in bpmn.assembled(model(spark)).orderBy("k", "n").collect()]
    a, b, c, d, g = "Activity_aaaaaaaa", "Activity_bbbbbbbb", "Activity_cccccccc", "Activity_dddddddd", "Gateway_eeeeeeee"
    assert got == [("Event_Start", b, ""), (a, g, ""), (g, c, ODD), (b, a, "first"), (a, c, ""), (c, d, ""), (d, "Event_End", "")]


def test_round_trip(spark):
    xml = {r["proc_id"]: r["xml"] for r in bpmn.documents(model(spark)).collect()}
    for x in xml.values():
        ET.fromstring(x)
    rows = bpmn.read(spark.createDataFrame(list(xml.items()), "doc string, xml string")).cache()
    assert not rows.where("fallback").count()
    acts = {r["id"]: r for r in bpmn.activities(rows).collect()}
    first, third = acts["Activity_aaaaaaaa"], acts["Activity_cccccccc"]
    assert (first["name"], first["role"], first["instruction"], first["tool"], first["duration"]) == (ODD, ODD, ODD, "formHandler:defaultform", 5)
    assert (first["x"], first["y"], first["w"], first["h"]) == (290, 140, 100, 80)
    assert (third["name"], third["role"], third["description"], third["y"]) == ("", "미분류", "x\x00y", 260)  # JSON has a form for what XML forbids
    assert acts["Activity_dddddddd"]["y"] == 20  # a role that the process doesn't have
    gates = {r["id"]: (r["type"], r["name"]) for r in bpmn.nodes(rows).where("kind = 'gateway'").collect()}
    assert gates == {"Gateway_eeeeeeee": ("inclusiveGateway", ODD), "Gateway_ffffffff": ("exclusiveGateway", "why")}
    assert {(r["name"], r["type"], r["description"]) for r in bpmn.variables(rows).collect()} == {("v", "number", "v description")}
    assert {(r["name"], r["process"]) for r in bpmn.pools(rows).collect()} == {(ODD, "Process_p"), ("", "Process_empty")}
    assert [r["name"] for r in bpmn.roles(rows).orderBy("name").collect()] == sorted(["Clerk", ODD, "미분류"])
    flows = {(r["source"], r["target"]): (r["condition"], r["points"]) for r in bpmn.sequences(rows).collect()}
    assert flows["Gateway_eeeeeeee", "Activity_cccccccc"] == (ODD, "790,60 440,300") and len(flows) == 7
    empty = bpmn.nodes(rows).where("doc = 'empty'")
    assert sorted(r["id"] for r in empty.collect()) == ["Event_End", "Event_Start"]
    shapes = {s.get("bpmnElement") for s in ET.fromstring(xml["p"]).iter() if s.tag.endswith("BPMNShape")}
    assert {"Participant_p", "Lane_r1", "Lane_r2", "Event_Start", *acts, *gates} <= shapes


def test_other_writers(spark):
    uuid = "01234567-89ab-cdef-0123-456789abcdef"
    xml = f"""<definitions xmlns="{bpmn.BPMN}" xmlns:u="urn:other"><collaboration><participant id="x" name="X" processRef="P"/><participant id="y" processRef="gone"/><participant id="z"/></collaboration>
    <process id="P"><laneSet><lane id="l" name="Boss"><extensionElements><u:properties><u:json>{{"roleResolutionContext": {{"_type": "a.b.DirectRoleResolutionContext", "endpoint": ["{uuid}"]}}}}</u:json></u:properties></extensionElements><flowNodeRef> t1 </flowNodeRef></lane><lane name=" boss "/><lane name=""/></laneSet>
    <manualTask id="t1" name="do"/><serviceTask id="t2"><extensionElements><u:properties><u:json>{{"tool": "mcp", "duration": 0, "role": "R", "inputData": ["a"]}}</u:json></u:properties></extensionElements></serviceTask><task id="t3"><extensionElements><u:properties><u:json>broken</u:json></u:properties></extensionElements></task>
    <sequenceFlow id="f" sourceRef="t1" targetRef="t2"><conditionExpression> x &gt; 1 </conditionExpression></sequenceFlow><subProcess><userTask id="inner"/></subProcess></process></definitions>"""
    rows = bpmn.read(spark.createDataFrame([("d", xml)], "doc string, xml string")).cache()
    acts = {r["id"]: (r["type"], r["role"], r["tool"], r["duration"], r["input_data"]) for r in bpmn.activities(rows).collect()}
    assert acts == {"t1": ("manualTask", "Boss", bpmn.TOOL, 5, []), "t2": ("serviceTask", "R", "mcp", 5, ["a"]), "t3": ("task", "", bpmn.TOOL, 5, [])}
    assert [tuple(r) for r in bpmn.roles(rows).collect()] == [("d", "Boss", uuid, uuid)]
    assert {(r["id"], r["process"]) for r in bpmn.pools(rows).collect()} == {("x", "P"), ("z", "")}
    assert bpmn.sequences(rows).first()["condition"] == "x > 1"


def test_what_cannot_be_parsed(spark):
    whole = bpmn.documents(model(spark)).where("proc_id = 'p'").first()["xml"]
    texts = [None, "", "plain", "<a/>", whole[:-10], whole[: len(whole) // 2], "<process id='P'><userTask id=\"t\" name='n &lt; 1'><scriptTask id='s'/>", "<userTask " * 5000, "<" * 100_000, '<userTask id="' + "x" * 100_000]
    rows = bpmn.read(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, xml string")).cache()
    found = {r["doc"]: r["n"] for r in rows.groupBy("doc").count().withColumnRenamed("count", "n").collect()}
    assert set(found) == {"4", "5", "6"} and rows.where("NOT fallback").count() == 0
    got = bpmn.nodes(rows.where("doc = '4'"))
    assert got.where("kind = 'activity'").count() == 4 and ODD in {r["name"] for r in got.collect()}
    assert {(r["id"], r["name"], r["type"], r["process"]) for r in bpmn.nodes(rows.where("doc = '6'")).collect()} == {("t", "n < 1", "userTask", "P"), ("s", "", "scriptTask", "P")}
