"""Whole process diagrams: flows put together, XML with pool, lanes, properties and diagram, and reading such XML back.

Writing is a plan: each node, lane and flow becomes the text of its element and of its shape or edge on a row of its own,
and the rows of a process are joined in order at the end. Reading parses each text once, in a small helper over batches, to
rows of one form, from which the typed frames are column expressions. XML that can't be parsed goes through a fallback by
patterns, which knows elements but neither lanes' members nor places.

Extension properties stand in a namespace that the caller names; on reading any namespace will do. Defined results: missing
names are empty; characters that XML forbids are left out; a process without tasks has no flows; ids are cut to ``width``
characters after their prefix, which must leave them unique in a process.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.functions.text import flow_id, is_uuid, name_key, or_else, xml_escape
from procgraph.operators.graph import first_by
from procgraph.operators.render import BPMN

#: Namespaces of the diagram (fixed values).
BPMNDI = "http://www.omg.org/spec/BPMN/20100524/DI"
DC = "http://www.omg.org/spec/DD/20100524/DC"
DI = "http://www.omg.org/spec/DD/20100524/DI"
#: Sizes and places in a diagram (fixed values).
LEFT, STEP, LANE, POOL = 140, 150, 120, 1200
START, END, UNASSIGNED, TOOL = "Event_Start", "Event_End", "미분류", "formHandler:defaultform"


@dataclass(frozen=True)
class Model:
    """Parts of processes, all with proc_id. Places in lists are by order (of tasks), then by seq."""

    processes: DataFrame  # name
    roles: DataFrame  # role_id, name, seq
    tasks: DataFrame  # task_id, name, description, role_id, order, seq
    gateways: DataFrame  # gateway_id, kind (exclusive, parallel, inclusive), description, condition, seq
    flows: DataFrame  # src, src_type, dst, dst_type (Task, Gateway, Event), condition, seq
    data: DataFrame | None = None  # name, description, type, seq
    width: int = 8

    def ref(self, kind: Column | str, i: str) -> Column:
        """The element that an entity becomes."""
        kind = F.lit(kind) if isinstance(kind, str) else kind
        prefix = F.when(kind == "Task", F.lit("Activity_")).when(kind == "Gateway", F.lit("Gateway_")).when(kind == "Event", F.lit("Event_"))
        return F.concat(prefix, F.left(F.col(i), F.lit(self.width)))


def assembled(m: Model) -> DataFrame:
    """proc_id, flow_id, src, dst, condition, k: start to the first task, flows of the graph, neighbours in order, last task to the end.

    Of flows with one id the first counts. The last task gets no end if the graph leads from it to an event.
    """
    w = W.partitionBy("proc_id").orderBy("order", "seq", "task_id")
    tasks = m.tasks.select("proc_id", "task_id", m.ref("Task", "task_id").alias("ref"), F.row_number().over(w).alias("n"), F.lead("task_id").over(w).alias("next"), F.lead(m.ref("Task", "task_id")).over(w).alias("next_ref"))
    row = lambda df, src, dst, cond, k, n: df.select("proc_id", src.alias("src"), dst.alias("dst"), cond.alias("condition"), F.lit(k).alias("k"), n.cast("long").alias("n"))
    none, place = F.lit(""), F.col("n")
    start = row(tasks.where("n = 1"), F.lit(START), F.col("ref"), none, 0, place)
    known = lambda side, frame, i, kind: frame.select("proc_id", F.col(i).alias(side), F.lit(kind).alias(f"{side}_type"), m.ref(kind, i).alias(f"{side}_ref"))
    ends = lambda side: known(side, m.tasks, "task_id", "Task").unionByName(known(side, m.gateways, "gateway_id", "Gateway"))
    graph = m.flows.join(ends("src"), ["proc_id", "src", "src_type"]).join(ends("dst"), ["proc_id", "dst", "dst_type"])
    graph = row(graph, F.col("src_ref"), F.col("dst_ref"), F.coalesce("condition", none), 1, F.col("seq"))
    line = row(tasks.where("next IS NOT NULL"), F.col("ref"), F.col("next_ref"), none, 2, place)
    ended = m.flows.where("dst_type = 'Event'").select("proc_id", F.col("src").alias("task_id")).distinct()
    end = row(tasks.where("next IS NULL").join(ended, ["proc_id", "task_id"], "left_anti"), F.col("ref"), F.lit(END), none, 3, place)
    every = start.unionByName(graph).unionByName(line).unionByName(end).withColumn("flow_id", flow_id("src", "dst"))
    return first_by(every, ["proc_id", "flow_id"], "k", "n", "condition")


def placed(m: Model) -> DataFrame:
    """proc_id, ref, tag, name, role, json, part, n, x, y, w, h of all nodes: start, tasks in order, gateways, end."""
    roles = m.roles.groupBy("proc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role_id", "name"))).alias("roles"))
    order = W.partitionBy("proc_id").orderBy("order", "seq", "task_id")
    none = F.array().cast(roles.schema["roles"].dataType)
    t = m.tasks.withColumn("i", F.row_number().over(order) - 1).join(roles, "proc_id", "left").withColumn("roles", F.coalesce("roles", none))
    at = F.array_position(F.transform("roles", lambda r: r["role_id"]), F.col("role_id")).cast("int")
    lane = F.when(or_else("role_id", "") == "", F.size("roles")).otherwise(F.greatest(at - 1, F.lit(0)))
    t = t.withColumn("role", F.when(at > 0, F.get(F.col("roles"), at - 1)["name"]).otherwise(F.lit("")))
    text = F.coalesce("description", F.lit(""))
    empty = F.array().cast("array<string>")
    task_json = F.to_json(F.struct(F.col("role"), F.lit(5).alias("duration"), text.alias("instruction"), text.alias("description"), empty.alias("checkpoints"), F.lit("none").alias("agentMode"), empty.alias("attachments"), empty.alias("inputData"), F.lit(TOOL).alias("tool"), empty.alias("customProperties")))
    node = lambda df, ref, tag, name, role, json, part, n, x, y, w, h: df.select("proc_id", ref.alias("ref"), tag.alias("tag"), name.alias("name"), role.alias("role"), json.alias("json"), F.lit(part).alias("part"), n.cast("int").alias("n"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    zero, blank = F.lit(0), F.lit("")
    tasks = node(t, m.ref("Task", "task_id"), F.lit("userTask"), F.coalesce("name", blank), F.col("role"), task_json, 1, F.col("i"), LEFT + F.col("i") * STEP, 20 + lane * LANE, 100, 80)
    count = lambda df, c: df.groupBy("proc_id").agg(F.count(F.lit(1)).alias(c))
    sizes = m.processes.select("proc_id").join(count(m.tasks, "nt"), "proc_id", "left").join(count(m.gateways, "ng"), "proc_id", "left").fillna(0, ["nt", "ng"])
    g = m.gateways.withColumn("i", F.row_number().over(W.partitionBy("proc_id").orderBy("seq", "gateway_id")) - 1).join(sizes, "proc_id")
    tag = F.when(F.col("kind").isin("parallel", "inclusive"), F.concat("kind", F.lit("Gateway"))).otherwise(F.lit("exclusiveGateway"))
    small = lambda d: F.to_json(F.struct(d.alias("description"), F.lit("").alias("role")))
    gates = node(g, m.ref("Gateway", "gateway_id"), tag, or_else("description", F.coalesce("condition", blank)), blank, small(text), 2, F.col("i"), LEFT + (F.col("nt") + F.col("i")) * STEP, F.lit(35), 50, 50)
    begin = node(sizes, F.lit(START), F.lit("startEvent"), F.lit("Start"), blank, small(F.lit("start event")), 0, zero, F.lit(40), F.lit(43), 34, 34)
    stop = node(sizes, F.lit(END), F.lit("endEvent"), F.lit("End"), blank, small(F.lit("end event")), 3, zero, LEFT + (F.col("nt") + F.col("ng")) * STEP + 80, F.lit(43), 34, 34)
    return begin.unionByName(tasks).unionByName(gates).unionByName(stop)


def routed(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """flows with x1, y1, x2, y2: from the middle of the right side to the middle of the left side."""
    a = nodes.select("proc_id", F.col("ref").alias("src"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.expr("h div 2")).cast("int").alias("y1"))
    b = nodes.select("proc_id", F.col("ref").alias("dst"), F.col("x").alias("x2"), (F.col("y") + F.expr("h div 2")).cast("int").alias("y2"))
    return flows.join(a, ["proc_id", "src"]).join(b, ["proc_id", "dst"])


def _text(x: Column) -> Column:
    """Text for an attribute or element: without what XML forbids, line ends and tabs kept."""
    y = xml_escape(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", ""))
    for a, b in (("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        y = F.replace(y, F.lit(a), F.lit(b))
    return y


def _tag(name: str | Column, attributes: dict[str, Column], body: Column | None = None) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    said = [part for k, v in attributes.items() for part in (F.lit(f' {k}="'), _text(v.cast("string")), F.lit('"'))]
    return F.concat(F.lit("<"), name, *said, *([F.lit("/>")] if body is None else [F.lit(">"), body, F.lit("</"), name, F.lit(">")]))


def _joined(rows: DataFrame, order: list[str], **texts: Column) -> DataFrame:
    """The texts of each process one behind the other."""
    cut = {k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, v.alias("_x")))), lambda r: r["_x"]), "").alias(k) for k, v in texts.items()}
    return rows.groupBy("proc_id").agg(*cut.values())


def documents(m: Model, extension: tuple[str, str] = ("ext", "urn:procgraph:properties"), resolution: str = "DirectRoleResolutionContext") -> DataFrame:
    """proc_id, xml of each process."""
    prefix, uri = extension
    properties = lambda json, more=None: _tag("bpmn:extensionElements", {}, _tag(f"{prefix}:properties", {}, F.concat(*([more] if more is not None else []), _tag(f"{prefix}:json", {}, _text(json)))))
    nodes, name = placed(m), lambda c: F.coalesce(c, F.lit(""))
    flows = routed(assembled(m), nodes)
    ids = lambda side, tag: flows.groupBy("proc_id", F.col(side).alias("ref")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n", "flow_id"))), lambda f: _tag(tag, {}, _text(f["flow_id"]))), "").alias(tag[5:]))
    linked = nodes.join(ids("dst", "bpmn:incoming"), ["proc_id", "ref"], "left").join(ids("src", "bpmn:outgoing"), ["proc_id", "ref"], "left")
    element = _tag(F.concat(F.lit("bpmn:"), F.col("tag")), {"id": F.col("ref"), "name": F.col("name")}, F.concat(properties(F.col("json")), name("incoming"), name("outgoing")))
    bounds = lambda x, y, w, h: _tag("dc:Bounds", {"x": x, "y": y, "width": w, "height": h})
    shape = _tag("bpmndi:BPMNShape", {"id": F.concat("ref", F.lit("_di")), "bpmnElement": F.col("ref")}, bounds(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    node_xml = _joined(linked, ["part", "n", "ref"], elements=element, shapes=shape)

    said = F.when(F.col("condition") != "", F.to_json(F.struct(F.lit("text").alias("conditionMode"))))
    head = {"id": F.col("flow_id"), "sourceRef": F.col("src"), "targetRef": F.col("dst")}
    sequence = F.when(said.isNotNull(), _tag("bpmn:sequenceFlow", head | {"name": F.col("condition")}, properties(said))).otherwise(_tag("bpmn:sequenceFlow", head))
    label = _tag("bpmndi:BPMNLabel", {}, bounds(F.expr("(x1 + x2) div 2 - 30"), F.expr("(y1 + y2) div 2 - 20"), F.lit(60), F.lit(14)))
    points = F.concat(_tag("di:waypoint", {"x": F.col("x1"), "y": F.col("y1")}), _tag("di:waypoint", {"x": F.col("x2"), "y": F.col("y2")}))
    edge = _tag("bpmndi:BPMNEdge", {"id": F.concat("flow_id", F.lit("_di")), "bpmnElement": F.col("flow_id")}, F.concat(points, F.when(said.isNotNull(), label).otherwise(F.lit(""))))
    flow_xml = _joined(flows, ["k", "n", "flow_id"], sequences=sequence, edges=edge)

    i = F.row_number().over(W.partitionBy("proc_id").orderBy("seq", "role_id")) - 1
    refs = m.tasks.groupBy("proc_id", F.coalesce("role_id", F.lit("")).alias("role_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "seq", "task_id", m.ref("Task", "task_id").alias("ref")))), lambda t: t["ref"]).alias("refs"))
    members = lambda rs: F.array_join(F.transform(rs, lambda r: _tag("bpmn:flowNodeRef", {}, _text(r))), "")
    lanes = m.roles.withColumn("i", i).join(refs, ["proc_id", "role_id"], "left")
    whole = F.concat(F.array(F.lit(START)), F.col("refs"), F.array(F.lit(END)))
    resolved = F.to_json(F.struct(F.struct(F.lit(resolution).alias("_type"), F.array().cast("array<string>").alias("endpoint")).alias("roleResolutionContext")))
    lane_id = F.concat(F.lit("Lane_"), F.col("role_id"))
    lane = _tag("bpmn:lane", {"id": lane_id, "name": F.col("name")}, F.concat(properties(resolved), F.when(F.col("refs").isNull(), F.lit("")).otherwise(members(whole))))
    lane_shape = _tag("bpmndi:BPMNShape", {"id": F.concat(lane_id, F.lit("_di")), "bpmnElement": lane_id, "isHorizontal": F.lit("true")}, bounds(F.lit(0), F.col("i") * LANE, F.lit(POOL), F.lit(LANE)))
    lane_xml = _joined(lanes, ["i"], lanes=lane, lane_shapes=lane_shape)
    rest = refs.where("role_id = ''").select("proc_id", _tag("bpmn:lane", {"id": F.lit("Lane_Unassigned"), "name": F.lit(UNASSIGNED)}, members(F.col("refs"))).alias("rest"))
    count = m.roles.groupBy("proc_id").agg(F.count(F.lit(1)).alias("n_roles"))

    p = m.processes.select("proc_id", name("name").alias("name"))
    if m.data is not None:
        variable = _tag(f"{prefix}:variable", {"name": F.col("name"), "description": F.col("description"), "type": F.col("type")})
        p = p.join(_joined(m.data, ["seq", "name"], variables=variable), "proc_id", "left")
    else:
        p = p.withColumn("variables", F.lit(""))
    for part in (node_xml, flow_xml, lane_xml, rest, count):
        p = p.join(part, "proc_id", "left")
    of = lambda prefix: F.concat(F.lit(prefix), F.col("proc_id"))
    about = F.to_json(F.struct(F.col("name").alias("definitionName"), F.lit("1.0").alias("version"), F.struct(F.lit("").alias("text")).alias("shortDescription")))
    pool = _tag("bpmn:collaboration", {"id": of("Collaboration_")}, _tag("bpmn:participant", {"id": of("Participant_"), "name": F.col("name"), "processRef": of("Process_")}))
    lane_set = _tag("bpmn:laneSet", {"id": of("LaneSet_")}, F.concat(name("lanes"), name("rest")))
    process = _tag("bpmn:process", {"id": of("Process_"), "name": F.col("name"), "isExecutable": F.lit("true"), "megaProcessId": F.lit(UNASSIGNED), "majorProcessId": F.lit(UNASSIGNED)}, F.concat(properties(about, name("variables")), lane_set, name("elements"), name("sequences")))
    pool_shape = _tag("bpmndi:BPMNShape", {"id": F.concat(of("Participant_"), F.lit("_di")), "bpmnElement": of("Participant_"), "isHorizontal": F.lit("true")}, bounds(F.lit(0), F.lit(0), F.lit(POOL), LANE * F.greatest(F.coalesce("n_roles", F.lit(0)), F.lit(1))))
    plane = _tag("bpmndi:BPMNDiagram", {"id": of("BPMNDiagram_")}, _tag("bpmndi:BPMNPlane", {"id": of("BPMNPlane_"), "bpmnElement": of("Collaboration_")}, F.concat(pool_shape, name("lane_shapes"), name("shapes"), name("edges"))))
    spaces = {"xmlns:bpmn": BPMN, "xmlns:bpmndi": BPMNDI, "xmlns:dc": DC, "xmlns:di": DI, f"xmlns:{prefix}": uri}
    top = _tag("bpmn:definitions", {k: F.lit(v) for k, v in spaces.items()} | {"id": of("Definitions_"), "name": F.col("name"), "targetNamespace": F.lit("http://bpmn.io/schema/bpmn")}, F.concat(pool, process, plane))
    return p.select("proc_id", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), top).alias("xml"))


#: What is read as what, by tag, in the order of reading (fixed values).
EVENTS = ("startEvent", "endEvent", "intermediateCatchEvent", "intermediateThrowEvent")
ACTIVITIES = ("userTask", "serviceTask", "task", "manualTask")
GATEWAYS = ("exclusiveGateway", "parallelGateway", "inclusiveGateway")
KINDS = {**dict.fromkeys(EVENTS, "event"), **dict.fromkeys(ACTIVITIES, "activity"), **dict.fromkeys(GATEWAYS, "gateway"), "sequenceFlow": "sequence"}
ROWS = "doc string, kind string, n int, id string, name string, type string, role string, source string, target string, process string, json string, description string, x double, y double, w double, h double, points string, fallback boolean"
ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]]) for c in ROWS.split(", ")])


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _children(e: ET.Element | None, *path: str) -> list[ET.Element]:
    found = [e] if e is not None else []
    for name in path:
        found = [c for f in found for c in f if _local(c) == name]
    return found


def _json(e: ET.Element) -> str | None:
    return next((j.text for j in _children(e, "extensionElements", "properties", "json")), None)


def _number(x: str | None) -> float:
    return float(x or 0)


def parsed(xml: str) -> list[dict]:
    """Everything in a diagram; raises ParseError."""
    root = ET.fromstring(xml)
    every: dict[str, list[ET.Element]] = {}
    for e in root.iter():
        every.setdefault(_local(e), []).append(e)
    box, way = {}, {}
    for s in every.get("BPMNShape", ()):
        for b in _children(s, "Bounds")[:1]:
            try:
                box[s.get("bpmnElement")] = {k: _number(b.get(a)) for k, a in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))}
            except ValueError:
                continue
    for s in every.get("BPMNEdge", ()):
        way[s.get("bpmnElement")] = " ".join(f"{p.get('x')},{p.get('y')}" for p in _children(s, "waypoint"))
    processes = every.get("process", [])
    ids = {p.get("id") for p in processes}
    inside = [p for c in every.get("collaboration", ()) for p in c.iter() if _local(p) == "participant"]
    rows = [{"kind": "participant", "id": p.get("id"), "name": p.get("name"), "process": p.get("processRef")} for p in inside if not p.get("processRef") or p.get("processRef") in ids] if processes else []
    for p in processes:
        lanes = _children(p, "laneSet", "lane")
        rows += [{"kind": "role", "id": e.get("id"), "name": e.get("name", "Unknown"), "process": p.get("id"), "json": _json(e)} for e in lanes]
        lane_of = {(r.text or "").strip(): e.get("name", "Unknown") for e in lanes for r in _children(e, "flowNodeRef")}
        rows += [{"kind": "data", "id": v.get("name"), "name": v.get("name"), "type": v.get("type", "string"), "description": v.get("description") or f"{v.get('name')} description", "process": p.get("id")} for v in _children(p, "extensionElements", "properties", "variable") if v.get("name")]
        for tag, kind in KINDS.items():
            for e in _children(p, tag):
                said = next((c.text for c in _children(e, "conditionExpression")), None)
                rows.append({"kind": kind, "id": e.get("id"), "name": e.get("name"), "type": tag, "role": lane_of.get(e.get("id", "")), "source": e.get("sourceRef"), "target": e.get("targetRef"), "process": p.get("id"), "json": _json(e), "description": said, "points": way.get(e.get("id"))})
    return [r | box.get(r["id"], {}) for r in rows]


_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"<]*)"|'([^'<]*)')""")
_START_TAG = re.compile(r"<(?:[\w.-]+:)?(participant|lane|process|scriptTask|" + "|".join(KINDS) + r""")(?=[\s/>])((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>""")


def by_patterns(xml: str) -> list[dict]:
    """The elements of a text that isn't well formed: their tags, ids, names and ends."""
    unescaped = lambda s: s.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&apos;", "'").replace("&#10;", "\n").replace("&#9;", "\t").replace("&#13;", "\r").replace("&amp;", "&")
    rows, process = [], None
    for m in _START_TAG.finditer(xml):
        tag, a = m[1], {k: unescaped(v or w or "") for k, v, w in _ATTRIBUTE.findall(m[2])}
        if tag == "process":
            process = a.get("id")
            continue
        kind = {"participant": "participant", "lane": "role", "scriptTask": "activity"}.get(tag) or KINDS[tag]
        rows.append({"kind": kind, "id": a.get("id"), "name": a.get("name"), "type": None if tag in ("participant", "lane") else tag, "source": a.get("sourceRef"), "target": a.get("targetRef"), "process": a.get("processRef") if tag == "participant" else process, "fallback": True})
    return rows


def read(xmls: DataFrame) -> DataFrame:
    """Rows of ROWS from texts. xmls: doc, xml. Texts are null or of any kind; one without a process has no rows."""

    def rows(xml: str | None) -> list[dict]:
        if not xml:
            return []
        try:
            return parsed(xml)
        except ET.ParseError:
            return by_patterns(xml)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, x in zip(b.column("doc").to_pylist(), b.column("xml").to_pylist(), strict=True):
                out = [{"doc": d, "n": n, "fallback": False, **r} for n, r in enumerate(rows(x))]
                yield pa.RecordBatch.from_pylist(out, ARROW)

    return xmls.select(F.col("doc").cast("string").alias("doc"), "xml").mapInArrow(run, ROWS)


def activities(rows: DataFrame) -> DataFrame:
    """doc, id, name, type, role, tool, instruction, description, duration, input_data, output_data, checkpoints, x, y, w, h.

    What the properties say counts before the lane and the defaults, where it isn't empty.
    """
    form = "tool string, instruction string, description string, duration string, role string, inputData array<string>, outputData array<string>, checkpoints array<string>"
    a = rows.where("kind = 'activity'").withColumn("j", F.from_json("json", form))
    said = lambda f, default: or_else(F.col(f"j.{f}"), default)
    many = lambda f: F.coalesce(f"j.{f}", F.array().cast("array<string>"))
    duration = F.col("j.duration").try_cast("int")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return a.select("doc", blank("id").alias("id"), blank("name").alias("name"), "type", said("role", blank("role")).alias("role"), said("tool", TOOL).alias("tool"), said("instruction", "").alias("instruction"), said("description", "").alias("description"), F.when(duration != 0, duration).otherwise(5).alias("duration"), many("inputData").alias("input_data"), many("outputData").alias("output_data"), many("checkpoints").alias("checkpoints"), "x", "y", "w", "h")


def roles(rows: DataFrame) -> DataFrame:
    """doc, name, endpoint, default: the lanes, one for each name (the first); an endpoint counts if it is a UUID."""
    context = F.get_json_object("json", "$.roleResolutionContext.endpoint")
    said = F.coalesce(F.when(context.startswith("["), F.get_json_object("json", "$.roleResolutionContext.endpoint[0]")).otherwise(context), F.lit(""))
    endpoint = F.when(is_uuid(said), said).otherwise("")
    direct = F.coalesce(F.get_json_object("json", "$.roleResolutionContext._type"), F.lit("")).endswith("DirectRoleResolutionContext")
    named = rows.where("kind = 'role'").withColumn("key", name_key(F.coalesce("name", F.lit("")))).where("key <> ''")
    return first_by(named, ["doc", "key"], "n").select("doc", "name", endpoint.alias("endpoint"), F.when(direct, endpoint).otherwise("").alias("default"))


def sequences(rows: DataFrame) -> DataFrame:
    """doc, id, name, source, target, condition, points."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.where("kind = 'sequence'").select("doc", *[blank(c).alias(c) for c in ("id", "name", "source", "target")], or_else(F.trim("description"), blank("name")).alias("condition"), "points")


def nodes(rows: DataFrame) -> DataFrame:
    """doc, kind, type, id, name, role, process, x, y, w, h of events, activities and gateways."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.where("kind IN ('event', 'activity', 'gateway')").select("doc", "kind", "type", blank("id"), blank("name"), blank("role"), blank("process"), "x", "y", "w", "h")


def variables(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'data'").select("doc", "name", "description", "type")


def pools(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'participant'").select("doc", "id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("process", F.lit("")).alias("process"))
