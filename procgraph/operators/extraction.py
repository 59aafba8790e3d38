"""From the payloads of an extraction to the nodes, maps and flows of a process graph.

Sections of a document are folded in order. What a section says by name is looked up among what it and the sections before
it have defined: of processes the last with a name counts, of roles the first, which is the only one that becomes a node.
Definitions and questions meet in one window for each document and name, ordered by section, so a document of any length
is no loop. Within a section names are matched by array functions on its one row; no pair of rows is formed.

Defined results: what is missing is null in a payload and gets the defaults of fold(); a payload that can't be read has no
entities. Section numbers are unique in a document. Ids come from kind, document, section and place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.functions.jsonx import json_part
from procgraph.functions.text import EVENT_TYPES, GATEWAY_TYPES, TASK_TYPES
from procgraph.sources.files import EXTRACTION

KEYS = ["doc_id", "section_no"]
NODE = "label string, id string, process_id string, name string, kind string, description string, detail string, ord int"
FLOW = "src string, src_type string, dst string, dst_type string, condition string, source int"


def _key(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def _or(x: Column, default: Column | str) -> Column:
    return F.coalesce(x, F.lit(default) if isinstance(default, str) else default)


def _kind(x: Column, allowed: tuple[str, ...], default: str) -> Column:
    y = F.lower(x)
    return F.when(y.isin(*allowed), y).otherwise(F.lit(default))


def _id(kind: str, i: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), "doc_id", F.col("section_no").cast("string"), i.cast("string"))


def _first(rows: Column, test) -> Column:
    """Place of the first row that passes, from 0; -1 if none does."""
    return (F.array_position(F.transform(rows, test), F.lit(True)) - 1).cast("int")


def _last(rows: Column) -> Column:
    return F.try_element_at(rows, F.lit(-1))


def sections(payloads: DataFrame) -> DataFrame:
    """doc_id, section_no, section_id and the arrays of the extraction, empty where there are none."""
    schema = EXTRACTION.replace("\n", " ").strip()
    parsed = payloads.select(*KEYS, "section_id", F.from_json(json_part(F.col("payload")), schema).alias("x")).select(*KEYS, "section_id", "x.*")
    lists = [f for f in parsed.schema if f.name not in (*KEYS, "section_id")]
    return parsed.select(*KEYS, "section_id", *[F.filter(F.coalesce(f.name, F.array().cast(f.dataType)), lambda r: r.isNotNull()).alias(f.name) for f in lists])


@dataclass(frozen=True)
class Extracted:
    nodes: DataFrame  # doc_id, section_no, and NODE
    edges: DataFrame  # doc_id, section_no, rel, src, dst
    flows: DataFrame  # doc_id, section_no, and FLOW


def named(s: DataFrame) -> DataFrame:
    """Sections with maps proc_of and role_of from the names that they use to the ids known there."""
    own = lambda c, kind, default: F.transform(c, lambda r, i: F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("q"), i.alias("seq"), _key(_or(r["name"], default)).alias("key"), _id(kind, i).alias("id")))
    ask = lambda c, kind, f: F.transform(c, lambda r: F.struct(F.lit(kind).alias("kind"), F.lit(1).alias("q"), F.lit(0).alias("seq"), _key(r[f]).alias("key"), F.lit(None).cast("string").alias("id")))
    asked = [ask(c, "process", "parent_process") for c in ("tasks", "gateways", "events")] + [ask("task_process_mappings", "process", "process_name")]
    asked += [ask(c, "role", f) for c, f in (("tasks", "performer_role"), ("task_role_mappings", "role_name"), ("decisions", "related_role"))]
    asked += [F.transform("roles", lambda r: F.struct(F.lit("role").alias("kind"), F.lit(1).alias("q"), F.lit(0).alias("seq"), _key(_or(r["name"], "Unknown Role")).alias("key"), F.lit(None).cast("string").alias("id")))]
    rows = F.concat(own("processes", "process", "Unknown Process"), own("roles", "role", "Unknown Role"), F.array_distinct(F.concat(*asked)))
    both = s.select(*KEYS, F.explode_outer(rows).alias("r")).where("r IS NOT NULL").select(*KEYS, "r.*")
    so_far = W.partitionBy("doc_id", "kind", "key").orderBy("section_no", "q", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    known = F.when(F.col("kind") == "process", F.last("id", ignorenulls=True).over(so_far)).otherwise(F.first("id", ignorenulls=True).over(so_far))
    found = both.withColumn("id", known).where("q = 1 AND id IS NOT NULL")
    of = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "id"))))
    maps = found.groupBy(*KEYS).agg(of("process").alias("proc_of"), of("role").alias("role_of"))
    none = F.create_map().cast("map<string,string>")
    return s.join(maps, KEYS, "left").withColumns({c: F.coalesce(c, none) for c in ("proc_of", "role_of")})


def fold(payloads: DataFrame) -> DataFrame:
    """A row for each section with arrays nodes, edges and flows. payloads: doc_id, section_no, section_id, payload."""
    s = named(sections(payloads))
    proc = lambda name: F.try_element_at("proc_of", _key(name))
    role = lambda name: F.try_element_at("role_of", _key(name))
    first_process = F.when(F.size("processes") > 0, _id("process", F.lit(0))).otherwise(F.lit(""))
    owner = lambda name: F.coalesce(proc(name), first_process)
    given = lambda name, look: F.when(_key(name) != "", look(name))

    def task(t: Column, i: Column) -> Column:
        order = t["order"]
        return F.struct(
            _id("task", i).alias("id"),
            _or(t["name"], F.concat(F.lit("Task "), (i + 1).cast("string"))).alias("name"),
            _kind(t["task_type"], TASK_TYPES, "human").alias("kind"),
            _or(t["description"], "").alias("description"),
            F.coalesce(order.try_cast("double").try_cast("int"), i).alias("ord"),
            F.coalesce(given(t["parent_process"], proc), first_process).alias("process_id"),
            given(t["performer_role"], role).alias("role_id"),
            F.nullif(_key(t["next_task"]), F.lit("")).alias("next"),
        )

    s = s.withColumn("t0", F.transform("tasks", task)).withColumn("k0", F.transform("t0", lambda t: F.lower(t["name"])))
    holds = lambda name: _first(F.col("k0"), lambda k: k.contains(_key(name)))  # noqa: E731  every name holds the empty one
    by_role = F.transform("task_role_mappings", lambda m: F.struct(holds(m["task_name"]).alias("at"), role(m["role_name"]).alias("to")))
    by_process = F.transform("task_process_mappings", lambda m: F.struct(holds(m["task_name"]).alias("at"), proc(m["process_name"]).alias("to")))
    known = lambda hits: F.filter(hits, lambda x: (x["at"] >= 0) & x["to"].isNotNull())
    s = s.withColumn("said_r", known(by_role)).withColumn("said_p", known(by_process))
    said = lambda c, i: _last(F.filter(c, lambda x: x["at"] == i))["to"]
    s = s.withColumn("t1", F.transform("t0", lambda t, i: F.struct(t["id"], t["name"], t["kind"], t["description"], t["ord"], F.coalesce(said("said_p", i), t["process_id"]).alias("process_id"), F.coalesce(said("said_r", i), t["role_id"]).alias("role_id"), t["next"], F.lower(t["name"]).alias("key"))))

    last_gateway = F.when(F.size("gateways") > 0, _id("gateway", F.size("gateways") - 1))

    def end(name: Column) -> Column:
        """id and type of what a flow's end names: a task either of whose names holds the other, else the last gateway, which has no name and so is in every name."""
        k = _key(name)
        at = _first(F.col("t1"), lambda t: t["key"].contains(k) | k.contains(t["key"]))
        hit = F.when((k != "") & (at >= 0), F.get(F.col("t1"), at)["id"])
        gate = F.when(k != "", last_gateway)
        return F.struct(F.coalesce(hit, gate).alias("id"), F.when(hit.isNotNull(), F.lit("task")).otherwise(F.lit("gateway")).alias("type"))

    flow = lambda a, at, b, bt, c, n: F.struct(a.alias("src"), at.alias("src_type"), b.alias("dst"), bt.alias("dst_type"), c.alias("condition"), F.lit(n).alias("source"))
    is_task = F.lit("task")
    ends = F.transform("sequence_flows", lambda f: F.struct(end(f["from_task"]).alias("a"), end(f["to_task"]).alias("b"), F.trim(_or(f["condition"], "")).alias("c")))
    stated = F.transform(F.filter(ends, lambda e: e["a"]["id"].isNotNull() & e["b"]["id"].isNotNull()), lambda e: flow(e["a"]["id"], e["a"]["type"], e["b"]["id"], e["b"]["type"], e["c"], 0))
    after = F.transform(F.filter("t1", lambda t: t["next"].isNotNull()), lambda t: F.struct(t["id"].alias("a"), _first(F.col("t1"), lambda o: o["key"].contains(t["next"])).alias("at")))
    then = F.transform(F.filter(after, lambda x: x["at"] >= 0), lambda x: flow(x["a"], is_task, F.get(F.col("t1"), x["at"])["id"], is_task, F.lit(""), 1))
    s = s.withColumn("f1", F.concat(stated, then))
    s = s.withColumn("line", F.array_sort(F.transform("t1", lambda t, i: F.struct(t["process_id"].alias("p"), t["ord"].alias("o"), i.alias("i"), t["id"].alias("id")))))
    pairs = F.zip_with(F.slice("line", 1, F.greatest(F.size("line") - 1, F.lit(0))), F.slice("line", 2, F.greatest(F.size("line"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    fresh = F.filter(pairs, lambda x: (x["a"]["p"] == x["b"]["p"]) & ~F.exists("f1", lambda f: (f["src"] == x["a"]["id"]) & (f["dst"] == x["b"]["id"])))
    flows = F.concat("f1", F.transform(fresh, lambda x: flow(x["a"]["id"], is_task, x["b"]["id"], is_task, F.lit(""), 2)))

    empty = F.lit("")
    node = lambda label, i, p, name, kind, text, detail=empty, order=F.lit(None): F.struct(F.lit(label).alias("label"), i.alias("id"), p.alias("process_id"), name.alias("name"), kind.alias("kind"), text.alias("description"), detail.alias("detail"), order.cast("int").alias("ord"))
    new_roles = F.filter(F.transform("roles", lambda r, i: F.struct(_or(r["name"], "Unknown Role").alias("name"), _or(r["org_unit"], "").alias("unit"), F.coalesce(r["persona_hint"], r["description"], empty).alias("hint"), _id("role", i).alias("id"))), lambda r: F.try_element_at("role_of", F.lower(r["name"])) == r["id"])
    nodes = F.concat(
        F.transform("processes", lambda p, i: node("Process", _id("process", i), _id("process", i), _or(p["name"], "Unknown Process"), empty, _or(p["description"], ""))),
        F.transform(new_roles, lambda r: node("Role", r["id"], empty, r["name"], empty, r["hint"], r["unit"])),
        F.transform("t1", lambda t: node("Task", t["id"], t["process_id"], t["name"], t["kind"], t["description"], order=t["ord"])),
        F.transform("gateways", lambda g, i: node("Gateway", _id("gateway", i), owner(g["parent_process"]), empty, _kind(g["gateway_type"], GATEWAY_TYPES, "exclusive"), _or(g["description"], ""), _or(g["condition"], ""))),
        F.transform("events", lambda e, i: node("Event", _id("event", i), owner(e["parent_process"]), _or(e["name"], "Event"), _kind(e["event_type"], EVENT_TYPES, "start"), empty, _or(e["trigger"], ""))),
        F.transform("decisions", lambda d, i: node("DMNDecision", _id("decision", i), empty, _or(d["name"], "Decision"), empty, _or(d["description"], ""), F.to_json(F.struct(F.coalesce(d["input_data"], F.array().cast("array<string>")).alias("input"), F.coalesce(d["output_data"], F.array().cast("array<string>")).alias("output"))))),
        F.transform("rules", lambda r, i: node("DMNRule", _id("rule", i), empty, F.coalesce(r["when"], r["condition"], empty), F.coalesce(r["confidence"], F.lit(1.0)).cast("string"), F.coalesce(r["then"], r["result"], empty), _or(r["decision_id"], ""))),
    )
    s = s.withColumn("nodes", nodes).withColumn("flows", flows)
    edge = lambda rel, a, b: F.struct(F.lit(rel).alias("rel"), a.alias("src"), b.alias("dst"))
    decided = F.transform("decisions", lambda d, i: edge("MAKES_DECISION", given(d["related_role"], role), _id("decision", i)))
    edges = F.concat(
        F.transform(F.filter("t1", lambda t: t["process_id"] != ""), lambda t: edge("HAS_TASK", t["process_id"], t["id"])),
        F.transform(F.filter("t1", lambda t: t["role_id"].isNotNull()), lambda t: edge("PERFORMED_BY", t["id"], t["role_id"])),
        F.filter(decided, lambda e: e["src"].isNotNull()),
        F.transform(F.filter("nodes", lambda n: F.coalesce(F.col("section_id"), F.lit("")) != ""), lambda n: edge("SUPPORTED_BY", n["id"], F.col("section_id"))),
    )
    return s.select(*KEYS, "section_id", "nodes", edges.alias("edges"), "flows")


def extracted(payloads: DataFrame) -> Extracted:
    """Nodes, edges and flows of documents, from their payloads."""
    s = fold(payloads)
    rows = lambda c: s.select(*KEYS, F.explode_outer(c).alias("r")).where("r IS NOT NULL").select(*KEYS, "r.*")  # noqa: E731  no filter that repeats how the list is made
    return Extracted(rows("nodes"), rows("edges"), rows("flows"))
