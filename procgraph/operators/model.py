"""The elements of a process model: normalising, repairing, and what a runtime needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.functions.text import coerce, or_else, snake_id, strip
from procgraph.operators.graph import checkpointed


def normal_ids(elements: DataFrame) -> DataFrame:
    """elements with new_id: the id in snake form, node_<position> where nothing is left of it; repeated ones get a number.

    elements: process_id, id, seq (from 0).
    """
    base = or_else(snake_id("id"), F.concat(F.lit("node_"), (F.col("seq") + 1).cast("string")))
    k = F.row_number().over(W.partitionBy("process_id", "_base").orderBy("seq"))
    return elements.withColumn("_base", base).withColumn("new_id", F.when(k == 1, F.col("_base")).otherwise(F.concat_ws("_", F.col("_base"), k.cast("string")))).drop("_base")


#: Types of events and gateways by the words that models use for them (fixed values).
EVENT_WORDS = {"startevent": "StartEvent", "start_event": "StartEvent", "start": "StartEvent", "endevent": "EndEvent", "end_event": "EndEvent", "end": "EndEvent"}
GATEWAY_WORDS = {
    "exclusivegateway": "ExclusiveGateway",
    "exclusive_gateway": "ExclusiveGateway",
    "parallelgateway": "ParallelGateway",
    "parallel_gateway": "ParallelGateway",
    "inclusivegateway": "InclusiveGateway",
    "inclusive_gateway": "InclusiveGateway",
}


def element_type(kind: str | Column, said: str | Column) -> Column:
    """Type of an element: activities are user activities; others by their words, else as they stand, else the default."""
    kind, y = (F.col(kind) if isinstance(kind, str) else kind), strip(F.coalesce(F.col(said) if isinstance(said, str) else said, F.lit("")))
    table = lambda d: F.element_at(F.create_map(*[F.lit(v) for kv in d.items() for v in kv]), F.lower(y))
    other_event = F.when(y.rlike(r"^\p{Lu}"), y).otherwise(F.lit("IntermediateCatchEvent"))
    event, gateway = F.coalesce(table(EVENT_WORDS), other_event), F.coalesce(table(GATEWAY_WORDS), F.nullif(y, F.lit("")), F.lit("ExclusiveGateway"))
    return F.when(kind == "Activity", F.lit("UserActivity")).when(kind == "Event", event).when(kind == "Gateway", gateway).otherwise(y)


def task_types(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("task_type", coerce("task_type", ("human", "agent", "system"), "human"))


def fill_ends(elements: DataFrame) -> DataFrame:
    """Sequences without an end get the nearest element before, or after, them that is no sequence.

    elements: process_id, seq, kind, id, source, target (the last two of sequences only).
    """
    node = F.when(F.col("kind") != "sequence", F.col("id"))
    w = W.partitionBy("process_id").orderBy("seq")
    before = F.last(node, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(node, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    every = elements.select("*", before.alias("_b"), after.alias("_a"))
    got = every.where("kind = 'sequence'").select("process_id", "seq", "id", or_else("source", F.col("_b")).alias("source"), or_else("target", F.col("_a")).alias("target"))
    return got.where("source <> '' AND target <> '' AND source <> target")


def repair(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """process_id, src, dst, made: the flows, and one between neighbours in order that have none.

    nodes: process_id, id, seq. flows: process_id, src, dst.
    """
    w = W.partitionBy("process_id").orderBy("seq")
    chain = nodes.select("process_id", F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where("dst IS NOT NULL AND src <> dst")
    have = flows.select("process_id", "src", "dst").distinct()
    made = chain.distinct().join(have, ["process_id", "src", "dst"], "left_anti")
    return have.withColumn("made", F.lit(False)).unionByName(made.withColumn("made", F.lit(True)))


def collapse_gateways(gateways: DataFrame, flows: DataFrame) -> DataFrame:
    """Flows without the gateways that fewer than two lead out of; what led to one leads to where it led.

    One pass over degrees taken before: chains of such gateways lose the link between them. gateways: process_id, id.
    flows: process_id, src, dst.
    """
    out = flows.groupBy("process_id", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to"))
    weak = gateways.select("process_id", "id").join(out, ["process_id", "id"], "left").where("coalesce(n, 0) < 2").select("process_id", "id", "to")
    ids = weak.select("process_id", "id")
    kept = flows.select("process_id", "src", "dst").join(ids.withColumnRenamed("id", "src"), ["process_id", "src"], "left_anti")
    led = kept.join(weak.select("process_id", F.col("id").alias("dst"), "to", F.lit(True).alias("gone")), ["process_id", "dst"], "left")
    led = led.select("process_id", "src", F.when(F.col("gone"), F.col("to")).otherwise(F.col("dst")).alias("dst"), "gone").where("dst IS NOT NULL AND (gone IS NULL OR src <> dst)")
    return led.join(ids.withColumnRenamed("id", "dst"), ["process_id", "dst"], "left_anti").select("process_id", "src", "dst").distinct()


def branch_names(gateways: DataFrame, flows: DataFrame, word: str = "조건") -> DataFrame:
    """flows out of a gateway with several, numbered by dst: process_id, src, dst, condition."""
    w = W.partitionBy("process_id", "src")
    out = flows.join(gateways.select("process_id", F.col("id").alias("src")), ["process_id", "src"], "left_semi")
    out = out.select("*", F.count(F.lit(1)).over(w).alias("_n"), F.row_number().over(w.orderBy("dst")).alias("_k"))
    return out.where("_n > 1").select("process_id", "src", "dst", F.concat(F.lit(word + " "), F.col("_k").cast("string")).alias("condition"))


def start_end(nodes: DataFrame) -> DataFrame:
    """process_id, src, dst: from a start event to the first node, from the last node to an end event."""
    order = F.struct("seq", "id")
    ends = nodes.groupBy("process_id").agg(F.min_by("id", order).alias("first"), F.max_by("id", order).alias("last"))
    start = ends.select("process_id", F.concat(F.lit("start_"), "process_id").alias("src"), F.col("first").alias("dst"))
    return start.unionByName(ends.select("process_id", F.col("last").alias("src"), F.concat(F.lit("end_"), "process_id").alias("dst")))


def input_refs(predecessors: DataFrame, fields: DataFrame, chosen: DataFrame, most: int = 60) -> DataFrame:
    """process_id, activity, refs: of the form fields of an activity's predecessors those chosen for it, else all; sorted.

    predecessors: process_id, activity, predecessor. fields: process_id, activity, ref. chosen: process_id, activity, ref.
    """
    key = ["process_id", "activity"]
    allowed = predecessors.join(fields.select("process_id", F.col("activity").alias("predecessor"), "ref"), ["process_id", "predecessor"]).groupBy(*key).agg(F.array_sort(F.collect_set("ref")).alias("allowed"))
    asked = chosen.groupBy(*key).agg(F.array_sort(F.collect_set("ref")).alias("asked"))
    both = F.array_intersect("allowed", F.coalesce("asked", F.array().cast("array<string>")))
    refs = F.slice(F.when(F.size(both) > 0, both).otherwise(F.col("allowed")), 1, most)
    return allowed.join(asked, key, "left").select(*key, refs.alias("refs"))


def process_tree(tree: DataFrame, fresh: DataFrame, group: str = "미분류") -> DataFrame:
    """mega, major, id, name rows of a process map with new processes appended under a default group if they are nowhere."""
    added = fresh.join(tree.select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.min("name").alias("name"))
    return tree.select("mega", "major", "id", "name").unionByName(added.select(F.lit(group).alias("mega"), F.lit(group).alias("major"), "id", "name"))


def org_members(nodes: DataFrame) -> DataFrame:
    """team, member: people of an org chart under their closest team, however deep. nodes: id, parent_id, is_team.

    A round a level, until no node has a parent in it; nodes of a circle, which no root leads to, are under no team.
    """
    level = checkpointed(nodes.where("parent_id IS NULL").select("id", F.when(F.col("is_team"), F.col("id")).alias("team"), "is_team"))
    rest = nodes.where("parent_id IS NOT NULL").select("id", "parent_id", "is_team")
    found = []
    while not level.isEmpty():
        found.append(level.where("NOT is_team AND team IS NOT NULL").select("team", F.col("id").alias("member")))
        above = level.select(F.col("id").alias("parent_id"), F.col("team").alias("up"))
        level = checkpointed(rest.join(above, "parent_id").select("id", F.when(F.col("is_team"), F.col("id")).otherwise(F.col("up")).alias("team"), "is_team"))
    return reduce(DataFrame.unionByName, found or [nodes.where("false").select(F.col("id").alias("team"), F.col("id").alias("member"))])
