"""A property graph in DataFrames: nodes by label, and edges (rel, src, dst, condition).

Upserts keep one row for a key; edges need both ends. Every operator but paths, closure and predecessors is a plan without actions.
"""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EDGE = "rel string, src string, dst string, condition string"
LABELS = ("Document", "Section", "Process", "Task", "Role", "Gateway", "Event", "Skill", "DMNDecision", "DMNRule")
RELS = ("HAS_TASK", "PERFORMED_BY", "NEXT", "MAKES_DECISION", "SUPPORTED_BY")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order, which must be total for a defined result."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, with their counts; empty when the constraint holds."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones with the same key; the columns are those of old."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def update_columns(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Old rows with the named columns taken from new where new has the key and a value. Keys of new are unique."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return old.join(fresh, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def linked(edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Edges whose ends are both there (column id), one for each rel, src and dst."""
    known = edges.join(src.select(F.col("id").alias("src")), "src", "left_semi").join(dst.select(F.col("id").alias("dst")), "dst", "left_semi")
    return known.groupBy("rel", "src", "dst").agg(F.min("condition").alias("condition"))


def rejected(edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """The edges that linked() leaves out because an end is missing."""
    s, d = src.select(F.col("id").alias("src"), F.lit(True).alias("_s")).distinct(), dst.select(F.col("id").alias("dst"), F.lit(True).alias("_d")).distinct()
    return edges.join(s, "src", "left").join(d, "dst", "left").where("_s IS NULL OR _d IS NULL").select("rel", "src", "dst", "condition")


@dataclass(frozen=True)
class PropertyGraph:
    nodes: dict[str, DataFrame]
    edges: DataFrame

    def upsert_nodes(self, label: str, new: DataFrame, key: str) -> PropertyGraph:
        old = self.nodes.get(label)
        return replace(self, nodes=self.nodes | {label: upsert(old, new, [key]) if old is not None else new})

    def upsert_edges(self, new: DataFrame) -> PropertyGraph:
        return replace(self, edges=upsert(self.edges, new, ["rel", "src", "dst"]))

    def rel(self, name: str) -> DataFrame:
        return self.edges.where(F.col("rel") == name)


def successors(tasks: DataFrame, *keep: str) -> DataFrame:
    """NEXT edges between tasks that follow each other in their process: process_id, rel, src, dst, condition.

    tasks: process_id, task_id, order, seq. keep: further columns, taken from the earlier task, as src_<name>.
    """
    w = W.partitionBy("process_id").orderBy(F.asc_nulls_last("order"), "seq")
    pairs = tasks.select("process_id", F.col("task_id").alias("src"), F.lead("task_id").over(w).alias("dst"), *[F.col(c).alias(f"src_{c}") for c in keep])
    return pairs.where("dst IS NOT NULL").select("process_id", F.lit("NEXT").alias("rel"), "src", "dst", F.lit("").alias("condition"), *[f"src_{c}" for c in keep])


def grouped_names(edges: DataFrame, key: str, other: str, names: DataFrame, out: str) -> DataFrame:
    """For each key the sorted distinct names of what its edges lead to, joined by commas. names: id, name."""
    got = edges.join(names.select(F.col("id").alias(other), "name"), other)
    return got.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias(out))


def process_detail(processes: DataFrame, graph: DataFrame, names: DataFrame) -> DataFrame:
    """Each process with its tasks, gateways, events and their roles; every branch is aggregated before it is joined."""
    has = lambda rel: graph.where(F.col("rel") == rel)
    out = processes
    for rel, col in (("HAS_TASK", "tasks"), ("HAS_GATEWAY", "gateways"), ("HAS_EVENT", "events")):
        branch = grouped_names(has(rel), "src", "dst", names, col)
        out = out.join(branch.withColumnRenamed("src", "proc_id"), "proc_id", "left")
    by_task = has("HAS_TASK").select(F.col("src").alias("proc_id"), F.col("dst").alias("task"))
    roles = grouped_names(by_task.join(has("PERFORMED_BY").select(F.col("src").alias("task"), F.col("dst").alias("role")), "task"), "proc_id", "role", names, "roles")
    out = out.join(roles, "proc_id", "left")
    return out.select("proc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("tasks", "gateways", "events", "roles")])


def neighbours(tasks: DataFrame, next_edges: DataFrame) -> DataFrame:
    """Each task with the names of those right after and right before it."""
    names = tasks.select(F.col("task_id").alias("id"), "name")
    after = grouped_names(next_edges, "src", "dst", names, "next_names").withColumnRenamed("src", "task_id")
    before = grouped_names(next_edges, "dst", "src", names, "prev_names").withColumnRenamed("dst", "task_id")
    out = tasks.join(after, "task_id", "left").join(before, "task_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("next_names", "prev_names")})


def process_flows(edges: DataFrame) -> DataFrame:
    """proc_id with every NEXT edge both of whose ends belong to the process."""
    members = edges.where(F.col("rel").isin("HAS_TASK", "HAS_GATEWAY", "HAS_EVENT")).select(F.col("src").alias("proc_id"), F.col("dst").alias("id")).distinct()
    flows = edges.where("rel = 'NEXT'").select("src", "dst", "condition")
    start = flows.join(members.withColumnRenamed("id", "src"), "src")
    return start.join(members.withColumnRenamed("id", "dst"), ["proc_id", "dst"], "left_semi").select("proc_id", "src", "dst", "condition")


def node_stats(counted: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Count of the nodes of each label, zeros included. counted: label."""
    named = counted.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    n = counted.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return named.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder of the session, which executors share; a temporary one only for a local master."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="procgraph-"))
    return df.checkpoint()


def paths(next_edges: DataFrame) -> DataFrame:
    """All paths over NEXT edges that use no edge twice: start, stop, hops. A round a hop, until nothing is new."""
    edges = checkpointed(next_edges.select("src", "dst", F.concat("src", F.lit(">"), "dst").alias("_edge")).distinct())
    fresh = checkpointed(edges.select(F.col("src").alias("start"), F.col("dst").alias("stop"), F.lit(1).alias("hops"), F.array("_edge").alias("_path")))
    rounds = []
    while not fresh.isEmpty():
        rounds.append(fresh.drop("_path"))
        step = fresh.join(edges, (F.col("stop") == F.col("src")) & ~F.array_contains("_path", F.col("_edge")))
        fresh = checkpointed(step.select("start", F.col("dst").alias("stop"), (F.col("hops") + 1).alias("hops"), F.array_append("_path", F.col("_edge")).alias("_path")))
    return reduce(DataFrame.unionByName, rounds or [fresh.drop("_path")])


def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """a, b for all b that can be reached from a, a itself only over a circle.

    Semi-naive with doubling: each round joins what is new with all that is known, so rounds are logarithmic in the
    longest path. Every round is written to the checkpoint folder, which all executors share.
    """
    known = checkpointed(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    fresh = known
    for _ in range(most_rounds):
        step = fresh.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        fresh = checkpointed(step.join(known, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = checkpointed(known.unionByName(fresh))
    raise RuntimeError(f"the closure did not settle in {most_rounds} rounds")


def predecessors(activities: DataFrame, edges: DataFrame) -> DataFrame:
    """process_id, activity, predecessor: activities from which another of the same process can be reached.

    Ids may occur again in other processes. In a process without any edge all earlier activities by seq are predecessors.
    activities: process_id, id, seq. edges: process_id, src, dst; what lies between may be gateways or events.
    """
    node = lambda c: F.struct("process_id", F.col(c).alias("id"))
    reach = closure(edges.select(node("src").alias("src"), node("dst").alias("dst"))).select(F.col("a.process_id").alias("process_id"), F.col("a.id").alias("predecessor"), F.col("b.id").alias("activity"))
    ids = activities.select("process_id", "id", "seq")
    found = reach.join(ids.select("process_id", F.col("id").alias("activity")), ["process_id", "activity"], "left_semi").join(ids.select("process_id", F.col("id").alias("predecessor")), ["process_id", "predecessor"], "left_semi").where("activity <> predecessor")
    bare = ids.join(edges.select("process_id").distinct(), "process_id", "left_anti")
    earlier = bare.alias("x").join(bare.alias("y"), (F.col("x.process_id") == F.col("y.process_id")) & (F.col("y.seq") < F.col("x.seq")))
    earlier = earlier.select(F.col("x.process_id").alias("process_id"), F.col("x.id").alias("activity"), F.col("y.id").alias("predecessor"))
    return found.select("process_id", "activity", "predecessor").unionByName(earlier)
