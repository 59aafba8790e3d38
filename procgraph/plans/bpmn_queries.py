"""Queries over whole process diagrams. Conversations are processes, their turns tasks, their speakers lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.operators import bpmn
from procgraph.plans.registry import query
from procgraph.sources.tables import conversations


def conversation_model(spark: SparkSession, sf_dir: str) -> bpmn.Model:
    """Turns whose number divides by 5 have no lane. A gateway for each conversation lies between its first and last turn; every third turn leads on under a condition."""
    c = conversations(spark, sf_dir).withColumnRenamed("process_id", "proc_id")
    w = W.partitionBy("proc_id").orderBy("order", "seq", "task_id")
    tasks = c.select("proc_id", "task_id", "name", F.col("text").alias("description"), F.when(F.col("order") % 5 != 0, F.col("role")).alias("role_id"), "order", "seq")
    ends = tasks.groupBy("proc_id").agg(F.min_by("task_id", F.struct("order", "seq", "task_id")).alias("first"), F.max_by("task_id", F.struct("order", "seq", "task_id")).alias("last"))
    gate = F.concat(F.lit("g_"), F.col("proc_id"))
    flow = lambda df, src, st, dst, dt, cond, seq: df.select("proc_id", src.alias("src"), F.lit(st).alias("src_type"), dst.alias("dst"), F.lit(dt).alias("dst_type"), F.lit(cond).alias("condition"), F.lit(seq).cast("long").alias("seq"))
    nxt = tasks.withColumn("next", F.lead("task_id").over(w)).where("next IS NOT NULL AND order % 3 = 0")
    flows = flow(ends, F.col("first"), "Task", gate, "Gateway", "", 0).unionByName(flow(ends, gate, "Gateway", F.col("last"), "Task", 'a < b & "c"', 1)).unionByName(flow(nxt, F.col("task_id"), "Task", F.col("next"), "Task", "then", 2))
    roles = tasks.where("role_id <> ''").select("proc_id", "role_id").distinct().select("proc_id", "role_id", F.concat(F.lit("The "), "role_id").alias("name"), F.lit(0).alias("seq"))
    processes = ends.select("proc_id", F.concat(F.lit("Talk "), "proc_id").alias("name"))
    gates = ends.select("proc_id", gate.alias("gateway_id"), F.lit("parallel").alias("kind"), F.lit("").alias("description"), F.lit("ask").alias("condition"), F.lit(0).alias("seq"))
    data = ends.select("proc_id", F.lit("topic").alias("name"), F.lit("what it's about").alias("description"), F.lit("string").alias("type"), F.lit(0).alias("seq"))
    return bpmn.Model(processes, roles, tasks, gates, flows, data, width=200)


_CTE = """
WITH t AS (SELECT process_id AS p, task_id, name, text, CASE WHEN ord % 5 <> 0 THEN role END AS r, ord, seq, 'Activity_' || task_id AS ref, row_number() OVER w - 1 AS i, lead(task_id) OVER w AS nx FROM (SELECT 'p' || conv_id AS process_id, 't_' || conv_id || '_' || turn AS task_id, turn::INT AS ord, turn AS seq, role, text, coalesce(text, '') AS name FROM conversations) WINDOW w AS (PARTITION BY process_id ORDER BY ord, seq, task_id)),
e AS (SELECT p, arg_min(ref, i) AS first, arg_max(ref, i) AS last, count(*) AS nt, 'Gateway_g_' || p AS gate FROM t GROUP BY p),
a AS (SELECT p, 'Event_Start' AS src, first AS dst, '' AS condition, 0 AS k, 0 AS n FROM e
UNION ALL SELECT p, first, gate, '', 1, 0 FROM e
UNION ALL SELECT p, gate, last, 'a < b & "c"', 1, 1 FROM e
UNION ALL SELECT p, ref, 'Activity_' || nx, 'then', 1, 2 FROM t WHERE nx IS NOT NULL AND ord % 3 = 0
UNION ALL SELECT p, ref, 'Activity_' || nx, '', 2, i FROM t WHERE nx IS NOT NULL
UNION ALL SELECT p, last, 'Event_End', '', 3, 0 FROM e),
f AS (SELECT *, left(regexp_replace('SequenceFlow_' || src || '_' || dst, '[^0-9A-Za-z_-]', '_', 'g'), 240) AS id FROM a QUALIFY row_number() OVER (PARTITION BY p, id ORDER BY k, n) = 1),
l AS (SELECT p, r, row_number() OVER (PARTITION BY p ORDER BY r) - 1 AS lane FROM (SELECT DISTINCT p, r FROM t WHERE r <> '')),
c AS (SELECT p, count(*) AS nl FROM l GROUP BY p),
n AS (SELECT p, ref, 'activity' AS kind, 'userTask' AS type, name, coalesce('The ' || r, '미분류') AS role, 140 + 150 * i AS x, 20 + 120 * CASE WHEN coalesce(r, '') = '' THEN coalesce(nl, 0) ELSE lane END AS y, 100 AS w, 80 AS h FROM t LEFT JOIN l USING (p, r) LEFT JOIN c USING (p)
UNION ALL SELECT p, gate, 'gateway', 'parallelGateway', 'ask', '', 140 + 150 * nt, 35, 50, 50 FROM e
UNION ALL SELECT p, 'Event_Start', 'event', 'startEvent', 'Start', coalesce('The ' || (SELECT max(r) FROM l WHERE l.p = e.p), ''), 40, 43, 34, 34 FROM e
UNION ALL SELECT p, 'Event_End', 'event', 'endEvent', 'End', coalesce('The ' || (SELECT max(r) FROM l WHERE l.p = e.p), ''), 140 + 150 * (nt + 1) + 80, 43, 34, 34 FROM e)
"""


@query(_CTE + "SELECT p AS proc_id, id AS flow_id, src, dst, condition FROM f")
def bpmn_flow_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpmn.assembled(conversation_model(spark, sf_dir)).select("proc_id", "flow_id", "src", "dst", "condition")


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpmn.read(bpmn.documents(conversation_model(spark, sf_dir)).withColumnRenamed("proc_id", "doc"))


@query(_CTE + "SELECT p AS doc, kind, type, ref AS id, regexp_replace(name, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS name, role, 'Process_' || p AS process, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM n")
def bpmn_diagram_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the diagrams, written and read again, with lanes and bounds."""
    return bpmn.nodes(_read(spark, sf_dir))


@query(_CTE + "SELECT f.p AS doc, id, condition AS name, src AS source, dst AS target, condition, (a.x + a.w) || ',' || (a.y + a.h // 2) || ' ' || b.x || ',' || (b.y + b.h // 2) AS points FROM f JOIN n a ON a.p = f.p AND a.ref = src JOIN n b ON b.p = f.p AND b.ref = dst")
def bpmn_diagram_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of the diagrams, written and read again, with their way points."""
    return bpmn.sequences(_read(spark, sf_dir))


@query(
    _CTE
    + """SELECT p AS doc, kind, type, ref AS id, regexp_replace(name, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS name, '' AS source, '' AS target FROM n UNION ALL SELECT p, 'sequence', 'sequenceFlow', id, condition, src, dst FROM f
       UNION ALL SELECT p, 'participant', '', 'Participant_' || p, 'Talk ' || p, '', '' FROM e UNION ALL SELECT p, 'role', '', 'Lane_' || r, 'The ' || r, '', '' FROM l UNION ALL SELECT DISTINCT p, 'role', '', 'Lane_Unassigned', '미분류', '', '' FROM t WHERE coalesce(r, '') = ''"""
)
def bpmn_broken_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same diagrams with their last tag cut off, which no parser takes."""
    broken = bpmn.documents(conversation_model(spark, sf_dir)).select(F.col("proc_id").alias("doc"), F.regexp_replace("xml", "</bpmn:definitions>$", "").alias("xml"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return bpmn.read(broken).where("fallback").select("doc", "kind", *[blank(c) for c in ("type", "id", "name", "source", "target")])
