"""Queries from payloads of an extraction to a whole graph. Orders are sections of a customer's document, their lines tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.operators import extraction
from procgraph.plans.registry import query
from procgraph.sources.tables import table


def order_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, section_no, section_id, payload: what an extraction might say of orders; every list of it is in use."""
    li = table(spark, sf_dir, "lineitem")
    role = lambda c: F.concat(F.lit("ole "), (F.col(c) % 9).cast("string"))
    line = li.select(
        "l_orderkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("by"),
        F.struct(
            F.when(F.col("l_partkey") % 5 == 0, F.col("l_returnflag")).otherwise(F.concat("l_returnflag", "l_linestatus", F.lit(" "), F.col("l_linenumber").cast("string"))).alias("name"),
            F.when(F.col("l_suppkey") % 3 == 0, F.lit("AGENT")).alias("task_type"),
            F.concat(F.lit("R"), role("l_suppkey")).alias("performer_role"),
            F.when(F.col("l_partkey") % 3 == 1, F.concat(F.col("l_linenumber").cast("string"), F.lit(".7"))).when(F.col("l_partkey") % 3 == 2, F.lit("x")).alias("order"),
            F.when(F.col("l_linestatus") == "O", F.lower("l_returnflag")).alias("next_task"),
            F.col("l_linenumber").alias("n"),
            F.col("l_returnflag").alias("flag"),
            F.concat("l_returnflag", "l_linestatus").alias("both"),
            (F.col("l_partkey") % 2 == 0).alias("even"),
            F.concat(F.lit("r"), role("l_partkey")).alias("other_role"),
        ).alias("x"),
    )
    lines = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("by", "x"))), lambda r: r["x"]).alias("xs"))
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").withColumn("xs", F.coalesce("xs", F.array().cast(lines.schema["xs"].dataType)))
    at = lambda n: F.filter("xs", lambda x: x["n"] == n)
    p = F.col("o_orderpriority")
    payload = F.struct(
        F.when(F.col("o_orderstatus") == "F", F.array(F.struct(p.alias("name"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("description")))).alias("processes"),
        F.transform(F.filter("xs", lambda x: x["flag"] == "R"), lambda x: F.struct(x["performer_role"].alias("name"), x["both"].alias("org_unit"))).alias("roles"),
        F.transform("xs", lambda x: F.struct(x["name"], x["task_type"], x["performer_role"], F.when(x["n"] % 2 == 0, F.lower(p)).alias("parent_process"), x["order"], x["next_task"])).alias("tasks"),
        F.transform(at(1), lambda x: F.struct(F.lit("Parallel").alias("gateway_type"), F.lit("1-URGENT").alias("parent_process"), x["both"].alias("condition"))).alias("gateways"),
        F.when(F.col("o_orderstatus") == "O", F.array(F.struct(F.lit("END").alias("event_type"), F.lit("done").alias("name")))).alias("events"),
        F.transform(at(2), lambda x: F.struct(x["flag"].alias("name"), x["performer_role"].alias("related_role"))).alias("decisions"),
        F.transform(at(3), lambda x: F.struct(x["both"].alias("condition"), x["flag"].alias("then"))).alias("rules"),
        F.transform(at(1), lambda x: F.struct(x["flag"].alias("task_name"), x["other_role"].alias("role_name"))).alias("task_role_mappings"),
        F.transform(at(3), lambda x: F.struct(x["flag"].alias("task_name"), F.lit("3-Medium").alias("process_name"))).alias("task_process_mappings"),
        F.transform(F.filter("xs", lambda x: x["n"] <= 2), lambda x: F.struct(x["both"].alias("from_task"), F.when(x["even"], F.lit("gate")).otherwise(F.lit("n")).alias("to_task"), F.lit(" if ").alias("condition"))).alias("sequence_flows"),
    )
    key = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("```json\n"), F.to_json(payload), F.lit("\n```"))
    return o.select(F.concat(F.lit("c"), key("o_custkey")).alias("doc_id"), F.col("o_orderkey").alias("section_no"), F.concat(F.lit("s"), key("o_orderkey")).alias("section_id"), text.alias("payload"))


#: The same sections in SQL, and their names looked up as of each section.
_CTE = """
WITH o AS (SELECT 'c' || o_custkey AS d, o_orderkey AS s, lower(o_orderpriority) AS pk, * FROM orders),
x AS MATERIALIZED (SELECT o.d, o.s, o.pk, row_number() OVER (PARTITION BY s ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_linenumber AS n, l_returnflag AS flag, l_returnflag || l_linestatus AS both_, l_partkey, l_linestatus,
        CASE WHEN l_partkey % 5 = 0 THEN l_returnflag ELSE l_returnflag || l_linestatus || ' ' || l_linenumber END AS name, 'role ' || (l_suppkey % 9) AS rk, 'role ' || (l_partkey % 9) AS ork, l_suppkey % 3 = 0 AS agent,
        CASE WHEN l_partkey % 3 = 1 THEN l_linenumber ELSE row_number() OVER (PARTITION BY s ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 END AS ord FROM o JOIN lineitem ON l_orderkey = s),
pd AS (SELECT d, s, pk AS k, 'process:' || d || ':' || s || ':0' AS id FROM o WHERE o_orderstatus = 'F'),
rd AS (SELECT d, s, rk AS k, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS j, both_ FROM x WHERE flag = 'R'),
rf AS MATERIALIZED (SELECT d, k, s, j, 'role:' || d || ':' || s || ':' || j AS id, both_ FROM rd QUALIFY row_number() OVER (PARTITION BY d, k ORDER BY s, j) = 1),
pq AS (SELECT DISTINCT o.d, o.s, v.k FROM o, (SELECT lower(o_orderpriority) AS k FROM orders GROUP BY 1) v),
po AS MATERIALIZED (SELECT pq.d, pq.s, pq.k, pd.id FROM pq ASOF JOIN pd ON pq.d = pd.d AND pq.k = pd.k AND pq.s >= pd.s),
pf AS (SELECT s, id FROM pd),
t0 AS (SELECT x.*, 'task:' || x.d || ':' || x.s || ':' || x.i AS id, coalesce(CASE WHEN n % 2 = 0 THEN po.id END, pf.id, '') AS p0, rf.id AS r0
       FROM x LEFT JOIN po ON po.d = x.d AND po.s = x.s AND po.k = x.pk LEFT JOIN pf ON pf.s = x.s LEFT JOIN rf ON rf.d = x.d AND rf.k = x.rk AND rf.s <= x.s),
mt AS (SELECT m.s, m.i AS m, m.n, m.ork, m.d, min(t.i) AS at FROM x m JOIN x t ON t.s = m.s AND contains(lower(t.name), lower(m.flag)) WHERE m.n IN (1, 3) GROUP BY ALL),
mr AS (SELECT mt.s, mt.at, arg_max(rf.id, m) AS id FROM mt JOIN rf ON rf.d = mt.d AND rf.k = mt.ork AND rf.s <= mt.s WHERE n = 1 GROUP BY 1, 2),
mp AS (SELECT mt.s, mt.at, arg_max(po.id, m) AS id FROM mt JOIN po ON po.d = mt.d AND po.s = mt.s AND po.k = '3-medium' WHERE n = 3 GROUP BY 1, 2),
t AS MATERIALIZED (SELECT t0.*, coalesce(mp.id, p0) AS p, coalesce(mr.id, r0) AS r FROM t0 LEFT JOIN mp ON mp.s = t0.s AND mp.at = t0.i LEFT JOIN mr ON mr.s = t0.s AND mr.at = t0.i),
g AS (SELECT d, s, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS j, both_ FROM x WHERE n = 1),
"""

_NODES = (
    _CTE
    + """
n AS (
SELECT d, s, 'Process' AS label, 'process:' || d || ':' || s || ':0' AS id, 'process:' || d || ':' || s || ':0' AS process_id, o_orderpriority AS name, '' AS kind, 'd' || s AS description, '' AS detail, NULL::INT AS ord FROM o WHERE o_orderstatus = 'F'
UNION ALL SELECT d, s, 'Role', id, '', 'R' || k[2:], '', '', both_, NULL FROM rf
UNION ALL SELECT d, s, 'Task', id, p, name, CASE WHEN agent THEN 'agent' ELSE 'human' END, '', '', ord FROM t
UNION ALL SELECT g.d, g.s, 'Gateway', 'gateway:' || g.d || ':' || g.s || ':' || j, coalesce(po.id, pf.id, ''), '', 'parallel', '', both_, NULL FROM g LEFT JOIN po ON po.s = g.s AND po.k = '1-urgent' LEFT JOIN pf ON pf.s = g.s
UNION ALL SELECT d, o.s, 'Event', 'event:' || d || ':' || o.s || ':0', coalesce(pf.id, ''), 'done', 'end', '', '', NULL FROM o LEFT JOIN pf ON pf.s = o.s WHERE o_orderstatus = 'O'
UNION ALL SELECT d, s, 'DMNDecision', 'decision:' || d || ':' || s || ':' || (row_number() OVER (PARTITION BY s ORDER BY i) - 1), '', flag, '', '', '{"input":[],"output":[]}', NULL FROM x WHERE n = 2
UNION ALL SELECT d, s, 'DMNRule', 'rule:' || d || ':' || s || ':' || (row_number() OVER (PARTITION BY s ORDER BY i) - 1), '', both_, '1.0', flag, '', NULL FROM x WHERE n = 3)
"""
)


@query(_NODES + "SELECT d AS doc_id, s AS section_no, label, id, process_id, name, kind, description, detail, ord::INT AS ord FROM n")
def extraction_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(order_payloads(spark, sf_dir)).nodes


@query(
    _NODES
    + """
, e AS (SELECT d, s, 'HAS_TASK' AS rel, p AS src, id AS dst FROM t WHERE p <> ''
UNION ALL SELECT d, s, 'PERFORMED_BY', id, r FROM t WHERE r IS NOT NULL
UNION ALL SELECT x.d, x.s, 'MAKES_DECISION', rf.id, 'decision:' || x.d || ':' || x.s || ':' || x.j FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS j FROM x WHERE n = 2) x JOIN rf ON rf.d = x.d AND rf.k = x.rk AND rf.s <= x.s
UNION ALL SELECT d, s, 'SUPPORTED_BY', id, 's' || s FROM n)
SELECT d AS doc_id, s AS section_no, rel, src, dst FROM e"""
)
def extraction_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(order_payloads(spark, sf_dir)).edges


@query(
    _CTE
    + """
gl AS (SELECT s, 'gateway:' || d || ':' || s || ':' || max(j) AS id FROM g GROUP BY s, d),
q AS (SELECT s, i, d, lower(both_) AS a, CASE WHEN l_partkey % 2 = 0 THEN 'gate' ELSE 'n' END AS b FROM x WHERE n <= 2),
qt AS (SELECT q.s, q.d, q.i, arg_min(t.id, t.i) FILTER (WHERE contains(lower(t.name), q.a) OR contains(q.a, lower(t.name))) AS ta, arg_min(t.id, t.i) FILTER (WHERE contains(lower(t.name), q.b) OR contains(q.b, lower(t.name))) AS tb FROM q JOIN t ON t.s = q.s GROUP BY ALL),
ends AS (SELECT qt.*, gl.id AS gl FROM qt LEFT JOIN gl ON gl.s = qt.s),
f0 AS (SELECT d, s, coalesce(ta, gl) AS src, CASE WHEN ta IS NULL THEN 'gateway' ELSE 'task' END AS src_type, coalesce(tb, gl) AS dst, CASE WHEN tb IS NULL THEN 'gateway' ELSE 'task' END AS dst_type, 'if' AS condition, 0 AS source FROM ends WHERE coalesce(ta, gl) IS NOT NULL AND coalesce(tb, gl) IS NOT NULL),
f1 AS (SELECT a.d, a.s, a.id AS src, 'task' AS src_type, arg_min(b.id, b.i) AS dst, 'task' AS dst_type, '' AS condition, 1 AS source FROM t a JOIN t b ON a.s = b.s AND contains(lower(b.name), lower(a.flag)) WHERE a.l_linestatus = 'O' GROUP BY ALL),
f AS MATERIALIZED (SELECT * FROM f0 UNION ALL SELECT * FROM f1),
c AS (SELECT d, s, id AS src, lead(id) OVER (PARTITION BY s, p ORDER BY ord, i) AS dst FROM t),
f2 AS (SELECT d, s, src, 'task', dst, 'task', '', 2 FROM c WHERE dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.src = c.src AND f.dst = c.dst))
SELECT d AS doc_id, s AS section_no, src, src_type, dst, dst_type, condition, source FROM (SELECT * FROM f UNION ALL SELECT * FROM f2)"""
)
def extraction_graph_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(order_payloads(spark, sf_dir)).flows
