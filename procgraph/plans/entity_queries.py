"""Queries over extracted entities: scopes, pools, mappings, evidence, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.functions.text import flow_id
from procgraph.operators import entities, graph, render
from procgraph.plans.graph_queries import grid_layout
from procgraph.plans.registry import query
from procgraph.plans.text_queries import FIELDS, KEY, USERS, _artifact_parts, _users
from procgraph.sources.tables import conversations, graph_edges, order_lines, table, user_events

def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


@query("SELECT p_partkey AS id, CASE WHEN p_size < 25 THEN p_brand ELSE (SELECT min(p_brand) FROM part) END AS process_id FROM part")
def process_scope_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 25, F.col("p_brand")).otherwise("").alias("process_id"))
    brands = p.select(F.col("p_brand").alias("proc_id"), F.col("p_brand").alias("seq")).distinct()
    return entities.scoped(rows, brands).select("id", "process_id")


@query("SELECT CASE WHEN length(p_name) > 12 THEN left(p_name, 12) || '…' ELSE p_name END AS p_name, CASE WHEN length(p_type) > 9 THEN left(p_type, 9) || '…' ELSE p_type END AS p_type FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 80)")
def compact_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt gets of the first 80 parts."""
    return entities.compact(table(spark, sf_dir, "part"), {"p_name": 12, "p_type": 9}, 80, "p_partkey")


@query("SELECT event_type AS label, count(*) AS n FROM events WHERE NOT starts_with(event_type, 'c') GROUP BY 1")
def stats_without_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.without_prefix(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n")), "c")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'resolved' END AS state FROM orders")
def question_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise(F.col("o_orderstatus")).alias("status"))
    done, still = entities.split_questions(q)
    return done.select("id", F.lit("resolved").alias("state")).unionByName(still.select("id", F.lit("open").alias("state")))


@query("SELECT 'HAS_TASK' AS rel, l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def parent_links_where_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines without a finished order have no parent."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.when(F.col("l_linenumber") > 0, F.col("l_orderkey")).alias("parent_id"))
    return entities.parent_links("HAS_TASK", li, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


@query(
    """WITH m AS (SELECT lower(split_part(p_name, ' ', 1)) AS n, lower(p_brand) AS target, p_partkey AS ord FROM part),
       t AS (SELECT lower(p_brand) AS target, arg_max('b' || p_size, (p_partkey, 'b' || p_size)) AS target_id FROM part WHERE p_size < 40 GROUP BY 1),
       h AS (SELECT m.n, arg_min(p_partkey, p_partkey) AS task_id FROM (SELECT DISTINCT n FROM m) m JOIN part ON contains(lower(p_name), m.n) GROUP BY 1)
       SELECT task_id, arg_max(target_id, (ord, target_id)) AS target_id FROM m JOIN t USING (target) JOIN h USING (n) GROUP BY task_id"""
)
def explicit_mapping_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of names as mapped tasks, brands as what they are mapped to."""
    p = table(spark, sf_dir, "part")
    mappings = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("task_name"), F.col("p_brand").alias("target_name"), F.col("p_partkey").alias("seq"))
    tasks = p.select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    targets = p.where("p_size < 40").select(_key("b", "p_size").alias("id"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("seq"))
    return entities.explicit(mappings, tasks, targets)


_LABELS = (("Process", "supplier", "s_suppkey"), ("Task", "customer", "c_custkey"), ("DMNRule", "part", "p_partkey"))


@query(
    """WITH e AS (SELECT 0 AS k, 'Process' AS label, s_suppkey AS id FROM supplier UNION ALL SELECT 1, 'Task', c_custkey FROM customer UNION ALL SELECT 2, 'DMNRule', p_partkey FROM part),
       f AS (SELECT id, arg_min(label, k) AS label FROM e GROUP BY id)
       SELECT DISTINCT label, l_partkey AS src, l_orderkey AS dst FROM lineitem JOIN f ON id = l_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""
)
def evidence_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id that suppliers, customers and parts may have belongs to the first of them that has it."""
    every = None
    for label, name, key in _LABELS:
        rows = table(spark, sf_dir, name).select(F.lit(label).alias("label"), F.col(key).alias("id"))
        every = rows if every is None else every.unionByName(rows)
    chunks = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chunk_id"))
    return entities.labelled_evidence(every, chunks, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id")))


@query("SELECT process_id, ord AS page, left(text, 200) AS snippet FROM conv QUALIFY row_number() OVER (PARTITION BY process_id ORDER BY ord, seq) = 1", "conv")
def evidence_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.snippets(conversations(spark, sf_dir).select("process_id", F.col("order").alias("page"), F.col("seq").alias("chunk_no"), "text"), "process_id")


@query(
    f"""WITH {USERS}, {FIELDS}, a AS (SELECT p_partkey AS activity_id, left(p_type, 6) AS role, {KEY.format("p_name || ' ' || (CASE WHEN p_size < 10 THEN 'seg' || p_size ELSE p_brand END) || ' '")} AS k FROM part),
        b AS (SELECT * FROM a WHERE NOT contains(k, 'red')),
        r AS (SELECT activity_id, user_id FROM b JOIN fl ON is_agent AND ({KEY.format("b.role")} <> '' AND (contains({KEY.format("b.role")}, v) OR contains(v, {KEY.format("b.role")})))
              QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY {KEY.format("b.role")} <> v, seq, f) = 1),
        t AS (SELECT activity_id, arg_min(user_id, seq) AS user_id FROM b JOIN fl ON is_agent AND (contains(k, v) OR contains(v, k)) GROUP BY 1)
        SELECT activity_id, coalesce(r.user_id, t.user_id) AS user_id FROM b LEFT JOIN r USING (activity_id) LEFT JOIN t USING (activity_id) WHERE coalesce(r.user_id, t.user_id) IS NOT NULL"""
)
def heuristic_agent_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as activities; what is red needs a human."""
    p = table(spark, sf_dir, "part")
    said = F.when(F.col("p_size") < 10, _key("seg", "p_size")).otherwise(F.col("p_brand"))
    acts = p.select(F.col("p_partkey").alias("activity_id"), F.left("p_type", F.lit(6)).alias("role"), F.col("p_name").alias("name"), said.alias("instruction"), F.lit(None).cast("string").alias("description"))
    return entities.heuristic_agent(acts, _users(spark, sf_dir), ("red",))


@query("SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'n' || s_nationkey END AS process_ref FROM supplier WHERE s_suppkey % 5 = 0 OR s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def collaboration_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(_key("s", "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 != 0, _key("n", "s_nationkey")).alias("process_ref"))
    return entities.participants(s, table(spark, sf_dir, "nation").where("n_regionkey < 3").select(_key("n", "n_nationkey").alias("proc_id")))


@query(
    """WITH g AS (SELECT arg_min(p_partkey, p_partkey) AS proc_id, list(p_brand ORDER BY p_partkey) AS ds FROM part GROUP BY lower(trim(p_name)))
       SELECT proc_id, list_reduce(ds, lambda a, d: CASE WHEN contains(a, d) THEN a ELSE a || ' ' || d END) AS description FROM g"""
)
def appended_process_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return entities.appended_descriptions(p.select(F.col("p_partkey").alias("proc_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("description"), F.col("p_partkey").alias("seq")))


@query(
    """, f AS (SELECT left(regexp_replace('SequenceFlow_' || src || '_' || dst, '[^0-9A-Za-z_-]', '_', 'g'), 240) AS flow_id, src, dst FROM nx)
       SELECT task_id AS id, coalesce((SELECT string_agg(flow_id, ',' ORDER BY flow_id) FROM f WHERE dst = task_id), '') AS incoming, coalesce((SELECT string_agg(flow_id, ',' ORDER BY flow_id) FROM f WHERE src = task_id), '') AS outgoing FROM conv""",
    "conv",
    "nx",
)
def node_flow_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    flows = graph.successors(c).select(flow_id("src", "dst").alias("flow_id"), "src", "dst", F.lit(0).alias("seq"))
    return entities.flow_lists(c.select(F.col("task_id").alias("id")), flows)


@query(
    """, e AS (SELECT 'HAS_TASK' AS rel, process_id AS src, task_id AS dst FROM li UNION ALL SELECT 'PERFORMED_BY', task_id, role_id FROM li UNION ALL SELECT 'NEXT', src, dst FROM lnx)
       SELECT rel, count(*) AS keys, sum(n)::BIGINT AS total FROM (SELECT rel, src, count(DISTINCT dst) AS n FROM e GROUP BY 1, 2) GROUP BY 1""",
    "li",
    "lnx",
)
def relationship_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.map_sizes(graph_edges(order_lines(spark, sf_dir), "role_id"))


@query(
    """, g AS (SELECT process_id, role, (140 + 150 * (row_number() OVER (PARTITION BY process_id ORDER BY seq, task_id) - 1))::INT AS x FROM conv), m AS (SELECT process_id, role, avg(x) AS mean FROM g GROUP BY 1, 2)
       SELECT process_id, role, mean, row_number() OVER (PARTITION BY process_id ORDER BY mean, role)::INT AS rank FROM m""",
    "conv",
)
def lane_mean_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = conversations(spark, sf_dir).select("process_id", F.col("task_id").alias("id"), "role")
    return entities.mean_positions(grid_layout(spark, sf_dir).join(roles, ["process_id", "id"]), "role", "x")


@query("SELECT process_id, count(*) FILTER (WHERE kind = 'task') AS n_task, count(*) FILTER (WHERE kind = 'gateway') AS n_gateway FROM ev GROUP BY 1", "ev")
def element_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.type_counts(user_events(spark, sf_dir), ("task", "gateway"))


@query("SELECT role, string_agg(task_id || '=' || left(name, 20), ',' ORDER BY process_id, seq, task_id) AS activities FROM conv WHERE trim(role) <> '' GROUP BY 1", "conv")
def activities_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir).select("role", F.struct("process_id", "seq").alias("seq"), F.col("task_id").alias("id"), F.left("name", F.lit(20)).alias("name"))
    got = entities.by_role(c)
    return got.select("role", F.array_join(F.transform("activities", lambda x: F.concat(x["id"], F.lit("="), x["name"])), ",").alias("activities"))


@query("WITH n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_partkey, l_suppkey FROM n QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1")
def most_common_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.most_common(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query(
    """WITH b AS (SELECT 0 AS side, c_mktsegment AS name, c_custkey AS seq FROM customer UNION ALL SELECT 1, lower(c_mktsegment), c_custkey FROM customer UNION ALL SELECT 1, p_type, p_partkey FROM part)
       SELECT arg_min(name, (side, seq, name)) AS name FROM b WHERE trim(name) <> '' GROUP BY lower(trim(name))"""
)
def role_candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("seq"))
    used = c.withColumn("name", F.lower("name")).unionByName(table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("seq")))
    return entities.candidate_pool(c, used)


@query(
    """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || '. ' || p_type END AS search_text, 'formHandler:' || p_brand || '_' || p_partkey || '_form' AS tool,
              CASE WHEN p_size % 4 = 0 THEN 'create_agent' WHEN p_size % 5 <> 0 AND p_size / 50.0 >= 0.72 THEN 'map' ELSE 'none' END AS action FROM part"""
)
def decisions_and_search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences are sizes by 50; every fifth is no number."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), "p_name", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("d"), "p_brand", F.col("p_partkey").cast("string").alias("a"), F.when(F.col("p_size") % 4 == 0, "create_agent").otherwise("map").alias("wish"), F.when(F.col("p_size") % 5 == 0, "high").otherwise((F.col("p_size") / 50).cast("string")).alias("conf"))
    return rows.select("id", entities.search_text("p_name", "d").alias("search_text"), entities.default_tool("p_brand", "a").alias("tool"), entities.decided("wish", "conf").alias("action"))


@query("SELECT DISTINCT process_id AS proc_id, process_id || '.bpmn' AS filename, true AS is_xml FROM conv", "conv")
def served_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = render.bpmn_xml(*_artifact_parts(spark, sf_dir))
    column = next(c for c in xml.columns if c != "proc_id")
    return entities.artifacts(xml, column, ".bpmn").select("proc_id", "filename", F.col("content").contains("definitions").alias("is_xml"))
