"""Queries over the graph: lists, details, flows, statistics, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.functions.text import flow_id, or_else
from procgraph.operators import graph, layout, model
from procgraph.plans.registry import query
from procgraph.sources.tables import conversations, graph_edges, order_lines, table, user_events


def names_of(tasks: DataFrame, *more: str) -> DataFrame:
    out = tasks.select(F.col("task_id").alias("id"), "name")
    for c in more:
        out = out.unionByName(tasks.select(F.col(c).alias("id"), F.col(c).alias("name")).distinct())
    return out


@query("SELECT process_id, count(DISTINCT task_id) AS n_tasks, count(DISTINCT role) AS n_roles FROM conv GROUP BY process_id", "conv")
def process_list_task_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).groupBy("process_id").agg(F.count_distinct("task_id").alias("n_tasks"), F.count_distinct("role").alias("n_roles"))


@query(
    "SELECT process_id AS proc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS tasks, '' AS gateways, '' AS events, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conv GROUP BY process_id",
    "conv",
)
def process_detail_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = conversations(spark, sf_dir)
    return graph.process_detail(tasks.select(F.col("process_id").alias("proc_id")).distinct(), graph_edges(tasks, "role"), names_of(tasks, "role"))


@query(
    """SELECT c.task_id, c.name, coalesce(a.name, '') AS next_names, coalesce(b.name, '') AS prev_names FROM conv c LEFT JOIN nx x ON x.src = c.task_id LEFT JOIN conv a ON a.task_id = x.dst
       LEFT JOIN nx y ON y.dst = c.task_id LEFT JOIN conv b ON b.task_id = y.src""",
    "conv",
    "nx",
)
def task_list_with_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = conversations(spark, sf_dir)
    return graph.neighbours(tasks, graph.successors(tasks)).select("task_id", "name", "next_names", "prev_names")


@query("SELECT process_id, task_id, role_id FROM li WHERE contains(task_id, '_77') OR contains(role_id, '77')", "li")
def task_detail_by_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).where(F.col("task_id").contains("_77") | F.col("role_id").contains("77")).select("process_id", "task_id", "role_id")


@query(
    """SELECT * EXCLUDE (k) FROM (SELECT l_partkey AS term, kind, id, k, FROM (SELECT DISTINCT l_partkey FROM lineitem) JOIN (
         SELECT 0 AS k, 'Task' AS kind, p_partkey AS key, p_name AS id FROM part WHERE p_size < 10 UNION ALL SELECT 1, 'Gateway', p_partkey, p_brand FROM part WHERE p_size < 30 UNION ALL SELECT 2, 'Event', p_partkey, p_type FROM part) ON key = l_partkey
       QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY k) = 1)"""
)
def element_lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an element is: a task if there is one, else a gateway, else an event."""
    part = table(spark, sf_dir, "part")
    kinds = [(0, "Task", "p_name", F.col("p_size") < 10), (1, "Gateway", "p_brand", F.col("p_size") < 30), (2, "Event", "p_type", F.lit(True))]
    found = [part.where(c).select(F.lit(k).alias("k"), F.lit(n).alias("kind"), "p_partkey", F.col(i).alias("id")) for k, n, i, c in kinds]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("term")).distinct()
    best = every.groupBy("p_partkey").agg(F.min_by(F.struct("kind", "id"), "k").alias("b"))
    return asked.join(best, asked["term"] == best["p_partkey"]).select("term", "b.kind", "b.id")


@query(
    "SELECT role_id, count(DISTINCT task_id) AS n_tasks, count(DISTINCT decision_id) AS n_decisions, min(process_id) AS first_process FROM li GROUP BY role_id",
    "li",
)
def role_list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).groupBy("role_id").agg(F.count_distinct("task_id").alias("n_tasks"), F.count_distinct("decision_id").alias("n_decisions"), F.min("process_id").alias("first_process"))


@query("SELECT decision_id, count(DISTINCT task_id) AS n_rules, string_agg(DISTINCT condition, ',' ORDER BY condition) AS inputs FROM li GROUP BY decision_id", "li")
def decision_list_rule_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).groupBy("decision_id").agg(F.count_distinct("task_id").alias("n_rules"), F.array_join(F.array_sort(F.collect_set("condition")), ",").alias("inputs"))


@query("SELECT src, dst FROM lnx", "li", "lnx")
def sequence_flows_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.successors(order_lines(spark, sf_dir)).select("src", "dst")


@query("SELECT process_id AS proc_id, src, dst, '' AS condition FROM nx", "conv", "nx")
def sequence_flows_by_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.process_flows(graph_edges(conversations(spark, sf_dir), "role"))


@query(
    """, n AS (SELECT 'Process' AS label, count(*) AS n FROM orders UNION ALL SELECT 'Task', count(*) FROM lineitem UNION ALL SELECT 'Role', count(*) FROM supplier UNION ALL SELECT 'Document', count(*) FROM documents)
       SELECT label, coalesce(n, 0) AS n FROM (SELECT unnest(['Document', 'Section', 'Process', 'Task', 'Role', 'Gateway', 'Event', 'Skill', 'DMNDecision', 'DMNRule']) AS label) LEFT JOIN n USING (label)""".replace(", n AS", "WITH n AS", 1)
)
def graph_stats_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = {"Process": "orders", "Task": "lineitem", "Role": "supplier", "Document": "documents"}
    parts = [table(spark, sf_dir, t).select(F.lit(label).alias("label")) for label, t in labels.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return graph.node_stats(every)


@query("SELECT 'HAS_TASK' AS label, count(*) AS n FROM li UNION ALL SELECT 'PERFORMED_BY', count(*) FROM li UNION ALL SELECT 'NEXT', count(*) FROM lnx UNION ALL SELECT 'MAKES_DECISION', 0 UNION ALL SELECT 'SUPPORTED_BY', 0", "li", "lnx")
def graph_stats_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_stats(graph_edges(order_lines(spark, sf_dir), "role_id").select(F.col("rel").alias("label")), graph.RELS)


@query("SELECT (SELECT count(*) FROM orders) AS processes, (SELECT count(*) FROM lineitem) AS tasks, (SELECT count(*) FROM supplier) AS roles, (SELECT count(*) > 0 FROM orders) AS has_data")
def graph_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are zero, not missing, where there is nothing."""
    labels = {"Process": "orders", "Task": "lineitem", "Role": "supplier"}
    counts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k, t in labels.items()]
    n = lambda k: F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0))
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).agg(n("Process").alias("processes"), n("Task").alias("tasks"), n("Role").alias("roles"), (n("Process") > 0).alias("has_data"))


@query("SELECT process_id, src, dst FROM nx", "conv", "nx")
def next_edges_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = conversations(spark, sf_dir)
    return graph.successors(tasks).select("process_id", "src", "dst")


@query(
    "SELECT process_id, 'start_' || process_id AS src, arg_min(task_id, seq) AS dst FROM conv GROUP BY process_id UNION ALL SELECT process_id, arg_max(task_id, seq), 'end_' || process_id FROM conv GROUP BY process_id",
    "conv",
)
def start_end_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.start_end(conversations(spark, sf_dir).select("process_id", F.col("task_id").alias("id"), "seq"))


@query(
    """SELECT left(regexp_replace('SequenceFlow_' || l.src || '_' || l.dst, '[^0-9A-Za-z_-]', '_', 'g'), 240) AS flow_id, a.condition FROM lnx l JOIN li a ON a.task_id = l.src WHERE a.condition <> ''""",
    "li",
    "lnx",
)
def conditional_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = order_lines(spark, sf_dir)
    flows = graph.successors(tasks).drop("condition").join(tasks.select("process_id", F.col("task_id").alias("src"), "condition"), ["process_id", "src"])
    return flows.where(or_else("condition", "") != "").select(flow_id("src", "dst").alias("flow_id"), "condition")


@query(
    """, p(start, stop, hops) AS (SELECT src, dst, 1 FROM nx UNION ALL SELECT p.start, nx.dst, p.hops + 1 FROM p JOIN nx ON nx.src = p.stop ) SELECT start, stop, hops FROM p""",
    "conv",
    "nx",
)
def path_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.paths(graph.successors(conversations(spark, sf_dir)))


@query(
    """, p(start, stop, hops) AS (SELECT src, dst, 1 FROM nx UNION ALL SELECT p.start, nx.dst, p.hops + 1 FROM p JOIN nx ON nx.src = p.stop ) SELECT start, stop, hops FROM p ORDER BY hops DESC, start, stop LIMIT 5""",
    "conv",
    "nx",
)
def longest_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.paths(graph.successors(conversations(spark, sf_dir))).orderBy(F.desc("hops"), "start", "stop").limit(5)


@query("SELECT b.task_id AS activity, a.task_id AS predecessor FROM conv a JOIN conv b ON a.process_id = b.process_id AND a.seq < b.seq", "conv")
def predecessor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = conversations(spark, sf_dir)
    edges = next_edges_lead(spark, sf_dir)
    return graph.predecessors(tasks.select("process_id", F.col("task_id").alias("id"), "seq"), edges).select("activity", "predecessor")


@query("SELECT process_id, task_id AS id, (140 + 150 * (row_number() OVER (PARTITION BY process_id ORDER BY seq, task_id) - 1))::INT AS x, 20 + 120 * CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS y FROM conv", "conv")
def grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.grid(_laned(spark, sf_dir))


def _laned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lane = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return conversations(spark, sf_dir).select("process_id", F.col("task_id").alias("id"), lane.alias("lane"), "seq")


@query(
    """, g AS (SELECT process_id, task_id AS id, (140 + 150 * (row_number() OVER (PARTITION BY process_id ORDER BY seq, task_id) - 1))::INT AS x, 20 + 120 * CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS y FROM conv)
       SELECT nx.process_id, src, dst, a.x + 100 AS x1, a.y + 40 AS y1, b.x AS x2, b.y + 40 AS y2 FROM nx JOIN g a ON a.id = src JOIN g b ON b.id = dst""",
    "conv",
    "nx",
)
def edge_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.midpoints(next_edges_lead(spark, sf_dir), grid_layout(spark, sf_dir))


@query()
def layered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layered(_laned(spark, sf_dir), next_edges_lead(spark, sf_dir))


@query()
def edge_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.routes(grid_layout(spark, sf_dir), next_edges_lead(spark, sf_dir))


@query(
    """, d AS (SELECT process_id, role_id AS lane, ord AS layer, count(*) AS n FROM li GROUP BY ALL), w AS (SELECT process_id, lane, 120 * max(n) AS width FROM d GROUP BY ALL)
       SELECT process_id, lane, width, coalesce(sum(width) OVER (PARTITION BY process_id ORDER BY lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x FROM w""",
    "li",
)
def lane_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lane_bounds(order_lines(spark, sf_dir).select("process_id", F.col("role_id").alias("lane"), F.col("order").alias("layer")))


@query(
    """, d AS (SELECT process_id, role_id AS lane, ord AS layer, count(*) AS n FROM li GROUP BY ALL), w AS (SELECT process_id, 120 * max(n) AS width FROM d GROUP BY process_id, lane)
       SELECT process_id, -30::BIGINT AS x_min, sum(width)::BIGINT + 30 AS x_max FROM w GROUP BY process_id""",
    "li",
)
def pool_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pool_box(lane_bounds(spark, sf_dir))


def _flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events of users with flows between every other pair of neighbours."""
    nodes = user_events(spark, sf_dir)
    chain = graph.successors(nodes.select("process_id", F.col("id").alias("task_id"), F.col("seq").alias("order"), "seq"), "seq")
    return nodes, chain.where(F.col("src_seq") % 2 == 0).select("process_id", "src", "dst")


@query("SELECT enx.process_id, src, dst, seq % 2 = 1 AS made FROM enx JOIN ev ON ev.id = enx.src", "ev", "enx")
def connectivity_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, flows = _flows(spark, sf_dir)
    return model.repair(nodes, flows)


@query(
    """, o AS (SELECT src AS id, count(*) AS n, min(dst) AS nxt FROM enx GROUP BY src), wk AS (SELECT ev.id, nxt FROM ev LEFT JOIN o USING (id) WHERE kind = 'gateway' AND coalesce(n, 0) < 2)
       SELECT process_id, src, dst FROM enx WHERE src NOT IN (SELECT id FROM wk) AND dst NOT IN (SELECT id FROM wk)
       UNION SELECT process_id, src, nxt FROM enx JOIN wk ON wk.id = dst WHERE nxt IS NOT NULL AND src <> nxt AND src NOT IN (SELECT id FROM wk) AND nxt NOT IN (SELECT id FROM wk)""",
    "ev",
    "enx",
)
def gateway_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, flows = _flows(spark, sf_dir)
    flows = graph.checkpointed(model.repair(nodes, flows).select("process_id", "src", "dst"))  # used four times
    return model.collapse_gateways(nodes.where("kind = 'gateway'").select("process_id", "id"), flows)


@query(
    """SELECT process_id, src, dst, '조건 ' || row_number() OVER (PARTITION BY process_id, src ORDER BY dst) AS condition FROM (SELECT DISTINCT process_id, role_id AS src, decision_id AS dst FROM li)
       QUALIFY count(*) OVER (PARTITION BY process_id, src) > 1""",
    "li",
)
def branch_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = order_lines(spark, sf_dir).select("process_id", F.col("role_id").alias("src"), F.col("decision_id").alias("dst")).distinct()
    return model.branch_names(flows.select("process_id", F.col("src").alias("id")).distinct(), flows)


@query(
    """, e AS (SELECT *, CASE WHEN kind = 'gateway' THEN NULL ELSE id END AS node FROM ev),
       f AS (SELECT *, last_value(node IGNORE NULLS) OVER (PARTITION BY process_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source,
                    first_value(node IGNORE NULLS) OVER (PARTITION BY process_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS target FROM e)
       SELECT process_id, seq, id, source, target FROM f WHERE kind = 'gateway' AND source IS NOT NULL AND target IS NOT NULL""",
    "ev",
)
def nearest_neighbour_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir)
    kind = F.when(F.col("kind") == "gateway", "sequence").otherwise("node")
    return model.fill_ends(e.select("process_id", "seq", "id", kind.alias("kind"), F.lit("").alias("source"), F.lit("").alias("target")))


@query(
    """, s AS (SELECT process_id, src, dst, '' AS condition, 0 AS k FROM enx JOIN ev ON ev.id = src WHERE ev.seq % 2 = 0 UNION ALL SELECT process_id, src, dst, 'next', 2 FROM enx)
       SELECT src, dst, arg_min(condition, k) AS condition, min(k) AS source FROM s GROUP BY src, dst""".replace("SELECT process_id, src, dst, '' AS condition, 0 AS k FROM enx JOIN ev ON ev.id = src", "SELECT enx.process_id, src, dst, '' AS condition, 0 AS k FROM enx JOIN ev ON ev.id = src"),
    "ev",
    "enx",
)
def flow_union_minus_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procgraph.operators.merge import flow_union

    nodes, flows = _flows(spark, sf_dir)
    chain = graph.successors(nodes.select("process_id", F.col("id").alias("task_id"), F.col("seq").alias("order"), "seq"))
    given = flows.select("src", "dst", F.lit("").alias("condition"), F.lit(0).cast("long").alias("seq"))
    return flow_union(given, given.where("false"), chain.select("src", "dst", F.lit("next").alias("condition"), F.lit(0).cast("long").alias("seq")))


@query("SELECT t.id AS team, p.id AS member FROM (SELECT 's' || s_suppkey AS id, s_nationkey FROM supplier) p JOIN (SELECT 'n' || n_nationkey AS id, n_nationkey FROM nation) t ON n_nationkey = s_nationkey")
def org_tree_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda t, i, up, team: table(spark, sf_dir, t).select(i.alias("id"), up.alias("parent_id"), F.lit(team).alias("is_team"))
    regions = row("region", key("r", "r_regionkey"), F.lit(None).cast("string"), True)
    return model.org_members(regions.unionByName(row("nation", key("n", "n_nationkey"), key("r", "n_regionkey"), True)).unionByName(row("supplier", key("s", "s_suppkey"), key("n", "s_nationkey"), False)))


@query(
    """SELECT r_name AS mega, n_name AS major, 'p' || n_nationkey AS id, n_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey
       UNION ALL SELECT '미분류', '미분류', 'p' || p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT n_nationkey FROM nation)"""
)
def proc_map_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    tree = tree.select(F.col("r_name").alias("mega"), F.col("n_name").alias("major"), F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    return model.process_tree(tree, table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name")))


@query(
    "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) UNION ALL SELECT DISTINCT l_orderkey, 'done' FROM lineitem WHERE l_linenumber = 7"
)
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("id"), F.lit("done").alias("status")).distinct()
    return graph.upsert(old, new, ["id"])


@query("SELECT DISTINCT 'PERFORMED_BY' AS rel, l_orderkey AS src, l_suppkey AS dst FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def edge_upsert_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.lit("PERFORMED_BY").alias("rel"), F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("").alias("condition"))
    src = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    dst = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return graph.linked(edges, src, dst).select("rel", "src", "dst")


@query(
    "SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem WHERE (l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))"
)
def edge_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.lit("PERFORMED_BY").alias("rel"), F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("").alias("condition"))
    src = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    dst = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return graph.rejected(edges, src, dst).select("src", "dst").distinct()


@query("SELECT o_orderkey AS id, coalesce(m, o_orderpriority) AS priority, o_orderstatus AS status FROM orders LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS m FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_orderkey = o_orderkey")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    new = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_returnflag").alias("priority"))
    return graph.update_columns(old, new, ["id"], ["priority"])
