"""Queries over names, texts, sections, vectors, payloads and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.functions import jsonx, similarity, text
from procgraph.operators import graph, merge, model, render, resolve, sections
from procgraph.operators.graph import successors
from procgraph.plans.registry import query
from procgraph.sources import files
from procgraph.sources.tables import conversations, order_lines, table, user_events
from procgraph.streaming import jobs

PARTS = "pt AS (SELECT p_partkey AS seq, 'k' || p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type FROM part)"
CHARS = "list_distinct(list_filter(string_split({0}, ''), lambda c: c <> ''))"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lit(1).alias("page"), "text")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two turns, parted by a blank line."""
    c = table(spark, sf_dir, "conversations")
    pair = c.select(F.col("conv_id").alias("doc_id"), (F.floor(F.col("turn") / 2) + 1).cast("int").alias("page"), "turn", "text")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return pair.groupBy("doc_id", "page").agg(F.array_join(rows, "\n\n").alias("text"))


@query(f"WITH {PARTS} SELECT id, name FROM pt QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY seq) = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.keep_first(_parts(spark, sf_dir), text.name_key("name")).select("id", "name")


@query(f"WITH {PARTS} SELECT arg_min(id, seq) AS proc_id, arg_min(name, seq) AS name, arg_min(brand, seq) AS description, '' AS purpose, count(*) AS n_merged FROM pt GROUP BY lower(trim(name))")
def merge_duplicate_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_processes(_parts(spark, sf_dir).select(F.col("id").alias("proc_id"), "name", F.col("brand").alias("description"), F.lit("").alias("purpose"), "seq"))


@query(f"WITH {PARTS}, m AS (SELECT id AS old_id, first_value(id) OVER (PARTITION BY lower(trim(name)) ORDER BY seq) AS new_id FROM pt) SELECT l_orderkey, l_linenumber, l_suppkey, new_id AS part_id FROM lineitem JOIN m ON old_id = 'k' || l_partkey")
def remap_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = merge.process_map(_parts(spark, sf_dir).select(F.col("id").alias("proc_id"), "name", "seq"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("part_id"))
    return merge.remap(lines, mapping, "part_id")


@query(f"WITH {PARTS}, u AS (SELECT id, 0 AS side, seq FROM pt WHERE seq % 2 = 0 UNION ALL SELECT CASE WHEN seq % 7 = 0 THEN '' ELSE id END, 1, seq FROM pt WHERE seq % 3 = 0) SELECT id, seq FROM u WHERE id = '' UNION ALL SELECT id, min(seq) FROM u WHERE id <> '' GROUP BY id")
def merge_list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    new = p.where("seq % 3 = 0").select(F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("id")).alias("id"), "seq")
    return merge.merge_list(p.where("seq % 2 = 0").select("id", "seq"), new)


@query()
def merge_similar_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return merge.merge_tasks(p.select(F.col("id").alias("task_id"), F.col("brand").alias("process_id"), F.col("type").alias("role_id"), "name", F.col("type").alias("description"), F.col("seq").cast("int").alias("order"), "seq"))


@query(
    f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT name, {CHARS.format("name")} AS c FROM n)
        SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))), 9) AS similarity FROM c a JOIN c b ON a.name < b.name
        WHERE len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))) > 0.6"""
)
def char_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return resolve.jaccard_pairs(n).withColumn("similarity", F.round("similarity", 9))


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT name, list_distinct(string_split(name, ' ')) AS c FROM n)
        SELECT a.name AS a, b.name AS b FROM c a JOIN c b ON a.name < b.name WHERE len(list_intersect(a.c, b.c)) >= 1 AND len(list_intersect(a.c, b.c)) >= 0.5 * least(len(a.c), len(b.c))"""
)
def core_word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    pairs = resolve.token_blocks(n.withColumn("id", F.col("name"))).select("a", "b")  # one word in common at least
    parted = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("및"))
    return pairs.where(similarity.core_words_agree(parted("a"), parted("b")))


@query(
    """WITH p AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS a, max(CASE WHEN turn = 1 THEN text END) AS b FROM conversations GROUP BY 1),
       l AS (SELECT conv_id, list_filter(list_transform(string_split(coalesce(a, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a, list_filter(list_transform(string_split(coalesce(b, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS b FROM p)
       SELECT conv_id, len(a) + len(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))) AS n_lines FROM l"""
)
def line_merge_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turn = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    merged = c.groupBy("conv_id").agg(turn(0).alias("a"), turn(1).alias("b")).select("conv_id", merge.merge_lines(F.col("a"), F.col("b")).alias("t"))
    return merged.select("conv_id", F.size(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n_lines"))


@query("SELECT doc_id, item_id FROM (SELECT doc_id, item_id FROM documents JOIN benchmark ON length(benchmark.text) > 2 AND contains(lower(documents.text), lower(benchmark.text)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY item_id) = 1)")
def infer_role_contains_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), "text")
    roles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("role_id"), F.col("text").alias("name"), F.lit(None).cast("string").alias("org_unit"), F.col("item_id").alias("seq"))
    found = resolve.infer_roles(docs, roles, docs.where("false"))
    return found.select(F.col("task_id").alias("doc_id"), F.col("role_id").alias("item_id"))


@query(
    """WITH f AS (SELECT p_partkey AS flow_id, lower(trim(split_part(p_name, ' ', 1))) AS q FROM part),
       n AS (SELECT 0 AS k, lower(name) AS name, name AS id, row_number() OVER (ORDER BY name) AS seq FROM (SELECT DISTINCT p_type AS name FROM part) UNION ALL SELECT 1, lower(name), name, row_number() OVER (ORDER BY name) FROM (SELECT DISTINCT p_name AS name FROM part))
       SELECT flow_id, id AS node_id, CASE k WHEN 0 THEN 'task' ELSE 'gateway' END AS kind FROM f JOIN n ON contains(q, name) OR contains(name, q) WHERE q <> '' QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY k, seq, id) = 1"""
)
def endpoint_resolution_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    distinct = lambda c: p.select(F.col(c).alias("name")).distinct().select(F.col("name").alias("id"), "name", F.col("name").alias("seq"))
    flows = p.select(F.col("p_partkey").alias("flow_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("from_name"))
    return resolve.endpoints(flows, distinct("p_type"), distinct("p_name"), "from_name")


@query(f"WITH {PARTS}, i AS (SELECT lower(trim(name)) AS k, arg_min(id, seq) AS first_id FROM pt GROUP BY 1) SELECT id, first_id FROM pt JOIN i ON k = lower(trim(name))")
def name_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return resolve.lookup(p.select("id", F.upper("name").alias("wanted")), p, "wanted", "first_id").select("id", "first_id")


@query("SELECT process_id, arg_max(role_id, (seq, role_id)) AS role_id FROM li GROUP BY process_id", "li")
def explicit_mapping_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.last_wins(order_lines(spark, sf_dir).select("process_id", "role_id", "seq"), "process_id", "role_id", "seq")


@query(
    """WITH t AS (SELECT count(*) AS n FROM documents), c AS (SELECT count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
       SELECT t.n AS tasks, c.n AS covered, c.n < 0.3 * t.n AS too_few FROM t, c"""
)
def role_coverage_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")).distinct()
    return docs.select("doc_id").join(labels, "doc_id", "left").agg(F.count(F.lit(1)).alias("tasks"), F.count("has").alias("covered"), (F.count("has") < 0.3 * F.count(F.lit(1))).alias("too_few"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 10")
def unassigned_questions_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(10)


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, trim(line, ' ' || chr(9) || chr(13)) AS line FROM l)
       SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '^#{1}\\s+(.+)$') OR regexp_matches(line, '^제\\s*\\d+\\s*[장절]\\s*(.+)$') OR regexp_matches(line, '^#{2}\\s+(.+)$') OR regexp_matches(line, '^\\d+\\.\\s+([A-Z가-힣].+)$')
         OR regexp_matches(line, '^\\d+\\.\\d+\\s+(.+)$') OR regexp_matches(line, '^\\d+\\.\\d+\\.\\d+\\s+(.+)$') OR regexp_matches(line, '^[A-Z]\\.\\s+(.+)$') OR regexp_matches(line, '^[IVX]+\\.\\s+(.+)$')) AS n_headings FROM s GROUP BY doc_id"""
)
def doc_line_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.lines(_pages(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count("level").alias("n_headings"))


@query()
def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.long_enough(sections.sections(_pages(spark, sf_dir)))


@query(
    """WITH h AS (SELECT process_id AS doc_id, ord AS page FROM conv WHERE role = 'user'), s AS (SELECT doc_id, page AS page_from, lead(page) OVER (PARTITION BY doc_id ORDER BY page) - 1 AS nxt FROM h)
       SELECT s.doc_id, page_from, coalesce(nxt, (SELECT max(ord) FROM conv WHERE process_id = s.doc_id)) AS page_to FROM s""".replace("WITH h AS", ", h AS", 1),
    "conv",
)
def section_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, user turns as pages with a heading."""
    c = conversations(spark, sf_dir)
    pages = c.select(F.col("process_id").alias("doc_id"), F.col("order").alias("page"), F.when(F.col("role") == "user", F.lit("# user")).otherwise("text").alias("text"))
    got = sections.sections(pages.withColumn("text", F.regexp_replace("text", r"(?m)^\s*(#|\d|제|[A-Z]+\.)", "-$1")).withColumn("text", F.when(F.col("text") == "-# user", "# user").otherwise(F.col("text"))))
    return got.where("section_no > 0").select("doc_id", "page_from", "page_to")


@query(
    """, r AS (SELECT process_id, min(ord) AS a, max(ord) - 1 AS b FROM conv GROUP BY 1) SELECT r.process_id AS range_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS content FROM r JOIN conv USING (process_id) WHERE ord BETWEEN a AND b GROUP BY 1""",
    "conv",
)
def page_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir).select(F.col("process_id").alias("doc_id"), F.col("order").alias("page"), "text")
    ranges = c.groupBy("doc_id").agg(F.min("page").alias("page_from"), (F.max("page") - 1).alias("page_to")).withColumn("range_id", F.col("doc_id"))
    return sections.pages_between(ranges, c).select("range_id", "content")


@query()
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.fixed_chunks(_turns(spark, sf_dir))


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.semantic_chunks(_turns(spark, sf_dir))


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def chunk_hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query()
def procedure_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.procedure_steps("text").alias("steps"))


@query("SELECT process_id AS doc_id, ord AS section_no, ord AS page_from, chunk_no FROM (SELECT process_id, ord FROM conv) LEFT JOIN (SELECT process_id, ord, min(turn) AS chunk_no FROM (SELECT process_id, ord, seq AS turn FROM conv WHERE role = 'assistant') GROUP BY 1, 2) USING (process_id, ord)", "conv")
def evidence_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir).select(F.col("process_id").alias("doc_id"), F.col("order").alias("page"), "seq", "role")
    chunks = c.where("role = 'assistant'").select("doc_id", "page", F.col("seq").alias("chunk_no"))
    return sections.evidence(c.select("doc_id", F.col("page").alias("section_no"), F.col("page").alias("page_from")), chunks).select("doc_id", "section_no", "page_from", "chunk_no")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.col("embedding").alias("v"))


@query("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) DESC, id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return resolve.vector_top(v, v.where("id = 0").select(F.col("v").alias("q")), 10).select("id", F.round("similarity", 6).alias("similarity"))


@query(
    """WITH s AS (SELECT a.vec_id AS id, b.vec_id AS match_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 2 = 1 AND b.vec_id % 2 = 0),
       t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, match_id) = 1)
       SELECT vec_id AS id, match_id, round(coalesce(s, 0), 6) AS similarity, CASE WHEN s >= 0.9 THEN 'merge' WHEN s >= 0.8 THEN 'review' ELSE 'create' END AS action FROM embeddings LEFT JOIN t ON t.id = vec_id WHERE vec_id % 2 = 1"""
)
def similar_entity_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entities (odd ids) against those that are there (even ids)."""
    v = _vectors(spark, sf_dir)
    return resolve.similar_entity(v.where("id % 2 = 1"), v.where("id % 2 = 0")).withColumn("similarity", F.round("similarity", 6))


@query(
    """WITH c AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 40)
       SELECT label AS entity, round(max(s), 6) AS similarity FROM c GROUP BY label ORDER BY max(s) DESC, entity LIMIT 20"""
)
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the 40 chunks most like a query, each by its best chunk."""
    v = _vectors(spark, sf_dir)
    top = resolve.vector_top(v, v.where("id = 0").select(F.col("v").alias("q")), 40)
    by = top.join(v.select("id", F.col("kind").alias("entity")), "id").groupBy("entity").agg(F.max("similarity").alias("s"))
    return by.orderBy(F.desc("s"), "entity").limit(20).select("entity", F.round("s", 6).alias("similarity"))


@query(
    """WITH n AS (SELECT DISTINCT p_name AS id FROM part), w AS (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(id), '\\s+'), lambda w: w <> ''))) AS word FROM n)
       SELECT x.id AS a, y.id AS b, count(*) AS common FROM w x JOIN w y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2"""
)
def fulltext_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.token_blocks(table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct())


USERS = "us AS (SELECT 'c' || c_custkey AS user_id, c_name AS username, c_mktsegment AS role, 'seg' || c_nationkey AS alias, c_custkey % 2 = 0 AS is_agent, c_custkey AS seq FROM customer)"
ASKED = "ask AS (SELECT DISTINCT p_type AS role FROM part UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT DISTINCT left(c_mktsegment, 4) FROM customer UNION SELECT 'seg1')"
KEY = "regexp_replace(lower({0}), '\\s+', '', 'g')"


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("user_id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("role"), F.concat(F.lit("seg"), F.col("c_nationkey").cast("string")).alias("alias"), (F.col("c_custkey") % 2 == 0).alias("is_agent"), F.col("c_custkey").alias("seq"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("role"))
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("role"))
    return types.unionByName(segments).unionByName(segments.select(F.left("role", F.lit(4)).alias("role"))).unionByName(spark.createDataFrame([("seg1",)], "role string")).distinct()


FIELDS = f"fl AS (SELECT user_id, is_agent, seq, f, {KEY.format('v')} AS v FROM (SELECT user_id, is_agent, seq, 0 AS f, username AS v FROM us UNION ALL SELECT user_id, is_agent, seq, 1, role FROM us UNION ALL SELECT user_id, is_agent, seq, 2, alias FROM us))"


@query(
    f"""WITH {USERS}, {ASKED}, {FIELDS}, q AS (SELECT role, {KEY.format("role")} AS k FROM ask),
        h AS (SELECT role, user_id, f, seq, CASE WHEN k = v THEN 0 ELSE 1 END + CASE WHEN is_agent THEN 0 ELSE 2 END AS tier FROM q JOIN fl ON contains(k, v) OR contains(v, k))
        SELECT role, user_id, tier FROM h QUALIFY row_number() OVER (PARTITION BY role ORDER BY tier, seq, f) = 1"""
)
def pick_user_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.pick_user(_asked(spark, sf_dir), _users(spark, sf_dir))


@query(
    f"""WITH {USERS}, {ASKED}, {FIELDS}, q AS (SELECT role, {KEY.format("role")} AS k FROM ask),
        h AS (SELECT role, user_id, max(CASE WHEN k = v THEN 1.0 WHEN contains(k, v) OR contains(v, k) THEN 0.8 WHEN length(k) >= 3 AND (contains(v, left(k, 3)) OR contains(v, right(k, 3))) THEN 0.5 ELSE 0 END) AS score FROM q, fl WHERE is_agent GROUP BY 1, 2),
        r AS (SELECT h.role, h.user_id, h.score::DOUBLE AS score, row_number() OVER (PARTITION BY h.role ORDER BY h.score DESC, us.seq) AS rank FROM h JOIN us ON us.user_id = h.user_id WHERE h.score > 0),
        top AS (SELECT user_id, row_number() OVER (ORDER BY seq) AS rank FROM us WHERE is_agent QUALIFY rank <= 20)
        SELECT role, user_id, score, rank FROM r WHERE rank <= 30 UNION ALL SELECT role, user_id, 0.0, rank FROM q, top WHERE role NOT IN (SELECT role FROM r)"""
)
def candidates_scored_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.candidates(_asked(spark, sf_dir), _users(spark, sf_dir))


@query(
    """WITH k AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g') AS k FROM documents)
       SELECT doc_id, CASE WHEN contains(k, 'api') OR contains(k, 'mail') OR contains(k, 'token') THEN 'agent' WHEN contains(k, 'approv') OR contains(k, 'license') THEN 'human' ELSE 'open' END AS class FROM k"""
)
def keyword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.keyword_class(F.coalesce("text", F.lit("")), ("api", "mail", "token"), ("approv", "license")).alias("class"))


@query(
    """, pr AS (SELECT b.task_id AS activity, a.task_id AS predecessor FROM conv a JOIN conv b ON a.process_id = b.process_id AND a.seq < b.seq),
       al AS (SELECT activity, list_sort(list(DISTINCT role)) AS refs, FROM pr JOIN conv ON conv.task_id = predecessor GROUP BY 1)
       SELECT activity, array_to_string(CASE WHEN list_contains(refs, 'user') AND seq % 2 = 0 THEN ['user'] ELSE refs END, ',') AS refs FROM al JOIN conv ON conv.task_id = activity""",
    "conv",
)
def input_refs_from_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of earlier turns as form fields; every other turn asks for those of users."""
    c = conversations(spark, sf_dir)
    acts = c.select("process_id", F.col("task_id").alias("id"), "seq")
    pairs = graph.predecessors(acts, successors(c).select("process_id", "src", "dst"))
    fields = c.select("process_id", F.col("task_id").alias("activity"), F.col("role").alias("ref"))
    chosen = c.where("seq % 2 = 0").select("process_id", F.col("task_id").alias("activity"), F.lit("user").alias("ref"))
    return model.input_refs(pairs, fields, chosen).select("activity", F.array_join("refs", ",").alias("refs"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), event_id % 10)::INT AS k FROM events")
def json_payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", jsonx.first_field(F.col("props"), "k").alias("raw"), (F.col("event_id") % 10).cast("int").alias("d"))
    return e.select("event_id", text.to_order("raw", "d").alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that lost their last brace, repaired."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object(jsonx.repair(F.regexp_replace("props", r"\}\s*$", "")), "$.k").cast("int").alias("k"))


@query("SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title FROM pages")
def html_field_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("title"))


@query()
def form_field_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of forms made from the names of parts."""
    form = F.concat(F.lit("<text-field name='"), text.snake_id("p_name"), F.lit("' alias='"), F.col("p_name"), F.lit("'></text-field><select-field v-model=\"form['"), text.snake_id("p_type"), F.lit("']\" type='list'></select-field>"))
    return render.form_fields(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("form_id"), form.alias("html")))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS name FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), jsonx.file_name_of_url(F.col("url")).alias("name"))


@query(
    """SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS snake, CASE WHEN lower(p_type) IN ('human', 'agent', 'system') THEN lower(p_type) ELSE 'human' END AS kind,
              left('Activity_' || p_brand, 17) AS short, 'K' || p_partkey || '_' || p_brand || '_form' AS form FROM part"""
)
def enum_and_id_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.concat(F.lit("K"), F.col("p_partkey").cast("string"))
    return p.select(F.col("p_partkey").alias("id"), text.snake_id("p_name").alias("snake"), text.coerce("p_type", text.TASK_TYPES, "human").alias("kind"), text.short_id("Activity_", "p_brand").alias("short"), text.form_id(F.lit(""), key, "p_brand").alias("form"))


@query(f"WITH {PARTS}, s AS (SELECT seq, brand, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS b FROM pt), r AS (SELECT *, row_number() OVER (PARTITION BY brand, b ORDER BY seq) AS k FROM s) SELECT brand AS process_id, seq, CASE WHEN k = 1 THEN b ELSE b || '_' || k END AS new_id FROM r")
def positional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.normal_ids(_parts(spark, sf_dir).select(F.col("brand").alias("process_id"), F.col("name").alias("id"), "seq")).select("process_id", "seq", "new_id")


def _artifact_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = conversations(spark, sf_dir)
    nodes = c.select(F.col("process_id").alias("proc_id"), F.col("task_id").alias("id"), F.lit("userTask").alias("kind"), "name", "role", "seq")
    flows = successors(c).select(F.col("process_id").alias("proc_id"), "src", "dst", "condition")
    return nodes.select("proc_id", F.col("proc_id").alias("name")).distinct(), nodes, flows


@query()
def bpmn_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.bpmn_xml(*_artifact_parts(spark, sf_dir))


@query("SELECT process_id AS proc_id, 'userTask' AS tag, task_id AS id, role, '' AS source, '' AS target FROM conv UNION ALL SELECT process_id, 'sequenceFlow', 'Flow_' || src || '_' || dst, '', src, dst FROM nx", "conv", "nx")
def bpmn_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.read_bpmn(render.bpmn_xml(*_artifact_parts(spark, sf_dir))).drop("name")


def _decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = order_lines(spark, sf_dir)
    decisions = li.groupBy("decision_id").agg(F.min("decision_id").alias("name"), F.array_sort(F.collect_set("condition")).alias("inputs"))
    rules = li.select("decision_id", F.concat_ws("_", "decision_id", F.col("order").cast("string")).alias("rule_id"), F.concat(F.lit("line < "), F.col("order").cast("string")).alias("when"), F.col("condition").alias("then")).distinct()
    return decisions, rules


@query(
    """, r AS (SELECT DISTINCT decision_id, decision_id || '_' || ord AS rule_id, ord, condition FROM li)
       SELECT decision_id, '{"id":"' || decision_id || '","name":"' || decision_id || '","inputs":["' || (SELECT string_agg(DISTINCT condition, '","' ORDER BY condition) FROM li l WHERE l.decision_id = r.decision_id) || '"],"rules":[' ||
         string_agg('{"rule_id":"' || rule_id || '","when":"line < ' || ord || '","then":"' || condition || '"}', ',' ORDER BY rule_id) || ']}' AS json FROM r GROUP BY decision_id""",
    "li",
)
def dmn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.dmn_json(*_decisions(spark, sf_dir))


@query()
def dmn_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.dmn_xml(*_decisions(spark, sf_dir))


@query()
def skill_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    return render.skill_markdown(c.select("task_id", "name", F.col("text").alias("description"), F.when(F.col("role") == "assistant", "agent").otherwise("human").alias("task_type")))


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir)
    return e.select(F.col("process_id").alias("job_id"), "seq", F.col("event_type").alias("status"), F.lit(0).cast("long").alias("progress"))


@query("SELECT process_id AS job_id, seq, event_type AS status FROM ev QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY process_id ORDER BY seq)", "ev")
def emit_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.changes(_progress(spark, sf_dir)).select("job_id", "seq", "status")


@query("SELECT process_id AS job_id, arg_max(event_type, seq) AS status, count(*) AS n_events FROM ev GROUP BY 1", "ev")
def latest_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(_progress(spark, sf_dir)).select("job_id", "status", "n_events")


@query(", l AS (SELECT process_id, arg_max(event_type, seq) AS status FROM ev GROUP BY 1) SELECT status, count(*) AS n_jobs FROM l GROUP BY 1", "ev")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(_progress(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n_jobs"))


@query(
    """WITH s AS (SELECT event_type, sum(value) AS total FROM events GROUP BY 1), f AS (SELECT total FROM s ORDER BY event_type LIMIT 1)
       SELECT event_type, round(total / (SELECT sum(total) FROM s), 6) AS share, round(((SELECT total FROM f) - total) / (SELECT total FROM f) * 100, 6) AS improvement FROM s"""
)
def stats_share_and_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("total"))
    base = F.first("total").over(W.orderBy("event_type").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    whole = F.sum("total").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return s.select("event_type", F.round(F.col("total") / whole, 6).alias("share"), F.round((base - F.col("total")) / base * 100, 6).alias("improvement"))


@query("SELECT page_id AS id, url, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS name FROM pages")
def request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that name a URL in JSON; the file name comes from the URL."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.to_json(F.struct(F.col("url").alias("pdf_url"))).alias("q"))
    return files.requests(rows, "q").select("id", "url", F.coalesce("name", F.lit("")).alias("name"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'pdf' WHEN p_partkey % 3 = 1 THEN 'office' ELSE 'image' END AS label FROM part) GROUP BY 1")
def file_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(F.lit(".pdf"), F.lit(".DOCX"), F.lit(".png")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(files.route(F.concat("p_name", ext)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 's' || l_suppkey AS section_id, count(*) AS n_tasks FROM lineitem GROUP BY 1")
def extraction_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction payloads made from order lines, parsed and counted."""
    task = F.struct(F.col("l_returnflag").alias("name"), F.col("l_linenumber").cast("string").alias("order"))
    made = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("section_id"), F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(task).alias("tasks"))), F.lit("\n```")).alias("payload"))
    return files.exploded(files.parse_extraction(made), "tasks").groupBy("section_id").agg(F.count(F.lit(1)).alias("n_tasks"))
