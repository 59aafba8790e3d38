"""Queries for new entities against those that are there, by names and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.functions.similarity import letter_counts
from procgraph.operators import search
from procgraph.plans.registry import query
from procgraph.sources.tables import conversations, table


def _ranked(new: str, there: str) -> str:
    """SQL that scores all pairs with a term in common: rk (id, match_id, score, rank). Both sides: id, kind, name."""
    split = "list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    return f"""ft AS (SELECT id AS match_id, kind, len({split}) AS n, unnest({split}) AS term FROM {there} WHERE kind IS NOT NULL),
        fk AS (SELECT kind, count(DISTINCT match_id) AS nn, count(*) AS ll FROM ft GROUP BY 1), fd AS (SELECT kind, term, count(DISTINCT match_id) AS df FROM ft GROUP BY 1, 2),
        fp AS (SELECT match_id, kind, term, n, count(*) AS tf FROM ft GROUP BY 1, 2, 3, 4),
        fa AS (SELECT match_id, kind, term, floor(1000 * ln((2.0 * nn + 2) / (2.0 * df + 1)))::BIGINT * ((22000 * tf) // (10 * tf + 3 + (9 * n * nn) // ll)) AS adds FROM fp JOIN fd USING (kind, term) JOIN fk USING (kind)),
        fq AS (SELECT DISTINCT id, kind, unnest({split}) AS term FROM {new}),
        fs AS (SELECT id, match_id, sum(adds)::BIGINT AS score FROM fq JOIN fa USING (kind, term) GROUP BY 1, 2),
        rk AS (SELECT id, match_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, match_id) AS rank FROM fs WHERE score > 0 QUALIFY rank <= 10)"""


@query(", it AS (SELECT item_id AS id, 'Task' AS kind, text AS name FROM benchmark), tu AS (SELECT task_id AS id, 'Task' AS kind, text AS name FROM conv), " + _ranked("it", "tu") + " SELECT id AS item_id, match_id AS task_id, score, rank FROM rk", "conv")
def fulltext_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten turns whose words score highest for each item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("Task").alias("kind"), F.col("text").alias("name"))
    turns = conversations(spark, sf_dir).select(F.col("task_id").alias("id"), F.lit("Task").alias("kind"), F.col("text").alias("name"))
    return search.top_by_name(items, turns).select(F.col("id").alias("item_id"), F.col("match_id").alias("task_id"), "score", "rank")


#: Parts as entities: even keys are in the graph, odd ones are new; some are tasks, which are never dropped.
_PARTS = """WITH en AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'Task' ELSE p_brand END AS kind, p_name || ' ' || p_type AS name, lower(p_name || ' ' || p_type || '. ' || p_size || p_brand) AS t FROM part),
    ve AS (SELECT *, [(length(t) - length(replace(t, c, '')))::DOUBLE for c in string_split('abcdefghijklmnopqrstuvwxyz', '')] AS v FROM en), nw AS (FROM ve WHERE id % 2 = 1), ol AS (FROM ve WHERE id % 2 = 0), """
_SIMILAR = (
    _PARTS
    + _ranked("nw", "ol")
    + """, cs AS (SELECT rk.id, match_id, rank, list_cosine_similarity(nw.v, ol.v) AS s FROM rk JOIN nw ON nw.id = rk.id JOIN ol ON ol.id = match_id),
    bs AS (SELECT * FROM cs WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, rank) = 1),
    de AS (SELECT nw.id, nw.kind, nw.name, coalesce(s, 0) AS similarity, CASE WHEN round(s, 9) >= 0.9 THEN 'merge' WHEN round(s, 9) >= 0.8 THEN 'review' ELSE 'create' END AS action, match_id FROM nw LEFT JOIN bs ON bs.id = nw.id) """
)


def part_entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", "p_type")
    kind = F.when(F.col("p_size") % 5 == 0, "Task").otherwise(F.col("p_brand"))
    e = p.select(F.col("p_partkey").alias("id"), kind.alias("kind"), name.alias("name"), letter_counts(F.concat(name, F.lit(". "), F.col("p_size").cast("string"), "p_brand")).alias("v"), F.col("p_partkey").alias("seq"))
    return e.where("id % 2 = 1"), e.where("id % 2 = 0")


@query(_SIMILAR + "SELECT id, CASE WHEN action <> 'create' THEN match_id END AS match_id, round(similarity, 6) AS similarity, action FROM de")
def similar_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The existing part of the same kind that a new one stands for, among the ten with the best names."""
    return search.similar_by_name(*part_entities(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query(_SIMILAR + "SELECT id, CASE action WHEN 'merge' THEN match_id WHEN 'create' THEN id END AS entity_id, CASE action WHEN 'merge' THEN 'merged' WHEN 'review' THEN 'pending_review' ELSE 'created' END AS outcome FROM de")
def entities_found_or_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_or_create(search.similar_by_name(*part_entities(spark, sf_dir)))


@query(_SIMILAR + "SELECT id, kind, name FROM de WHERE kind = 'Task' OR action <> 'merge' QUALIFY row_number() OVER (PARTITION BY kind, lower(trim(name)) ORDER BY id) = 1")
def dedup_against_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.deduplicated(*part_entities(spark, sf_dir)).select("id", "kind", "name")
