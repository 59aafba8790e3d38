"""Queries over models that are put in order and laid out. Conversations are processes, their speakers lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.operators.autolayout import laid_out, lane_boxes
from procgraph.operators.graph import checkpointed
from procgraph.operators.validation import validated
from procgraph.plans.registry import query
from procgraph.sources.tables import conversations


def conversation_elements(spark: SparkSession, sf_dir: str, branches: bool) -> DataFrame:
    """Turns in order; with branches, every third is a gateway that the fourth one after it points to, and every fifth leads back."""
    c = conversations(spark, sf_dir)
    third, back = F.lit(branches) & (F.col("seq") % 3 == 1), F.lit(branches) & (F.col("seq") % 5 == 4)
    there = lambda step: F.regexp_replace("task_id", r"\d+$", (F.col("seq") + step).cast("string"))
    blank = [F.lit("").alias(x) for x in ("type", "target", "condition")]
    nodes = c.select("process_id", (2 * F.col("seq")).alias("seq"), F.when(third, "Gateway").otherwise("Activity").alias("kind"), F.col("task_id").alias("id"), "name", F.when(F.lit(branches) & (F.col("seq") % 3 == 2), there(-4)).alias("source"), *blank)
    again = c.where(back).select("process_id", (2 * F.col("seq") + 1).alias("seq"), F.lit("Sequence").alias("kind"), F.lit("").alias("id"), F.lit("again").alias("name"), F.col("task_id").alias("source"), F.lit("").alias("type"), there(-3).alias("target"), F.lit("").alias("condition"))
    put = checkpointed(validated(nodes.unionByName(again)))
    lanes = c.select(F.col("process_id").alias("process_id"), F.col("task_id").alias("id"), F.col("role").alias("lane"))
    return put.join(lanes, ["process_id", "id"], "left")


@query()
def auto_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes with their boxes and all flows with their ways."""
    return laid_out(conversation_elements(spark, sf_dir, True)).drop("name", "type", "condition")


@query(
    """WITH t AS (SELECT 'p' || conv_id AS p, 't_' || conv_id || '_' || turn AS id, coalesce(trim(role), '') AS lane, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS layer FROM conversations),
       n AS (SELECT *, 100 AS w, 80 AS h FROM t UNION ALL SELECT p, 'start_event', '', 0, 34, 34 FROM t GROUP BY p UNION ALL SELECT p, 'end_event', '', max(layer) + 1, 34, 34 FROM t GROUP BY p),
       l AS (SELECT p, lane, row_number() OVER (PARTITION BY p ORDER BY lane = '', min(layer)) - 1 AS k FROM n GROUP BY p, lane)
       SELECT p AS process_id, id, lane, layer, 120 * k + 60 - w // 2 AS x, 150 * layer + 80 - h // 2 AS y, w::BIGINT AS width, h::BIGINT AS height, 120 * k AS lane_x, 120::BIGINT AS lane_width, 150 * (max(layer) OVER (PARTITION BY p) + 1) AS lane_height FROM n JOIN l USING (p, lane)"""
)
def auto_layout_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of models without branches, with the boxes of their lanes."""
    elements = checkpointed(conversation_elements(spark, sf_dir, False))
    nodes = laid_out(elements).where("kind <> 'Sequence'").select("process_id", "id", F.trim(F.coalesce("lane", F.lit(""))).alias("lane"), "layer", "x", "y", "width", "height")
    boxes = lane_boxes(elements).select(F.col("process_id").alias("process_id"), F.col("lane").alias("lane"), F.col("x").alias("lane_x"), F.col("width").alias("lane_width"), F.col("height").alias("lane_height"))
    return nodes.join(boxes, ["process_id", "lane"])
