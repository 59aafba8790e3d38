"""Tables on disk, and how they map onto processes, tasks, roles and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.operators.graph import successors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as tasks: process_id, task_id, order, seq, role, text."""
    t = table(spark, sf_dir, "conversations")
    pid = F.concat(F.lit("p"), F.col("conv_id").cast("string"))
    return t.select(pid.alias("process_id"), F.concat_ws("_", F.lit("t"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("task_id"), F.col("turn").cast("int").alias("order"), F.col("turn").cast("long").alias("seq"), "role", "text", F.coalesce("text", F.lit("")).alias("name"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tasks: process_id, task_id, order, seq, role_id, decision_id, condition."""
    t = table(spark, sf_dir, "lineitem")
    key = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return t.select(
        F.concat(F.lit("o"), key[0]).alias("process_id"),
        F.concat_ws("_", *key).alias("task_id"),
        F.col("l_linenumber").alias("order"),
        (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("seq"),
        F.concat(F.lit("s"), key[3]).alias("role_id"),
        F.concat("l_returnflag", "l_linestatus").alias("decision_id"),
        F.col("l_returnflag").alias("condition"),
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nodes of a process for each user: process_id, id, seq, kind, event_type, value, props."""
    t = table(spark, sf_dir, "events")
    return t.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("process_id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("seq"), F.when(F.col("event_type") == "error", "gateway").otherwise("task").alias("kind"), "event_type", "value", "props", "ts")


def graph_edges(tasks: DataFrame, role: str) -> DataFrame:
    """HAS_TASK, PERFORMED_BY and NEXT edges of tasks: rel, src, dst, condition."""
    none = F.lit("").alias("condition")
    has = tasks.select(F.lit("HAS_TASK").alias("rel"), F.col("process_id").alias("src"), F.col("task_id").alias("dst"), none)
    by = tasks.select(F.lit("PERFORMED_BY").alias("rel"), F.col("task_id").alias("src"), F.col(role).alias("dst"), none)
    return has.unionByName(by).unionByName(successors(tasks).drop("process_id"))
