"""Queries over the tables' twins of streams. The events of a user are messages about a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.plans.registry import query
from procgraph.sources.tables import user_events
from procgraph.streaming import sessions

WAIT_MS = 72 * 3_600_000
_EV = "WITH e AS (SELECT 'u' || user_id AS p, 'e' || event_id AS id, ts, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events) "


def event_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of users with an odd number of events one delta is missing, by what their last message says."""
    e = user_events(spark, sf_dir)
    deltas = e.select(F.col("process_id").alias("job_id"), "seq", F.when(F.col("seq") % 11 != 3, F.col("event_type")).alias("field"), F.col("id").alias("value"), F.lit(False).alias("ended"), F.col("ts").alias("at"))
    n = F.count(F.lit(1))
    ends = e.groupBy(F.col("process_id").alias("job_id")).agg((n + n % 2).alias("seq"), F.max("ts").alias("at"))
    return deltas.unionByName(ends.select("job_id", "seq", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("ended"), "at"))


@query(
    _EV
    + """, c AS (SELECT p FROM e GROUP BY p HAVING count(*) % 2 = 0)
       SELECT p AS job_id, t AS field, CASE WHEN t IN ('click', 'view') THEN list(id ORDER BY seq) ELSE [arg_max(id, seq)] END AS "values" FROM e WHERE p IN (FROM c) AND seq % 11 <> 3 GROUP BY p, t"""
)
def accumulated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.accumulate(event_deltas(spark, sf_dir), ("click", "view"))


def event_jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Some purchases complete a job, some errors are followed by someone's cancelling it."""
    e = user_events(spark, sf_dir).withColumn("at", F.col("ts"))
    done = (F.col("event_type") == "purchase") & (F.col("seq") % 5 == 0)
    events = e.select(F.col("process_id").alias("job_id"), "seq", F.when(done, "completed").otherwise(F.col("event_type")).alias("status"), F.col("seq").alias("progress"), "at")
    return events, e.where("event_type = 'error' AND seq % 6 = 4").select(F.col("process_id").alias("job_id"), "at")


@query(
    _EV
    + """, m AS (SELECT p AS job_id, seq, CASE WHEN t = 'purchase' AND seq % 5 = 0 THEN 'completed' ELSE t END AS status, seq AS progress, ts, false AS c FROM e
             UNION ALL SELECT p, NULL, 'cancelled', NULL, ts, true FROM e WHERE t = 'error' AND seq % 6 = 4),
       v AS (SELECT *, coalesce(bool_or(c OR status IN ('completed', 'failed', 'cancelled')) OVER w, false) AS gone, coalesce(max(seq) OVER w, -1) + 1 AS nx, coalesce(last_value(progress IGNORE NULLS) OVER w, 0) AS pr FROM m
             WINDOW w AS (PARTITION BY job_id ORDER BY ts, c, seq NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT job_id, CASE WHEN c THEN nx ELSE seq END AS seq, status, CASE WHEN c THEN pr ELSE progress END AS progress FROM v WHERE NOT gone"""
)
def cancelled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.cancel(*event_jobs(spark, sf_dir))


def event_questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A user's k-th error asks what the k-th view or click answers, before, after or never."""
    e = user_events(spark, sf_dir)

    def numbered(rows: DataFrame) -> DataFrame:
        k = F.row_number().over(W.partitionBy("process_id").orderBy("seq"))
        return rows.select(F.concat_ws("_", "process_id", k.cast("string")).alias("question_id"), "id", "event_type", F.col("ts").alias("at"))

    q = numbered(e.where("event_type = 'error'")).select("question_id", F.col("id").alias("task_id"), "at")
    return q, numbered(e.where("event_type IN ('click', 'view')")).select("question_id", F.initcap("event_type").alias("answer"), "at")


_ANSWERS = (
    _EV
    + f""", q AS (SELECT p || '_' || row_number() OVER (PARTITION BY p ORDER BY seq) AS q, id, ts FROM e WHERE t = 'error'), a AS (SELECT p || '_' || row_number() OVER (PARTITION BY p ORDER BY seq) AS q, t, ts FROM e WHERE t IN ('click', 'view')),
       o AS (SELECT q.q, q.id, a.t FROM q LEFT JOIN a ON a.q = q.q AND abs(epoch_ms(a.ts) - epoch_ms(q.ts)) <= {WAIT_MS}) """
)


@query(_ANSWERS + "SELECT q AS question_id, id AS task_id, CASE WHEN t IS NULL THEN 'expired' ELSE 'answered' END AS outcome, upper(t[1]) || t[2:] AS answer FROM o")
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.answer(*event_questions(spark, sf_dir), WAIT_MS)


@query(_ANSWERS + "SELECT e.id AS task_id, CASE coalesce(o.t, '') WHEN 'view' THEN 'r_view' WHEN 'click' THEN 'r_click' ELSE 'r_' || e.t END AS role_id FROM e LEFT JOIN o ON o.id = e.id")
def answers_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a task whose role is its type; answers to errors name another."""
    e = user_events(spark, sf_dir)
    roles = e.select(F.concat(F.lit("r_"), "event_type").alias("role_id"), F.upper("event_type").alias("name")).distinct()
    tasks = e.select(F.col("id").alias("task_id"), F.concat(F.lit("r_"), "event_type").alias("role_id"))
    return sessions.applied(tasks, answered_questions(spark, sf_dir), roles)
