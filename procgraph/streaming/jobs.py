"""Jobs claimed from a queue and their progress as streams.

Everything works on micro-batches and on whole tables alike. Claims are keyed by job, so a batch that runs again after a
failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from procgraph.operators.graph import upsert

JOB = "job_id string, agent string, status string, query string"
EVENT = "job_id string, seq long, status string, progress long"
TERMINAL = ("completed", "failed", "cancelled")


def pending(jobs: DataFrame, agent: str) -> DataFrame:
    return jobs.where((F.col("agent") == agent) & (F.col("status") == "pending"))


def claim(store: DataFrame, batch: DataFrame, agent: str) -> DataFrame:
    """The store with the batch's pending jobs taken over as running; jobs that it has already stay as they are."""
    fresh = pending(batch, agent).dropDuplicates(["job_id"]).join(store.select("job_id"), "job_id", "left_anti").withColumn("status", F.lit("running"))
    return upsert(store, fresh, ["job_id"])


def changes(events: DataFrame) -> DataFrame:
    """Events whose status or progress differs from the one before in the job."""
    w = W.partitionBy("job_id").orderBy("seq")
    now = F.struct("status", "progress")
    return events.select("*", F.lag(now).over(w).alias("_was")).where(~now.eqNullSafe(F.col("_was"))).drop("_was")


def latest(events: DataFrame) -> DataFrame:
    """job_id, status, progress of the last event of each job, and how many there were."""
    order = F.struct("seq", "status", "progress")
    return events.groupBy("job_id").agg(F.max_by("status", order).alias("status"), F.max_by("progress", order).alias("progress"), F.count(F.lit(1)).alias("n_events"))


def mapped_progress(step: Column, total: Column, low: int, high: int) -> Column:
    """Step k of n as a whole number between low and high."""
    return F.floor(low + (high - low) * step / F.greatest(total, F.lit(1)))


def change_stream(events: DataFrame) -> DataFrame:
    """changes() of a stream: the last status of each job is kept as state, and is dropped when the job ends."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, out = (state.get if state.exists else None), []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            now = (r.status, int(r.progress))
            if now != was:
                out.append((key[0], int(r.seq), *now))
            was = now
        if was and was[0] in TERMINAL:
            state.remove()
        elif was:
            state.update(was)
        yield pd.DataFrame(out, columns=["job_id", "seq", "status", "progress"])

    return events.groupBy("job_id").applyInPandasWithState(run, EVENT, "status string, progress long", "append", GroupStateTimeout.NoTimeout)


def read_events(spark: SparkSession, path: str, schema: str = EVENT, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_jobs(jobs: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], seconds: int | None = 5) -> StreamingQuery:
    """Hands each micro-batch of jobs to a function that must be idempotent; all that is there once if seconds is None."""
    writer = jobs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
