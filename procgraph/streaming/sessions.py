"""Jobs that are built up, cancelled, or wait for people: keyed state over streams, each with a twin over whole tables.

Times are event times. A stream may be cut anywhere and started again from its checkpoint; it then gives what its twin gives
for the whole table, provided that messages come in the order of their times, but for those no later than ``delay``, and
those of one job, or of one question, exactly so. Rows behind the watermark are left out. State goes by timers, so that of
jobs that never end doesn't stay. Rows without a key or a time are left out by both forms. The state of one key is in memory.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from procgraph.streaming.jobs import EVENT, TERMINAL

DELTA = "job_id string, seq long, field string, value string, ended boolean, at timestamp"
PART = "job_id string, field string, values array<string>"
QUESTION = "question_id string, task_id string, at timestamp"
ANSWER = "question_id string, answer string, at timestamp"
OUTCOME = "question_id string, task_id string, outcome string, answer string"

Step = Callable[[str, pd.DataFrame, dict], tuple[list[tuple], dict | None, int]]


def _stateful(df: DataFrame, key: str, schema: str, delay: str, step: Step, late: Callable[[str, dict, int], tuple[list[tuple], dict | None, int]]) -> DataFrame:
    """Runs step over the new rows of each key, late when its timer is due; both give rows, the state (None: gone) and its timer in ms."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            out, now, until = late(k[0], was, state.getCurrentWatermarkMs())
        else:
            out, now, until = step(k[0], pd.concat(list(frames)), was)
            if now is not None and until <= state.getCurrentWatermarkMs():
                more, now, until = late(k[0], now, state.getCurrentWatermarkMs())
                out = out + more
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(now),))
            state.setTimeoutTimestamp(until)
        yield pd.DataFrame(out, columns=names)

    given = df.where(F.col(key).isNotNull() & F.col("at").isNotNull()).withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay).withColumn("ms", F.unix_millis(F.col("at").cast("timestamp")))
    return given.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def _none(v: object) -> object:
    return None if v is None or v != v else v


def accumulate(deltas: DataFrame, lists: tuple[str, ...] = ()) -> DataFrame:
    """job_id, field, values of each job whose deltas are all there: the last value of a field by seq, all of them in order for lists.

    deltas: DELTA, with seq from 0. The row with ended says how many there are by its seq. A seq that is there again counts
    once, by its least row. A null field changes nothing; a seq that is null or negative is left out, and one beyond the end
    keeps the job from being whole.
    """
    d = deltas.where("job_id IS NOT NULL AND at IS NOT NULL AND seq >= 0")
    ends = d.where("ended").groupBy("job_id").agg(F.min("seq").alias("total"))
    once = d.where("NOT coalesce(ended, false)").groupBy("job_id", "seq").agg(F.min(F.struct("field", "value")).alias("d")).select("job_id", "seq", "d.*")
    whole = once.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("most")).join(ends, "job_id").where("n = total AND most = total - 1").select("job_id")
    order = F.array_sort(F.collect_list(F.struct("seq", "value")))
    said = once.where("field IS NOT NULL").join(whole, "job_id", "left_semi").groupBy("job_id", "field").agg(order.alias("all"), F.max_by("value", "seq").alias("last"))
    values = F.when(F.col("field").isin(*lists) if lists else F.lit(False), F.transform("all", lambda x: x["value"])).otherwise(F.array("last"))
    return said.select("job_id", "field", values.alias("values"))


def accumulate_stream(deltas: DataFrame, lists: tuple[str, ...] = (), delay: str = "10 seconds", keep_ms: int = 86_400_000) -> DataFrame:
    """accumulate() of a stream: a job's rows come all at once when the last delta is there; deltas may come in any order.

    A job without a new delta for keep_ms is given up.
    """

    def step(job: str, rows: pd.DataFrame, was: dict) -> tuple[list[tuple], dict | None, int]:
        seen, total, last = was.get("seen", {}), was.get("total"), max(was.get("last", 0), int(rows["ms"].max()))
        fresh: dict = {}
        for r in rows.itertuples(index=False):
            if _none(r.seq) is None or r.seq < 0:
                continue
            if _none(r.ended):
                total = int(r.seq) if total is None else min(total, int(r.seq))
            else:
                fresh.setdefault(str(int(r.seq)), []).append([_none(r.field), _none(r.value)])
        for k, all_of in fresh.items():
            seen.setdefault(k, min(all_of, key=lambda x: [(v is not None, v or "") for v in x]))
        if was.get("done") or total is None or len(seen) != total or any(int(k) >= total for k in seen):
            return [], ({"done": True, "last": last} if was.get("done") else {"seen": seen, "total": total, "last": last}), last + keep_ms
        fields: dict = {}
        for _, (field, value) in sorted(seen.items(), key=lambda kv: int(kv[0])):
            if field is not None:
                fields[field] = [*fields.get(field, []), value] if field in lists else [value]
        return [(job, f, v) for f, v in fields.items()], {"done": True, "last": last}, last + keep_ms

    return _stateful(deltas, "job_id", PART, delay, step, lambda job, was, now: ([], None, 0))


def _messages(events: DataFrame, controls: DataFrame) -> DataFrame:
    cancel = controls.select("job_id", F.lit(None).cast("long").alias("seq"), F.lit("cancelled").alias("status"), F.lit(None).cast("long").alias("progress"), "at", F.lit(True).alias("cancel"))
    return events.select("job_id", "seq", "status", "progress", "at", F.lit(False).alias("cancel")).unionByName(cancel)


def cancel(events: DataFrame, controls: DataFrame) -> DataFrame:
    """The events of jobs up to their end; a job that is cancelled before gets one event that says so, and none after it.

    That event has the next seq and the progress so far. Events come before a control of the same time, and a job that is
    cancelled without having begun is cancelled all the same. events: EVENT and at. controls: job_id, at.
    """
    m = _messages(events, controls).where("job_id IS NOT NULL AND at IS NOT NULL")
    so_far = W.partitionBy("job_id").orderBy("at", "cancel", F.col("seq").asc_nulls_first(), "status", "progress").rowsBetween(W.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.col("status").isin(*TERMINAL) | F.col("cancel")).over(so_far), F.lit(False))
    most, last = F.max("seq").over(so_far), F.last("progress", ignorenulls=True).over(so_far)
    of: Callable[[str, Column], Column] = lambda c, other: F.when(F.col("cancel"), other).otherwise(F.col(c)).alias(c)
    said = m.select("*", over.alias("over"), (F.coalesce(most, F.lit(-1)) + 1).alias("next"), F.coalesce(last, F.lit(0)).alias("at_last"))
    return said.where("NOT over").select("job_id", of("seq", F.col("next")), "status", of("progress", F.col("at_last")))


def cancel_stream(events: DataFrame, controls: DataFrame, delay: str = "10 seconds", keep_ms: int = 86_400_000) -> DataFrame:
    """cancel() of two streams. That a job is over is known until keep_ms after its last message."""

    def step(job: str, rows: pd.DataFrame, was: dict) -> tuple[list[tuple], dict | None, int]:
        over, most, last, at, out = was.get("over", False), was.get("most", -1), was.get("progress", 0), was.get("at", 0), []
        key = lambda v: (_none(v) is not None, _none(v))  # noqa: E731  nulls first, as columns have it
        order = sorted(rows.itertuples(index=False), key=lambda r: (r.at, r.cancel, *[x for v in (r.seq, r.status, r.progress) for x in (key(v) if _none(v) is not None else (False, 0))]))
        for r in order:
            at = max(at, int(r.ms))
            if over:
                continue
            seq, progress = _none(r.seq), _none(r.progress)
            if r.cancel:
                seq, progress = most + 1, last
            out.append((job, seq if seq is None else int(seq), _none(r.status), progress if progress is None else int(progress)))
            over = bool(r.cancel) or r.status in TERMINAL
            most, last = max(most, int(seq)) if seq is not None else most, int(progress) if progress is not None else last
        return out, {"over": over, "most": most, "progress": last, "at": at}, at + keep_ms

    return _stateful(_messages(events, controls), "job_id", EVENT, delay, step, lambda job, was, now: ([], None, 0))


def answer(questions: DataFrame, answers: DataFrame, wait_ms: int) -> DataFrame:
    """OUTCOME of each question: answered by the first answer no further than wait_ms before or after it, else expired.

    Of equal times the least answer counts; of questions with one id the first. questions: QUESTION. answers: ANSWER.
    """
    given = lambda df: df.where("question_id IS NOT NULL AND at IS NOT NULL").withColumn("ms", F.unix_millis(F.col("at").cast("timestamp")))
    q = given(questions).groupBy("question_id").agg(F.min(F.struct("ms", "task_id")).alias("q")).select("question_id", F.col("q.ms").alias("asked"), "q.task_id")
    a = given(answers).join(q, "question_id").where(F.abs(F.col("ms") - F.col("asked")) <= wait_ms).groupBy("question_id").agg(F.min(F.struct("ms", "answer")).alias("a"))
    got = q.join(a, "question_id", "left")
    return got.select("question_id", "task_id", F.when(F.col("a").isNull(), "expired").otherwise("answered").alias("outcome"), F.col("a.answer").alias("answer"))


def answer_stream(questions: DataFrame, answers: DataFrame, wait_ms: int, delay: str = "10 seconds") -> DataFrame:
    """answer() of two streams: a question waits until an answer or its timer comes; an answer may come first and then waits as long.

    An outcome comes once; the question is known until its time is over, so further answers change nothing.
    """
    q = questions.select("question_id", "task_id", F.lit(None).cast("string").alias("answer"), "at", F.lit(True).alias("asks"))
    a = answers.select("question_id", F.lit(None).cast("string").alias("task_id"), "answer", "at", F.lit(False).alias("asks"))

    def step(question: str, rows: pd.DataFrame, was: dict) -> tuple[list[tuple], dict | None, int]:
        if was.get("done"):
            return [], was, was["asked"] + wait_ms + 1
        asked, task = was.get("asked"), was.get("task")
        known = was.get("answers", [])
        text = lambda v: (_none(v) is not None, _none(v) or "")
        for r in sorted(rows.itertuples(index=False), key=lambda r: (r.ms, text(r.task_id))):
            if r.asks and asked is None:
                asked, task = int(r.ms), _none(r.task_id)
            elif not r.asks:
                known.append([int(r.ms), _none(r.answer)])
        if asked is None:
            return [], {"answers": known}, max(ms for ms, _ in known) + wait_ms + 1
        near = [(ms, *text(x)) for ms, x in known if abs(ms - asked) <= wait_ms]
        state = {"asked": asked, "task": task, "answers": []}
        if not near:
            return [], state, asked + wait_ms + 1
        _, said, best = min(near)
        return [(question, task, "answered", best if said else None)], state | {"done": True}, asked + wait_ms + 1

    def late(question: str, was: dict, now: int) -> tuple[list[tuple], dict | None, int]:
        waits = "asked" in was and not was.get("done")
        return ([(question, was["task"], "expired", None)] if waits else []), None, 0

    return _stateful(q.unionByName(a), "question_id", OUTCOME, delay, step, late)


def applied(tasks: DataFrame, outcomes: DataFrame, roles: DataFrame) -> DataFrame:
    """tasks with the role that the answer about them names, where there is one: names as they are in lower case.

    Of several answers about a task the one to the last question by id counts, of roles of one name the first by id.
    tasks: task_id, role_id, and more. roles: role_id, name.
    """
    named = roles.groupBy(F.lower("name").alias("_name")).agg(F.min("role_id").alias("_role"))
    said = outcomes.where("outcome = 'answered'").select("task_id", "question_id", F.lower("answer").alias("_name")).join(named, "_name")
    last = said.groupBy("task_id").agg(F.max_by("_role", "question_id").alias("_role"))
    return tasks.join(last, "task_id", "left").withColumn("role_id", F.coalesce("_role", "role_id")).drop("_role").select(tasks.columns)
