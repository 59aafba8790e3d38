"""Streams of messages cut at random places, each piece by a query that starts from the checkpoint, against their twins over tables."""

import datetime as dt
import random

import pytest

from procgraph.streaming import sessions as s
from procgraph.streaming.jobs import EVENT, write_stream

T0 = dt.datetime(2024, 1, 1)
AT = lambda sec: T0 + dt.timedelta(seconds=sec)
FAR = 40 * 86_400


def cut(spark, tmp_path, tables, build, seed):
    """Rows of each table in the order of their times, in pieces; a query that stops and starts again after each."""
    rng = random.Random(seed)
    times = sorted({r[-1] for _, rows in tables for r in rows})
    stops = sorted(rng.sample(times[1:], 3)) + [None]
    out, cp, low = str(tmp_path / "out"), str(tmp_path / "cp"), None
    paths = [str(tmp_path / f"in{i}") for i in range(len(tables))]
    for high in stops:
        for (schema, rows), path in zip(tables, paths, strict=True):
            part = [r for r in rows if (low is None or r[-1] >= low) and (high is None or r[-1] < high)]
            rng.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        streams = [spark.readStream.schema(schema).parquet(p) for (schema, _), p in zip(tables, paths, strict=True)]
        q = write_stream(build(*streams), out, cp)
        assert q.awaitTermination(120) and q.exception() is None
        low = high
    return spark.read.parquet(out)


def rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=repr)


def test_accumulation(spark, tmp_path):
    rng, data = random.Random(5), []
    for j in range(12):
        n = rng.randint(0, 9)
        data += [(f"j{j}", i, rng.choice(["a", "b", "list", None]), rng.choice(["x", "y", "한", None]), rng.choice([False, None]), AT(rng.randint(0, 500))) for i in range(n) if not (j % 4 == 1 and i == 0 and n > 1)]
        data += [(f"j{j}", n, None, None, True, AT(rng.randint(0, 500)))] * (j % 5 != 2)
    data += rng.sample(data, 10)  # messages that come twice
    data += [(None, 0, "a", "x", False, AT(9)), ("j0", None, "a", "x", False, AT(9)), ("j0", -1, "a", "x", False, AT(9))]
    want = s.accumulate(spark.createDataFrame(data, s.DELTA), ("list",))
    got = cut(spark, tmp_path, [(s.DELTA, data)], lambda d: s.accumulate_stream(d, ("list",), delay="1 hour"), 1)
    assert rows(got) == rows(want) and want.count()
    assert {r["job_id"] for r in want.select("job_id").collect()}.isdisjoint({"j2", "j7"})


def test_cancellation(spark, tmp_path):
    rng, events, controls = random.Random(6), [], []
    for j in range(12):
        for i in range(rng.randint(0, 12)):
            events.append((f"j{j}", i, rng.choice(["run", "wait", "completed" if i > 6 else "run"]), i * 10, AT(20 * i + j)))
        controls += [(f"j{j}", AT(rng.randint(0, 12) * 20 + j))] * rng.choice([0, 1, 2])
    shape, control = EVENT + ", at timestamp", "job_id string, at timestamp"
    want = s.cancel(spark.createDataFrame(events, shape), spark.createDataFrame(controls, control))
    got = cut(spark, tmp_path, [(shape, events), (control, controls)], s.cancel_stream, 2)
    assert rows(got) == rows(want)
    over = [r for r in rows(want) if r[2] == "cancelled"]
    assert over and len({r[0] for r in over}) == len(over)
    assert not any(e[0] == c[0] and e[1] > c[1] for c in over for e in rows(want))


def test_people(spark, tmp_path):
    """Answers before, after, too early, too late, twice and never; the last question moves the time on."""
    rng, q, a = random.Random(7), [], []
    for i in range(25):
        at = rng.randint(0, 5000)
        q.append((f"q{i}", f"t{i}", AT(at)))
        a += [(f"q{i}", rng.choice(["Clerk", "BOSS", None]), AT(max(0, at + rng.choice([-900, -300, -1, 0, 1, 250, 300, 301, 900])))) for _ in range(rng.randint(0, 2))]
    a.append(("nobody", "x", AT(10)))
    asked, said = spark.createDataFrame(q, s.QUESTION), spark.createDataFrame(a, s.ANSWER)
    want = s.answer(asked, said, 300_000)
    far = [("end", "t", AT(FAR)), ("end2", "t", AT(2 * FAR))]
    got = cut(spark, tmp_path, [(s.QUESTION, q + far), (s.ANSWER, a)], lambda x, y: s.answer_stream(x, y, 300_000), 3).where("question_id NOT LIKE 'end%'")
    assert rows(got) == rows(want)
    assert {r[2] for r in rows(want)} == {"answered", "expired"}


def test_applied(spark):
    df = spark.createDataFrame
    tasks = df([("t1", "r0", 1), ("t2", "r0", 2), ("t3", None, 3)], "task_id string, role_id string, extra int")
    out = df([("q1", "t1", "answered", "CLERK"), ("q2", "t1", "answered", "boss"), ("q3", "t2", "answered", "nobody"), ("q4", "t3", "expired", None), (None, None, "answered", None)], s.OUTCOME)
    roles = df([("r2", "Clerk"), ("r1", "clerk"), ("r3", "Boss"), ("r4", None)], "role_id string, name string")
    assert rows(s.applied(tasks, out, roles)) == [("t1", "r3", 1), ("t2", "r0", 2), ("t3", None, 3)]


@pytest.mark.parametrize("twin", [lambda e: s.accumulate(e("x", s.DELTA)), lambda e: s.cancel(e("x", EVENT + ", at timestamp"), e("y", "job_id string, at timestamp")), lambda e: s.answer(e("x", s.QUESTION), e("y", s.ANSWER), 1)])
def test_empty(spark, twin):
    assert twin(lambda _, schema: spark.createDataFrame([], schema)).count() == 0
