"""Layouts of random models: boxes never overlap, flows start and end at their boxes and go through none."""

import random

import pytest

from procgraph.operators.autolayout import laid_out, lane_boxes

SCHEMA = "process_id string, seq long, kind string, id string, source string, target string, lane string, x long, extra int"


def models(n=25):
    rng, out = random.Random(4), []
    for p in range(n):
        ids = [f"n{i}" for i in range(rng.randint(1, 9))]
        out += [(f"p{p}", i, rng.choice(["Activity", "Gateway", "Event", "Thing"]), k, "", "", rng.choice(["A", " B", "C", "", None]), 7, i) for i, k in enumerate(ids)]
        out += [(f"p{p}", 50 + i, "Sequence", f"f{i}", rng.choice(ids), rng.choice([*ids, "gone", None]), None, None, i) for i in range(rng.randint(0, 12))]
    out += [("p0", 99, "Activity", "n0", "", "", "A", None, 0), (None, 1, "Activity", "n0", "", "", "A", None, 0)]
    return out


@pytest.fixture(scope="module")
def done(spark):
    df = spark.createDataFrame(models(), SCHEMA)
    return df, [r.asDict() for r in laid_out(df).collect()]


def points(r):
    return [tuple(map(int, p.split(","))) for p in r["points"].split(" ")]


def overlap(a, b):
    return a["x"] < b["x"] + b["width"] and b["x"] < a["x"] + a["width"] and a["y"] < b["y"] + b["height"] and b["y"] < a["y"] + a["height"]


def crosses(p, q, r):
    (x1, x2), (y1, y2) = sorted((p[0], q[0])), sorted((p[1], q[1]))
    return x1 < r["x"] + r["width"] and x2 > r["x"] and y1 < r["y"] + r["height"] and y2 > r["y"]


def test_rows_are_kept(done):
    df, got = done
    assert sorted((r["process_id"], r["seq"], r["extra"]) for r in got) == sorted((r["process_id"], r["seq"], r["extra"]) for r in df.where("process_id IS NOT NULL").collect())
    again = [r for r in got if (r["process_id"], r["seq"]) == ("p0", 99)]
    assert again[0]["x"] is None and next(r for r in got if (r["process_id"], r["seq"]) == ("p0", 0))["x"] is not None


def test_boxes(spark, done):
    lanes = {(r["process_id"], r["lane"]): r.asDict() for r in lane_boxes(done[0]).collect()}
    for p in {r["process_id"] for r in done[1]}:
        nodes = [r for r in done[1] if r["process_id"] == p and r["kind"] != "Sequence" and r["x"] is not None]
        assert not any(overlap(a, b) for i, a in enumerate(nodes) for b in nodes[:i])
        mine = [v for (q, _), v in lanes.items() if q == p]
        assert not any(overlap(a, b) for i, a in enumerate(mine) for b in mine[:i])
        for r in nodes:
            lane = lanes[p, (r["lane"] or "").strip()]
            assert lane["x"] <= r["x"] and r["x"] + r["width"] <= lane["x"] + lane["width"] and lane["y"] <= r["y"] and r["y"] + r["height"] <= lane["y"] + lane["height"]


def test_ways(done):
    n = 0
    for p in {r["process_id"] for r in done[1]}:
        at = {r["id"]: r for r in done[1] if r["process_id"] == p and r["kind"] != "Sequence" and r["x"] is not None}
        for r in (r for r in done[1] if r["process_id"] == p and r["kind"] == "Sequence"):
            if r["target"] not in at:
                assert r["points"] is None
                continue
            a, b, way = at[r["source"]], at[r["target"]], points(r)
            assert way[0] == (a["x"] + a["width"] // 2, a["y"] + a["height"]) and way[-1] == (b["x"] + b["width"] // 2, b["y"])
            assert all((x == u) != (y == v) for (x, y), (u, v) in zip(way, way[1:], strict=False))
            assert not any(crosses(q, s, box) for q, s in zip(way, way[1:], strict=False) for box in at.values())
            n += 1
    assert n > 50


def test_sideways(done):
    def flip(r):
        way = None if r["points"] is None else " ".join(f"{y},{x}" for x, y in points(r))
        return r | {"x": r["y"], "y": r["x"], "width": r["height"], "height": r["width"], "points": way}

    got = [r.asDict() for r in laid_out(done[0], sideways=True).collect()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(map(key, got)) == sorted(key(flip(r)) for r in done[1])


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert laid_out(none).count() == 0 and lane_boxes(none).count() == 0
