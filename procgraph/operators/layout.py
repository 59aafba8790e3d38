"""Places of nodes and routes of edges in a process diagram. A process is small; each is laid out by itself."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRID, STEP_X, STEP_Y = 20, 120, 150


def grid(nodes: DataFrame) -> DataFrame:
    """process_id, id, x, y: a column for each node in order, a row for each lane. nodes: process_id, id, lane, seq."""
    i = F.row_number().over(W.partitionBy("process_id").orderBy("seq", "id")) - 1
    return nodes.select("process_id", "id", (F.lit(140) + 150 * i).alias("x"), (F.lit(20) + 120 * F.col("lane")).cast("int").alias("y"))


def midpoints(edges: DataFrame, places: DataFrame, width: int = 100, height: int = 80) -> DataFrame:
    """process_id, src, dst, x1, y1, x2, y2: from the right side of a node to the left side of the other."""
    a = places.select("process_id", F.col("id").alias("src"), (F.col("x") + width).alias("x1"), (F.col("y") + height // 2).alias("y1"))
    b = places.select("process_id", F.col("id").alias("dst"), F.col("x").alias("x2"), (F.col("y") + height // 2).alias("y2"))
    return edges.join(a, ["process_id", "src"]).join(b, ["process_id", "dst"]).select("process_id", "src", "dst", "x1", "y1", "x2", "y2")


def lane_bounds(nodes: DataFrame) -> DataFrame:
    """process_id, lane, width, x: lanes side by side, as wide as their fullest layer. nodes: process_id, lane, layer."""
    dense = nodes.groupBy("process_id", "lane", "layer").agg(F.count(F.lit(1)).alias("n")).groupBy("process_id", "lane").agg((STEP_X * F.greatest(F.max("n"), F.lit(1))).alias("width"))
    w = W.partitionBy("process_id").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    return dense.select("process_id", "lane", "width", F.coalesce(F.sum("width").over(w), F.lit(0).cast("long")).alias("x"))


def pool_box(lanes: DataFrame, padding: int = 30) -> DataFrame:
    """process_id, x_min, x_max of a pool around its lanes."""
    return lanes.groupBy("process_id").agg((F.min("x") - padding).alias("x_min"), (F.max(F.col("x") + F.col("width")) + padding).alias("x_max"))


def _feedback(ids: list, out: dict) -> set:
    """Edges that lead back to a node on the way from the root, by depth-first search in the given order."""
    state, back = dict.fromkeys(ids, 0), set()
    for root in ids:
        if state[root]:
            continue
        stack = [(root, iter(out.get(root, ())))]
        state[root] = 1
        while stack:
            node, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                state[node] = 2
                stack.pop()
            elif state.get(nxt) == 1:
                back.add((node, nxt))
            elif state.get(nxt) == 0:
                state[nxt] = 1
                stack.append((nxt, iter(out.get(nxt, ()))))
    return back


def layers(ids: list, edges: list) -> dict:
    """Layer of each node, breadth first from nodes without incoming edges; each node is expanded once."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    back = _feedback(ids, out)
    forward = [(a, b) for a, b in edges if (a, b) not in back]
    has_in = {b for _, b in forward}
    queue = [i for i in ids if i not in has_in] or ids[:1]
    layer, seen = dict.fromkeys(ids, 0), set(queue)
    next_of: dict = {}
    for a, b in forward:
        next_of.setdefault(a, []).append(b)
    for node in queue:
        for b in next_of.get(node, ()):
            if b in layer:
                layer[b] = max(layer[b], layer[node] + 1)
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
    return layer


def layered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """process_id, id, layer, x, y. nodes: process_id, id, lane, seq. edges: process_id, src, dst.

    Edges count in the order of what they lead from and to, so how rows arrive makes no difference. Nodes without a lane come
    last, in a lane of their own.
    """

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values(["seq", "id"])
        ids = n["id"].tolist()
        at = {i: k for k, i in enumerate(ids)}
        known = {(a, b) for a, b in zip(e["src"], e["dst"], strict=True) if a in at and b in at}
        layer = layers(ids, sorted(known, key=lambda x: (at[x[0]], at[x[1]])))
        lanes = [None if v is None or v != v else v for v in n["lane"]]
        full, place, left, x = {}, [], {}, 0
        for at_lane in zip(lanes, (layer[i] for i in ids), strict=True):
            place.append(full.get(at_lane, 0))
            full[at_lane] = place[-1] + 1
        for lane in sorted({v for v, _ in full}, key=lambda v: (v is None, v)):
            left[lane] = x
            x += STEP_X * max(c for (v, _), c in full.items() if v == lane)
        of = [layer[i] for i in ids]
        return pd.DataFrame({"process_id": key[0], "id": ids, "layer": of, "x": [left[v] + k * STEP_X + STEP_X // 2 for v, k in zip(lanes, place, strict=True)], "y": [STEP_Y * v + 40 for v in of]})

    return nodes.groupBy("process_id").cogroup(edges.groupBy("process_id")).applyInPandas(run, "process_id string, id string, layer long, x long, y long")


def simplify(points: list) -> list:
    """Without the points that lie on the straight line between their neighbours."""
    out = points[:1]
    for i in range(1, len(points) - 1):
        (ax, ay), (bx, by), (cx, cy) = out[-1], points[i], points[i + 1]
        if (bx - ax) * (cy - ay) != (by - ay) * (cx - ax):
            out.append(points[i])
    return out + points[-1:] if len(points) > 1 else out


def route(start: tuple, goal: tuple, boxes: list, most: int = 1000, beam: int = 100) -> list:
    """Way of horizontal and vertical steps on the grid round boxes, with few turns; an L if none is found.

    Beyond ``most`` open ways the ``beam`` best go on. The way stays within five steps of all that there is.
    """
    snap = lambda p: (round(p[0] / GRID) * GRID, round(p[1] / GRID) * GRID)
    a, b = snap(start), snap(goal)
    inside = {(px, py) for x, y, w, h in boxes for px in range((x // GRID + 1) * GRID, x + w, GRID) for py in range((y // GRID + 1) * GRID, y + h, GRID)}
    xs = [a[0], b[0], *(v for x, _, w, _ in boxes for v in (x, x + w))]
    ys = [a[1], b[1], *(v for _, y, _, h in boxes for v in (y, y + h))]
    left, right, top, bottom = min(xs) - 5 * GRID, max(xs) + 5 * GRID, min(ys) - 5 * GRID, max(ys) + 5 * GRID
    heap, best = [(0, 0, a, (0, 0), (a,))], {}
    while heap:
        if len(heap) > most:
            heap = heapq.nsmallest(beam, heap)
        _, turns, p, way, path = heapq.heappop(heap)
        if p == b:
            return simplify([start, *path, goal])
        for d in ((GRID, 0), (-GRID, 0), (0, GRID), (0, -GRID)):
            q = (p[0] + d[0], p[1] + d[1])
            t = turns + (way not in ((0, 0), d))
            if not (left <= q[0] <= right and top <= q[1] <= bottom) or (q in inside and q != b) or best.get((q, d), (1 << 30, 0)) <= (t, len(path)):
                continue
            best[q, d] = (t, len(path))
            far = abs(q[0] - b[0]) + abs(q[1] - b[1])
            heapq.heappush(heap, (100 * t + far + len(path), t, q, d, (*path, q)))
    return simplify([start, (goal[0], start[1]), goal])


def routes(places: DataFrame, edges: DataFrame, width: int = 100, height: int = 80) -> DataFrame:
    """process_id, src, dst, points (x,y joined by blanks). places: process_id, id, x, y. edges: process_id, src, dst."""

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        at = {i: (int(x), int(y)) for i, x, y in zip(n["id"], n["x"], n["y"], strict=True)}
        out = []
        for a, b in sorted(zip(e["src"], e["dst"], strict=True)):
            if a in at and b in at:
                boxes = [(x, y, width, height) for i, (x, y) in at.items() if i not in (a, b)]
                points = route((at[a][0] + width, at[a][1] + height // 2), (at[b][0], at[b][1] + height // 2), boxes)
                out.append((key[0], a, b, " ".join(f"{x},{y}" for x, y in points)))
        return pd.DataFrame(out, columns=["process_id", "src", "dst", "points"])

    return places.groupBy("process_id").cogroup(edges.groupBy("process_id")).applyInPandas(run, "process_id string, src string, dst string, points string")
