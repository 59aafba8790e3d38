"""Whole models laid out: lanes beside each other, layers below each other, ways round all boxes, written back into the elements.

Places in a lane's layer go by seq, lanes by their first node, nodes without a lane come last in a lane of their own. Boxes
never overlap: a lane is as wide as its fullest layer needs. A flow leaves a box in the middle of its lower side and enters
one in the middle of its upper side, in horizontal and vertical steps. Sideways, all coordinates change places.

Defined results: rows without a process are left out; a flow to or from what isn't there has no points; of nodes with one id
the first counts, the others have no place. Layers and ways are found a process at a time, which has to fit in a task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.functions.text import strip
from procgraph.operators.graph import checkpointed, first_by
from procgraph.operators.layout import GRID, STEP_Y, lane_bounds, layered, route

#: Width and height of a node by its kind (fixed values).
SIZES = {"Gateway": (50, 50), "Event": (34, 34)}
ACTIVITY = (100, 80)


def _size(i: int) -> Column:
    kind = F.col("kind")
    return F.coalesce(*[F.when(kind == k, F.lit(v[i])) for k, v in SIZES.items()], F.lit(ACTIVITY[i])).cast("long")


def _pairs(elements: DataFrame) -> DataFrame:
    said = elements.where("kind = 'Sequence' AND process_id IS NOT NULL").select(*[F.col(c).alias(n) for c, n in (("process_id", "process_id"), ("source", "src"), ("target", "dst"))])
    return said.distinct()


def places(elements: DataFrame) -> DataFrame:
    """process_id, id, lane, lane_no, layer, x, y, width, height of the nodes; x and y are those of the upper left corner."""
    nodes = first_by(elements.where("process_id IS NOT NULL AND kind <> 'Sequence' AND id IS NOT NULL").select("process_id", "id", "seq", "kind", strip(F.coalesce("lane", F.lit(""))).alias("lane")), ["process_id", "id"], "seq", "kind", "lane")
    lanes = nodes.groupBy("process_id", "lane").agg(F.min(F.struct("seq", "id")).alias("_at"))
    lanes = lanes.withColumn("lane_no", F.row_number().over(W.partitionBy("process_id").orderBy(F.col("lane") == "", "_at"))).drop("_at")
    nodes = nodes.join(lanes, ["process_id", "lane"])
    flows = _pairs(elements)
    found = layered(nodes.select("process_id", "id", F.col("lane_no").alias("lane"), "seq"), flows)
    sized = nodes.select("process_id", "id", "lane", "lane_no", _size(0).alias("width"), _size(1).alias("height")).join(found, ["process_id", "id"])
    middle = F.lit(ACTIVITY[1] // 2)
    return sized.select("process_id", "id", "lane", "lane_no", "layer", (F.col("x") - F.expr("width div 2")).alias("x"), (F.col("y") + middle - F.expr("height div 2")).alias("y"), "width", "height")


def ways(boxes: DataFrame, flows: DataFrame) -> DataFrame:
    """process_id, src, dst, points (x,y joined by blanks). boxes: places(). flows: process_id, src, dst."""

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        at = {r.id: (int(r.x), int(r.y), int(r.width), int(r.height)) for r in n.itertuples(index=False)}
        every, out = list(at.values()), []
        for a, b in sorted({(a, b) for a, b in zip(e["src"], e["dst"], strict=True) if a in at and b in at}):
            (ax, ay, aw, ah), (bx, by, bw, _) = at[a], at[b]
            start, goal = (ax + aw // 2, ay + ah), (bx + bw // 2, by)
            below, above = -(-start[1] // GRID) * GRID, goal[1] // GRID * GRID
            points = [start, *route((start[0], below), (goal[0], above), every), goal]
            out.append((key[0], a, b, " ".join(f"{x},{y}" for i, (x, y) in enumerate(points) if not i or points[i - 1] != (x, y))))
        return pd.DataFrame(out, columns=["process_id", "src", "dst", "points"])

    return boxes.groupBy("process_id").cogroup(flows.groupBy("process_id")).applyInPandas(run, "process_id string, src string, dst string, points string")


def laid_out(elements: DataFrame, sideways: bool = False) -> DataFrame:
    """elements with layer, x, y, width, height (of nodes) and points (of flows).

    elements: process_id, seq, kind, id, source, target, lane, and more.
    """
    boxes = checkpointed(places(elements))
    flows = _pairs(elements)
    lines = ways(boxes, flows).select("process_id", F.col("src").alias("source"), F.col("dst").alias("target"), "points")
    if sideways:
        boxes = boxes.select("process_id", "id", "layer", F.col("y").alias("x"), F.col("x").alias("y"), F.col("height").alias("width"), F.col("width").alias("height"))
        lines = lines.withColumn("points", F.regexp_replace("points", r"(-?\d+),(-?\d+)", "$2,$1"))
    own = elements.where("process_id IS NOT NULL").drop("layer", "x", "y", "width", "height", "points")
    first = F.row_number().over(W.partitionBy("process_id", "id").orderBy("seq", "kind", strip(F.coalesce("lane", F.lit("")))))
    nodes = own.where("kind <> 'Sequence'").withColumn("_k", first).join(boxes.select("process_id", "id", F.lit(1).alias("_k"), "layer", "x", "y", "width", "height"), ["process_id", "id", "_k"], "left").drop("_k")
    said = own.where("kind = 'Sequence'").join(lines, ["process_id", "source", "target"], "left")
    return nodes.unionByName(said, allowMissingColumns=True)


def lane_boxes(elements: DataFrame, sideways: bool = False) -> DataFrame:
    """process_id, lane, x, y, width, height of the lanes around their nodes; the lane of those without one is empty."""
    boxes = places(elements)
    height = boxes.groupBy("process_id").agg(((F.max("layer") + 1) * STEP_Y).alias("height"))
    names = boxes.select("process_id", "lane", "lane_no").distinct()
    wide = lane_bounds(boxes.select("process_id", F.col("lane_no").alias("lane"), "layer")).withColumnRenamed("lane", "lane_no")
    got = wide.join(names, ["process_id", "lane_no"]).join(height, "process_id")
    x, w = F.col("x").cast("long"), F.col("width").cast("long")
    y, h = F.lit(0).cast("long"), F.col("height").cast("long")
    return got.select("process_id", "lane", *[c.alias(n) for c, n in zip((y, x, h, w) if sideways else (x, y, w, h), ("x", "y", "width", "height"), strict=True)])
