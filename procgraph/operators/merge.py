"""Deduplication and merging of extracted entities. Input order is the column seq."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.functions.similarity import STOP_WORDS
from procgraph.functions.text import name_key, or_else, strip
from procgraph.operators.graph import first_by


def keep_first(rows: DataFrame, key: Column) -> DataFrame:
    """The first row of each key by seq."""
    return first_by(rows.withColumn("_key", key), ["_key"], "seq").drop("_key")


def merge_list(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both lists, one row for each id (the first); rows without an id all stay. Columns id and seq."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    named = first_by(both.where("id IS NOT NULL AND id <> ''"), ["id"], "_side", "seq")
    return named.unionByName(both.where("id IS NULL OR id = ''")).drop("_side")


def process_map(processes: DataFrame) -> DataFrame:
    """old_id, new_id: each process to the first of its name. processes: proc_id, name, seq."""
    keyed = processes.select("proc_id", "seq", name_key("name").alias("_key"))
    first = keyed.groupBy("_key").agg(F.min_by("proc_id", "seq").alias("new_id"))
    return keyed.join(first, "_key").select(F.col("proc_id").alias("old_id"), "new_id")


def merge_processes(processes: DataFrame) -> DataFrame:
    """One process for each name: the first one's id and name, and the first description and purpose that aren't empty."""
    order = F.struct("seq", "proc_id")
    first_text = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", order)), F.lit("")).alias(c)
    grouped = processes.groupBy(name_key("name").alias("_key"))
    return grouped.agg(F.min_by("proc_id", order).alias("proc_id"), F.min_by("name", order).alias("name"), first_text("description"), first_text("purpose"), F.count(F.lit(1)).alias("n_merged")).drop("_key")


def remap(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """rows with the ids in a column exchanged as old_id, new_id say; others stay."""
    m = mapping.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    return rows.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def _alike(a: str, b: str, near: bool) -> bool:
    """Whether two names mean the same task; near: they stand next to each other in the process."""
    a, b = a.lower().strip(), b.lower().strip()
    if a in b or b in a:
        return True
    p, q = (set(s.replace(" ", "").replace("및", " ").split()) - set(STOP_WORDS) for s in (a, b))
    common = len(p & q)
    if common and 2 * common >= min(len(p), len(q)):
        return True
    x, y = set(a), set(b)
    return near and bool(x and y) and len(x & y) / len(x | y) > 0.6


def merge_tasks(tasks: DataFrame) -> DataFrame:
    """old_id, task_id, name, description: tasks of a process and role that are alike become one.

    In order, each task that isn't taken yet gathers the later ones like it. The longest name (the first of such) stands for
    the group; descriptions are joined, distinct and sorted. Groups are small: one process and role.
    tasks: task_id, process_id, role_id, name, description, order, seq.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows = p.sort_values(["order", "seq", "task_id"]).to_dict("records")
        taken, out = set(), []
        for i, r in enumerate(rows):
            if i in taken:
                continue
            near = lambda j, r=r: abs(r["order"] - rows[j]["order"]) <= 1
            group = [j for j in range(i, len(rows)) if j not in taken and (j == i or _alike(r["name"] or "", rows[j]["name"] or "", near(j)))]
            taken.update(group)
            best = max((rows[j] for j in group), key=lambda x: len(x["name"] or ""))
            text = " | ".join(sorted({rows[j]["description"] for j in group if rows[j]["description"]}))
            out += [(rows[j]["task_id"], best["task_id"], best["name"], text) for j in group]
        return pd.DataFrame(out, columns=["old_id", "task_id", "name", "description"])

    return tasks.groupBy("process_id", "role_id").applyInPandas(run, "old_id string, task_id string, name string, description string")


def flow_union(explicit: DataFrame, derived: DataFrame, ordered: DataFrame) -> DataFrame:
    """Flows from three sources; pairs that an earlier source has are left out of the next, the first row of a pair counts.

    Each: src, dst, condition, seq.
    """
    rank = lambda df, k: df.select("src", "dst", or_else("condition", "").alias("condition"), "seq", F.lit(k).alias("_k"))
    every = rank(explicit, 0).unionByName(rank(derived, 1)).unionByName(rank(ordered, 2))
    best = every.groupBy("src", "dst").agg(F.min_by(F.struct("condition", "_k"), F.struct("_k", "seq", "condition")).alias("b"))
    return best.select("src", "dst", F.col("b.condition").alias("condition"), F.col("b._k").alias("source"))


def merge_lines(base: Column, extra: Column) -> Column:
    """The stripped lines of base, then those of extra that base doesn't have, once each; base as it is if extra has none."""
    lines = lambda x: F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\r\n|\r|\n"), strip), lambda s: s != "")
    merged = F.array_join(F.concat(lines(base), F.array_except(lines(extra), lines(base))), "\n")
    return F.when(F.size(lines(extra)) == 0, F.coalesce(base, F.lit(""))).otherwise(merged)
