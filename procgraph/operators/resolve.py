"""Joins that find, for each row, the first of several others that matches.

Containment can't be hashed, but a text that contains a name contains the name's leading characters. Both sides meet by
those, and what meets is looked at as a whole; no pair is formed that has them not in common.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.functions.similarity import action, char_jaccard, cosine
from procgraph.functions.text import name_key, text_key

#: Numbers of leading characters by which names are filed; a name goes by the largest that isn't over its length.
GRAMS = (16, 3, 2, 1)
#: Names up to which their leading characters are sent to every task.
SMALL = 20_000
#: Different names up to which each text is searched for all of them.
FEW = 256
#: Characters of a text that are cut into grams together.
PIECE = 4096


def _containing_few(texts: DataFrame, names: DataFrame, text: str, name: str, words: list[str], small: bool) -> DataFrame:
    """The same for a few different names, in one pass over the texts; only texts that hold one go on to the join."""
    asked = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    held = F.flatten(F.transform(F.array(F.col(text)), lambda t: F.filter(asked, lambda w: F.contains(t, w))))  # the text is made once, not for each name
    hits = texts.where(F.col(text) != "").withColumn("_w", F.explode_outer(held)).where("_w IS NOT NULL")
    return hits.join(F.broadcast(names) if small else names, F.col("_w") == F.col(name)).drop("_w")


def containing(texts: DataFrame, names: DataFrame, text: str, name: str, small: int = SMALL) -> DataFrame:
    """Pairs of rows where the text contains the name (not empty). Columns of both sides must differ in name."""
    known = names.where(F.length(name) > 0)
    counts = known.groupBy(F.col(name).alias("_w")).agg(F.count(F.lit(1)).alias("n")).limit(FEW + 1).collect()
    if len(counts) <= FEW:
        return _containing_few(texts, known, text, name, sorted(r["_w"] for r in counts), sum(r["n"] for r in counts) <= small)
    length = F.coalesce(*[F.when(F.length(name) >= n, n) for n in GRAMS])
    filed = known.withColumn("_g", F.left(F.col(name), length))
    keys = filed.select("_g").distinct()
    few = keys.limit(small + 1).count() <= small
    keyed = texts.where(F.col(text) != "").withColumn("_t", F.xxhash64(text))
    used = [n for n in GRAMS if not filed.where(F.length("_g") == n).isEmpty()] if few else list(GRAMS)
    met = []
    for n in used:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / PIECE).cast("int")), lambda j: F.substring(F.col(text), j * PIECE + 1, F.lit(PIECE + n - 1)))  # noqa: B023
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_p") - n + 1)), lambda i: F.substring(F.col("_p"), i, F.lit(n))))  # noqa: B023
        cut = keyed.select("_t", F.explode(pieces).alias("_p")).select("_t", F.explode(grams).alias("_g"))
        met.append(cut.join(F.broadcast(keys) if few else keys, "_g", "left_semi"))
    if not met:
        met = [keyed.select("_t", F.lit("").alias("_g")).where("false")]
    pairs = reduce(DataFrame.unionByName, met).distinct()
    return keyed.join(pairs, "_t").join(filed, "_g").where(F.col(text).contains(F.col(name))).drop("_t", "_g")


def infer_roles(tasks: DataFrame, roles: DataFrame, assigned: DataFrame) -> DataFrame:
    """task_id, role_id: for tasks without a role, the first role whose name or unit (over two characters) is in the text.

    tasks: task_id, text. roles: role_id, name, org_unit, seq. assigned: task_id.
    """
    open_tasks = tasks.join(assigned.select("task_id").distinct(), "task_id", "left_anti").select("task_id", F.lower("text").alias("_text"))
    words = roles.select("role_id", "seq", F.posexplode(F.array("name", "org_unit")).alias("_k", "_w")).select("role_id", "seq", "_k", F.lower("_w").alias("_word")).where(F.length("_word") > 2)
    hits = containing(open_tasks, words, "_text", "_word")
    return hits.groupBy("task_id").agg(F.min_by("role_id", F.struct("seq", "_k")).alias("role_id"))


def lookup(rows: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the id that the name in a column stands for, by lower-cased name. names: id, name, seq; first one wins."""
    index = names.withColumn("_key", name_key("name")).groupBy("_key").agg(F.min_by("id", "seq").alias(out))
    return rows.withColumn("_key", name_key(column)).join(index, "_key", "left").drop("_key")


def last_wins(mapping: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The last value of each key, as assigning to a dictionary in the order of seq leaves it."""
    return mapping.groupBy(key).agg(F.max_by(value, F.struct(seq, value)).alias(value))


def endpoints(flows: DataFrame, tasks: DataFrame, gateways: DataFrame, column: str) -> DataFrame:
    """flow_id, node_id, kind: what an end of a flow names: the same name, or one contains the other; tasks first, then by seq.

    flows: flow_id and the column with the name. tasks, gateways: id, name, seq.
    """
    nodes = tasks.select(F.lit(0).alias("_kind"), "id", "name", "seq").unionByName(gateways.select(F.lit(1).alias("_kind"), "id", "name", "seq"))
    nodes = nodes.select("_kind", "id", "seq", name_key("name").alias("_name"))
    asked = flows.select("flow_id", name_key(column).alias("_asked")).where("_asked <> ''")
    names = asked.select("_asked").distinct()
    cols = ["_asked", "_kind", "id", "seq"]
    hit = containing(names, nodes, "_asked", "_name").select(*cols).unionByName(containing(nodes, names, "_name", "_asked").select(*cols))
    best = hit.groupBy("_asked").agg(F.min_by(F.struct("id", "_kind"), F.struct("_kind", "seq", "id")).alias("b"))
    return asked.join(best, "_asked").select("flow_id", F.col("b.id").alias("node_id"), F.when(F.col("b._kind") == 0, "task").otherwise("gateway").alias("kind"))


def pick_user(roles: DataFrame, users: DataFrame) -> DataFrame:
    """role, user_id, tier: exact over agents (user name, role, alias), contained over agents, then both over all users.

    roles: role. users: user_id, username, role, alias, is_agent, seq.
    """
    fields = users.select("user_id", "is_agent", F.col("seq").alias("_seq"), F.posexplode(F.array("username", "role", "alias")).alias("_f", "_v")).select("user_id", "is_agent", "_seq", "_f", text_key("_v").alias("_value")).where("_value <> ''")
    asked = roles.select("role", text_key("role").alias("_asked")).where("_asked <> ''")
    exact = asked.join(fields, F.col("_asked") == F.col("_value")).withColumn("_t", F.lit(0))
    cols = ["role", "_asked", "user_id", "is_agent", "_seq", "_f", "_value", "_t"]
    inside = containing(fields, asked, "_value", "_asked").unionByName(containing(asked, fields, "_asked", "_value"), allowMissingColumns=True).withColumn("_t", F.lit(1))
    tier = F.col("_t") + F.when(F.col("is_agent"), 0).otherwise(2)
    every = exact.select(*cols).unionByName(inside.select(*cols))
    best = every.groupBy("role").agg(F.min_by(F.struct("user_id", tier.alias("tier")), F.struct(tier, "_seq", "_f")).alias("b"))
    return best.select("role", F.col("b.user_id").alias("user_id"), F.col("b.tier").alias("tier"))


def candidates(roles: DataFrame, users: DataFrame, most: int = 30, fallback: int = 20) -> DataFrame:
    """role, user_id, score of up to 30 agents: 1.0 the same, 0.8 contained, 0.5 head or tail of the role; else the first 20.

    users: user_id, username, role, alias, is_agent, seq, and optionally description, goal, persona.
    """
    users = users.where("is_agent")
    texts = [c for c in ("username", "role", "alias", "description", "goal", "persona") if c in users.columns]
    fields = users.select("user_id", F.explode(F.array(*texts)).alias("_v")).select("user_id", text_key("_v").alias("_value")).where("_value <> ''").distinct()
    asked = roles.select("role", text_key("role").alias("_asked")).where("_asked <> ''")
    ends = asked.where(F.length("_asked") >= 3).select("role", "_asked", F.explode(F.array(F.left("_asked", F.lit(3)), F.right("_asked", F.lit(3)))).alias("_end"))
    cols = ["role", "_asked", "user_id", "_value"]
    met = containing(fields, ends, "_value", "_end").select(*cols).unionByName(containing(fields, asked, "_value", "_asked").select(*cols)).unionByName(containing(asked, fields, "_asked", "_value").select(*cols)).distinct()
    a, v = F.col("_asked"), F.col("_value")
    score = F.when(a == v, 1.0).when(a.contains(v) | v.contains(a), 0.8).when((F.length(a) >= 3) & (v.contains(F.left(a, F.lit(3))) | v.contains(F.right(a, F.lit(3)))), 0.5).otherwise(0.0)
    hits = met.where(score > 0).groupBy("role", "user_id").agg(F.max(score).alias("score"))
    seq = users.select("user_id", "seq", "is_agent")
    ranked = hits.join(seq, "user_id").withColumn("rank", F.row_number().over(W.partitionBy("role").orderBy(F.desc("score"), "seq"))).where(F.col("rank") <= most)
    top = seq.where("is_agent").orderBy("seq").limit(fallback).select("user_id", F.row_number().over(W.orderBy("seq")).alias("rank"))
    none = asked.select("role").join(ranked.select("role").distinct(), "role", "left_anti").join(F.broadcast(top))
    return ranked.select("role", "user_id", "score", "rank").unionByName(none.select("role", "user_id", F.lit(0.0).alias("score"), "rank"))


def vector_top(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """id, similarity of the k vectors most like a query vector, by cosine. vectors: id, v. query: one row, q."""
    scored = vectors.join(F.broadcast(query.limit(1))).select("id", cosine(F.col("v"), F.col("q")).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def similar_entity(entities: DataFrame, existing: DataFrame, block: int = 4096) -> DataFrame:
    """id, match_id, similarity, action: the most similar existing entity of the same kind, and what that means.

    Both: id, kind, v (vector). The existing ones of a kind lie in blocks; a block is compared with the new ones as matrices,
    so a kind of very many is no single task. Ties go to the smaller match_id.
    """
    n = existing.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
    there = existing.join(n, "kind").select(F.col("kind").alias("kind_there"), F.pmod(F.xxhash64("id"), "_n").alias("block_there"), F.col("id").alias("match_id"), F.col("v").cast("array<double>").alias("v"))
    new = entities.join(n, "kind").select("kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("block"), "id", F.col("v").cast("array<double>").alias("v"))

    def unit(v: pd.Series) -> np.ndarray:
        x = np.stack(v.to_numpy())
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)

    def best(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": a["id"].iloc[:0], "match_id": b["match_id"].iloc[:0], "similarity": np.zeros(0)})
        b = b.sort_values("match_id")
        x, y, out = unit(a["v"]), unit(b["v"]), []
        for at in range(0, len(x), 1024):
            s = x[at : at + 1024] @ y.T
            k = s.argmax(1)
            out.append(pd.DataFrame({"id": a["id"].iloc[at : at + 1024].to_numpy(), "match_id": b["match_id"].to_numpy()[k], "similarity": s[np.arange(len(k)), k]}))
        return pd.concat(out)

    kinds = dict(entities.dtypes)["id"], dict(existing.dtypes)["id"]
    scored = new.groupBy("kind", "block").cogroup(there.groupBy("kind_there", "block_there")).applyInPandas(best, f"id {kinds[0]}, match_id {kinds[1]}, similarity double")
    top = scored.groupBy("id").agg(F.min_by(F.struct("match_id", "similarity"), F.struct(-F.col("similarity"), "match_id")).alias("b"))
    out = entities.select("id").join(top, "id", "left").select("id", F.col("b.match_id").alias("match_id"), F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"))
    return out.withColumn("action", action(F.col("similarity")))


def jaccard_pairs(names: DataFrame, limit: float = 0.6) -> DataFrame:
    """a, b, similarity of the names (column name, distinct) whose sets of characters share more than limit, a < b.

    Without loss: of two such sets, with rare characters first, each has two characters of the other among its first
    n - ceil(limit * n) + 2, unless it has one only; both are filed under every two of those.
    """
    chars = names.select("name", F.array_distinct(F.filter(F.split("name", ""), lambda c: c != "")).alias("cs")).where("size(cs) > 0")
    each = chars.select("name", F.explode("cs").alias("c"))
    often = each.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    sets = each.join(F.broadcast(often) if often.limit(SMALL + 1).count() <= SMALL else often, "c").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("cs"))
    size = F.size("cs")
    first = F.transform(F.slice("cs", 1, F.least(size, size - F.ceil(limit * size).cast("int") + 2)), lambda x: x["c"])
    twos = F.flatten(F.transform("first", lambda x, i: F.transform(F.slice("first", i + 2, F.size("first")), lambda y: F.when(x < y, F.concat(x, y)).otherwise(F.concat(y, x)))))
    filed = sets.select("name", first.alias("first")).select("name", F.explode(F.when(F.size("first") == 1, F.col("first")).otherwise(twos)).alias("key"))
    pairs = filed.alias("x").join(filed.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.name") < F.col("y.name"))).select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()
    return pairs.withColumn("similarity", char_jaccard(F.col("a"), F.col("b"))).where(F.col("similarity") > limit)


def token_blocks(rows: DataFrame, split_rows: int = 1000) -> DataFrame:
    """a, b, common for all pairs that share words, by an inverted index. rows: id, name.

    A word of more than split_rows rows is split: one side of its pairs lies in one of several parts, the other in all.
    """
    words = rows.select("id", F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), r"(?U)\s+"), lambda w: w != ""))).alias("word"))
    several = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("word", F.ceil(F.col("n") / split_rows).alias("parts"))
    kept = words.join(several, "word")
    x = kept.select("id", "word", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    y = kept.select("id", "word", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    pairs = x.alias("x").join(y.alias("y"), (F.col("x.word") == F.col("y.word")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.id") < F.col("y.id")))
    return pairs.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count(F.lit(1)).alias("common"))


def ordered_text(df: DataFrame, keys: list[str], text: Column, *order: str) -> DataFrame:
    """The texts of each key in order, joined by newlines, as column text."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["_t"]), "\n").alias("text"))
