"""Katz backoff of any order in tables: one of n-grams and one of contexts for each order, evaluated recursively by joins.

Training: the n-grams of each order are counted and discounted; the backoff weight of a context is what its discounted
probabilities leave, over what the same tokens leave of the order below, so each context adds up to one exactly. Each
order's tables are written to the shared folder. Scoring: distinct n-grams meet the tables of the highest order; those
that aren't there go on with the backoff weight of their context to the order below, down to unigrams. Tokens are the
words themselves, so nothing rests on hashes. Keys are n-grams and contexts, counted on the map side first, so no context,
however frequent, is one task's work.

Equal texts are scored once. Defined results: as in katz; with order 1 the score is that of unigrams alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.llm.common import WS, stored
from procgraph.llm.quality import LOWER, UPPER

#: No word holds white space.
END, START = "\n", "\r"
#: Counts of this much and more aren't discounted.
WHOLE = 6


def token_rows(texts: DataFrame, order: int) -> DataFrame:
    """digest, hist (the order - 1 tokens before, by blanks), w of every token. texts: digest, text, and others kept."""
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), f"[{WS}]+"), lambda x: x != "")
    padded = F.concat(F.array(*[F.lit(START)] * (order - 1)).cast("array<string>"), words, F.array(F.lit(END)))
    grams = F.transform(F.sequence(F.lit(1), F.size("_t") - (order - 1)), lambda i: F.struct(F.array_join(F.slice("_t", i, order - 1), " ").alias("hist"), F.get("_t", i + (order - 2)).alias("w")))
    others = [c for c in texts.columns if c != "text"]
    return texts.select(*others, padded.alias("_t")).select(*others, F.explode(grams).alias("g")).select(*others, "g.*")


def shorter(hist: str) -> Column:
    """A history without its first token; blanks part tokens."""
    return F.when(F.col(hist).contains(" "), F.expr(f"substring({hist}, locate(' ', {hist}) + 1)")).otherwise("")


def counts_of_counts(table: DataFrame) -> np.ndarray:
    got = {r["r"]: r["n"] for r in table.groupBy(F.least("c", F.lit(7)).alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 7 rows
    return np.array([got.get(r, 0) for r in range(7)])


def discounted(d: np.ndarray) -> Column:
    """The discounted count of a row."""
    return F.col("c") * F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in d]), F.least("c", F.lit(WHOLE)).cast("int")), F.lit(1.0))


def train(tokens: DataFrame, n_docs: int, order: int) -> tuple:
    """The unigram statistics, unigrams (w, c, p), and for each order from 2 the tables of n-grams and contexts.

    tokens: hist, w, times of the training rows.
    """
    from procgraph.llm.katz import Unigrams, discounts

    highest = stored(tokens.groupBy("hist", "w").agg(F.sum("times").alias("c")), f"grams-{order}")
    counted = {order: highest}
    for k in range(order - 1, 0, -1):
        above = counted[k + 1]
        counted[k] = stored(above.groupBy(shorter("hist").alias("hist"), "w").agg(F.sum("c").alias("c")), f"counts-{k}")
    one = counted[1]
    sums = one.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    uni = Unigrams.of(int(sums["n"] or 0), int(sums["v"]), n_docs, counts_of_counts(one))
    low = one.select("hist", "w", "c", (F.lit(float(uni.scale)) * discounted(uni.d) / max(uni.total, 1)).alias("p"))
    grams, contexts = {1: stored(low, "unigrams")}, {}
    for k in range(2, order + 1):
        d = discounts(counts_of_counts(counted[k]))
        below = grams[k - 1].select(F.col("hist").alias("_h"), F.col("w").alias("_w"), F.col("p").alias("low"))
        rows = counted[k].withColumn("_short", shorter("hist")).join(below, (F.col("_short") == F.col("_h")) & (F.col("w") == F.col("_w")))
        rows = stored(rows.select("hist", "w", "c", discounted(d).alias("dc"), "low"), f"rows-{k}")
        sums = rows.groupBy("hist").agg(F.sum("c").alias("total"), F.sum("dc").alias("share"), F.sum("low").alias("mass"))
        left = 1 - F.col("share") / F.col("total")
        none = left <= 1e-12
        free = F.when(none, 1 / (F.col("total") + 1)).otherwise(left)
        weight = free / F.greatest(1 - F.col("mass"), F.lit(1e-300))
        scale = F.when(none, F.col("total") / (F.col("total") + 1)).otherwise(1.0) / F.col("total")
        contexts[k] = stored(sums.select("hist", weight.alias("weight"), scale.alias("scale")), f"contexts-{k}")
        grams[k] = stored(rows.join(contexts[k], "hist").select("hist", "w", (F.col("dc") * F.col("scale")).alias("p")), f"probabilities-{k}")
    return uni, grams, contexts


def log_probs(asked: DataFrame, uni, grams: dict, contexts: dict) -> DataFrame:
    """hist, w, lp (log10) of distinct n-grams. asked: hist, w."""
    now = asked.withColumns({"_h": F.col("hist"), "lp": F.lit(0.0), "done": F.lit(False)})
    for k in range(max(grams), 1, -1):
        g = grams[k].select(F.col("hist").alias("_gh"), F.col("w").alias("_gw"), "p")
        c = contexts[k].select(F.col("hist").alias("_ch"), "weight")
        now = now.join(g, (F.col("_h") == F.col("_gh")) & (F.col("w") == F.col("_gw")) & ~F.col("done"), "left").join(c, (F.col("_h") == F.col("_ch")) & ~F.col("done"), "left")
        step = F.when(F.col("done"), 0.0).otherwise(F.log10(F.coalesce("p", "weight", F.lit(1.0))))
        now = now.select("hist", "w", shorter("_h").alias("_h"), (F.col("lp") + step).alias("lp"), (F.col("done") | F.col("p").isNotNull()).alias("done"))
    one = grams[1].select(F.col("w").alias("_gw"), "p")
    now = now.join(one, F.col("w") == F.col("_gw"), "left")
    return now.select("hist", "w", (F.col("lp") + F.when(F.col("done"), 0.0).otherwise(F.log10(F.coalesce("p", F.lit(float(uni.unseen)))))).alias("lp"))


def score(docs: DataFrame, held: Column, order: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    if order < 1:
        raise ValueError("the order is 1 at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    texts = rows.groupBy("digest").agg(F.first("text").alias("text"), F.count(F.when(~F.col("held_out"), 1)).alias("times"))
    tokens = stored(token_rows(texts, order), "tokens")
    n_docs = rows.where(~F.col("held_out")).count()
    uni, grams, contexts = train(tokens.where("times > 0").select("hist", "w", "times"), n_docs, order)
    each = stored(tokens.groupBy("digest", "hist", "w").agg(F.count(F.lit(1)).alias("n")), "occurrences")
    lp = log_probs(each.select("hist", "w").distinct(), uni, grams, contexts)
    c = grams[1].select(F.col("w").alias("_w"), "c")
    told = lp.join(c, F.col("w") == F.col("_w"), "left").select(F.col("hist").alias("_h"), F.col("w").alias("_w"), "lp", F.coalesce("c", F.lit(0)).alias("c"))
    got = each.join(told, (F.col("hist") == F.col("_h")) & (F.col("w") == F.col("_w")))
    n, base = F.col("n"), F.log10((F.col("c") + 0.5) / (uni.total + 0.5 * (uni.types + 1)))
    sums = got.groupBy("digest").agg(F.sum(n).alias("n_tokens"), F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("n_known"), F.sum(n * base).alias("base_score"), F.sum(n * F.col("lp")).alias("score"))
    return rows.select("doc_id", "held_out", "digest").join(sums, "digest").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(uni.total).cast("long").alias("train_tokens"), "base_score", "score")
