"""Quality rules: counts within a text, and lines that too many documents of a host share.

Lines are normalised (A-Z lowered, white space and ASCII punctuation to one blank, trimmed) and hashed. For each host
(``source``; null is a host of its own) the distinct documents that hold a line are counted; exact copies of a text are
one document there, so that copying a clean text doesn't turn its lines into boilerplate. Lines of more than ``min_docs``
documents of a host are removed, whatever the size of the host; a document that keeps less than ``keep_per_cent`` of its
words is depleted and rejected, as is one that fails the base rules.

Defined results: a null or empty text has no words and fails the base; lines of which nothing is left by normalising are
never removed; repeated rows give one result each; other columns of the input don't matter. Only DataFrame functions run.
Counting combines on the map side, so a host or line with a third of all rows is no hot task; the join with the frequent
lines can be split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.llm.common import WS, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that normalising a line turns to a blank.
LINE_NOISE = rf"[{WS}!-/:-@\[-`{{-~]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value bound to a lambda variable, so that it is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """How many words lie in windows of width words that the array holds twice or more."""

    def counted(w: Column) -> Column:
        window = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) > width, let(window, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))).otherwise(F.lit(0))

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda t: F.filter(t, lambda x, k: (x["h"] == F.get(t, k - 1)["h"]) | (x["h"] == F.get(t, k + 1)["h"]))
        starts = let(by_hash, lambda t: F.array_sort(F.transform(twice(t), lambda x: x["i"])))
        begin = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, begin, step, lambda acc: acc["n"])

    return let(words, counted)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, host, digest of the text, and the base counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    counted = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("source"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("digest"),
        let(
            words_of(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).cast("long").alias("n_repeat_words")),
        ).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, r = F.col("w.n_words"), F.col("w.n_repeat_words")
    return counted.select("doc_id", "host", "digest", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), ((n < 50) | (100 * r > 50 * n)).alias("base_failed"))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, host, digest, and an array of lines: pos, hash of the normalised line, words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = lambda x: F.trim(F.regexp_replace(F.translate(x, UPPER, LOWER), LINE_NOISE, " "))
    line = lambda x, i: let(
        norm(x), lambda y: F.struct(i.alias("pos"), F.when(y != "", F.xxhash64(y)).alias("line"), F.size(words_of(x)).alias("words"))
    )
    return docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("host"), F.xxhash64(text).alias("digest"), F.filter(F.transform(F.split(text, "\n"), line), lambda x: x["line"].isNotNull()).alias("lines"))


def frequent_lines(rows: DataFrame, min_docs: int = 10) -> DataFrame:
    """host and line of the lines of more than min_docs distinct documents of the host, from line_rows()."""
    texts = rows.select("host", "digest", F.array_distinct(F.transform("lines", lambda x: x["line"])).alias("lines")).groupBy("host", "digest").agg(F.first("lines").alias("lines"))
    counts = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    return counts.where(F.col("docs") > min_docs).select("host", "line")


def removals(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, digest, removed: the positions and word counts of the lines to remove, for the texts that have any."""
    rows = stored(line_rows(docs), "lines")  # hashes and numbers, read twice
    each = rows.select("doc_id", "host", "digest", F.explode("lines").alias("x")).select("doc_id", "host", "digest", "x.*")
    hit = each.join(frequent_lines(rows, **limits), ["host", "line"])
    return hit.groupBy(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest")).agg(F.collect_set(F.struct("pos", "words")).alias("removed"))


def _with_removals(left: DataFrame, docs: DataFrame, **limits) -> DataFrame:
    right = removals(docs, **limits)
    return left.join(right, left["doc_id"].eqNullSafe(right["r_id"]) & (left["digest"] == right["r_digest"]), "left").drop("r_id", "r_digest")


def assess(docs: DataFrame, keep_per_cent: int = 50, **limits) -> DataFrame:
    """One row for each row of docs: the base counts, n_words_removed, and kept."""
    gone = F.aggregate(F.coalesce("removed", F.array().cast("array<struct<pos:int,words:int>>")), F.lit(0), lambda acc, x: acc + x["words"]).cast("long")
    out = _with_removals(base(docs), docs, **limits).withColumn("n_words_removed", gone)
    depleted = 100 * (F.col("n_words") - F.col("n_words_removed")) < keep_per_cent * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("host", "digest", "removed")


def clean(docs: DataFrame, keep_per_cent: int = 50, **limits) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs; removed lines are gone from text, n_chars follows."""
    counted = base(docs).where(~F.col("base_failed")).select(F.col("doc_id").alias("_pg_b_id"), F.col("digest").alias("_pg_b_digest"), "n_words").groupBy("_pg_b_id", "_pg_b_digest").agg(F.max("n_words").alias("n_words"))
    right = removals(docs.select("doc_id", "text", "source"), **limits)
    verdict = counted.join(right, F.col("_pg_b_id").eqNullSafe(F.col("r_id")) & (F.col("_pg_b_digest") == F.col("r_digest")), "left")
    gone = F.aggregate(F.coalesce("removed", F.array().cast("array<struct<pos:int,words:int>>")), F.lit(0), lambda acc, x: acc + x["words"])
    verdict = verdict.where(100 * (F.col("n_words") - gone) >= keep_per_cent * F.col("n_words")).select("_pg_b_id", "_pg_b_digest", F.transform("removed", lambda x: x["pos"]).alias("_pg_b_removed"))
    on = F.col("_pg_b_id").eqNullSafe(F.col("doc_id")) & (F.col("_pg_b_digest") == F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rest = let(F.col("_pg_b_removed"), lambda gone: F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n"))
    out = docs.join(verdict, on).withColumn("text", F.when(F.col("_pg_b_removed").isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_pg_b_removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def oracle(min_docs: int = 10) -> str:
    """SQL for the rows of assess()."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[{WS}]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{WS}]')) AS l FROM d),
n AS (SELECT *, len(w) AS n_words, len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols,
             len(regexp_replace(t, '[{WS}]+', '', 'g')) AS word_chars, len(l) - len(list_distinct(l)) AS n_dup_lines FROM w),
k AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM n)),
f AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM f) GROUP BY doc_id),
e AS (SELECT doc_id, host, md5(t) AS digest, unnest(string_split(t, chr(10))) AS x FROM d),
ln AS (SELECT doc_id, host, digest, len(list_filter(regexp_split_to_array(x, '[{WS}]+'), lambda y: y <> '')) AS words,
              trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '{LINE_NOISE}', ' ', 'g')) AS line FROM e),
c AS (SELECT host, line, count(DISTINCT digest) AS docs FROM ln WHERE line <> '' GROUP BY host, line),
fr AS (SELECT host, line FROM c WHERE docs > {min_docs}),
g AS (SELECT doc_id, sum(words) AS gone FROM ln JOIN fr USING (host, line) GROUP BY doc_id),
b AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0) AS gone FROM n LEFT JOIN r USING (doc_id) LEFT JOIN g USING (doc_id)),
o AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CAST(gone AS BIGINT) AS n_words_removed, NOT base_failed AND NOT 100 * (n_words - gone) < 50 * n_words AS kept
FROM o
"""


ORACLE = oracle()
