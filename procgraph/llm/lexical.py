"""Ranked lexical search over a length-stratified index.

Documents whose normaliser ``m`` (from their length) is equal form a stratum, in segments of at most ``segment`` documents.
Within a segment a posting list belongs to a term and a count ``tf``, so its impact is computed once for all documents on it.
The largest tf of each term gives a bound for what an item can score in a segment. The segments with the best bounds are
scored first; the k-th score that they yield is a floor, and of the others only segments whose bound reaches it are visited.
Scores and floors are exact integers, so nothing is lost.

Building takes two passes over the texts: lengths are counted (a row for each length), then the counts of each document go
to the segment of its stratum, a random one where a stratum has several. Items are searched in blocks of about
``item_bytes`` bytes of text; the terms of a block are broadcast. No row joins an item with a document but where the document
is among the best of its segment.

Defined results: a null or empty text has no terms, is no document of the statistics, and is never found; an item without
terms finds nothing. Rows with the same id are documents of their own, each may be found; null ids come last among ties.
Items with the same id and text are one item; items that share an id only are ranked one by one. A long text counts whole.
Other columns of either input, whatever their names, aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.llm.blobs import ranges
from procgraph.llm.common import dropped, stored, utf8

#: What isn't part of a term, in ASCII; all other characters are.
GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TERM = re.compile(rf"[^{GAP}]+".encode())
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
INSIDE = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def terms(text: object) -> list[bytes]:
    return TERM.findall(utf8(text).translate(LOWER))


def n_terms(text: object) -> int:
    inside = INSIDE[np.frombuffer(utf8(text), np.uint8)]
    return int(inside[:1].sum() + np.count_nonzero(inside[1:] > inside[:-1]))


def lengths(docs: DataFrame) -> DataFrame:
    """n, docs: how many documents have n terms; those without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            seen.update(n_terms(t) for t in b.column("text").to_pylist())
        seen.pop(0, None)
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["n", "docs"])

    return docs.select("text").mapInArrow(run, "n long, docs long").groupBy("n").agg(F.sum("docs").alias("docs"))


def index(docs: DataFrame, id_col: str = "doc_id", segment: int = 2048, broadcast_rows: int = 100_000) -> tuple[DataFrame, int, int]:
    """The index as a written table, and the numbers of documents and of terms.

    m, part: the segment. term, tf, docs: a posting list, places in the segment as 16-bit integers. ids: of the documents,
    in a row of its own without a term.
    """
    sizes = stored(lengths(docs), "lengths")
    n_docs, n_all = sizes.agg(F.sum("docs"), F.sum(F.col("n") * F.col("docs"))).first()
    n_docs, n_all = n_docs or 0, max(n_all or 0, 1)
    strata = sizes.groupBy(F.expr(f"10 + (90 * n * {n_docs}L) div {n_all}L").alias("s_m")).agg(F.ceil(F.sum("docs") / segment).cast("int").alias("parts"))
    if strata.limit(broadcast_rows + 1).count() <= broadcast_rows:
        strata = F.broadcast(strata)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows, ms, names, tfs = [], [], [], []
                for i, t in enumerate(b.column("text").to_pylist()):
                    found = terms(t)
                    if found:
                        tf = Counter(found)
                        rows.append(i)
                        ms.append(10 + 90 * len(found) * n_docs // n_all)
                        names.append(b" ".join(tf.keys()))
                        tfs.append(np.fromiter(tf.values(), "<u4", len(tf)).tobytes())
                keep = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ms, pa.int64()), b.column("id").take(keep), b.column("h").take(keep), pa.array(names, pa.binary()), pa.array(tfs, pa.binary())], ["m", "id", "h", "terms", "tfs"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), "text").withColumn("h", F.xxhash64("id", "text"))
    counted = plain.mapInArrow(count, "m long, id long, h long, terms binary, tfs binary").join(strata, F.col("m") == F.col("s_m"))
    placed = counted.withColumn("part", F.pmod("h", F.col("parts")).cast("int")).select("m", "part", "id", "terms", "tfs").repartition("m", "part").sortWithinPartitions("m", "part")

    def one(m: int, part: int, held: list[tuple]) -> pa.RecordBatch:
        """The rows of a segment."""
        names = [n.split(b" ") for _, n, _ in held]
        doc = np.repeat(np.arange(len(held), dtype=np.uint16), [len(n) for n in names])
        code, known = pd.factorize(np.array([t for n in names for t in n], object))
        tf = np.frombuffer(b"".join(t for *_, t in held), "<u4").astype(np.int64)
        by = np.lexsort((doc, -tf, code))
        code, tf, doc = code[by], tf[by], doc[by]
        begin = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])))
        raw, cut = doc.astype("<u2").tobytes(), np.append(begin, len(doc)) * 2
        n = len(begin)
        cols = [
            pa.array(np.full(n + 1, m)),
            pa.array(np.full(n + 1, part, np.int32)),
            pa.array([*known[code[begin]].tolist(), None], pa.binary()).cast(pa.string()),
            pa.array(np.append(tf[begin], 0)),
            pa.array([*(raw[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)), None], pa.binary()),
            pa.array([None] * n + [[i for i, *_ in held]], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(cols, ["m", "part", "term", "tf", "docs", "ids"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments from rows sorted by stratum and part; one that grew too large is cut, which only needs another number."""
        key, cut, held = None, 0, []
        for b in batches:
            for m, part, *doc in zip(*(b.column(c).to_pylist() for c in ("m", "part", "id", "terms", "tfs")), strict=True):
                if held and (key != (m, part) or len(held) == segment):
                    yield one(key[0], key[1] + (cut << 20), held)
                    cut, held = (cut + 1 if key == (m, part) else 0), []
                key = (m, part)
                held.append(tuple(doc))
        if held:
            yield one(key[0], key[1] + (cut << 20), held)

    table = stored(placed.mapInArrow(build, "m long, part int, term string, tf long, docs binary, ids array<long>"), "postings")
    dropped(sizes)
    return table, n_docs, n_all


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_blocks(items: DataFrame, id_col: str, item_bytes: int) -> Iterator[list[tuple]]:
    """Blocks of distinct items with terms: id and terms."""
    plain = items.select(F.col(id_col).alias("id"), "text").where(F.col("text").isNotNull()).distinct()
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // item_bytes) + 1
    for k in range(n):
        rows = plain.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()  # about item_bytes
        found = [(r["id"], sorted(set(terms(r["text"])))) for r in sorted(rows, key=lambda r: (str(r["id"]), r["text"]))]
        if found := [x for x in found if x[1]]:
            yield found


IMPACT = "(1000000000L * tf) div (1000L * tf + 8L * m)"


def search(built: tuple[DataFrame, int, int], items: DataFrame, k: int = 10, first: int = 8, item_bytes: int = 4 << 20, id_col: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    spark, (postings, n_docs, _) = items.sparkSession, built
    kind = items.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in item_blocks(items, id_col, item_bytes):
        out = out.unionByName(block_search(postings, n_docs, block, kind, k, first))
    return out


def block_search(postings: DataFrame, n_docs: int, items: list[tuple], kind: str, k: int, first: int) -> DataFrame:
    spark = postings.sparkSession
    names = sorted({t for _, ts in items for t in ts})
    number = {t: i for i, t in enumerate(names)}
    asked = spark.createDataFrame([(t.decode("utf-8", "surrogatepass"), i) for t, i in number.items()], "term string, t int")  # the terms of a block of items
    hits = stored(postings.join(F.broadcast(asked), "term").select("m", "part", "t", "tf", "docs"), "hits")
    places = postings.where(F.col("ids").isNotNull()).select("m", "part", "ids")
    dfs = {r["t"]: r["df"] for r in hits.groupBy("t").agg(F.sum(F.octet_length("docs") / 2).cast("long").alias("df")).collect()}
    wanted = [(i, number[t], w) for i, (_, ts) in enumerate(items) for t in ts if dfs.get(number[t]) and (w := weight(n_docs, dfs[number[t]])) > 0]
    per: dict[int, list] = {}
    for i, t, w in wanted:
        per.setdefault(i, []).append((t, w))
    of_item = {i: (np.array([t for t, _ in x]), np.array([w for _, w in x])) for i, x in per.items()}
    model = spark.sparkContext.broadcast(of_item)  # as large as the block of items

    weights = spark.createDataFrame(wanted, "item int, t int, w long")
    tops = hits.groupBy("m", "part", "t").agg(F.max("tf").alias("tf")).select("m", "part", "t", F.expr(IMPACT).alias("impact"))
    bounds = tops.join(F.broadcast(weights), "t").groupBy("item", "m", "part").agg(F.sum(F.col("w") * F.col("impact")).alias("bound"))
    bounds = stored(bounds, "bounds")
    order = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "m", "part"))
    early = bounds.withColumn("n", order).where(F.col("n") <= first).select("item", "m", "part", F.lit(1).cast("long").alias("floor"))

    def score(key: tuple, rows: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        """The best k of a segment for each item that visits it, from the floor on."""
        none = pd.DataFrame({"item": np.zeros(0, np.int32), "id": pd.array([], "Int64"), "score": np.zeros(0, np.int64)})
        if not len(rows) or not len(visits):
            return none
        ids = np.array(next(x for x in rows["ids"] if x is not None), object)
        rows = rows[rows["t"] >= 0]
        t, tf, m = rows["t"].to_numpy(), rows["tf"].to_numpy(), int(key[0])
        by = np.argsort(t, kind="stable")
        t, tf, blobs = t[by], tf[by], rows["docs"].to_numpy()[by]
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)  # once for each posting list
        size = np.array([len(b) // 2 for b in blobs], np.int64)
        doc = np.frombuffer(b"".join(blobs), "<u2").astype(np.int64)
        each = np.repeat(impact, size)
        known, begin = np.unique(t, return_index=True)
        ends = np.cumsum(size)
        low, high = (ends - size)[begin], ends[np.append(begin[1:], len(t)) - 1]
        got = [none]
        for item, floor in zip(visits["item"].tolist(), visits["floor"].tolist(), strict=True):
            terms_, w = model.value[item]
            at = np.minimum(np.searchsorted(known, terms_), len(known) - 1)
            here = known[at] == terms_
            at, w = at[here], w[here]
            n = high[at] - low[at]
            take = ranges(low[at], n)
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, doc[take], each[take] * np.repeat(w, n))
            best = np.flatnonzero(total >= floor)
            if len(best):
                best = sorted(best.tolist(), key=lambda i: (-total[i], ids[i] is None, ids[i] or 0))[:k] if len(best) <= 4 * k else top(best, total, ids)
                got.append(pd.DataFrame({"item": np.full(len(best), item, np.int32), "id": pd.array([ids[i] for i in best], "Int64"), "score": total[best]}))
        return pd.concat(got)

    def top(best: np.ndarray, total: np.ndarray, ids: np.ndarray) -> list[int]:
        least = np.partition(total[best], len(best) - k)[len(best) - k]
        return sorted(best[total[best] >= least].tolist(), key=lambda i: (-total[i], ids[i] is None, ids[i] or 0))[:k]

    rows = hits.select("m", "part", "t", "tf", "docs", F.lit(None).cast("array<long>").alias("ids")).unionByName(
        places.select("m", "part", F.lit(-1).alias("t"), F.lit(0).cast("long").alias("tf"), F.lit(None).cast("binary").alias("docs"), "ids")
    )

    def scored(visits: DataFrame) -> DataFrame:
        return rows.groupBy("m", "part").cogroup(visits.groupBy("m", "part")).applyInPandas(score, "item int, id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        best = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        return found.withColumn("rank", best).where(F.col("rank") <= k)

    sure = stored(ranked(scored(early)), "early")
    floors = {r["item"]: r["score"] for r in sure.where(F.col("rank") == k).select("item", "score").collect()}  # at most one an item
    floor = spark.createDataFrame(sorted(floors.items()), "item int, floor long")
    late = bounds.join(early.select("item", "m", "part"), ["item", "m", "part"], "left_anti").join(F.broadcast(floor), "item", "left")
    late = late.withColumn("floor", F.greatest(F.coalesce("floor", F.lit(1).cast("long")), F.lit(1).cast("long"))).where(F.col("bound") >= F.col("floor")).select("item", "m", "part", "floor")
    best = ranked(sure.drop("rank").unionByName(scored(late)))
    names_of = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"item int, item_id {kind}")
    return best.join(F.broadcast(names_of), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Builds the index of docs and searches it for items."""
    return search(index(docs), items, k)


ORACLE = rf"""
WITH t AS (SELECT rowid AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{GAP}]+')) AS term FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
p AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
m AS (SELECT r, (100 - 90 + (90 * n * docs) // l)::BIGINT AS m FROM n, c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{GAP}]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, r, sum(w * ((1000000000::BIGINT * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""
