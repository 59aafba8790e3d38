"""Scores texts by a bigram language model with Katz backoff.

Counts are Good-Turing discounted up to ``k``. What discounting frees in a context is spread over the tokens not seen in
it by a backoff weight that makes the probabilities of the context add up to one exactly: weight = (1 - sum of discounted
probabilities of seen tokens) / (1 - sum of unigram probabilities of the same tokens). Of the unigrams, what is freed
belongs to all tokens never seen in training together. The log probability of a token is that of its bigram where the
bigram was seen, else the backoff weight of the context plus, recursively, the log probability of its unigram, else that of
an unseen token. Where there is nothing to discount (no or odd counts of counts, or a context with frequent tokens only) an
absolute discount, or one added count, leaves mass for the rest.

Layout of order 2: tokens are 64-bit hashes of lower-cased words. Tables: unigrams (in parts by ranges of the hash: hashes and
counts) and bigrams (in parts by context: ids and counts). Documents lie in blocks by a hash; a block asks each part for the
ids and counts of its words, sends the distinct bigrams with their places to the parts by context, and gets back sums of
log probabilities for each document. Counting is done within a block before anything is shuffled. Contexts with more than
one part's share of all tokens are split by the next word; their totals, at most as many as there are parts, go over the
driver.

Defined results: a null or empty text is its end alone. Rows are scored one by one, repeated ones too; a null id counts as
the empty text in choosing the fold. Without training rows every token has probability one. A very long text is a block by
itself. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from procgraph.llm import ngrams
from procgraph.llm.blobs import BLOCK, dec, dec_all, enc
from procgraph.llm.common import crc_mod, mix64, shuffle_partitions, stored, utf8

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[LOWER]
STEP = 0xD6E8FEB86659FD93
START, UNKNOWN, END = -2, -1, -3
#: Bytes of a word beyond which another hash is taken.
LONG = 256
END_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK >> 1)
        up = [np.full(size, x, np.uint64) for x in (STEP, pow(STEP, -1, 1 << 64))]
        for x in up:
            x[0] = 1
        _powers[:] = [np.cumprod(x) for x in up]
    return _powers[0], _powers[1]


def tokens(texts: Iterable, together: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end among them, and the number of tokens of each text.

    So many bytes are worked on together, as each takes several numbers; a longer text is by itself.
    """
    groups: list[list[bytes]] = [[]]
    size = 0
    for t in texts:
        raw = utf8(t)
        if groups[-1] and size + len(raw) > together:
            groups.append([])
            size = 0
        groups[-1].append(raw)
        size += len(raw)
    h, count = zip(*map(hashed, groups), strict=True)
    return np.concatenate(h), np.concatenate(count)


def hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    blank = SPACE[data]
    begin = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    stop = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    up, down = powers(len(data))
    total = np.append(np.uint64(0), np.cumsum(VALUES[data] * up[: len(data)]))
    h = mix64((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64))
    for i in np.flatnonzero(stop - begin > LONG):  # for long words with a pattern a polynomial isn't safe
        h[i] = xxhash.xxh64_intdigest(data[begin[i] : stop[i]].tobytes().lower(), 11)
    h[h == END_HASH] = np.uint64(0)
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    count = np.diff(np.searchsorted(begin, ends), prepend=0) + 1 if raw else np.zeros(0, np.int64)
    out = np.full(int(count.sum()), END_HASH, np.uint64)
    own = np.ones(len(out), bool)
    own[np.cumsum(count) - 1] = False
    out[own] = h
    return out, count


def discounts(n: np.ndarray, k: int = 5) -> np.ndarray:
    """d[r] for counts r up to k from n[r], the number of types with count r (r up to k + 1); d[k + 1] is 1."""
    d = np.ones(k + 2)
    n = n.astype(float)
    if (n[1 : k + 2] > 0).all():
        a = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        d[1 : k + 1] = ((r + 1) * n[2 : k + 2] / n[1 : k + 1] / r - a) / (1 - a) if a != 1 else 0
    if not ((d[1 : k + 1] > 0) & (d[1 : k + 1] < 1)).all():
        low = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.0
        r = np.arange(1, k + 1)
        d[1 : k + 1] = (r - min(low, 0.9)) / r
    return d


@dataclass
class Unigrams:
    """What the counts of counts say about the probability of a token by its count."""

    total: int = 0
    types: int = 0
    docs: int = 0
    d: np.ndarray = field(default_factory=lambda: np.ones(7))
    scale: float = 1.0
    unseen: float = 1.0

    @classmethod
    def of(cls, total: int, types: int, docs: int, n: np.ndarray) -> Unigrams:
        if not total:
            return cls()
        d = discounts(n)
        r = np.arange(len(d) - 1)
        free = float(((1 - d[:-1]) * r * n[: len(r)]).sum()) / total
        scale = 1.0 if free > 1e-12 else total / (total + 1)
        return cls(total, types, docs, d, scale, free if free > 1e-12 else 1 / (total + 1))

    def prob(self, c: np.ndarray) -> np.ndarray:
        p = self.scale * self.d[np.minimum(c, len(self.d) - 1)] * c / max(self.total, 1)
        return np.where(c > 0, p, self.unseen)


@dataclass
class Contexts:
    """Discounts of bigrams, and for the split contexts: count, discounted share, unigram mass of what was seen."""

    d: np.ndarray
    split: dict[int, tuple[float, float, float]]


def summed(begin: np.ndarray, *cols: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(c, begin) if len(begin) else c[:0] for c in cols]


def begins(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


@dataclass
class Part:
    """The bigrams of a part: distinct pairs, and for each pair that a block sent the number of its distinct pair."""

    h: np.ndarray
    w: np.ndarray
    c: np.ndarray
    cw: np.ndarray
    back: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Part:
        h, w = dec_all([r["h"] for r in rows], True), dec_all([r["w"] for r in rows])
        c, cw = dec_all([r["c"] for r in rows]), dec_all([r["cw"] for r in rows])
        by = np.lexsort((w, h))
        begin = begins(h[by], w[by])
        back = np.empty(len(by), np.int64)
        back[by] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(by)))) if len(by) else by
        (c,) = summed(begin, c[by])
        first = by[begin]
        return cls(h[first], w[first], c, cw[first], back)


def of_parts(rows: Iterable, kind: int) -> Iterator[tuple[int, list]]:
    got: dict[int, list] = {}
    for r in rows:
        if r["kind"] == kind:
            got.setdefault(r["part"], []).append(r)
    yield from got.items()


def unigram_table(docs: DataFrame, parts: int) -> DataFrame:
    """part, n_types, n_tokens, n_counts (types with count 1, 2, ...), hashes, counts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            size = np.cumsum(p["text"].str.len().fillna(0).to_numpy()) // BLOCK
            for _, g in p.groupby(size):
                h, n = np.unique(tokens(g["text"])[0], return_counts=True)
                part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                cut = np.searchsorted(part, np.arange(parts + 1))
                rows = [(i, enc(h[a:b], True), enc(n[a:b])) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
                yield pd.DataFrame(rows, columns=["part", "h", "n"])

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        h, n = dec_all(list(p["h"]), True).view(np.uint64), dec_all(list(p["n"]))
        by = np.argsort(h, kind="stable")
        begin = begins(h[by])
        (n,) = summed(begin, n[by])
        few = np.bincount(np.minimum(n, 7), minlength=8)
        return pd.DataFrame({"part": p["part"].iloc[:1], "n_types": len(begin), "n_tokens": int(n.sum()), "n_counts": [few[:7].tolist()], "hashes": [enc(h[by][begin], True)], "counts": [enc(n)]})

    raw = docs.select("text").mapInPandas(count, "part int, h binary, n binary")
    return raw.groupBy("part").applyInPandas(merge, "part int, n_types long, n_tokens long, n_counts array<long>, hashes binary, counts binary")


ENTRY = "part int, kind int, block int, h binary, w binary, c binary, cw binary, times binary, doc binary, hot binary, n_docs int, doc_id binary, no_id binary, held binary, n_tokens binary, n_known binary, base binary"


def entries(texts: DataFrame, unigrams: DataFrame, uni: Unigrams, parts: int) -> DataFrame:
    """Rows of kind 0: distinct bigrams of a block for one part, and where they occur; of kind 1: the block's documents."""

    def ask(p: pd.DataFrame) -> pd.DataFrame:
        h = np.unique(tokens(p["text"])[0])
        part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cut = np.searchsorted(part, np.arange(parts + 1))
        rows = [(i, int(p["block"].iloc[0]), enc(h[a:b], True)) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
        return pd.DataFrame(rows, columns=["part", "block", "h"])

    def answer(key: tuple, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        h = dec_all(list(known["hashes"]), True).view(np.uint64)
        n = dec_all(list(known["counts"]))
        rows = []
        for block, b in zip(asked["block"], asked["h"], strict=True):
            want = dec(b, True).view(np.uint64)
            at = np.minimum(np.searchsorted(h, want), max(len(h) - 1, 0))
            hit = h[at] == want if len(h) else np.zeros(len(want), bool)
            ids = np.where(hit, at * parts + int(key[0]), UNKNOWN)
            rows.append((block, int(key[0]), enc(ids, True), enc(n[at] * hit if len(h) else ids * 0)))
        return pd.DataFrame(rows, columns=["block", "part", "ids", "counts"])

    def send(key: tuple, p: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        h, count = tokens(p["text"])
        uniq, at = np.unique(h, return_inverse=True)
        told = told.sort_values("part")
        ids, counts = dec_all(list(told["ids"]), True), dec_all(list(told["counts"]))
        ids[uniq == END_HASH] = END  # its count is the number of training rows
        w, cw = ids[at], counts[at]
        last = np.cumsum(count) - 1
        ctx, c_ctx = np.roll(w, 1), np.roll(cw, 1)
        first = np.append(0, last[:-1] + 1)
        ctx[first], c_ctx[first] = START, uni.docs
        doc = np.repeat(np.arange(len(p)), count)
        held = p["held_out"].to_numpy(dtype=bool)
        base = np.log10((cw + 0.5) / (uni.total + 0.5 * (uni.types + 1)))
        no_id = p["doc_id"].isna().to_numpy()
        by_doc = lambda x: np.bincount(doc, x, len(p))
        rows = [
            (int(key[0]) % parts, 1, int(key[0]), *[None] * 7, len(p), enc(p["doc_id"].fillna(0).to_numpy(np.int64)), enc(no_id.astype(np.int64)), enc(held.astype(np.int64)), enc(count), enc(by_doc(cw > 0).astype(np.int64)), by_doc(base).tobytes())
        ]
        salts = (c_ctx * parts // max(uni.total, 1) + 1).astype(np.uint64)
        hot = np.unique(ctx[salts > 1])
        part = (mix64(ctx.view(np.uint64) * np.uint64(31) + mix64(w.view(np.uint64)) % salts) % np.uint64(parts)).astype(np.int64)
        by = np.lexsort((doc, w, ctx, part))
        part, ctx, w, doc, cw = part[by], ctx[by], w[by], doc[by], cw[by]
        begin = begins(part, ctx, w)
        times = np.diff(np.append(begin, len(by)))
        (c,) = summed(begin, (~held[doc]).astype(np.int64))
        cut = np.searchsorted(part[begin], np.arange(parts + 1))
        occ = np.append(begin, len(by))
        for i in range(parts):
            a, b = cut[i], cut[i + 1]
            if a < b:
                x = begin[a:b]
                rows.append((i, 0, int(key[0]), enc(ctx[x], True), enc(w[x]), enc(c[a:b]), enc(cw[x]), enc(times[a:b]), enc(doc[occ[a] : occ[b]]), enc(hot[np.isin(hot, ctx[x])]), len(p), *[None] * 6))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ENTRY.split(", ")])

    asked = texts.groupBy("block").applyInPandas(ask, "part int, block int, h binary")
    told = asked.groupBy("part").cogroup(unigrams.select("part", "hashes", "counts").groupBy("part")).applyInPandas(answer, "block int, part int, ids binary, counts binary")
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(send, ENTRY)


def count_parts(rows: Iterable[Row], uni: Unigrams) -> Iterator[tuple]:
    """For the table of bigrams: part, n_counts, ids and counts of seen pairs, totals of the split contexts."""
    for part, got in of_parts(rows, 0):
        p = Part.of(got)
        seen = p.c > 0
        h, w, c, cw = p.h[seen], p.w[seen], p.c[seen], p.cw[seen]
        few = np.bincount(np.minimum(c, 7), minlength=8)[:7]
        split, hot = [], set(dec_all([r["hot"] for r in got]).tolist())
        begin = begins(h)
        for a, b in zip(begin, np.append(begin[1:], len(h)), strict=False):
            if int(h[a]) in hot:
                n = np.bincount(np.minimum(c[a:b], 6), c[a:b], 7)
                split.append((int(h[a]), float(uni.prob(cw[a:b]).sum()), [float(x) for x in n]))
        yield int(part), few.tolist(), enc(h, True), enc(w), enc(c), [Row(h=s[0], mass=s[1], by_count=s[2]) for s in split]


TABLE = "part int, n_counts array<long>, h binary, w binary, c binary, split array<struct<h:long,mass:double,by_count:array<double>>>"


def score_parts(rows: Iterable[Row], uni: Unigrams, ctx: Contexts) -> Iterator[tuple]:
    """block, sums of log probabilities by document; or a block's documents as they came."""
    rows = list(rows)
    for _, got in of_parts(rows, 1):
        for r in got:
            yield (r["block"], r["n_docs"], None, *(r[k] for k in ("doc_id", "no_id", "held", "n_tokens", "n_known", "base")))
    for _, got in of_parts(rows, 0):
        p = Part.of(got)
        begin = begins(p.h)
        size = np.diff(np.append(begin, len(p.h)))
        seen = p.c > 0
        total, share, mass = summed(begin, p.c.astype(float), ctx.d[np.minimum(p.c, 6)] * p.c, np.where(seen, uni.prob(p.cw), 0.0))
        for i, h in enumerate(p.h[begin].tolist()):
            if h in ctx.split:
                total[i], share[i], mass[i] = ctx.split[h]
        free = np.where(total > 0, 1 - share / np.maximum(total, 1), 1.0)
        none = free <= 1e-12
        scale = np.where(none, total / (total + 1), 1.0)
        free = np.where(none, 1 / (total + 1), free)
        weight = np.where(total > 0, free / np.maximum(1 - mass, 1e-300), 1.0)
        rep = lambda x: np.repeat(x, size)
        with np.errstate(divide="ignore"):
            direct = np.log10(rep(scale) * ctx.d[np.minimum(p.c, 6)] * p.c / np.maximum(rep(total), 1))
        value = np.where(seen, direct, np.log10(rep(weight)) + np.log10(uni.prob(p.cw)))[p.back]
        at = 0
        for r in got:
            times = dec(r["times"])
            per = np.bincount(dec(r["doc"]), np.repeat(value[at : at + len(times)], times), r["n_docs"])
            at += len(times)
            yield (r["block"], r["n_docs"], per.tobytes(), *[None] * 6)


SUMS = "block int, n_docs int, sums binary, doc_id binary, no_id binary, held binary, n_tokens binary, n_known binary, base binary"


def finish(p: pd.DataFrame, total: int) -> pd.DataFrame:
    info = p[p["doc_id"].notna()].iloc[0]
    score = np.zeros(int(info["n_docs"]))
    for s in sorted(bytes(x) for x in p["sums"].dropna()):  # in one order, so that sums don't depend on arrival
        score += np.frombuffer(s)
    ids = pd.Series(dec(info["doc_id"])).astype("Int64").mask(dec(info["no_id"]).astype(bool))
    return pd.DataFrame(
        {
            "doc_id": ids,
            "held_out": dec(info["held"]).astype(bool),
            "n_tokens": dec(info["n_tokens"]),
            "n_known": dec(info["n_known"]),
            "train_tokens": total,
            "base_score": np.frombuffer(bytes(info["base"])),
            "score": score,
        }
    )


def score(docs: DataFrame, held_out: Column | None = None, block_bytes: int = 3 << 20, order: int = 2, part_bytes: int = 8 << 20) -> DataFrame:
    """Learns from the rows that aren't held out (crc32 of the id modulo 5 is 1) and scores all rows.

    Other orders than 2 go by the tables of the module ngrams, which need more disk.
    """
    held = held_out if held_out is not None else crc_mod("doc_id", 5) == 1
    if order != 2:
        return ngrams.score(docs, held, order)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("s"), F.count(F.when(~F.col("held_out"), 1)).alias("n")).first()
    n_blocks = int((size["s"] or 0) // block_bytes) + 1
    parts = int((size["s"] or 0) // part_bytes) + 1  # a part is as large in any corpus
    unigrams = stored(unigram_table(rows.where(~F.col("held_out")), parts), "unigrams")
    stats = unigrams.agg(F.sum("n_types").alias("v"), F.sum("n_tokens").alias("n"), *[F.sum(F.get("n_counts", F.lit(r))).alias(f"n{r}") for r in range(7)]).first()
    uni = Unigrams.of(stats["n"] or 0, stats["v"] or 0, size["n"], np.array([stats[f"n{r}"] or 0 for r in range(7)]))
    texts = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    sent = entries(texts, unigrams, uni, parts).repartition(max(shuffle_partitions(spark), parts // 2), "part").rdd  # its shuffle is read twice
    bigrams = stored(spark.createDataFrame(sent.mapPartitions(lambda r: count_parts(r, uni)), TABLE), "bigrams")
    n2 = bigrams.agg(*[F.sum(F.get("n_counts", F.lit(r))).alias(f"n{r}") for r in range(7)]).first()
    d = discounts(np.array([n2[f"n{r}"] or 0 for r in range(7)]))
    split: dict[int, tuple[float, float, float]] = {}
    for r in bigrams.select(F.explode("split").alias("s")).select("s.*").groupBy("h").agg(F.sum("mass").alias("mass"), *[F.sum(F.get("by_count", F.lit(i))).alias(f"c{i}") for i in range(7)]).collect():
        c = np.array([r[f"c{i}"] for i in range(7)])
        split[r["h"]] = (float(c.sum()), float((c * d).sum()), float(r["mass"]))
    ctx = spark.sparkContext.broadcast(Contexts(d, split))
    sums = spark.createDataFrame(sent.mapPartitions(lambda r: score_parts(r, uni, ctx.value)), SUMS)
    return sums.groupBy("block").applyInPandas(lambda p: finish(p, uni.total), OUT)
