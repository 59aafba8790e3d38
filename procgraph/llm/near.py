"""Near copies by SimHash fingerprints of their shingles and, without loss, by the Jaccard similarity of the shingles.

Fingerprints of the sets are linked by the generalised pigeonhole principle (simhash.links); whole sets verify these links.
An exact check follows, as sets at the limit may differ in more bits than the radius: a prefix filter, bounds, verification.

A text is the set of its shingles of ``width`` words (white space separates words, A-Z is lowered; fewer words make one
shingle), held as 64-bit hashes. All sets are put in one order, with shingles that a sample shows to be frequent last. Of
two sets whose similarity reaches the limit, each has a shingle of the other among its first n - ceil(limit * n) + 1, so
texts that share none there need no comparison; the order chosen changes the work only. Pairs that meet must also pass
bounds on sizes, places and the parity of shingles by bucket, each of which holds for all pairs at the limit; those that pass
meet once more with parities over twice as many buckets as they have shingles, which leave little but links.

Only distinct sets are compared. A pair that passes is verified by itself, on whole sets, wherever its smaller set is; no
group has to fit in a task. One pair of each set and the links of fingerprints go first; pairs that these join need no text. Of a key that very many sets share, only a forest of what passes in random blocks goes on at
first. Once the links found join most of them, the pairs of such keys whose sets are still apart follow, block by block, so
that no link is lost. How many follow depends on the bounds: many long texts that share a rare passage but are unlike pass
them as pairs.

Defined results: texts without words have one empty set and are copies of one another; a null text is an empty one. The row
that stands for a component has its smallest id, null ids last, then the smallest digest of the text; of rows that have
both in common one stays, by a digest of the row. A component of null ids keeps one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.llm.common import dropped, mix64, released, stored, utf8
from procgraph.llm.simhash import components, links, one_row, planned

#: Sets under one key beyond which a forest replaces its pairs.
HEAVY = 64
#: Characters of text whose shingles a task holds at a time; the text in which they end is taken whole.
CHARS = 2 << 20
#: Sets of a heavy key in one block of those compared later; partners of a set that are verified in one go.
BLOCK, PARTNERS = 4096, 256
BUCKETS = 512
STEP = 0xD6E8FEB86659FD93


def shingles(text: object, width: int = 5) -> np.ndarray:
    """The hashes of a text's shingles, sorted and distinct."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += h[k : k + n] * np.uint64(pow(STEP, k + 1, 1 << 64))
    return np.unique(mix64(out))


def sliced(frames: Iterator[pd.DataFrame], chars: int = CHARS) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about so many characters of text."""
    for p in frames:
        size = np.array([len(t) if isinstance(t, str) else 0 for t in p["text"]], np.int64)
        for _, part in p.groupby((np.cumsum(size) - size) // chars, sort=False):
            yield part


def parity(h: np.ndarray) -> bytes:
    """A bit for each bucket: whether it has an odd number of shingles. Bits that differ are at most as many as shingles that do."""
    odd = np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of a set of hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def sketch(h: np.ndarray) -> bytes:
    """parity() over a power of two of buckets, at least twice as many as there are shingles."""
    size = 1 << max(6, (2 * len(h) - 1).bit_length()) if len(h) else 64
    odd = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differ(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the buckets of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n)) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def prefix(h: np.ndarray, limit: Fraction, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles under which a set is filed."""
    n = len(h)
    if not n:
        return h
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        h = h[np.lexsort((h, np.where(frequent[at] == h, counts[at], 0)))]
    return h[: n - -(-limit.numerator * n // limit.denominator) + 1]


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, limit: Fraction) -> np.ndarray:
    """Bounds by the sizes and the bits that differ."""
    p, q = limit.numerator, limit.denominator
    return (q * np.minimum(n, m) >= p * np.maximum(n, m)) & ((p + q) * apart <= (q - p) * (n + m))


def linked(a: np.ndarray, b: np.ndarray, limit: Fraction) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return (limit.numerator + limit.denominator) * common >= limit.numerator * (len(a) + len(b))


def bits_of(rows: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in rows), np.uint64).reshape(-1, BUCKETS // 64)


def frequent_shingles(docs: DataFrame, width: int, sample_rows: int = 20_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of what at least five and one in 2000 texts of a sample hold; only to order shingles."""
    share = min(1.0, sample_rows / max(docs.count(), 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in sliced(frames):
            got = [shingles(t, width) for t in p["text"]]
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.uint64), *got]).view(np.int64)})

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))).mapInPandas(run, "h long")
    often = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(5, sample_rows // 2000)).orderBy(F.desc("n"), "h").limit(most).collect()
    h, n = np.array([r["h"] for r in often], np.int64).view(np.uint64), np.array([r["n"] for r in often], np.int64)
    by = np.argsort(h)
    return h[by], n[by]


def by_group(frames: Iterator[pd.DataFrame], where: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted frames, cut where the group changes."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        if len(f):
            k = f[where].to_numpy()
            last = int(np.flatnonzero((k != k[-1]).any(1)).max(initial=-1)) + 1
            rest = f.iloc[last:]
            if last:
                yield f.iloc[:last]
    if rest is not None and len(rest):
        yield rest


def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by key and set those whose key several sets have, each set once; one row is held back between frames."""
    last = None
    for f in frames:
        if not len(f):
            continue
        taken = last is not None and last[1]
        f = f if last is None else pd.concat([last[0], f], ignore_index=True)
        k, g = f["key"].to_numpy(), f["gid"].to_numpy()
        fresh = np.append(True, (k[1:] != k[:-1]) | (g[1:] != g[:-1]))
        f, k = f[fresh], k[fresh]
        same = k[1:] == k[:-1]
        keep = np.append(same, False) | np.append(taken, same)
        yield f[:-1][keep[:-1]]
        last = f[-1:], bool(keep[-1])
    if last is not None and last[1]:
        yield last[0]


def heavy_pairs(gid: np.ndarray, n: np.ndarray, pos: np.ndarray, bits: np.ndarray, test) -> np.ndarray:
    """A spanning forest of the pairs that pass the test."""
    label, out = np.arange(len(gid)), []
    for i in range(1, len(gid)):
        js = np.flatnonzero(label[:i] != label[i])
        js = js[test(n[i], n[js], pos[i], pos[js], bits[i][None], bits[js])]
        while js.size:  # as often as trees meet
            j = js[0]
            out.append((gid[i], gid[j]))
            label[label == label[j]] = label[i]
            js = js[label[js] != label[i]]
    return np.array(out, np.int64).reshape(-1, 2)


def passing(limit: Fraction):
    """The test of sets under one key by sizes, places of the key and bits."""
    p, q = limit.numerator, limit.denominator

    def test(n, m, i, j, x, y) -> np.ndarray:
        most = np.minimum(i, j) + 1 + np.minimum(n - i, m - j) - 1  # in common before, at and after the key
        return may_link(n, m, np.bitwise_count(x ^ y).sum(1, dtype=np.int64), limit) & ((p + q) * most >= p * (n + m))

    return test


def pairs_frame(pairs: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame(np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=1), axis=0), columns=["a", "b"])


def meet(frames: Iterator[pd.DataFrame], limit: Fraction) -> Iterator[pd.DataFrame]:
    """a, b: sets in one block of a key that pass all bounds; of a heavy key a forest of them."""
    test = passing(limit)
    for f in by_group(frames, ["key", "block"]):
        key, block, gid, n, pos = (f[c].to_numpy(np.int64) for c in ("key", "block", "gid", "n", "pos"))
        bits, out = bits_of(f["bits"]), []
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
        size = np.diff(np.append(begin, len(key)))
        heavy = block[begin] >= 0
        for a, s in zip(begin[heavy], size[heavy], strict=True):
            at = slice(a, a + s)
            out.append(heavy_pairs(gid[at], n[at], pos[at], bits[at], test))
        left = np.repeat(np.where(heavy, 0, size), size) - (np.arange(len(key)) - np.repeat(begin, size))  # rows of the group from this one on
        for d in range(1, int(size[~heavy].max(initial=1))):
            i = np.flatnonzero(left > d)
            i = i[test(n[i], n[i + d], pos[i], pos[i + d], bits[i], bits[i + d])]
            out.append(np.stack([gid[i], gid[i + d]], 1))
        yield pairs_frame(out)


def apart(frames: Iterator[pd.DataFrame], limit: Fraction) -> Iterator[pd.DataFrame]:
    """a, b: sets of two blocks of a heavy key (or of one) that pass all bounds and are in different classes so far."""
    test = passing(limit)
    for f in by_group(frames, ["key", "low", "high"]):
        for (_, low, high), g in f.groupby(["key", "low", "high"], sort=False):
            gid, n, pos, label, block = (g[c].to_numpy(np.int64) for c in ("gid", "n", "pos", "label", "block"))
            bits, out = bits_of(g["bits"]), []
            for i in range(1, len(gid)):
                js = np.flatnonzero((label[:i] != label[i]) & ((block[:i] != block[i]) | (low == high)))
                js = js[test(n[i], n[js], pos[i], pos[js], bits[i][None], bits[js])]
                out.append(np.stack([np.full(len(js), gid[i]), gid[js]], 1))
                if sum(map(len, out[-1000:])) > 1_000_000:
                    yield pairs_frame(out)
                    out = []
            yield pairs_frame(out)


def screen(frames: Iterator[pd.DataFrame], limit: Fraction) -> Iterator[pd.DataFrame]:
    """a, b: pairs that may be linked by their sizes and sketches."""
    for f in frames:
        bits = np.array([differ(x, y) for x, y in zip(f["x"], f["y"], strict=True)], np.int64)
        yield f.loc[may_link(f["n"].to_numpy(np.int64), f["m"].to_numpy(np.int64), bits, limit), ["a", "b"]]


def screened(pairs: DataFrame, sketches: DataFrame, limit: Fraction) -> DataFrame:
    """The pairs that may be linked. sketches: gid, n, sketch."""
    a, b = (sketches.select(F.col("gid").alias(g), F.col("n").alias(n), F.col("sketch").alias(x)) for g, n, x in (("a", "n", "x"), ("b", "m", "y")))
    return pairs.join(a, "a").join(b, "b").mapInPandas(partial(screen, limit=limit), "a long, b long")


def alike(sets: DataFrame, radius: int) -> DataFrame:
    """a, b: sets whose fingerprints are equal or linked within the radius; for each pair of fingerprints one of sets."""
    prints = settled(sets.select("fp", "gid").distinct(), "prints")
    lead = settled(prints.groupBy("fp").agg(F.min("gid").alias("lead")), "lead")
    near = links(lead.select("fp"), planned(lead, radius), radius)
    for c in ("a", "b"):
        near = near.join(lead.withColumnRenamed("fp", c), c).withColumn(c, F.col("lead")).drop("lead")
    same = prints.join(lead, "fp").where("gid <> lead").select(F.col("gid").alias("a"), F.col("lead").alias("b"))
    return near.select("a", "b").union(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def verify(frames: Iterator[pd.DataFrame], limit: Fraction, width: int) -> Iterator[pd.DataFrame]:
    """a, b: pairs that are linked. Rows come sorted by a, part, b; that without b holds the text of a, others that of b."""
    own = None
    for f in frames:
        out = []
        for a, b, alone, text in zip(f["a"].to_numpy(), f["b"].to_numpy(), f["own"].to_numpy(), f["text"], strict=True):
            h = shingles(text, width)
            if alone:
                own = h
            elif linked(own, h, limit):
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def verified(pairs: DataFrame, texts: DataFrame, limit: Fraction, width: int) -> DataFrame:
    """The pairs whose texts are linked. texts: gid, text. A set with many partners is verified in several parts."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    other = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
    other = other.join(texts.withColumnRenamed("gid", "b"), "b").select("a", "part", F.lit(False).alias("own"), "b", "text")
    own = parts.join(texts.withColumnRenamed("gid", "a"), "a")
    own = own.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("own"), F.lit(0).cast("long").alias("b"), "text")
    rows = own.unionByName(other).repartition("a", "part").sortWithinPartitions("a", "part", F.desc("own"))
    return rows.mapInPandas(partial(verify, limit=limit, width=width), "a long, b long")


def settled(df: DataFrame, name: str) -> DataFrame:
    """stored(), after which the shuffle files that led to the table go."""
    out = stored(df, name)
    released(df.sparkSession)
    return out


def texts_of(pairs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """gid, text of the sets in pairs."""
    asked = pairs.select(F.col("a").alias("gid")).union(pairs.select("b")).distinct()
    first = sets.select("gid", "doc_id", "digest").join(asked, "gid").groupBy("gid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("r"))
    first = first.select("gid", F.col("r.doc_id").alias("r_id"), F.col("r.digest").alias("r_digest"))
    texts = rows.join(first, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")))
    return settled(texts.groupBy("gid").agg(F.max("text").alias("text")), "texts")  # repeated rows combine


def apart_by(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose sets have different labels. label: gid, label; without one a set is its own."""
    for c in ("a", "b"):
        pairs = pairs.join(label.select(F.col("gid").alias(c), F.col("label").alias(f"{c}_label")), c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
    return pairs.where("a_label <> b_label").select("a", "b")


def classes(docs: DataFrame, similarity: str = "0.8", width: int = 5, heavy: int = HEAVY, radius: int = 3) -> DataFrame:
    """doc_id, digest (of the text), component of every row of docs."""
    limit = Fraction(similarity)
    frequent, counts = frequent_shingles(docs, width)
    order = docs.sparkSession.sparkContext.broadcast((frequent, counts))

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # of this partition: copies are filed once
        for p in sliced(frames):
            sets = [shingles(t, width) for t in p["text"]]
            gid = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            fresh = ~pd.Series(gid).duplicated().to_numpy() & np.array([g not in seen for g in gid.tolist()], bool)
            seen.update(gid.tolist())
            yield pd.DataFrame(
                {
                    "doc_id": p["doc_id"].astype("Int64").array,
                    "digest": p["digest"].array,
                    "gid": gid,
                    "n": [len(s) for s in sets],
                    "bits": [parity(s) for s in sets],
                    "sketch": [sketch(s) if f else None for s, f in zip(sets, fresh, strict=True)],
                    "fp": np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64),
                    "prefix": [prefix(s if f else s[:0], limit, *order.value).view(np.int64) for s, f in zip(sets, fresh, strict=True)],
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    sets = settled(rows.mapInPandas(file, "doc_id long, digest long, gid long, n int, bits binary, sketch binary, fp long, prefix array<long>"), "sets")
    keys = sets.select("gid", "n", F.posexplode("prefix").alias("pos", "key"))
    several = settled(keys.repartition("key").sortWithinPartitions("key", "gid").mapInPandas(met, "gid long, n int, pos int, key long"), "met")
    bits = sets.select("gid", "bits").join(several.select("gid").distinct(), "gid", "left_semi").groupBy("gid").agg(F.max("bits").alias("bits"))
    many = several.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > heavy)

    def blocks(size: int) -> Column:
        return F.pmod(F.xxhash64("gid", "key"), F.ceil(F.col("many") / size))

    block = F.when(F.col("many").isNull(), F.lit(-1).cast("long")).otherwise(blocks(heavy))
    near_keys = several.join(many, "key", "left").select("key", block.alias("block"), "gid", "n", "pos").join(bits, "gid")
    dealt = near_keys.repartition("key", "block").sortWithinPartitions("key", "block")
    pairs = settled(dealt.mapInPandas(partial(meet, limit=limit), "a long, b long").distinct(), "pairs")

    sketches = sets.groupBy("gid").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    prints = settled(screened(alike(sets, radius), sketches, limit), "alike")
    likely = settled(screened(pairs, sketches, limit).unionByName(prints).distinct(), "likely")
    texts = texts_of(likely, sets, rows)
    start = settled(prints.unionByName(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct(), "start")
    edges = settled(verified(start, texts, limit, width), "edges")
    label = components(edges).select(F.col("node").alias("gid"), F.col("root").alias("label"))
    left = apart_by(likely.join(start, ["a", "b"], "left_anti"), label)
    edges = edges.unionByName(settled(verified(left, texts, limit, width), "edges"))
    label = components(edges).select(F.col("node").alias("gid"), F.col("root").alias("label"))
    released(docs.sparkSession)

    shared = several.join(many, "key").join(label, "gid", "left").withColumn("label", F.coalesce("label", "gid"))
    mixed = shared.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    left = shared.join(mixed, "key").withColumn("block", blocks(BLOCK)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("many") / BLOCK) - 1)))
    left = left.select("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "gid", "n", "pos", "label").join(bits, "gid")
    left = left.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    late = settled(left.mapInPandas(partial(apart, limit=limit), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"), "late")
    late = settled(screened(late, sketches, limit), "late")
    if late.isEmpty():
        least = label.withColumnRenamed("label", "least")
    else:
        found = verified(late, texts_of(late, sets, rows), limit, width)
        for c in ("a", "b"):
            found = found.join(label.withColumnRenamed("gid", c), c, "left").withColumn(c, F.coalesce("label", c)).drop("label")
        root = components(found).withColumnRenamed("node", "label")
        least = label.join(root, "label", "full").select(F.coalesce("gid", "label").alias("gid"), F.coalesce("root", "label").alias("least"))
    for t in (several, pairs, prints, likely, start, texts):
        dropped(t)
    released(docs.sparkSession)
    return sets.select("gid", "doc_id", "digest").join(least, "gid", "left").select("doc_id", "digest", F.coalesce("least", "gid").alias("component"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with its columns, that stand for their component: one of each."""
    return one_row(docs, classes(docs.select("doc_id", "text"), **how))
