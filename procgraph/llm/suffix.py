"""Suffix-array deduplication of repeated byte strings.

A byte is removed if it is covered by a string of ``length`` bytes that also starts in a document with a smaller id.

Suffixes are taken at anchors: of the grams of half the length within a string, the one with the least hash, so that equal
strings have equal anchors at equal places, and every string belongs to one anchor. Only anchors whose gram occurs in
several documents can matter; hashes of grams tell which. For those, the suffixes are range-partitioned by the leading
bytes of the anchor with sampled splitters, and each bucket is sorted by multikey quicksort, eight bytes being one key,
until strings of full length are told apart. Splitters compare the whole gram and equal strings have equal grams, so equal
strings never lie on two sides of a boundary: looking across it can't find more.

Before each shuffle a block of documents sends what occurs often in it only once, for its smallest id, so a passage that a
third of all documents share gives each bucket at most one suffix for each block and place.

Defined results: a null text is an empty one. Strings never cross documents; those that repeat within one document only
stay. Rows with a null id are left whole. Rows with the same id are one document and must have the same text; each gives
one result. Texts shorter than ``length`` bytes are left whole. Other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from procgraph.llm.blobs import Block, blocks, dec, dec_all, enc, ranges
from procgraph.llm.common import mix64, utf8

A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def squeeze(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def unsqueeze(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(b))


def words(data: np.ndarray) -> np.ndarray:
    """For every place the eight bytes from there on as one big-endian number."""
    n = len(data)
    out = np.empty(max(n - 7, 0), np.uint64)
    for s in range(min(8, len(out))):
        part = data[s : s + (n - s) // 8 * 8].view(">u8")
        out[s::8] = part[: len(out[s::8])]
    return out


def key_places(length: int) -> list[int]:
    """Where in a string of so many bytes its keys of eight bytes begin; the last may overlap the one before."""
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]


class Anchors:
    """Runs of string starts with the same anchor, over the documents of a block."""

    def __init__(self, b: Block, length: int) -> None:
        gram = length // 2 - 1
        self.gram, self.data, n = gram, b.data, len(b.data)
        self.w = words(b.data)
        if n < length:
            self.low = self.high = self.at = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        h = np.zeros(n - gram + 1, np.uint64)
        for k in key_places(gram):
            h = (h ^ self.w[k : k + len(h)]) * A
            h ^= h >> np.uint64(29)
        least, place, width = h, np.arange(len(h), dtype=np.int32), 1
        span = length - gram + 1

        def merged(step: int) -> tuple[np.ndarray, np.ndarray]:
            first = least[:-step] <= least[step:]
            return np.where(first, least[:-step], least[step:]), np.where(first, place[:-step], place[step:])

        while 2 * width <= span:
            least, place = merged(width)
            width *= 2
        if span > width:
            least, place = merged(span - width)
        fits = np.zeros(n + 1, np.int8)
        long = b.size >= length
        np.add.at(fits, b.start[long], 1)
        np.add.at(fits, (b.start + b.size - length + 1)[long], -1)
        starts = np.flatnonzero(np.cumsum(fits[: len(place)]))
        q = place[starts]
        new = np.flatnonzero((np.diff(q, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        self.low = starts[new]
        self.high = starts[np.append(new[1:], len(starts)) - 1] if len(new) else starts[:0]
        self.at = q[new].astype(np.int64)
        doc_starts = b.start[long]
        self.doc = np.flatnonzero(long)[np.searchsorted(doc_starts, self.low, "right") - 1] if len(new) else self.low
        self.hash = mix64(h[self.at]) >> np.uint64(16)

    def grams(self, which: np.ndarray) -> np.ndarray:
        """The leading bytes of the anchors' suffixes, as byte strings."""
        g = self.gram
        rows = self.data[(self.at[which][:, None] + np.arange(g))]
        return np.ascontiguousarray(rows).view(f"S{g}").reshape(-1)


def hash_bucket(h: np.ndarray, parts: int) -> np.ndarray:
    """Buckets of 48-bit hashes, rising with the hash; up to 2**32 of them without overflow."""
    return ((h >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)


def groups(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin; all keys sorted."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def shared_grams(w: np.ndarray, at: np.ndarray, doc: np.ndarray, gram: int) -> np.ndarray:
    """Which of some anchors have a gram, by its hash, that anchors of other documents have, too."""
    key = np.zeros(len(at), np.uint64)
    for k in key_places(gram):
        key = mix64(key ^ w[at + k])
    by = np.argsort(key, kind="stable")
    begin = groups(key[by])
    if not len(begin):
        return by
    d = doc[by]
    several = np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)
    return np.sort(by[np.repeat(several, np.diff(np.append(begin, len(by))))])


def multikey_order(key_at, places: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of n strings and the group of equal strings of each, by multikey quicksort.

    key_at(which, place) gives the keys at a place of the strings. After each key only strings that aren't alone are
    sorted on, within their group, and of those only groups whose next keys differ.
    """
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = key_at(np.arange(n), places[0])
    order = np.argsort(first)
    begin = groups(first[order])
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    for place in places[1:]:
        several = np.flatnonzero((np.diff(group, prepend=-1) == 0) | (np.diff(group, append=-1) == 0))
        if not len(several):
            break
        sub, g = order[several], group[several]
        key, start = key_at(sub, place), groups(g)
        apart = np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start)
        if not apart.any():
            continue
        mixed = np.repeat(apart, np.diff(np.append(start, len(g))))
        several, sub, g, key = several[mixed], sub[mixed], g[mixed], key[mixed]
        by = np.lexsort((key, g))
        order[several] = sub[by]
        new = np.zeros(n, np.int64)
        new[begin] = 1
        inner = groups(g[by], key[by])
        new[several[inner]] = 1
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
    return order, group


def packed(x: np.ndarray) -> bytes:
    """A few numbers as bytes; there are many such rows, so compressing each would cost more than it saves."""
    return x.astype("<i8").tobytes()


def unpacked(blobs: list) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i8")


def doc_rows(doc: np.ndarray, *cols: np.ndarray) -> Iterator[tuple]:
    """Slices of the columns for each document; all sorted by it."""
    begin = groups(doc)
    if not len(begin):
        return
    for lo, hi in zip(begin, np.append(begin[1:], len(doc)), strict=True):
        yield (int(doc[lo]), *(c[lo:hi] for c in cols))


def flagged_docs(docs: DataFrame, length: int, bucket_bytes: int = 4 << 20) -> DataFrame:
    """f_id, low, count: blobs of where removed strings start in a document; several rows for a document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    parts = int(size // bucket_bytes) + 1  # a bucket is as large in any corpus
    cols = "bucket int, kind int, id long, a binary, b binary, c binary"
    frame = lambda rows: pd.DataFrame(rows, columns=["bucket", "kind", "id", "a", "b", "c"])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Hashes of grams by ranges of the hash; those of several documents of the block are settled here."""
        for blk in blocks(frames):
            x, ids = Anchors(blk, length), blk.rows["id"].to_numpy()
            doc = ids[x.doc]
            by = np.lexsort((doc, x.hash))
            h, d = x.hash[by], doc[by]
            once = groups(h, d)
            h, d = h[once], d[once]
            begin = groups(h)
            several = np.repeat(np.diff(np.append(begin, len(h))) > 1, np.diff(np.append(begin, len(h))))
            bucket = hash_bucket(h, parts)
            one_h, one_d, one_b = h[~several], d[~several], bucket[~several]
            both, both_b = h[begin][several[begin]], bucket[begin][several[begin]]
            cut, cut2 = np.searchsorted(one_b, np.arange(parts + 1)), np.searchsorted(both_b, np.arange(parts + 1))
            rows = [(k, 0, 0, enc(one_h[cut[k] : cut[k + 1]], True), enc(one_d[cut[k] : cut[k + 1]]), enc(both[cut2[k] : cut2[k + 1]], True)) for k in range(parts) if cut[k] < cut[k + 1] or cut2[k] < cut2[k + 1]]
            local = np.lexsort((h[several], d[several]))
            rows += [(i % parts, 1, i, packed(hs), None, None) for i, hs in doc_rows(d[several][local], h[several][local])]
            yield frame(rows)

    def settle(p: pd.DataFrame) -> pd.DataFrame:
        """Which hashes of a document occur in others, too."""
        told = p[p["kind"] == 1]
        out = [(int(i), bytes(a)) for i, a in zip(told["id"], told["a"], strict=True)]
        asked = p[p["kind"] == 0]
        h, d, both = dec_all(list(asked["a"]), True), dec_all(list(asked["b"])), np.unique(dec_all(list(asked["c"]), True))
        by = np.lexsort((d, h))
        h, d = h[by], d[by]
        if len(h):
            begin = groups(h)
            size = np.diff(np.append(begin, len(h)))
            shared = np.repeat(np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin), size) | np.isin(h, both)
            h, d = h[shared], d[shared]
            by = np.lexsort((h, d))
            out += [(i, packed(hs)) for i, hs in doc_rows(d[by], h[by])]
        return pd.DataFrame(out, columns=["s_id", "hashes"]).astype({"s_id": "int64"})

    shared = docs.select("id", "text").mapInPandas(ask, cols).groupBy("bucket").applyInPandas(settle, "s_id long, hashes binary")
    shared = shared.groupBy("s_id").agg(F.collect_list("hashes").alias("hashes"))
    sample = splitters(docs.select("id", "text"), length, parts)
    split = spark.sparkContext.broadcast(sample)  # one gram for each bucket

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Stretches of text around anchors, by ranges of the anchors' suffixes; equal stretches go once."""
        for blk in blocks(frames):
            x, ids = Anchors(blk, length), blk.rows["id"].to_numpy()
            wanted = [unpacked(list(hs)).view(np.uint64) | np.uint64(i << 48) for i, hs in enumerate(blk.rows["hashes"])]
            keys = np.concatenate(wanted) if wanted else np.zeros(0, np.uint64)
            use = np.flatnonzero(np.isin(x.hash | (x.doc.astype(np.uint64) << np.uint64(48)), keys)) if len(x.low) else np.zeros(0, np.int64)
            low, high, at, doc = x.low[use], x.high[use], x.at[use], ids[x.doc[use]]
            place = key_places(length)
            key = (high - low).astype(np.uint64) * B + (at - low).astype(np.uint64) * C
            for k in place:
                key = (mix64(key ^ x.w[low + k]) ^ x.w[high + k]) * A
            by = np.lexsort((doc, key))
            begin = groups(key[by])
            first = np.repeat(by[begin], np.diff(np.append(begin, len(by)))) if len(by) else by
            same = (high[by] - low[by] == high[first] - low[first]) & (at[by] - low[by] == at[first] - low[first])
            for k in place:  # equal keys are equal stretches unless hashes collide, so look
                same &= (x.w[low[by] + k] == x.w[low[first] + k]) & (x.w[high[by] + k] == x.w[high[first] + k])
            gone = by[same & (doc[by] > doc[first])]
            stay = np.setdiff1d(np.arange(len(use)), gone)
            start = blk.start[x.doc[use]]
            gone = gone[np.lexsort((low[gone], doc[gone]))]
            rows = [(i % parts, 1, i, packed(lo), packed(n), None) for i, lo, n in doc_rows(doc[gone], (low - start)[gone], (high - low + 1)[gone])]
            bucket = np.searchsorted(split.value, x.grams(use[stay]), "right")
            by = stay[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            for k, s in doc_rows(bucket, by):
                text = squeeze(blk.data[ranges(low[s], high[s] - low[s] + length)].tobytes())
                pos = np.stack([(low - start)[s], (high - low + 1)[s], (at - low)[s]]).reshape(-1)
                rows.append((k, 0, 0, enc(doc[s]), enc(pos), text))
            yield frame(rows)

    def sort(p: pd.DataFrame) -> pd.DataFrame:
        told = p[p["kind"] == 1]
        out = [(int(i), bytes(a), bytes(b)) for i, a, b in zip(told["id"], told["a"], told["b"], strict=True)]
        sent = p[p["kind"] == 0]
        if len(sent):
            doc = dec_all(list(sent["a"]))
            low, n, to = np.concatenate([dec(b).reshape(3, -1) for b in sent["b"]], 1)
            w = words(np.frombuffer(b"".join(map(unsqueeze, sent["c"])), np.uint8))
            begins = np.cumsum(n + length - 1) - (n + length - 1)
            keep = shared_grams(w, begins + to, doc, length // 2 - 1)
            doc, low, n, begins = doc[keep], low[keep], n[keep], begins[keep]
            at, of = ranges(begins, n), np.repeat(np.arange(len(n)), n)
            order, group = multikey_order(lambda which, place: w[at[which] + place], key_places(length), len(at))
            d = doc[of[order]]
            begin = groups(group)
            later = order[d > np.minimum.reduceat(d, begin)[group]] if len(order) else order
            d, where = doc[of[later]], (low - begins)[of[later]] + at[later]
            by = np.lexsort((where, d))
            d, where = d[by], where[by]
            new = np.flatnonzero((np.diff(d, prepend=d[:1] - 1) != 0) | (np.diff(where, prepend=-2) != 1))
            count = np.diff(np.append(new, len(d)))
            out += [(i, packed(lo), packed(c)) for i, lo, c in doc_rows(d[new], where[new], count)]
        return pd.DataFrame(out, columns=["f_id", "low", "count"]).astype({"f_id": "int64"})

    near = docs.join(shared, F.col("id") == F.col("s_id")).drop("s_id")
    return near.mapInPandas(send, cols).groupBy("bucket").applyInPandas(sort, "f_id long, low binary, count binary")


def splitters(docs: DataFrame, length: int, parts: int, sample_docs: int = 2000) -> np.ndarray:
    """Grams at evenly spaced ranks among the anchors of a bounded sample of documents; they only balance buckets."""
    n = docs.count()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blk in blocks(frames):
            x = Anchors(blk, length)
            yield pd.DataFrame({"g": [bytes(g) for g in x.grams(np.arange(0, len(x.low), 16))]})

    share = int((1 << 20) * min(1.0, sample_docs / max(n, 1)))
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).mapInPandas(run, "g binary").limit(200_000)
    got = np.sort(np.array([bytes(r["g"]) for r in some.collect()], f"S{length // 2 - 1}"))
    return np.unique(got[np.linspace(0, len(got) - 1, parts + 1).astype(int)[1:-1]]) if len(got) else got


def spans(lows: list, counts: list, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that strings starting at the given places cover."""
    low = unpacked(lows)
    end = low + unpacked(counts) + length - 1
    by = np.argsort(low, kind="stable")
    low, end = low[by], np.maximum.accumulate(end[by])
    new = np.flatnonzero(np.append(True, low[1:] > end[:-1]))
    return list(zip(low[new].tolist(), end[np.append(new[1:], len(low)) - 1].tolist(), strict=True))


def _with_flags(docs: DataFrame, length: int) -> DataFrame:
    """The rows of docs with lows and counts; docs has id, text and others.

    Both joins take the same columns of the same rows by the same key, so that the texts are shuffled once.
    """
    named = docs.where(F.col("id").isNotNull())
    flags = flagged_docs(named, length).groupBy("f_id").agg(F.collect_list("low").alias("lows"), F.collect_list("count").alias("counts"))
    none = [F.lit(None).cast("array<binary>").alias(c) for c in ("lows", "counts")]
    return named.join(flags, F.col("id") == F.col("f_id"), "left").drop("f_id").unionByName(docs.where(F.col("id").isNull()).select("*", *none))


def digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            out = []
            for text, lows, counts in zip(p["text"], p["lows"], p["counts"], strict=True):
                raw = utf8(text)
                cut = spans(list(lows), list(counts), length) if lows is not None else []
                at, kept = 0, hashlib.sha256()
                for lo, hi in cut:
                    kept.update(raw[at:lo])
                    at = hi
                kept.update(raw[at:])
                out.append((len(raw), sum(hi - lo for lo, hi in cut), len(cut), kept.hexdigest()))
            res = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            res.insert(0, "doc_id", p["id"].astype("Int64").array)
            yield res

    found = _with_flags(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), length)
    return found.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_text(text: str, lows: list, counts: list, length: int) -> str:
    """A text without its repeated bytes; characters that are covered in part stay."""
    raw, out, at = utf8(text), [], 0
    for lo, hi in spans(lows, counts, length):
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        out.append(raw[at:lo])
        at = hi
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs without the repeated bytes, with its columns; n_chars follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), "text", *[F.col(c).alias(f"x{i}") for i, c in enumerate(others)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(n) for n in b.schema.names if n not in ("lows", "counts")]
            names = [n for n in b.schema.names if n not in ("lows", "counts")]
            texts, lows, counts = (b.column(n).to_pylist() for n in ("text", "lows", "counts"))
            fresh = [t if lo is None or t is None else cut_text(t, lo, n, length) for t, lo, n in zip(texts, lows, counts, strict=True)]
            at = names.index("text")
            cols[at] = pa.array(fresh, cols[at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array([lo is not None for lo in lows])], [*names, "hit"])

    found = _with_flags(plain, length)
    schema = StructType([*(f for f in found.schema if f.name not in ("lows", "counts")), StructField("hit", BooleanType())])
    out = found.mapInArrow(run, schema)
    back = {"doc_id": F.col("id"), "text": F.col("text")} | {c: F.col(f"x{i}") for i, c in enumerate(others)}
    if "n_chars" in others:
        back["n_chars"] = F.when(F.col("hit"), F.length("text").cast("long")).otherwise(back["n_chars"])
    return out.select(*[back[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
