"""Substring deduplication over words, by super-k-mers.

A window is ``length`` consecutive words of one document. A word goes if a window that covers it has the word sequence of
another window anywhere, in the same document, too.

The minimiser of a window is the gram of ``gram`` words in it with the least hash. Consecutive windows of a document that
share it, at one place, form a super-k-mer, which travels as one string to the bucket of its minimiser. Equal windows have
equal minimisers, so they meet; a bucket sorts its windows by hash, and compares the bytes of those that sort together, so
counts are exact.

* First the minimisers alone are counted, a row of numbers for each super-k-mer; only super-k-mers of a minimiser that occurs
  more than once are sent as text.
* A block of documents sends what occurs several times in it only once, marked as repeated, so a passage or a copy that a
  third of all documents hold reaches its bucket once a block.
* A minimiser with more than ``hot`` different super-k-mers (a phrase that many texts share, in different surroundings) is
  split: its windows travel alone, each to the bucket of its own hash.
* Buckets are read as a sorted stream; memory holds the rows of one minimiser, equal ones once.

Rows shuffled grow with the text. Defined results: words are what white space (blank and 0x09 to 0x0D) separates,
unchanged. A null or empty text has no words. Documents of fewer words than ``length`` stay whole. Documents are told apart
by id and text, null ids too: a row that is repeated has its windows elsewhere, so all its windows are repeated. Other columns
of the input, whatever their names, don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.llm.blobs import ranges
from procgraph.llm.common import mix64, stored, utf8

BASE = 0x9E3779B97F4A7C15
#: Bytes of text, or of strings in a bucket, that are worked on together; a longer text is a block by itself.
BLOCK = 4 << 20
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of 0, 1, ... and the inverses, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << n.bit_length()
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


#: A number for each byte, so that words with like letters differ in all bits.
LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Bytes:
    """Some bytes in which any stretch can be hashed, and compared, at once."""

    def __init__(self, data: bytes) -> None:
        self.raw = data
        self.data = np.frombuffer(data, np.uint8)
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTERS[self.data] * up[:-1], out=self.sums[1:])
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = self.data
        self.eight = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.down[start])

    def words(self, at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.eight[at]).view(np.uint64).reshape(-1)

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which stretches of size bytes, eight or more, at a and at b are equal."""
        ok, left = np.ones(len(a), bool), np.arange(len(a))
        for k in range(0, int(size.max(initial=0)), 8):
            left = left[(size[left] > k) & ok[left]]
            at = np.minimum(k, size[left] - 8)
            ok[left] = self.words(a[left] + at) == self.words(b[left] + at)
        return ok

    def alike(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A number for each stretch, the same for equal ones: the index of one of them."""
        if not len(start):
            return start
        h = self.hashes(start, stop)
        by = np.argsort(h, kind="stable")
        new = np.diff(h[by], prepend=~h[by[:1]]) != 0
        first = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        size = stop - start
        follow = np.flatnonzero(~new)
        ok = np.zeros(len(by), bool)
        fits = follow[size[by[follow]] == size[first[follow]]]
        ok[fits] = self.same(start[by[fits]], start[first[fits]], size[by[fits]])
        bad = follow[~ok[follow]]
        out = np.empty(len(by), np.int64)
        out[by] = first
        seen: dict[bytes, int] = {}
        for i in by[bad].tolist():  # other stretches with an equal hash, which chance doesn't give
            out[i] = seen.setdefault(self.raw[start[i] : stop[i]], i)
        return out


def least(h: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each span neighbours lies, the first of equal ones."""
    place, low, width = np.arange(len(h)), h, 1
    while width < span:
        step = min(width, span - width)
        first = low[:-step] <= low[step:]
        low, place = np.where(first, low[:-step], low[step:]), np.where(first, place[:-step], place[step:])
        width += step
    return place


@dataclass
class Supers:
    """The super-k-mers of a block of documents, or single windows."""

    text: Bytes  # the words of all documents, each with a blank behind it
    doc: np.ndarray  # place of the document in the block
    low: np.ndarray  # first window, by its first word in the document
    n: np.ndarray  # windows
    word: np.ndarray  # its first word in the block
    start: np.ndarray  # bytes from its first word on
    stop: np.ndarray  # up to its last word
    key: np.ndarray  # hash of the minimiser, or of the window


def supers(texts: list[bytes], length: int, gram: int) -> tuple[Supers, np.ndarray, np.ndarray]:
    """The super-k-mers of some documents, and where each word begins and ends."""
    split = [t.split() for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    data = b"".join(b" ".join(w) + b" " for w in split if w)
    text = Bytes(data)
    stops = np.flatnonzero(text.data == 32)
    starts = np.append(0, stops + 1)[: len(stops)]
    none = np.zeros(0, np.int64)
    windows = np.maximum(count - length + 1, 0)
    at = ranges(np.cumsum(count) - count, windows)  # words with which a window begins
    if not len(at):
        return Supers(text, none, none, none, none, none, none, none.view(np.uint64)), starts, stops
    grams = text.hashes(starts[: len(starts) - gram + 1], stops[gram - 1 :])
    place = least(grams, length - gram + 1)[at]
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    word = at[new]
    n = np.diff(np.append(new, len(at)))
    doc = np.repeat(np.arange(len(texts)), windows)[new]
    low = word - (np.cumsum(count) - count)[doc]
    return Supers(text, doc, low, n, word, starts[word], stops[word + n - 1 + length - 1], grams[place[new]]), starts, stops


def split_hot(s: Supers, which: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int) -> Supers:
    """Some super-k-mers cut into their windows, with the hashes of these as keys; the others as they are."""
    many = np.where(which, s.n, 1)
    of, k = np.repeat(np.arange(len(many)), many), ranges(np.zeros(len(many), np.int64), many)
    word, cut = s.word[of] + k, which[of]
    start, stop = np.where(cut, starts[word], s.start[of]), np.where(cut, stops[word + length - 1], s.stop[of])
    return Supers(s.text, s.doc[of], s.low[of] + k, np.where(cut, 1, s.n[of]), word, start, stop, np.where(cut, s.text.hashes(start, stop), s.key[of]))


def batched(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with about limit bytes of text, and the text as bytes."""
    for b in batches:
        raw, at, total = [utf8(t) for t in b.column("text").to_pylist()], 0, 0
        for k, t in enumerate(raw):
            if total and total + len(t) > limit:
                yield b.slice(at, k - at), raw[at:k]
                at, total = k, 0
            total += len(t)
        if at < len(raw):
            yield b.slice(at), raw[at:]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def runs(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where rows begin that don't go on from the one before: all of cols but the last equal, the last one more."""
    new = np.diff(cols[-1], prepend=cols[-1][:1] - 2) != 1
    for c in cols[:-1]:
        new |= np.diff(c, prepend=c[:1] - 1) != 0
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(new)))


ROW = "key long, id long, digest long, low int, n int, done boolean, text binary"
FOUND = "f_id long, f_digest long, low int, n int"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest"), "text")


def marked(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """mini, id, digest, kind, forms: the minimisers that occur more than once.

    kind 0 and 2: a document has it; 1: a block has it several times. forms: the different super-k-mers with it, as far as
    blocks could tell; none for kind 2.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in batched(batches, BLOCK):
            s, _, _ = supers(texts, length, gram)
            by = np.lexsort((s.doc, s.key))
            key, doc = s.key[by], s.doc[by]
            form = s.text.hashes(s.start, s.stop)[by]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            times = np.diff(np.append(begin, len(key)))
            inner = np.lexsort((form, key))
            differ = np.append(True, (key[inner][1:] != key[inner][:-1]) | (form[inner][1:] != form[inner][:-1]))[: len(key)]
            forms = np.add.reduceat(differ.astype(np.int64), begin) if len(begin) else begin
            one, more = begin[times == 1], np.repeat(times > 1, times)
            first = more & np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
            told, several = np.flatnonzero(first), begin[times > 1]
            rows, kind = np.concatenate([one, several, told]), np.repeat([0, 1, 2], [len(one), len(several), len(told)]).astype(np.int32)
            at = pa.array(doc[rows])
            n = np.concatenate([np.ones(len(one), np.int64), times[times > 1], np.zeros(len(told), np.int64)])
            f = np.concatenate([np.ones(len(one), np.int64), forms[times > 1], np.zeros(len(told), np.int64)])
            yield pa.RecordBatch.from_arrays([signed(key[rows]), b.column("id").take(at), b.column("digest").take(at), pa.array(kind), pa.array(n), pa.array(f)], ["mini", "id", "digest", "kind", "times", "forms"])

    rows = docs.mapInArrow(count, "mini long, id long, digest long, kind int, times long, forms long")
    same = W.partitionBy("mini", F.when(F.col("kind") == 2, F.xxhash64("id", "digest")))  # what is known already needn't meet
    met = rows.withColumn("all", F.sum("times").over(same)).withColumn("forms", F.sum("forms").over(same))
    return met.where((F.col("kind") == 2) | (F.col("all") > 1)).select("mini", "id", "digest", "kind", "forms")


def repeats(docs: DataFrame, length: int = 35, gram: int = 6, hot: int = 10_000, broadcast_rows: int = 100_000) -> DataFrame:
    """f_id, f_digest, low, n: runs of windows that occur elsewhere, too, of docs with id, digest and text."""
    marks = stored(marked(docs, length, gram), "minimisers")
    many = marks.where((F.col("kind") < 2) & (F.col("forms") > hot)).select(F.col("mini").alias("hot")).distinct()
    n_hot = many.limit(broadcast_rows + 1).count()
    wanted = marks.where("kind <> 1")
    if n_hot:
        wanted = wanted.join(F.broadcast(many) if n_hot <= broadcast_rows else many, F.col("mini") == F.col("hot"), "left")
    else:
        wanted = wanted.withColumn("hot", F.lit(None).cast("long"))
    wanted = wanted.groupBy(F.col("id").alias("w_id"), F.col("digest").alias("w_digest")).agg(F.collect_set("mini").alias("minis"), F.collect_set("hot").alias("hots"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in batched(batches, BLOCK):
            s, starts, stops = supers(texts, length, gram)
            own = lambda key, doc: mix64(key + doc.astype(np.uint64) * np.uint64(BASE))

            def asked(col: str) -> np.ndarray:
                lists = b.column(col)
                doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
                return own(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), doc)

            mine = own(s.key, s.doc)
            keep = np.flatnonzero(np.isin(mine, asked("minis")))
            mine = mine[keep]
            s = Supers(s.text, *(getattr(s, c)[keep] for c in ("doc", "low", "n", "word", "start", "stop", "key")))
            s = split_hot(s, np.isin(mine, asked("hots")), starts, stops, length)
            rep = s.text.alike(s.start, s.stop)
            several = np.bincount(rep, minlength=len(rep)) > 1
            sent, gone = np.flatnonzero(rep == np.arange(len(rep))), np.flatnonzero(several[rep])
            d, w = np.repeat(s.doc[gone], s.n[gone]), ranges(s.low[gone], s.n[gone])
            by = np.lexsort((w, d))
            begin, size = runs(d[by], w[by])
            begin = by[begin]
            doc = np.concatenate([s.doc[sent], d[begin]])
            raw = s.text.raw
            at = pa.array(doc)
            cols = [
                signed(np.concatenate([s.key[sent], mix64(d[begin].astype(np.uint64) + s.text.sums[-1])])),
                b.column("id").take(at),
                b.column("digest").take(at),
                pa.array(np.concatenate([s.low[sent], w[begin]]).astype(np.int32)),
                pa.array(np.concatenate([s.n[sent], size]).astype(np.int32)),
                pa.array(np.concatenate([several[sent], np.ones(len(begin), bool)])),
                pa.array([raw[x:y] for x, y in zip(s.start[sent].tolist(), (s.stop[sent] + 1).tolist(), strict=True)] + [None] * len(begin), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["key", "id", "digest", "low", "n", "done", "text"])

    def found(t: pa.Table, row: np.ndarray, low: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at = pa.array(row)
        ids, digests = (t.column(c).take(at).combine_chunks() for c in ("id", "digest"))
        chunk = lambda a: a if isinstance(a, pa.Array) else a.chunk(0) if a.num_chunks else pa.array([], a.type)
        return pa.RecordBatch.from_arrays([chunk(ids), chunk(digests), pa.array(low.astype(np.int32)), pa.array(n.astype(np.int32))], ["f_id", "f_digest", "low", "n"])

    def numbers(t: pa.Table, col: str) -> np.ndarray:
        return t.column(col).to_numpy()

    def once(t: pa.Table) -> tuple[pa.Table, pa.RecordBatch, Bytes, np.ndarray]:
        """Equal strings once, marked as done; where those lie that aren't told yet; and the strings."""
        texts = t.column("text").to_pylist()
        text = Bytes(b"".join(texts))
        stop = np.cumsum(np.array([len(x) for x in texts], np.int64))
        start = stop - np.array([len(x) for x in texts], np.int64)
        rep = text.alike(start, stop)
        done, several = numbers(t, "done").astype(bool), (np.bincount(rep, minlength=len(rep)) > 1)[rep]
        fresh, stay = np.flatnonzero(several & ~done), np.flatnonzero(rep == np.arange(len(rep)))
        out = found(t, fresh, numbers(t, "low")[fresh], numbers(t, "n")[fresh])
        left = t.set_column(t.schema.get_field_index("done"), "done", pa.array(done | several)).take(pa.array(stay))
        return left, out, text, start[stay]

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """The windows of whole buckets: those that occur several times."""
        t, out, text, start = once(t)
        yield out
        ends = np.flatnonzero(text.data == 32)
        begins = np.append(0, ends + 1)
        n = numbers(t, "n").astype(np.int64)
        row, k = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)
        word = np.searchsorted(begins, start)[row] + k
        rep = text.alike(begins[word], ends[word + length - 1])
        hit = np.flatnonzero((np.bincount(rep, minlength=len(rep)) > 1)[rep] & ~numbers(t, "done").astype(bool)[row])
        begin, size = runs(row[hit], k[hit])
        first = hit[begin]
        yield found(t, row[first], numbers(t, "low")[row[first]] + k[first], size)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, BLOCK
        for b in batches:
            strings = b.column("text").is_valid()
            told = pa.Table.from_batches([b.filter(pc.invert(strings))])
            yield found(told, np.arange(told.num_rows), numbers(told, "low"), numbers(told, "n"))
            b = b.filter(strings)
            if not b.num_rows:
                continue
            for part in (b.slice(at, 2000) for at in range(0, b.num_rows, 2000)):
                held.append(part)
                size += part.nbytes
                if size < limit:
                    continue
                t = pa.Table.from_batches(held)
                key = numbers(t, "key")
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from settle(t.slice(0, cut))
                t = t.slice(cut).combine_chunks()
                if t.nbytes > limit // 2:  # one minimiser: equal strings once, the others are few or it would be split
                    t, out, _, _ = once(t)
                    yield out
                held = t.to_batches()
                size = sum(x.nbytes for x in held)
                limit = max(BLOCK, 2 * size)
        if held:
            yield from settle(pa.Table.from_batches(held))

    near = docs.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest"))).drop("w_id", "w_digest")
    return near.mapInArrow(send, ROW).repartition("key").sortWithinPartitions("key").mapInArrow(sort, FOUND)


def remove(docs: DataFrame, length: int = 35, **how) -> DataFrame:
    """doc_id, text (the words that stay, one blank between them), n_words, n_removed, spans (first word, and one past the last) of every row."""
    rows = keyed(docs)
    hits = repeats(rows, length, **how).groupBy("f_id", "f_digest").agg(F.collect_list("low").alias("lows"), F.collect_list("n").alias("counts"))
    both = rows.join(hits, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest")), "left").select("id", "text", "lows", "counts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, texts in batched(iter([whole]), 4 * BLOCK):
                out: list[tuple] = []
                for raw, lows, counts in zip(texts, b.column("lows").to_pylist(), b.column("counts").to_pylist(), strict=True):
                    words = raw.split()
                    if lows:
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, np.array(lows), 1)
                        np.add.at(change, np.array(lows) + np.array(counts) + length - 1, -1)
                        gone = np.cumsum(change)[:-1] > 0
                        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                        spans = list(zip(edge[::2], edge[1::2], strict=True))
                        words_kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    else:
                        spans, words_kept = [], words
                    out.append((b" ".join(words_kept).decode("utf-8", "surrogatepass"), len(words), len(words) - len(words_kept), [{"start": x, "stop": y} for x, y in spans]))
                cols = list(zip(*out, strict=True))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "text", "n_words", "n_removed", "spans"])

    return both.mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long, spans array<struct<start:int,stop:int>>")


def digests(docs: DataFrame, length: int = 35, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return remove(docs, length, **how).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def oracle(length: int = 35) -> str:
    """SQL for the rows of digests(), for distinct ids."""
    return rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + {length - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {length - 2})) AS i FROM w)),
h AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {length})) AS i FROM h),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
