"""Best-fit packing of documents into sequences under several capacities.

A piece is a vector of its tokens, its one document and its attention cost (tokens squared); a sequence has a capacity
of each. Pieces are alike if they are equally long, so the packing works on how many pieces there are of each length, which
is at most ``max_tokens`` numbers whatever the corpus. A sequence starts with the longest length left; then the length
with the largest weighted dot product with what is left of the capacities (or the least norm of what would be left) goes
in, among those that fit in every respect, until none fits. The filled sequence is repeated as often as its lengths last.
Pieces then find their places by their rank among the pieces of their length. Ranks are taken in hashed parts of
each length, so a length with a third of all pieces isn't ranked in one task.

Defined results: a null text is an empty one: its only token is the end. Documents longer than a sequence are cut, others
never; very long ones are encoded whole, a word at a time. Rows with null ids, and repeated rows, are packed one by one.
Other columns of the input aren't read. An empty table has no pieces. A capacity that some piece alone exceeds is an error.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from procgraph.llm.common import shuffle_partitions, stored

#: A dictionary of words is emptied when it has so many, which bounds a worker's memory.
CACHE = 800_000
#: Texts whose unknown words are looked up together.
TOGETHER = 128
#: Characters that all tables of Unicode class and lower alike: what isn't here is left to the library.
PLAIN = "\\x00-\\x1b\\x20-\\x7f\\xa1-\\u012f\\u0131-\\u024f"
PLAIN_TEXT = re.compile(f"[{PLAIN}]*")
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Token ids of texts by a tokenizer that drops white space, word by word with a dictionary of words.

    A plain word falls into the parts that the file's pattern gives; the last token of each part, and no other, ends a word.
    Unknown parts are therefore encoded in one call, and the ids are told apart by those tokens. Words with any other
    character are encoded by the library one by one.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        suffix, vocab = file["model"]["end_of_word_suffix"], file["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.pattern = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """White space apart; plain words in lower case, others as they are."""
        if PLAIN_TEXT.fullmatch(text):
            return text.lower().split()
        words = re.split(r"[ \t-\r]+", text) if any(c in text for c in ODD_SPACES) else text.split()
        return [w.lower() if PLAIN_TEXT.fullmatch(w) else w for w in words if w]

    def alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, fresh: set[str]) -> None:
        odd = [w for w in fresh if not PLAIN_TEXT.fullmatch(w)]
        self.known.update(zip(odd, self.alone(odd), strict=True))
        split = {w: [w] if w.isalpha() else self.pattern.findall(w) for w in fresh.difference(odd)}
        parts = self.parts
        ask = list({p for ps in split.values() for p in ps if p not in parts})
        if ask:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(ask)], add_special_tokens=False)[0].ids, "<u4")
            stop = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stop) == len(ask):
                raw = ids.tobytes()
                parts.update((p, raw[i:j]) for p, i, j in zip(ask, [0, *stop[:-1].tolist()], stop.tolist(), strict=True))
            else:  # another tokenizer file, whose words don't end in tokens of their own
                parts.update(zip(ask, self.alone(ask), strict=True))
        self.known.update((w, b"".join([parts[p] for p in ps])) for w, ps in split.items())

    def packed_all(self, texts: list) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null texts are empty."""
        for at in range(0, len(texts), TOGETHER):
            if len(self.known) > CACHE or len(self.parts) > CACHE:
                self.known.clear()
                self.parts.clear()
            words = [self.words(t) if isinstance(t, str) else [] for t in texts[at : at + TOGETHER]]
            get = self.known.get
            got = [list(map(get, ws)) for ws in words]
            if fresh := {w for ws, g in zip(words, got, strict=True) if None in g for w, x in zip(ws, g, strict=True) if x is None}:
                self.learn(fresh)
                got = [list(map(get, ws)) if None in g else g for ws, g in zip(words, got, strict=True)]
            yield from map(b"".join, got)

    def packed(self, text: str) -> bytes:
        return next(self.packed_all([text]))


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut(docs: DataFrame, max_tokens: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, end = word_tokenizer(path), np.array([end_id], "<u4").tobytes()
        for p in parts:
            out = []
            for doc_id, ids in zip(p["doc_id"].astype("Int64"), t.packed_all(p["text"].tolist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    x = ids[at : at + 4 * max_tokens]
                    out.append((doc_id, k, at // 4, len(x) // 4, zlib.crc32(x)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECES)


@dataclass
class Places:
    """For each length: from which rank on, which sequences take how many pieces each, and from which offset."""

    first: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    n_sequences: int


def best_fit(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float] | None = None, rule: str = "dot") -> Places:
    """Packs so many pieces of each length. rule: dot (largest weighted dot product) or norm (least weighted norm left).

    By default a capacity weighs what all pieces together need of it, so that the scarce one decides.
    """
    lengths = np.array(sorted(counts), np.int64)
    left = np.array([counts[x] for x in lengths.tolist()], np.int64)
    cap = np.array(capacity, np.int64)
    need = np.stack([lengths, np.ones_like(lengths), lengths**2], 1)
    if len(lengths) and (need > cap).any():
        raise ValueError("a piece is larger than a sequence")
    share = need / cap
    w = np.array(weights) if weights else left @ share / max(float((left @ share).max(initial=0)), 1e-300)
    rows: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in lengths.tolist()}
    used, n_seq = np.zeros_like(left), 0
    while (alive := np.flatnonzero(left)).size:
        room, taken, avail = cap.copy(), [], left.copy()
        pick = int(alive[-1])  # the longest
        while True:
            k = int(min(avail[pick], (room // need[pick]).min()))
            taken.append((pick, k))
            avail[pick] -= k
            room = room - k * need[pick]
            fits = np.flatnonzero((avail > 0) & (need <= room).all(1))
            if not fits.size:
                break
            if rule == "dot":
                pick = int(fits[np.argmax((share[fits] * (room / cap) * w).sum(1))])
            else:
                pick = int(fits[np.argmin((((room - need[fits]) / cap) ** 2 * w).sum(1))])
        per: dict[int, int] = {}
        for i, k in taken:
            per[i] = per.get(i, 0) + k
        times = int(min(left[i] // k for i, k in per.items()))
        at = 0
        for i, k in per.items():
            x = int(lengths[i])
            rows[x].append((int(used[i]), n_seq, k, at))
            at += k * x
            used[i] += times * k
            left[i] -= times * k
        n_seq += times
    column = lambda j: {x: np.array([r[j] for r in v], np.int64) for x, v in rows.items()}
    return Places(column(0), column(1), column(2), column(3), n_seq)


def pack(docs: DataFrame, max_tokens: int = 2048, max_docs: int | None = None, max_attention: int | None = None, end_id: int = 0, path: str | None = None, rule: str = "dot") -> DataFrame:
    """The pieces of all documents with sequence_id and offset. By default only the tokens bind."""
    spark = docs.sparkSession
    parts = 4 * shuffle_partitions(spark)
    pieces = stored(cut(docs, max_tokens, end_id, path).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")), "pieces")
    sizes = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    places = spark.sparkContext.broadcast(best_fit(counts, (max_tokens, max_tokens if max_docs is None else max_docs, max_tokens**2 if max_attention is None else max_attention), rule=rule))
    before = sizes.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("within", within).join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = places.value
        for p in frames:
            seq, off = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            length, rank = p["length"].to_numpy(), p["rank"].to_numpy()
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    x = int(length[at[0]])
                    r = np.searchsorted(to.first[x], rank[at], "right") - 1
                    n, each = rank[at] - to.first[x][r], to.each[x][r]
                    seq[at], off[at] = to.sequence[x][r] + n // each, to.offset[x][r] + n % each * x
            yield p.drop(columns="rank").astype({"doc_id": "Int64"}).assign(sequence_id=seq, offset=off)

    return ranked.mapInPandas(run, PIECES + ", sequence_id long, offset long")
