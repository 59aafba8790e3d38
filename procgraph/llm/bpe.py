"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a pre-token's bytes there is exactly one token that a valid encoding of that prefix ends with. It is
the token whose removal leaves a prefix with a known last token such that the two tokens never merge across their border.
Storing it for each prefix encodes the pre-token (walk back from the end), lets bytes be appended without looking at what
stands before, and lets an edit be re-encoded from the edited byte on.

Defined results: a null text is an empty one; an empty one has no tokens. Bytes that aren't in the ranks can't occur, as
every single byte is a token. Pre-tokens are encoded one by one, so a long text needs memory in proportion to its length,
and time in proportion to length times the longest token. Repeated rows are encoded one by one; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procgraph.llm.common import utf8

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: A dictionary of pre-tokens is emptied when it has so many, which bounds a worker's memory.
CACHE = 250_000
#: Of longer pre-tokens so many first bytes are looked up together.
HEAD = 6
#: Characters that tables of Unicode of different ages may class differently.
FAR = re.compile("[\u0250-\U0010ffff]")
#: White space that touches white space or an end of the text.
BLANK_RUN = re.compile(r"\s\s|^\s|\s$")


@cache
def unlike() -> dict[int, str]:
    """Characters that the library takes for another class than this module's expressions do, with one of the library's class."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    bytes_only = {bytes([i]): i for i in range(256)}

    def found(pattern: str) -> tuple[set[str], set[str]]:
        library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=bytes_only, special_tokens={})
        return set(library.decode(library.encode_ordinary(every))), set(regex.findall(pattern, every))

    out: dict[int, str] = {}
    for pattern, like in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\xa0")):
        theirs, ours = found(pattern)
        out |= {ord(c): "\x01" for c in ours - theirs if ord(c) not in out} | {ord(c): like for c in theirs - ours}
    return out


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._border: dict[int, bool] = {}
        self._heads: dict[bytes, list[int]] = {}
        self._pieces: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self.lone_blanks = pattern == public_tokenizers.PATTERN
        self.usable = {t: r for t, r in ranks.items() if len(t) == 1 or self.halves(t)}  # what merging can lead to
        ends: dict[bytes, set[int]] = {}
        for t in self.usable:
            ends.setdefault(t[-3:], set()).add(len(t))
        self.tails = {k: tuple(sorted(v | {1, 2}, reverse=True)) for k, v in ends.items()}  # lengths of tokens by their last bytes

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}, pattern)

    def split(self, text: str) -> list[str]:
        """Pre-tokens, with the library's classes of characters."""
        if text.isascii() or not FAR.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(unlike()))]

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the last merge of the token joins; None if merging its bytes doesn't end in the token."""
        if token not in self._halves:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)))
                if best[0] == 1 << 62:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def _spine(self, rank: int, side: int) -> list[tuple[bytes, int, int]]:
        """The symbols that stand at one end of a token while it is merged: bytes, when it forms, when it is used up."""
        known = self._right if side else self._left
        if rank not in known:
            out, token, until = [], self.tokens[rank], 1 << 61
            while True:
                born = self.ranks[token] if len(token) > 1 else -1
                out.append((token, born, until))
                if len(token) == 1:
                    break
                token, until = self.halves(token)[side], born
            known[rank] = out
        return known[rank]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b together leaves just a and b."""
        key = a << 32 | b
        if (said := self._border.get(key)) is None:
            said, get = True, self.ranks.get
            for x, born_x, until_x in self._spine(a, 1):
                for y, born_y, until_y in self._spine(b, 0):
                    m = get(x + y)
                    if m is not None:
                        m = max(m, born_x, born_y)
                        if m < until_x and m <= until_y:
                            said = False
            if len(self._border) > 2 * CACHE:
                self._border.clear()
            self._border[key] = said
        return said

    def extend(self, data: bytes, last: list[int], start: int = 0) -> list[int]:
        """last[i]: the last token of data[:i + 1]. Keeps what is known up to start and fills in the rest."""
        del last[start:]
        get, border, tails, longest = self.usable.get, self._border.get, self.tails.get, self.longest
        for end in range(start + 1, len(data) + 1):
            for length in tails(data[end - 3 : end] if end > 2 else data[:end], (2, 1)):
                begin = end - length
                if begin < 0 or (t := get(data[begin:end])) is None:
                    continue
                if begin:
                    a = last[begin - 1]
                    if (apart := border(a << 32 | t)) is None:
                        apart = self.stay_apart(a, t)
                    if not apart:
                        continue
                last.append(t)
                break
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        last, head = self._heads.get(data[:HEAD]), len(data) > HEAD
        if not head or last is None:
            last = self.extend(data[:HEAD], [])
            if head:
                if len(self._heads) > CACHE:
                    self._heads.clear()
                self._heads[data[:HEAD]] = last
        return self.walk(self.extend(data, list(last), HEAD) if head else last)

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            ids = array("I", self.encode_piece(utf8(piece))).tobytes()
            if len(piece) <= 64:
                if len(self._pieces) > CACHE:
                    self._pieces.clear()
                self._pieces[piece] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        With ``lone_blanks``, a text whose blanks all stand between two other characters is cut before each of them:
        there a pre-token starts in any case. What lies between is looked up as a whole.
        """
        if not self.lone_blanks or BLANK_RUN.search(text):
            return b"".join(map(self._piece, self.split(text)))
        known, out, lead = self._chunks, [], ""
        for chunk in text.split(" "):
            ids = known.get(chunk if lead else None)
            if ids is None:
                ids = b"".join(map(self._piece, self.split(lead + chunk)))
                if lead and len(chunk) <= 24:
                    if len(known) > CACHE:
                        known.clear()
                    known[chunk] = ids
            out.append(ids)
            lead = " "
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


class Encoder:
    """An encoding of one pre-token that can grow and be edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, bytearray(data), []
        vocabulary.extend(data, self.last)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        self.vocabulary.extend(bytes(self.data), self.last, start)

    def splice(self, begin: int, end: int, by: bytes) -> None:
        """Replaces data[begin:end]; prefixes before the edit keep their tokens."""
        self.data[begin:end] = by
        self.vocabulary.extend(bytes(self.data), self.last, begin)

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.last)


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary.from_file(path, pattern)


def encode_column(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array of int) of every text."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path, pattern)
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "ids": [v.encode(t) if isinstance(t, str) else [] for t in p["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, ids array<int>")


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes decoded from them."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path, pattern)
        for p in parts:
            ids = [v.packed(t) if isinstance(t, str) else b"" for t in p["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": p["doc_id"].astype("Int64"),
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(v.decode(x)).hexdigest() for x in ids],
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SCHEMA)
