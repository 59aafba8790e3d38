"""Columns of integers as compressed bytes, and documents in blocks, for operators that work on whole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard

from procgraph.llm.common import utf8

#: Bytes of text that are worked on together; a longer text is a block by itself.
BLOCK = 2 << 20


def enc(x: np.ndarray, delta: bool = False) -> bytes:
    """Integers as bytes: 64 bits each, as differences if asked, by byte planes, compressed."""
    x = np.ascontiguousarray(x).astype(np.int64, copy=False) if x.dtype != np.uint64 else np.ascontiguousarray(x).view(np.int64)
    if delta and len(x):
        x = np.diff(x, prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def dec(b: bytes, delta: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(b)), np.uint8)
    x = np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.int64) if len(raw) else np.zeros(0, np.int64)
    return np.cumsum(x) if delta else x


def dec_all(blobs: list, delta: bool = False) -> np.ndarray:
    return np.concatenate([dec(b, delta) for b in blobs]) if blobs else np.zeros(0, np.int64)


@dataclass
class Block:
    rows: pd.DataFrame
    data: np.ndarray  # bytes of all texts, one after the other
    start: np.ndarray  # where each text begins
    size: np.ndarray


def blocks(frames: Iterator[pd.DataFrame], limit: int = BLOCK) -> Iterator[Block]:
    for p in frames:
        texts, at = p["text"].tolist(), 0
        while at < len(texts):
            part, total = [], 0
            for k in range(at, len(texts)):
                t = texts[k]
                raw = utf8(t)
                if part and total + len(raw) > limit:
                    break
                part.append(raw)
                total += len(raw)
            size = np.array([len(t) for t in part], np.int64)
            yield Block(p.iloc[at : at + len(part)], np.frombuffer(b"".join(part), np.uint8), np.cumsum(size) - size, size)
            at += len(part)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then the next."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - count), count)
