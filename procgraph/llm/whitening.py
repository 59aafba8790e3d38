"""Whitening of embeddings from an exact scatter matrix, by bit-sliced counting.

Entries become integers ``x = floor(scale * c) + shift``. The covariance is fitted on each distinct x vector once. Its cross
products are exact: every dimension, less its smallest value, is cut into bit planes, a plane of 64 vectors is one word, and
the product of two dimensions is the sum over pairs of planes of ``2**(a + b)`` times the number of set bits that both have
in common. The products are centred as integers, ``n * sum(x y) - sum(x) * sum(y)``, before they become doubles for eigh.

Passes: the commonest dimension and the range of each entry (no shuffle of vectors), the distinct vectors (written, so what
follows survives lost executors), their scatter (tasks send one row a pair of dimensions), the check of the result, and the
rows themselves, which aren't shuffled. Copies are combined before the shuffle. The driver gets ``d * d`` numbers.

Defined results: vectors that are null, empty, or hold null or non-finite entries take no part, nor do those with an entry
of 2**56 or more (it has no 64-bit form) or of another length than most (the shorter one, if equally many). Repeated rows
and repeated or null ids give one set of rows each. Components whose variance is below 1e-10 of the largest aren't returned,
as they hold rounding only; so one distinct vector, or none, gives no rows. ``deviation`` is null where it doesn't fit into
64 bits, which is so for some hundred million vectors; ``deviation_exact`` has it in any case up to 38 digits. Other columns,
whatever their names, aren't read; there are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procgraph.llm.common import dropped, stored

LIMBS, LIMB = 6, 32
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id and x (array of long) of the vectors that take part, before their length counts."""
    v = F.col("v")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 56)))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) > 0) & good)
    return rows.select("vec_id", F.transform(v, lambda c: F.floor(c * scale).cast("long") + F.lit(shift).cast("long")).alias("x"))


def matrix(b: pa.RecordBatch, d: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Dimensions by bits by words: the bit planes of the columns, 64 rows a word."""
    rows, d = y.shape
    out = np.zeros((d, bits, -(-rows // 64) * 8), np.uint8)
    at = np.arange(bits, dtype=np.uint64)[:, None]
    for i in range(d):
        bit = ((y[:, i].astype(np.uint64)[None] >> at) & np.uint64(1)).astype(np.uint8)
        out[i, :, : -(-rows // 8)] = np.packbits(bit, axis=1)
    return out.view(np.uint64)


def scatter(y: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of products (upper triangle) and sums of the columns of y, as Python integers."""
    p, d = planes(y, bits), y.shape[1]
    wide = 2 * bits + len(y).bit_length() > 62
    kind = object if wide else np.int64
    weight = np.array([1 << a for a in range(bits)], kind)
    products = np.zeros((d, d), kind)
    for i in range(d):
        for a in range(bits):
            if p[i, a].any():
                both = np.bitwise_count(p[i:] & p[i, a]).sum(-1, dtype=np.int64).astype(kind)
                products[i, i:] += (both * weight).sum(1) * (1 << a)
    sums = (np.bitwise_count(p).sum(-1, dtype=np.int64).astype(kind) * weight).sum(1)
    return products.astype(object), sums.astype(object)


def limbs(v: int) -> list[int]:
    return [(v >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS)]


@dataclass
class Model:
    n: int
    low: np.ndarray  # the smallest value of each dimension
    total: list[int]  # sums over the fit list, less low
    axes: np.ndarray  # dimensions by components, over the root of the variance
    explained: np.ndarray
    bits: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as 64-bit integers, or as Python's where they don't fit."""
        y = x - self.low
        if self.bits + self.n.bit_length() < 62:
            return y * self.n - np.array(self.total, np.int64)
        return y.astype(object) * self.n - np.array(self.total, object)

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (z / self.n).astype(np.float64) @ self.axes

    def deviation(self, z: np.ndarray) -> list[int] | np.ndarray:
        if 2 * (self.bits + self.n.bit_length()) + z.shape[1].bit_length() < 63:
            return (z * z).sum(1)
        z = z.astype(object)
        return (z * z).sum(1).tolist()


def fitted(products: dict[tuple[int, int], int], sums: list[int], n: int, low: np.ndarray, bits: int, components: int) -> Model:
    d = len(sums)
    cov, trace = np.zeros((d, d)), 0
    for i in range(d):
        for j in range(i, d):
            m = n * products.get((i, j), 0) - sums[i] * sums[j]
            cov[i, j] = cov[j, i] = m / (n * n)  # integers divide with one rounding
            trace += m if i == j else 0
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    keep = [k for k in range(min(components, d)) if value[k] > 0 and value[k] > 1e-10 * value[0]]
    value, vector = value[keep], vector[:, keep]
    sign = np.sign(vector[np.abs(vector).argmax(0), np.arange(len(keep))]) if keep else 1.0
    return Model(n, low, sums, vector * sign / np.sqrt(value), value / (trace / (n * n)) if keep else value, bits)


def whiten(vectors: DataFrame, components: int = 16, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each vector that takes part and each component: vec_id and the columns of OUT."""
    spark = vectors.sparkSession
    found = integers(vectors, id_col, vector_col)
    schema = f"vec_id {dict(found.dtypes)['vec_id']}, {OUT}"
    most = found.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not most:
        return spark.createDataFrame([], schema)
    d = int(most[0]["d"])
    found = found.where(F.size("x") == d)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                x = matrix(b, d)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(low), pa.array(high)], ["i", "low", "high"])

    ends = found.select("x").mapInArrow(reach, "i int, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    low = np.array([r["low"] for r in ends], np.int64)
    bits = max(1, max(r["high"] - r["low"] for r in ends).bit_length())
    fit_list = stored(found.select("x").distinct(), "whitening")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, products, sums = 0, np.zeros((d, d), object), np.zeros(d, object)
        for b in batches:
            y = matrix(b, d) - low
            for at in range(0, len(y), block):
                p, s = scatter(y[at : at + block], bits)
                products += p
                sums += s
            n += len(y)
        if n:
            rows = [(i, j, *limbs(products[i, j])) for i in range(d) for j in range(i, d)] + [(i, -1, *limbs(s)) for i, s in enumerate(sums)] + [(-1, -1, *limbs(n))]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols[:2]] + [pa.array(c, pa.int64()) for c in cols[2:]], ["i", "j", *(f"l{k}" for k in range(LIMBS))])

    names = [f"l{k}" for k in range(LIMBS)]
    parts = fit_list.mapInArrow(sliced, "i int, j int, " + ", ".join(f"{c} long" for c in names))
    sums = {(r["i"], r["j"]): sum(r[c] << (LIMB * k) for k, c in enumerate(names)) for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    n = sums[-1, -1]
    fit = fitted(sums, [sums[i, -1] for i in range(d)], n, low, bits, components)
    k = fit.axes.shape[1]
    if not k:
        dropped(fit_list)
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(fit)  # d by at most `components` numbers

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, some = np.zeros((k, k)), np.zeros(k), False
        for b in batches:
            w = model.value.whitened(model.value.centred(matrix(b, d)))
            total, first, some = total + w.T @ w, first + w.sum(0), some or len(w) > 0
        if some:
            rows = [(i, j, total[i, j]) for i in range(k) for j in range(k)] + [(i, -1, first[i]) for i in range(k)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2])], ["i", "j", "v"])

    got = {(r["i"], r["j"]): r["v"] / n for r in fit_list.mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    error = max(abs(got[i, j] - got[i, -1] * got[j, -1] - (i == j)) for i in range(k) for j in range(k))
    dropped(fit_list)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                z = model.value.centred(matrix(b, d))
                w, far, m = model.value.whitened(z), model.value.deviation(z), b.num_rows
                if isinstance(far, np.ndarray):
                    plain = pa.array(far)
                    exact = plain.cast(pa.decimal128(38, 0))
                else:
                    plain = pa.array([v if v < 1 << 63 else None for v in far], pa.int64())
                    exact = pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(m), k))
                cols = [b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), plain.take(each), pa.array(w.reshape(-1)), pa.array(np.tile(model.value.explained, m)), pa.array(np.full(m * k, error)), exact.take(each)]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return found.mapInArrow(rows, schema)
