"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into parts; part i gets a threshold t_i, with the t_i adding up to the radius less the number of
parts but one (a part with -1 is left out). Two fingerprints within the radius are then within t_i in at least one part i.
Bits that go together are put in one part, as such a part tells less when it is small; how many parts there are and which
thresholds they get is found by dynamic programming on the candidates that a sample of fingerprints leads to expect. For
each part a fingerprint is filed under its bits there and probed under all values within t_i; what meets is verified on
all 64 bits. Values that very many fingerprints share are refined by the pigeonhole principle on the bits outside the
part, so that no group is compared in one task.

Only distinct fingerprints are compared. From each group comes a spanning forest of its verified links, not all pairs; this
keeps components as they are. Components are then found by propagating the smallest id and contracting, in rounds.

Defined results: a null text is an empty one; texts without words have fingerprint zero, and it links like any other. Null
ids: the row keeps its fingerprint and its component is the smallest id of it that isn't null. Repeated rows give one result
each. Other columns of the input aren't read. keep_one keeps one row of each component: the smallest id, null ids last, then
the smallest digest of the text; of repeated rows one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procgraph.llm.common import stored, utf8

#: Fingerprints under one key beyond which the key is refined.
HEAVY = 2000


def fingerprint(text: object, width: int = 3, seed: int = 42) -> int:
    words = utf8(text).lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b" ".join(words[i : i + width]), seed) for i in range(n)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, digest (of the text), fp: the fingerprint as a signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            fp = np.array([fingerprint(t, width) for t in p["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "digest": p["digest"], "fp": fp})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text").mapInPandas(run, "doc_id long, digest long, fp long")


@dataclass(frozen=True)
class Plan:
    """parts: bit positions of each part; limits: their thresholds."""

    parts: tuple[tuple[int, ...], ...]
    limits: tuple[int, ...]


def bits_of(fps: np.ndarray) -> np.ndarray:
    return (fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """64 positions in m groups of like size; a group grows by the bit that goes most with those in it."""
    c = np.zeros((64, 64))
    if len(bits) > 1:
        x = bits.astype(float) - bits.mean(0)
        sd = np.sqrt((x * x).sum(0))
        c = np.abs(x.T @ x) / np.maximum(np.outer(sd, sd), 1e-9)
    left, out = list(range(64)), []
    for g in range(m):
        size = len(left) // (m - g)
        own = [left.pop(0)]
        while len(own) < size:
            best = max(left, key=lambda b: (c[b, own].sum(), -b))
            left.remove(best)
            own.append(best)
        out.append(sorted(own))
    return out


def plan(sample: np.ndarray, n: int, radius: int = 3, filed: float = 4.0, met: float = 0.02) -> Plan:
    """The partition and thresholds of least cost: filed for each key written, met for each candidate compared."""
    bits = bits_of(sample)
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, max(len(sample), 1), 200_000) for _ in range(2))
    differ = sample[a] ^ sample[b] if len(sample) > 1 else np.zeros(0, np.uint64)
    differ = differ[differ != 0]  # only distinct fingerprints are compared
    best: tuple[float, Plan] | None = None
    for m in range(1, radius + 2):
        parts = group_bits(bits, m)
        cost = []
        for p in parts:
            away = bits_of(differ)[:, p].sum(1) if len(differ) else np.zeros(0)
            row = {-1: 0.0}
            for t in range(radius + 1):
                chance = max((away <= t).mean() if len(away) else 0.0, sum(comb(len(p), i) for i in range(t + 1)) / 2.0 ** len(p))
                keys = 1.0 if t == 0 else 1.0 + sum(comb(len(p), i) for i in range(t + 1))
                row[t] = filed * n * keys + met * chance * n * n / 2
            cost.append(row)
        total = radius - m + 1
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}  # by the sum of thresholds so far
        for row in cost:
            fresh: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, ts) in table.items():
                for t, x in row.items():
                    if s + t not in fresh or c + x < fresh[s + t][0]:
                        fresh[s + t] = (c + x, (*ts, t))
            table = fresh
        if total in table and (best is None or table[total][0] < best[0]):
            best = (table[total][0], Plan(tuple(map(tuple, parts)), table[total][1]))
    return best[1]


def keys_of(fps: np.ndarray, part: tuple[int, ...]) -> np.ndarray:
    """The bits of a part, where they stand."""
    mask = np.uint64(sum(1 << b for b in part))
    return fps & mask


def variants(part: tuple[int, ...], limit: int) -> np.ndarray:
    """What to flip to reach all values of a part within the limit, the value itself first."""
    flips = [0]
    for k in range(1, limit + 1):
        flips += [sum(1 << b for b in c) for c in combinations(part, k)]
    return np.array(flips, np.uint64)


def forest(fps: np.ndarray, probe: np.ndarray, filed: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between fps[i], i in probe, and fps[j], j in filed, within the radius, less those that close a circle."""
    label, out = np.arange(len(fps)), []
    step = max(1, (1 << 20) // max(len(filed), 1))
    for at in range(0, len(probe), step):
        rows = probe[at : at + step]
        near = np.bitwise_count(fps[rows][:, None] ^ fps[filed][None]) <= radius
        for i, hit in zip(rows, near, strict=True):
            js = filed[hit]
            js = js[label[js] != label[i]]
            while js.size:  # as often as trees meet
                j = js[0]
                out.append((int(i), int(j)))
                label[label == label[j]] = label[i]
                js = js[label[js] != label[i]]
    return out


def links(distinct: DataFrame, p: Plan, radius: int = 3) -> DataFrame:
    """a, b: fingerprints (signed long) that are linked; their transitive closure is that of all links."""
    subs = [tuple(map(tuple, np.array_split(np.array([b for b in range(64) if b not in part]), radius + 1))) for part in p.parts]

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy().view(np.uint64)
            for i, (part, limit) in enumerate(zip(p.parts, p.limits, strict=True)):
                if limit < 0:
                    continue
                for k, flip in enumerate(variants(part, limit)):
                    # kind 0: filed and, where only equal values meet, probing as well; kind 1: probing only
                    kinds = [0] if limit == 0 else [0, 1] if k == 0 else [1]
                    for kind in kinds:
                        yield pd.DataFrame({"part": i, "key": (keys_of(fp, part) ^ flip).view(np.int64), "kind": kind, "fp": f["fp"]})

    filed = distinct.mapInPandas(file, "part int, key long, kind int, fp long")
    heavy = filed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY).select("part", "key", F.lit(True).alias("heavy"))

    def refine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Under a heavy key, two within the radius agree in one of radius + 1 groups of the bits outside the part, too."""
        for f in frames:
            part, fp, heavy_rows = f["part"].to_numpy(), f["fp"].to_numpy().view(np.uint64), f["heavy"].to_numpy(dtype=bool)
            plain = f[~heavy_rows]
            yield plain[["part", "key", "kind", "fp"]].assign(sub=-1, rest=0)
            for i in np.unique(part[heavy_rows]):
                at = heavy_rows & (part == i)
                for s, group in enumerate(subs[i]):
                    yield f.loc[at, ["part", "key", "kind", "fp"]].assign(sub=s, rest=keys_of(fp[at], group).view(np.int64))

    cols = "part int, key long, kind int, fp long, sub int, rest long"
    keyed = filed.join(heavy, ["part", "key"], "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))).mapInPandas(refine, cols)
    where = ["part", "key", "sub", "rest"]

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; a group may go on in the next frame."""
        rest = None

        def pairs(g: pd.DataFrame) -> list[tuple[int, int]]:
            fp, kind = g["fp"].to_numpy().view(np.uint64), g["kind"].to_numpy()
            store = np.flatnonzero(kind == 0)
            ask = np.flatnonzero(kind == 1) if (kind == 1).any() else store
            uniq, to = np.unique(fp, return_inverse=True)
            return [(int(uniq[a].view(np.int64)), int(uniq[b].view(np.int64))) for a, b in forest(uniq, np.unique(to[ask]), np.unique(to[store]), radius)]

        def run(f: pd.DataFrame) -> pd.DataFrame:
            k = f[where].to_numpy()
            edge = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            bounds, out = [0, *edge.tolist(), len(f)], []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo > 1:
                    out += pairs(f.iloc[lo:hi])
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            k = f[where].to_numpy()
            last = int(np.flatnonzero((k != k[-1]).any(1)).max(initial=-1)) + 1
            rest = f.iloc[last:]
            if last:
                yield run(f.iloc[:last])
        if rest is not None and len(rest):
            yield run(rest)

    several = keyed.repartition(*where).sortWithinPartitions(*where)
    return several.mapInPandas(verify, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: for every node of an edge, the smallest node that it is linked with over any number of edges.

    Each round links every node and its neighbours to the smallest of them (large star, then small star), which keeps
    components; it ends when nothing changes. Links to a centre combine on the map side.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    for _ in range(most_rounds):
        now = stored(now, "links")
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if sign == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = sign
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def planned(distinct: DataFrame, radius: int, sample_rows: int = 4096) -> Plan:
    """plan() for distinct fingerprints fp, by a bounded sample of them."""
    n = distinct.count()
    share = min(1.0, 1.2 * sample_rows / max(n, 1))
    sample = [r["fp"] for r in distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < share * (1 << 20)).limit(sample_rows).collect()]  # only to estimate
    return plan(np.array(sorted(sample), np.int64).view(np.uint64), n, radius)


def rooted(docs: DataFrame, radius: int = 3, width: int = 3, sample_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """fingerprints() of docs; and fp, least_id, root (the fingerprint that names the component) of each fingerprint."""
    prints = stored(fingerprints(docs, width), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    member = components(links(distinct.select("fp"), planned(distinct, radius, sample_rows), radius))
    return prints, distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row of docs."""
    prints, roots = rooted(docs, **how)
    least = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_row(docs: DataFrame, member: DataFrame) -> DataFrame:
    """One row of docs for each component. member: doc_id, digest (xxhash64 of the text), component, for every row of docs.

    Of a component stays the smallest id, null ids last, then the smallest digest; of rows equal in both one, by a digest
    of the row.
    """
    many = member.groupBy("component", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("digest").alias("digest"), F.col("n").alias("n"))
    stay = many.groupBy("component").agg(F.min(key).alias("k")).select(F.col("k.id").alias("_pg_id"), F.col("k.digest").alias("_pg_digest"), F.col("k.n").alias("_pg_n"))
    kept = docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("_pg_id")) & (F.xxhash64("text") == F.col("_pg_digest")))
    nth = F.row_number().over(Window.partitionBy("_pg_id", "_pg_digest").orderBy(F.xxhash64(*docs.columns)))
    repeated = kept.where("_pg_n > 1").withColumn("_pg_nth", nth).where("_pg_nth = 1")  # only these are shuffled again
    return kept.where("_pg_n = 1").select(*docs.columns).union(repeated.select(*docs.columns))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with its columns, that stand for their component: one of each, as in one_row()."""
    prints, roots = rooted(docs.select("doc_id", "text"), **how)
    return one_row(docs, prints.join(roots, "fp").select("doc_id", "digest", F.col("root").alias("component")))
