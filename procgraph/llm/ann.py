"""Nearest neighbours by an inverted file with product-quantised residuals, and bounds that make it exact.

Coarse centroids split the vectors into lists; what a vector differs from its centroid by is product-quantised. A query
first scans the lists whose centroids are nearest: asymmetric distance tables rank their members, the ``depth`` best of
each cell are scored exactly, in double precision on the original vectors, and what the error of its code leaves a chance
against them is scored, too. Of the other lists only those follow whose centroid and radius leave a chance to beat the k
nearest so far, so none is lost, whatever the rows are like. Vectors travel with their codes and are scored where they lie;
of a query a cell gives at most k + 1 rows.

Centroids and codebooks are fitted on at most ``sample_rows`` vectors, those with the lowest hashes; every vector is
indexed. How many lists are scanned first and how deep is ranked is set from the same sample; that changes the work only.
The less structure the vectors have, the fewer lists the bounds leave out: rows without any are scanned as a whole, by
tables, and the work then grows with queries times vectors. Equal vectors are one vector with the smallest of its ids, and
queries that are equal are asked once. Small lists share a cell of about ``block`` vectors, a list of many members is split
into several, so that a hot list is no hot task.

Nearness is the largest inner product; ties go to the smaller id. Defined results: vectors that are null, zero, or hold
null or non-finite components take no part, nor do those of another dimension than most, nor null ids. A row that is repeated
with id and vector counts once, as query and as candidate. Rows that share an id only are queries and candidates of their
own, so such an id has several lists of ranks, and may be found several times. A query never finds its own id. With fewer candidates than k all are returned; an empty
table gives no rows. Other columns of the input, whatever their names, aren't read; there are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.llm.blobs import ranges
from procgraph.llm.common import ship, stored


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = n > 0
        c[full] = total[full] / n[full, None]
        if (empty := np.flatnonzero(~full)).size:
            c[empty] = x[rng.choice(len(x), empty.size)]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


@dataclass
class Index:
    centroids: np.ndarray  # lists by dimensions
    books: np.ndarray  # parts by words by dimensions of a part
    probes: int
    depth: int

    def split(self, x: np.ndarray) -> np.ndarray:
        m, _, d = self.books.shape
        return np.pad(x, ((0, 0), (0, m * d - x.shape[1]))).reshape(len(x), m, d)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(x, self.centroids)
        parts = self.split(x - self.centroids[lists])
        return lists, np.stack([nearest(parts[:, j], self.books[j]) for j in range(len(self.books))], 1).astype(np.uint8)

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far vectors are from their centroids, and from what their codes stand for."""
        away = x - self.centroids[lists]
        left = self.split(away) - np.stack([b[codes[:, j]] for j, b in enumerate(self.books)], 1)
        return np.linalg.norm(away, axis=1), np.sqrt((left * left).sum((1, 2)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Queries by parts by words: inner products of a query's part with the words."""
        return np.matmul(self.split(q).transpose(1, 0, 2), self.books.transpose(0, 2, 1)).transpose(1, 0, 2)

    def estimate(self, q: np.ndarray, tables: np.ndarray, codes: np.ndarray, at: int) -> np.ndarray:
        """Asymmetric inner products of queries, by their tables, with the members of one list."""
        out = np.repeat((q @ self.centroids[at])[:, None], len(codes), 1)
        for j in range(codes.shape[1]):
            out += tables[:, j, codes[:, j]]
        return out


def fit(x: np.ndarray, n: int, k: int, target: float, parts: int = 32, words: int = 256, seed: int = 5) -> Index:
    rng = np.random.default_rng(seed)
    lists = max(1, int(min(np.sqrt(n), 1024, len(x) // 16)))
    c = kmeans(x, lists, 10, rng)
    d = -(-x.shape[1] // parts)
    ix = Index(c, np.zeros((-(-x.shape[1] // d), 1, d)), lists, 1)
    cut = ix.split(x - c[nearest(x, c)])
    ix.books = np.stack([np.pad(b := kmeans(cut[:, j], words, 8, rng), ((0, words - len(b)), (0, 0)), mode="edge") for j in range(cut.shape[1])])
    some = rng.choice(len(x), min(256, len(x)), replace=False)
    lists_of, codes = ix.encode(x)
    tables = ix.tables(x[some])
    exact = x[some] @ x.T
    guess = np.empty_like(exact)
    for at in np.unique(lists_of):
        guess[:, lists_of == at] = ix.estimate(x[some], tables, codes[lists_of == at], at)
    exact[np.arange(len(some)), some] = guess[np.arange(len(some)), some] = -np.inf
    like = int(np.ceil(k * min(1.0, len(x) / n)))  # so many of the sample are as near as the k nearest of all
    best = np.argsort(-exact, 1, kind="stable")[:, : min(like, max(len(x) - 1, 1))]
    place = np.argsort(np.argsort(-(x[some] @ c.T), 1, kind="stable"), 1)
    probe = np.take_along_axis(place, lists_of[best], 1)
    deep = np.take_along_axis(np.argsort(np.argsort(-guess, 1, kind="stable"), 1), best, 1)
    slack = 1 - target  # a quarter of it for what reranking misses
    ix.probes = min(len(c), int(np.quantile(probe, 1 - 0.75 * slack, method="higher")) + 1)
    ix.depth = int(k * max(4, np.ceil((np.quantile(deep, 1 - 0.25 * slack, method="higher") + 1) / like)))
    return ix


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x (array of double): the vectors that take part, before the dimension counts."""
    x = F.col("x")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & x.isNotNull() & good)


def cells(size: np.ndarray, block: int) -> list[list[int]]:
    """For each list the cells that hold its members: one that it shares with others, or several of its own."""
    out, n, filled = [], 0, block
    for members in size.tolist():
        if members > block:
            own = -(-members // block)
            out.append(list(range(n, n + own)))
            n, filled = n + own, block
        else:
            if filled + members > block:
                n, filled = n + 1, 0
            filled += members
            out.append([n - 1])
    return out


#: No id: of a query that any id may answer, and of a vector without a second id. Ids are compared with it only.
NONE = -(1 << 63)


@dataclass
class Members:
    """The vectors of a cell, by lists."""

    lists: np.ndarray  # those in the cell, and where their members begin and end
    begin: np.ndarray
    end: np.ndarray
    codes: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    err: np.ndarray
    ids: np.ndarray  # of all vectors, one after the other; at and size tell whose
    at: np.ndarray
    size: np.ndarray
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def of(cls, m: pd.DataFrame) -> Members:
        m = m.assign(first=[i[0] for i in m["ids"]]).sort_values(["list", "first"], kind="stable")
        lists, begin = np.unique(m["list"].to_numpy(), return_index=True)
        size, x = np.array([len(i) for i in m["ids"]], np.int64), np.stack(m["x"].to_numpy())
        second = np.array([i[1] if len(i) > 1 else NONE for i in m["ids"]], np.int64)
        codes = np.frombuffer(b"".join(map(bytes, m["codes"])), np.uint8).reshape(len(m), -1)
        return cls(lists, begin, np.append(begin[1:], len(m)), codes, x, np.linalg.norm(x, axis=1), m["err"].to_numpy(), np.concatenate(list(m["ids"])), np.cumsum(size) - size, size, m["first"].to_numpy(), second)


def products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Inner products of q[i] and x[j], summed from the first component to the last, so that they are the same in any batch."""
    out = np.zeros(len(i))
    for at in range(0, len(i), step):
        a, b, total = q[i[at : at + step]], x[j[at : at + step]], out[at : at + step]
        for c in range(x.shape[1]):
            total += a[:, c] * b[:, c]
    return out


def best_of(i: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among the best of their query i, ties to the smaller id; sorted by query and rank."""
    by = np.lexsort((ids, -score, i))
    q = i[by]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q
    return by[np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < most]


def scan(ix: Index, qx: np.ndarray, own: np.ndarray, floor: np.ndarray, probes: np.ndarray, m: Members, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and score of the rows of a cell that may be among the best of a query: all that reach its floor, at most so many."""
    tables, norm = ix.tables(qx), np.linalg.norm(qx, axis=1)
    guess = np.full((len(qx), len(m.x)), -np.inf)
    for j, (lo, hi) in enumerate(zip(m.begin, m.end, strict=True)):
        who = np.flatnonzero(probes[:, j])
        if who.size:
            est = ix.estimate(qx[who], tables[who], m.codes[lo:hi], int(m.lists[j]))
            first = np.where(m.first[None, lo:hi] == own[who, None], m.second[None, lo:hi], m.first[None, lo:hi])
            guess[who, lo:hi] = np.where(first == NONE, -np.inf, np.where(np.isnan(est), np.inf, est))
    depth = min(max(ix.depth, most), len(m.x))
    top = np.argpartition(-guess, depth - 1, 1)[:, :depth]
    i, x = np.repeat(np.arange(len(qx)), depth), top.reshape(-1)
    seen = guess[i, x] > -np.inf
    i, x = i[seen], x[seen]
    score = products(qx, m.x, i, x)
    if depth >= most:  # the last of the best so far, where there are so many
        so_far = np.full((len(qx), depth), -np.inf)
        so_far.reshape(-1)[seen] = score
        floor = np.maximum(floor, -np.partition(-so_far, most - 1, 1)[:, most - 1])
    slack = norm[:, None] * (m.err * (1 + 1e-9) + 1e-9 * m.norm)[None]
    left = (guess > -np.inf) & ~(guess + slack < floor[:, None])
    left[i, x] = False
    more_i, more_x = np.nonzero(left)
    i, x, score = np.append(i, more_i), np.append(x, more_x), np.append(score, products(qx, m.x, more_i, more_x))
    reach = ~(score < floor[i])
    i, x, score = i[reach], x[reach], score[reach]
    few = best_of(i, np.where(m.first[x] == own[i], m.second[x], m.first[x]), score, most)  # later vectors have no row among the best
    i, x, score = i[few], x[few], score[few]
    n = m.size[x]
    i, score, ids = np.repeat(i, n), np.repeat(score, n), m.ids[ranges(m.at[x], n)]
    i, score, ids = (v[ids != own[i]] for v in (i, score, ids))
    few = best_of(i, ids, score, most)
    return i[few], ids[few], score[few]


def search(vectors: DataFrame, k: int = 20, query_every: int = 20, sample_rows: int = 8192, target: float = 0.96, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of every vector whose id is divisible by query_every."""
    spark = vectors.sparkSession
    ship(spark)
    out = "query_id long, rank int, vec_id long, score double"
    found = usable(vectors, id_col, vector_col)
    dims = found.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out)
    dim = int(dims[0]["d"])
    rows = stored(found.where(F.size("x") == dim).distinct(), "rows")
    most = k + 1  # a query may be among its own nearest, and goes at the end
    nth = F.row_number().over(W.partitionBy("x").orderBy("id"))
    found = rows.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    found = stored(found.withColumn("dig", F.xxhash64("x")), "vectors")
    some = found.orderBy("dig", F.element_at("ids", 1)).limit(sample_rows).collect()  # a bounded sample, the same however rows are dealt out
    n = found.count()
    sample = np.array([r["x"] for r in sorted(some, key=lambda r: (r["ids"][0], r["x"]))])
    model = spark.sparkContext.broadcast(fit(sample, n, k, target))  # at most 1024 centroids and 256 words a part

    def indexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            if len(p):
                x = np.stack(p["x"].to_numpy())
                lists, codes = model.value.encode(x)
                away, err = model.value.errors(x, lists, codes)
                yield pd.DataFrame({"list": lists, "ids": p["ids"], "x": p["x"], "codes": [c.tobytes() for c in codes], "away": away, "err": err})

    members = stored(found.mapInPandas(indexed, "list int, ids array<long>, x array<double>, codes binary, away double, err double"), "members")
    lists = {r["list"]: r for r in members.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()}  # as many as there are lists
    size, radius = (np.array([lists[i][c] if i in lists else 0 for i in range(len(model.value.centroids))]) for c in ("n", "r"))
    places = cells(size, block)
    where = F.get(F.array(*[F.array(*[F.lit(c) for c in own]) for own in places]), F.col("list"))
    members = members.withColumn("cell", F.get(where, F.pmod(F.xxhash64("x"), F.size(where)).cast("int")))

    wanted = rows.where(F.col("id") % query_every == 0)
    again = wanted.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.col("id").alias("own"))  # their other rows don't count
    wanted = wanted.join(again, "id", "left").withColumn("own", F.coalesce("own", F.lit(NONE))).withColumn("qdig", F.xxhash64("x", "own"))
    wanted = stored(wanted, "wanted")

    def starting(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The lists that a query scans first: the nearest that hold k candidates, and up to several times depth together."""
        for p in frames:
            if len(p):
                order = np.argsort(-(np.stack(p["q"].to_numpy()) @ model.value.centroids.T), 1, kind="stable")
                upto = np.cumsum(size[order], 1)
                few, deep = ((upto <= m).sum(1) + 1 for m in (most, min(10 * model.value.depth, block)))
                upto = np.minimum(deep, np.maximum(model.value.probes, few))
                yield p.assign(early=pd.Series([o[:u][size[o[:u]] > 0].tolist() for o, u in zip(order, upto, strict=True)], p.index, object))

    queries = wanted.groupBy("qdig", "own", F.col("x").alias("q")).agg(F.min("id").alias("qid")).select("qid", "qdig", "own", "q")
    queries = stored(queries.mapInPandas(starting, "qid long, qdig long, own long, q array<double>, early array<int>"), "queries")
    cols = "cell int, qid long, qdig long, own long, q array<double>, floor double, lists array<int>"

    def by_cells(p: pd.DataFrame, lists: list[np.ndarray]) -> pd.DataFrame:
        ask = []
        for i, own in enumerate(lists):
            by_cell: dict[int, list[int]] = {}
            for at in own.tolist():
                for c in places[at]:
                    by_cell.setdefault(c, []).append(at)
            ask += [(c, i, ls) for c, ls in by_cell.items()]
        i = [a[1] for a in ask]
        return pd.DataFrame({"cell": [a[0] for a in ask], **{c: p[c].to_numpy()[i] for c in ("qid", "qdig", "own", "q", "floor")}, "lists": pd.Series([a[2] for a in ask], dtype=object)})

    def first_asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            yield by_cells(p, list(p["early"]))

    def then_asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The lists that a query hasn't scanned, and that the bound by centroid and radius doesn't exclude."""
        c = model.value.centroids
        reach = radius * (1 + 1e-9) + 1e-9 * np.linalg.norm(c, axis=1)
        for p in frames:
            if not len(p):
                continue
            q = np.stack(p["q"].to_numpy())
            ask = (size > 0)[None] & ~(q @ c.T + np.linalg.norm(q, axis=1)[:, None] * reach[None] < p["floor"].to_numpy()[:, None])
            for i, early in enumerate(p["early"]):
                ask[i, early] = False
            yield by_cells(p, [np.flatnonzero(a) for a in ask])

    def near(key: tuple, q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        got = [pd.DataFrame({**{c: np.zeros(0, np.int64) for c in ("qid", "qdig", "id")}, "score": np.zeros(0)})]
        if len(q) and len(m):
            mine, q = Members.of(m), q.sort_values(["qid", "qdig"], kind="stable")
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                probes = np.stack([np.isin(mine.lists, ls) for ls in part["lists"]])
                i, ids, score = scan(model.value, np.stack(part["q"].to_numpy()), part["own"].to_numpy(), part["floor"].to_numpy(), probes, mine, most)
                got.append(pd.DataFrame({"qid": part["qid"].to_numpy()[i], "qdig": part["qdig"].to_numpy()[i], "id": ids, "score": score}))
        return pd.concat(got)

    def scanned(asked: DataFrame) -> DataFrame:
        return asked.groupBy("cell").cogroup(members.groupBy("cell")).applyInPandas(near, "qid long, qdig long, id long, score double")

    def top(hits: DataFrame) -> DataFrame:
        best = F.row_number().over(W.partitionBy("qid", "qdig").orderBy(F.desc("score"), "id"))
        return hits.withColumn("n", best).where(F.col("n") <= most)

    low = F.lit(float("-inf"))
    early = stored(top(scanned(queries.withColumn("floor", low).mapInPandas(first_asked, cols))), "nearest")
    floor = early.where(F.col("n") == most).select("qid", "qdig", F.col("score").alias("floor"))
    late = queries.join(floor, ["qid", "qdig"], "left").withColumn("floor", F.coalesce("floor", low)).mapInPandas(then_asked, cols)
    hits = top(early.drop("n").unionByName(scanned(late)))
    hits = hits.groupBy("qid", "qdig").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("hits"))
    asked = queries.select("qid", "qdig", "own", F.col("q").alias("x"))
    answered = wanted.join(asked, ["qdig", "own", "x"]).select(F.col("id").alias("query_id"), "qid", "qdig").join(hits, ["qid", "qdig"])
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    answered = answered.select("query_id", F.posexplode(others).alias("rank", "h"))
    return answered.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("h.id").alias("vec_id"), F.col("h.score").alias("score"))
