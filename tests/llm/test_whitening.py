"""Whitening against whole-number covariance by brute force."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from procgraph.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, components=16):
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in enumerate(rows)}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    cov = np.array([[float(Fraction(sum(n * v[i] * v[j] for v in fit) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    z = {i: [n * v[j] - s[j] for j in range(d)] for i, v in x.items()}
    return n, {i: sum(c * c for c in v) for i, v in z.items()}, {i: np.abs(np.array(v) / n @ u / np.sqrt(e)) for i, v in z.items()}, e / np.trace(cov)


def check(got, rows, components):
    n, deviation, white, explained = brute(rows, components)
    assert len(got) == len(rows) * components
    for r in got:
        i, k = r["vec_id"], r["component"] - 1
        assert r["n"] == n and int(r["deviation_exact"]) == deviation[i] and r["deviation"] == (deviation[i] if deviation[i] < 1 << 63 else None)
        assert abs(abs(r["whitened"]) - white[i][k]) < 1e-8 * max(1, white[i][k]) and abs(r["explained"] - explained[k]) < 1e-9 and r["identity_error"] < 1e-4


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(300, 7)) * [1, 2, 3, 5, 8, 13, 21]).tolist()
    rows += rows[:100]  # a third of all rows occur twice
    df = spark.createDataFrame(list(enumerate(rows)), SCHEMA).withColumns({c: F.lit("q") for c in ("x", "v", "n", "component", "d")})
    for parts in (1, 5):
        check(whitening.whiten(df.repartition(parts), components=5).collect(), rows, 5)


def test_wide_values(spark):
    rng = np.random.default_rng(4)
    rows = (rng.normal(size=(90, 3)) * [1e3, 1e9, 1e12]).tolist()
    got = whitening.whiten(spark.createDataFrame(list(enumerate(rows)), SCHEMA)).collect()
    n, deviation, _, _ = brute(rows)
    assert {r["vec_id"]: int(r["deviation_exact"]) for r in got} == deviation and all(r["deviation"] is None for r in got)
    assert {r["component"] for r in got} == {1, 2}  # variances are to each other as 1, 1e-6 and 1e-18
    sharp = (rng.normal(size=(90, 3)) * [1e3, 2e3, 3e3]).tolist()
    check(whitening.whiten(spark.createDataFrame(list(enumerate(sharp)), SCHEMA)).collect(), sharp, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.0, 1.0], [1.0, 0.5], [-1.0, 2.0], [0.25, -3.0]]
    odd = [None, [], [nan, 1.0], [1.0, inf], [None, 1.0], [1.0], [1.0, 2.0, 3.0], [1e300, 1.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(good)] + [(None, good[0]), (0, good[0])] + [(100 + i, v) for i, v in enumerate(odd)], SCHEMA)
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in got) == sorted([(False, i, k) for i in (0, 0, 1, 2, 3) for k in (1, 2)] + [(True, 0, k) for k in (1, 2)])
    check([r for r in got if r["vec_id"]] + [r for r in got if r["vec_id"] == 0][:2], good, 2)
    for none in (df.where("vec_id = 100"), df.limit(0), df.where("vec_id = 0")):
        assert whitening.whiten(none).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)], SCHEMA)
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}


def test_fixture(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [r["embedding"] for r in v.orderBy("vec_id").collect()]
    ids = [r["vec_id"] for r in v.select("vec_id").orderBy("vec_id").collect()]
    got = whitening.whiten(v).collect()
    n, deviation, white, explained = brute(rows)
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, deviation[k]) for k, i in enumerate(ids)}
    at = {i: k for k, i in enumerate(ids)}
    assert max(abs(abs(r["whitened"]) - white[at[r["vec_id"]]][r["component"] - 1]) for r in got) < 1e-6 and got[0]["identity_error"] < 1e-9
