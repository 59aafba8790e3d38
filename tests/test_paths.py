"""Paths have no greatest length."""

from procgraph.operators import graph


def test_chain_of_over_100_hops(spark):
    n = 104
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n)], "src string, dst string").coalesce(1)
    got = graph.paths(edges)
    assert got.count() == n * (n + 1) // 2 and got.agg({"hops": "max"}).first()[0] == n
    assert graph.paths(edges.where("false")).count() == 0
