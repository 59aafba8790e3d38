"""Blocking by words loses no pair, however frequent a word is."""

import collections
import random

import pytest

from procgraph.operators import resolve


def test_word_of_very_many_rows(spark):
    rows = spark.createDataFrame([(i, f"common w{i // 2}") for i in range(1100)], "id long, name string")
    got = {r["common"]: r["n"] for r in resolve.token_blocks(rows).groupBy("common").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got == {1: 1100 * 1099 // 2 - 550, 2: 550}


@pytest.mark.parametrize("split_rows", [3, 1000])
def test_blocks_equal_brute_force(spark, split_rows):
    rng = random.Random(1)
    names = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 4))) for _ in range(60)]
    want = collections.Counter({(i, j): len(set(a.split()) & set(names[j].split())) for i, a in enumerate(names) for j in range(i + 1, len(names))})
    got = {(r["a"], r["b"]): r["common"] for r in resolve.token_blocks(spark.createDataFrame(list(enumerate(names)), "id long, name string"), split_rows).collect()}
    assert got == {k: n for k, n in want.items() if n}
