"""Ranked search against brute force."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from procgraph.llm import lexical


def brute(docs, items, k=10):
    split = [(i, Counter(t.decode() for t in lexical.terms(x))) for i, x in docs]
    split = [(i, c) for i, c in split if c]
    n, total = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, c in split:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in {t.decode() for t in lexical.terms(text)} if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def check(spark, docs, items, parts=3, segment=2048, **how):
    extra = {c: F.lit("q") for c in ("m", "part", "term", "tf", "ids", "id", "h")}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).withColumns(extra)
    b = spark.createDataFrame(items, "item_id long, text string").withColumns(extra)
    got = lexical.search(lexical.index(d, segment=segment), b, **how)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, how.get("k", 10))


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "É", "straße", "x_y", "Ab", "aB", "中文"]
    text = lambda m: rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(words, k=m))
    docs = [(i, text(rng.choice([1, 3, 10, 10, 10, 40, 90]))) for i in range(n)]
    docs += [(n + i, docs[0][1]) for i in range(n // 2)]  # a third are copies: one stratum, all tied
    return docs, [(i, text(rng.randint(1, 9))) for i in range(12)]


def test_against_brute_force(spark):
    check(spark, *corpus(1))
    check(spark, *corpus(2), segment=7, first=1)
    check(spark, *corpus(3), k=3, segment=4, item_bytes=40, first=2)


def test_odd_rows(spark):
    docs = [(None, None), (1, None), (2, ""), (3, "--"), (4, "cat dog"), (4, "cat dog"), (4, "cat"), (None, "cat dog"), (7, "cat " * 50_000), (8, "bird")]
    items = [(1, "Cat!"), (1, "Cat!"), (1, "bird"), (2, None), (3, ""), (None, "dog"), (5, "nothing like it")]
    check(spark, docs, items)
    check(spark, [], items)
    check(spark, docs, [])
    check(spark, [(1, None)], items)


def test_counting_terms():
    for t in ("", "a", " a", "a b", "ÉÉ-x_9", "中 文", "..", None, "a\x00b\x7fc"):
        assert lexical.n_terms(t) == len(lexical.terms(t))
