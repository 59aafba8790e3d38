"""Katz backoff of several orders against a recursion over plain dictionaries."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from procgraph.llm import katz


def brute(texts, order):
    words = {d: ["\r"] * (order - 1) + (t or "").lower().split() + ["\n"] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    tables = {k: collections.Counter() for k in range(1, order + 1)}
    for d, w in words.items():
        if not held[d]:
            for i in range(order - 1, len(w)):
                for k in tables:
                    tables[k][tuple(w[i - k + 1 : i + 1])] += 1
    few = lambda x: np.bincount([min(v, 7) for v in x.values()] or [0], minlength=8)[:7]
    uni = katz.Unigrams.of(sum(tables[1].values()), len(tables[1]), sum(not x for x in held.values()), few(tables[1]))
    d = {k: katz.discounts(few(tables[k])) for k in tables}
    contexts = {k: collections.defaultdict(list) for k in tables}
    for k in tables:
        for g in tables[k]:
            contexts[k][g[:-1]].append(g)

    def weigh(h):
        got, k = contexts[len(h) + 1].get(h), len(h) + 1
        if not got:
            return 1.0, 1.0, 0
        total = sum(tables[k][g] for g in got)
        free = 1 - sum(d[k][min(tables[k][g], 6)] * tables[k][g] for g in got) / total
        scale = 1.0 if free > 1e-12 else total / (total + 1)
        return scale, (free if free > 1e-12 else 1 / (total + 1)) / (1 - sum(prob(g[1:]) for g in got)), total

    seen = {}

    def prob(g):
        if len(g) == 1:
            return float(uni.prob(np.array([tables[1].get(g, 0)]))[0])
        h = g[:-1]
        scale, weight, total = seen.setdefault(h, None) or seen.__setitem__(h, weigh(h)) or seen[h]
        c = tables[len(g)].get(g, 0)
        return scale * d[len(g)][min(c, 6)] * c / total if c else weight * prob(g[1:])

    for h in list(contexts[order])[:200]:
        assert sum(prob((*h, *g)) for g in tables[1]) <= 1 + 1e-9
    out = {}
    for x, w in words.items():
        gs = [tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w))]
        out[x] = (held[x], len(gs), sum(tables[1].get(g[-1:], 0) > 0 for g in gs), uni.total, sum(math.log10(prob(g)) for g in gs))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = [f"W{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)]
    out = {i: " ".join(words[i * 18 : i * 18 + rng.randint(0, 18)]) for i in range(150)}
    return out | {150: None, 151: "", 152: out[3], 153: "same same same same same"}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_every_order(spark, texts, order):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    from procgraph.llm import ngrams
    from procgraph.llm.common import crc_mod

    want, got = brute(texts, order), ngrams.score(docs, crc_mod("doc_id", 5) == 1, order).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:4]
        assert r["score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)


def test_blocks_equal_tables(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts, 2)
    for r in katz.score(docs, block_bytes=3000, part_bytes=1000).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)


def test_long_words_with_a_pattern():
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    h, _ = katz.tokens([a, b, a.upper()])
    assert h[0] != h[2] and h[0] == h[4]
