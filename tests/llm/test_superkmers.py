"""Repeated windows of words against brute force."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from procgraph.llm import superkmers

SCHEMA = "doc_id long, text string"


def brute(texts, length):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = {k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(i, i + length)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length, parts=3, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit("q") for c in ("id", "digest", "key", "low", "n", "mini", "lows")})
    got = superkmers.digests(df, length, **how).collect()
    want = [(i, *r) for (i, _), r in zip(rows, brute([t for _, t in rows], length), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") * rng.randint(1, 3) if rng.random() < 0.5 else f"w{rng.randint(0, 3000)}"
    passages = [[word() for _ in range(rng.randint(5, 60))] for _ in range(8)]
    out = []
    for i in range(docs):
        w = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        out.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    out += [(100 + i, out[i][1]) for i in range(20)]
    return out


def test_against_brute_force(spark, monkeypatch):
    check(spark, corpus(1), 9)
    check(spark, corpus(2), 35)
    check(spark, corpus(3), 12, gram=3, hot=2)  # frequent minimisers are split
    monkeypatch.setattr(superkmers, "BLOCK", 300)
    check(spark, corpus(4), 9)
    check(spark, corpus(5), 9, gram=2, hot=1, broadcast_rows=0)


def test_within_one_document_and_periods(spark):
    check(spark, [(1, "a b c d e " * 30), (2, "x " * 200), (3, "x " * 9), (4, "  é ß " * 8)], 10)


def test_odd_rows(spark):
    long = " ".join(f"t{i % 7000}" for i in range(60_000))
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "one two"), (None, "p q r s t u v w x y z"), (None, "p q r s t u v w x y z"), (5, "k l m n o p2 q2 r2 s2 t2"), (5, "k l m n o p2 q2 r2 s2 t2"), (5, "other text"), (6, long)]
    check(spark, rows, 10)
    check(spark, [], 10)


def test_hash_collisions(monkeypatch):
    """Equal hashes of unlike stretches are told apart by their bytes."""
    monkeypatch.setattr(superkmers, "mix64", lambda x: x & 0)
    import numpy as np

    t = superkmers.Bytes(b"aaaaaaaa bbbbbbbb aaaaaaaa cccccccc bbbbbbbb ")
    start = np.arange(0, 45, 9)
    a = t.alike(start, start + 8)
    assert (a[0] == a[2]) and (a[1] == a[4]) and len(set(a.tolist())) == 3


def test_texts_and_spans(spark):
    a = [f"a{i}" for i in range(20)]
    df = spark.createDataFrame([(1, " ".join(["x", *a, "y"])), (2, " ".join([*a, "z"]))], SCHEMA)
    got = {r["doc_id"]: r for r in superkmers.remove(df, 10).collect()}
    assert (got[1]["text"], got[1]["spans"], got[2]["text"]) == ("x y", [(1, 21)], "z")
