"""Near copies by shingles against brute force, and which row of a component stays."""

import random
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from procgraph.llm import near, simhash

DOCS = "doc_id long, text string, source string"


def edited(rng, base, share):
    """base with a run of words exchanged, and few single ones."""
    w = list(base)
    for _ in range(rng.randint(0, 2)):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    cut, n = rng.randrange(len(w)), int(share * len(w))
    return w[:cut] + [f"y{rng.randrange(10**6)}" for _ in range(n)] + w[cut + n :]


def texts_of(seed=1):
    rng = random.Random(seed)
    footer = [f"foot{i}" for i in range(25)]
    out = ["", " \n", "one", "one two", "ONE two"]
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200, 700]))] + footer * rng.randint(0, 1)
        out += [" ".join(edited(rng, base, rng.choice([0, 0, 0.02, 0.05, 0.1]))) for _ in range(rng.randint(1, 9))]
    return out


def brute(texts):
    """The least position of each text's component."""
    sets = [set(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.encode().lower().split()) else set() for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("heavy", [64, 2])
def test_near_equals_brute_force(spark, heavy):
    texts = texts_of()
    want = brute(texts)
    assert 40 < len(set(want)) < len(texts) - 40
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS).repartition(3)
    assert {r["doc_id"] for r in near.keep_one(docs, heavy=heavy).collect()} == set(want)


def test_heavy_keys_keep_components():
    """The bounds alone, in one key that all sets share."""
    limit, sets = Fraction("0.8"), [near.shingles(t) for t in texts_of(2)]
    bits = near.bits_of(near.pd.Series([near.parity(s) for s in sets]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a) and len(b) and near.linked(a, b, limit):
                assert near.may_link(*(np.array([len(x)]) for x in (a, b)), np.bitwise_count(bits[i] ^ bits[j]).sum(keepdims=True), limit).all()
                assert set(near.prefix(a, limit, a[:0], a[:0])) & set(near.prefix(b, limit, a[:0], a[:0]))


def test_stage_finds_copies_that_are_many_bits_apart(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join(base[:60] + [f"n{i}" for i in range(16)] + base[76:]), " ".join(f"z{i}" for i in range(200))]
    assert (simhash.fingerprint(texts[0], 5) ^ simhash.fingerprint(texts[1], 5)).bit_count() > 3
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]


@pytest.mark.parametrize("keep_one", [simhash.keep_one, near.keep_one])
def test_one_row_of_each_component(spark, keep_one):
    """Null ids, repeated rows, one id with two texts."""
    say = lambda c: " ".join(f"{c}{i}" for i in range(90))
    rows = [(None, say("a"), "s"), (None, say("b"), "s"), (None, say("b"), "t"), (3, say("c"), "s"), (3, say("c"), "s"), (None, say("c"), "s"), (5, say("d"), "s"), (5, say("e"), "s"), (5, say("e"), None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"][0]) for r in got.collect()) == [("3", "c"), ("5", "d"), ("5", "e"), ("None", "a"), ("None", "b")]


def test_keys_that_meet():
    """Keys of one set go, repeated rows count once, and frames end anywhere."""
    rows = [(1, 5), (2, 5), (2, 5), (2, 6), (2, 7), (3, 5), (3, 5), (4, 6), (4, 9)]
    for size in range(1, 10):
        frames = [near.pd.DataFrame(rows[i : i + size], columns=["key", "gid"]) for i in range(0, len(rows), size)]
        got = [tuple(map(int, r)) for f in near.met(iter(frames)) for r in f[["key", "gid"]].to_numpy()]
        assert got == [(2, 5), (2, 6), (2, 7), (4, 6), (4, 9)]


def test_copies_in_several_partitions(spark):
    """Copies in several partitions, and keys that very many sets share."""
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join([*base[:i], f"n{i}", *base[i + 1 :]]) for i in range(0, 150, 2)] * 8 + [" ".join(f"z{i}" for i in range(90))] * 8
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS).repartition(5)
    assert sorted(r["doc_id"] for r in near.keep_one(docs, heavy=8).collect()) == [0, 600]


def test_sliced_keeps_rows():
    """Nulls, an empty frame and texts longer than a slice."""
    texts = ["a" * 50, None, "", "b" * 7, "c" * 300, None, "d"]
    frame = near.pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    parts = list(near.sliced(iter([frame.iloc[:0], frame, frame]), 60))
    assert [len(p) for p in parts] == [5, 2, 5, 2]
    assert near.pd.concat(parts)["doc_id"].tolist() == 2 * list(range(len(texts)))
    for nulls in (None, float("nan")):
        assert sum(map(len, near.sliced(iter([near.pd.DataFrame({"text": [nulls, nulls]})])))) == 2


def test_one_row_of_repeated_ones(spark):
    """Of rows equal in id and text one stays, also where the rest differs; those with a row of their own pass as they are."""
    rows = [(1, "x", "p"), (1, "x", "q"), (1, "x", "q"), (2, "x", "r"), (3, "y", "s"), (None, "z", "t"), (None, "z", "t"), (None, None, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(4)
    digest = near.F.xxhash64("text").alias("digest")
    member = docs.select("doc_id", digest, near.F.xxhash64("text").alias("component"))
    got = [tuple(r) for r in simhash.one_row(docs, member).collect()]
    assert sorted((r[0] or 0, r[1] or "") for r in got) == [(0, ""), (0, "z"), (1, "x"), (3, "y")]
    assert set(got) <= set(rows)
