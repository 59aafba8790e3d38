"""Fingerprints come before the exact check of near copies, and sketches spare texts without losing links."""

from fractions import Fraction

import numpy as np
from test_near import DOCS, texts_of

from procgraph.llm import near


def test_fingerprints_link_sets(spark):
    """Pairs within three bits, and no others, are linked by fingerprints over any number of steps."""
    sets = [near.shingles(t) for t in texts_of(3)]
    fps = [near.fingerprint(s) for s in sets]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = near.alike(spark.createDataFrame(list(zip(range(len(sets)), signed, strict=True)), "gid long, fp long"), 3).collect()
    label = np.arange(len(sets))
    for a, b in got:
        assert a < b and (fps[a] ^ fps[b]).bit_count() <= 3
        label[label == label[b]] = label[a]
    for i, a in enumerate(fps):
        assert all(label[i] == label[j] for j in range(i) if (a ^ fps[j]).bit_count() <= 3)
    assert len(set(label.tolist())) < len(sets) - 20


def test_the_stage_asks_fingerprints(spark, monkeypatch):
    asked, links = [], near.links
    monkeypatch.setattr(near, "links", lambda fps, *a: asked.append(sorted(r["fp"] for r in fps.collect())) or links(fps, *a))
    texts = [t for t in texts_of(4) if len(t) > 5][:60]
    near.keep_one(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)).collect()
    fps = np.array(sorted({near.fingerprint(near.shingles(t)) for t in texts}), np.uint64).view(np.int64)
    assert asked == [sorted(fps.tolist())]


def test_sketches_lose_no_link_and_spare_long_texts():
    limit, rng = Fraction("0.8"), np.random.default_rng(1)
    sets = [near.shingles(t) for t in texts_of(2)]
    long = np.unique(rng.integers(0, 1 << 63, 9000).astype(np.uint64))
    sets += [long, long[100:], long[:4500], np.unique(np.append(long[:1200], rng.integers(0, 1 << 63, 7000).astype(np.uint64)))]
    passed = np.zeros((len(sets), len(sets)), bool)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            apart = near.differ(near.sketch(a), near.sketch(b))
            assert apart <= len(np.setxor1d(a, b))
            passed[i, j] = near.may_link(len(a), len(b), apart, limit)
            assert passed[i, j] or not near.linked(a, b, limit)
    n = len(sets)
    assert passed[n - 4, n - 3] and not passed[n - 4, n - 1]  # an unlike text with a long passage in common
    whole = near.bits_of(near.pd.Series([near.parity(sets[n - 4]), near.parity(sets[n - 1])]))
    assert near.may_link(len(sets[n - 4]), len(sets[n - 1]), int(np.bitwise_count(whole[0] ^ whole[1]).sum(dtype=np.int64)), limit)
