"""Multikey quicksort sorts on only where strings differ."""

import numpy as np

from procgraph.llm import suffix


def ordered(strings, monkeypatch):
    """Order and groups of byte strings of one length, and how many rows were sorted on after the first key."""
    rows, lexsort = [], np.lexsort
    monkeypatch.setattr(suffix.np, "lexsort", lambda keys: rows.append(len(keys[0])) or lexsort(keys))
    size = len(strings[0])
    w = suffix.words(np.frombuffer(b"".join(strings), np.uint8))
    order, group = suffix.multikey_order(lambda which, place: w[which * size + place], suffix.key_places(size), len(strings))
    monkeypatch.undo()
    return [strings[i] for i in order], group.tolist(), sum(rows)


def test_equal_strings_are_not_sorted_on(monkeypatch):
    rng = np.random.default_rng(1)
    kinds = [rng.integers(97, 123, 50).astype(np.uint8).tobytes() for _ in range(20)]
    strings = [kinds[i] for i in rng.integers(0, 20, 1000)]
    got, group, rows = ordered(strings, monkeypatch)
    assert got == sorted(strings) and len(set(group)) == 20 and rows == 0


def test_groups_that_differ_late_are(monkeypatch):
    rng = np.random.default_rng(2)
    kinds = [b"same head" + bytes(rng.integers(97, 99, 5).astype(np.uint8)) + b"the middle of it" + bytes(rng.integers(97, 99, 20).astype(np.uint8)) for _ in range(200)]
    strings = [kinds[i] for i in rng.integers(0, 200, 3000)] + [b"z" * 50] * 500
    got, group, rows = ordered(strings, monkeypatch)
    assert got == sorted(strings) and 0 < rows
    assert all((group[i] == group[i - 1]) == (got[i] == got[i - 1]) for i in range(1, len(got)))
