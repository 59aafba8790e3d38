"""Token ids against the libraries over all of Unicode."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from procgraph.llm import bpe, packing

EVERY = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def strings(n, seed):
    rng = random.Random(seed)
    near = [c for c in range(0x250)] + [0x558, 0x88F, 0xC5C, 0xA7CE, 0x3A3, 0x3C2, 0x130, 0x301, 0x32D4D, 0x3D69A, 0xFB35, 0x11F42]
    for _ in range(n):
        yield "".join(chr(rng.choice(near) if rng.random() < 0.7 else rng.choice(EVERY)) for _ in range(rng.randint(1, 14)))


@pytest.fixture(scope="module")
def words():
    path = P.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return packing.WordTokenizer(path), own


def differing(tokenizer, own, texts):
    want = own.encode_batch_fast(texts, add_special_tokens=False)
    return [t for t, w, g in zip(texts, want, tokenizer.packed_all(texts), strict=True) if g != np.array(w.ids, "<u4").tobytes()]


def test_characters_between_letters(words):
    for at in range(0, len(EVERY), 50_000):
        assert not differing(*words, [f"a{chr(c)}B {chr(c)}" for c in EVERY[at : at + 50_000 : 5]])
    assert not differing(*words, [f"a{chr(c)}b" for c in bpe.unlike()])


def test_random_strings(words):
    assert not differing(*words, list(strings(20_000, 3)))


def test_another_way_of_ending_words(words):
    tokenizer, own = packing.WordTokenizer(P.path("word_bpe_49k.json")), words[1]
    tokenizer.ends[:] = False
    assert not differing(tokenizer, own, ["plain words, 12 of them's", "a՘b"])


def test_byte_pairs_over_all_characters():
    v = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    texts = [f"a{chr(c)}'s {chr(c)}1" for c in EVERY[::9]] + [f"x{chr(c)}'s" for c in bpe.unlike()] + list(strings(15_000, 5))
    assert [t for t in texts if v.encode(t) != own.encode_ordinary(t)] == []


def test_packing_odd_characters(spark):
    texts = ["a՘b", "\U00032794", "וּ\U00011f42ꞻ  ", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert packing.pack(docs).count() == len(texts)
