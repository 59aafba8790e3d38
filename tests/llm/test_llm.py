"""The ten operators and the pipeline: SQL, brute force, round trips, and odd inputs."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers as P
from procgraph.llm import ann, bpe, katz, langid, licenses, packing, quality, secrets, simhash, suffix
from procgraph.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length string, id string, digest string"


def clashing(docs):
    return docs.withColumns({c: F.lit("q") for c in ("kinds", "c_id", "r_id", "n_words", "removed", "host", "rank", "lows", "fp", "secret_spans", "part")})


def make(spark, texts, sources=None, langs=None):
    """Documents with more columns whose names operators use inside."""
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t) if t is not None else None, "x", "y", "z") for i, t in enumerate(texts)]
    return clashing(spark.createDataFrame(rows, DOCS).repartition(3))


def odd(spark):
    """Null and empty texts, repeated rows, null ids, a very long text, null columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c " * 30, "en", None, 180), (3, "a b c " * 30, "en", None, 180), (None, "null id text", None, "s", 12), (None, None, None, None, None), (4, long, "de", "s", len(long)), (5, " \t\n\x0b ", "en", "s", 5), (6, "…ß漢字 \x1c 😀", "fr", "s", 9)]
    return clashing(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).repartition(2))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, same):
    same(QUERIES[name], ORACLE[name])


def per_row(docs):
    return {
        "licenses": lambda: licenses.scan(docs),
        "katz": lambda: katz.score(docs),
        "suffix": lambda: suffix.digests(docs),
        "quality": lambda: quality.assess(docs),
        "bpe": lambda: bpe.digests(docs),
        "simhash": lambda: simhash.classes(docs),
        "secrets": lambda: secrets.scan(docs),
        "langid": lambda: langid.identify(docs),
    }


NAMES = "licenses katz suffix quality bpe simhash secrets langid".split()


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_keep_their_number(spark, name):
    docs = odd(spark)
    got = sorted(per_row(docs)[name]().collect(), key=str)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    twins = [r for r in got if r["doc_id"] == 3]
    assert len(twins) == 2 and twins[0] == twins[1]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert per_row(odd(spark).where("false"))[name]().count() == 0


def test_empty_table_of_the_rest(spark):
    docs = odd(spark).where("false")
    assert packing.pack(docs).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    for f in (quality.clean, simhash.keep_one, suffix.remove, secrets.redact):
        assert f(docs).columns == docs.columns and f(docs).count() == 0


def test_license_forms(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [mit, "Copyright (c) 2020 Somebody\n\n" + mit.upper(), mit.replace("\n", "\r\n").replace(",", " ,"), mit.replace("sublicense", "sub-license"), mit + " more", "", None, licenses.KNOWN["BSD-3-Clause"].replace("copyright holder", "copyright owner")]
    got = {r["doc_id"]: r for r in licenses.scan(make(spark, texts)).collect()}
    assert [got[i]["license_id"] for i in range(8)] == ["MIT", "MIT", "MIT", "MIT", None, None, None, "BSD-3-Clause"]
    assert got[5]["digest"] is None and got[6]["digest"] is None and got[4]["digest"]


def katz_brute(texts, k=5):
    words = {d: (t or "").encode().lower().split() + [None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c, b, h = collections.Counter(), collections.Counter(), collections.Counter()
    for d, w in words.items():
        if not held[d]:
            c.update(w)
            b.update(zip(["<s>", *w], w))
            h.update(["<s>", *w][: len(w)])
    few = lambda x: np.bincount([min(v, 7) for v in x.values()] or [0], minlength=8)[:7]
    n, v = sum(c.values()), len(c)
    uni, d2 = katz.Unigrams.of(n, v, sum(not x for x in held.values()), few(c)), katz.discounts(few(b))
    p1 = lambda w: float(uni.prob(np.array([c.get(w, 0)]))[0])
    weight = {}
    for x in h:
        mine = [(w, m) for (y, w), m in b.items() if y == x]
        free = 1 - sum(d2[min(m, 6)] * m for _, m in mine) / h[x]
        scale = 1.0 if free > 1e-12 else h[x] / (h[x] + 1)
        weight[x] = (scale, (free if free > 1e-12 else 1 / (h[x] + 1)) / (1 - sum(p1(w) for w, _ in mine)))
    prob = lambda x, w: weight[x][0] * d2[min(b[x, w], 6)] * b[x, w] / h[x] if b[x, w] else weight.get(x, (1, 1))[1] * p1(w)
    for x in h:  # exactly normalised, the unseen tokens counting as one
        assert sum(prob(x, w) for w in c) + weight[x][1] * uni.unseen == pytest.approx(1, abs=1e-9)
    out = {}
    for d, w in words.items():
        base = sum(math.log10((c.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out[d] = (held[d], len(w), sum(c.get(x, 0) > 0 for x in w), n, base, sum(math.log10(prob(x, y)) for x, y in zip(["<s>", *w], w)))
    return out


def test_katz_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"W{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = {i: " ".join(words[i * 20 : i * 20 + rng.randint(0, 20)]) for i in range(200)}
    want = katz_brute(texts)
    for size in (1 << 20, 2000):
        got = katz.score(make(spark, [texts[i] for i in range(200)]), block_bytes=size).collect()
        assert len(got) == 200
        for r in got:
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:4]
            assert (r["base_score"], r["score"]) == pytest.approx(want[r["doc_id"]][4:], rel=1e-9)


def test_katz_without_training(spark):
    docs = make(spark, ["a b", ""])
    assert {(r["train_tokens"], r["score"], r["n_known"]) for r in katz.score(docs, F.lit(True)).collect()} == {(0, 0.0, 0)}


def suffix_brute(texts, length=50):
    seen, out = {}, {}
    for d, t in sorted(texts.items()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], d) != d:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def passages(rng, n=120):
    pool = ["".join(rng.choice("abcdeé漢 \n") for _ in range(rng.randint(30, 200))) for _ in range(25)] + ["ab" * 60, "a" * 130, "a" * 49, "x" * 50]
    return [None if rng.random() < 0.03 else "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))) for _ in range(n)]


def test_suffix_equals_brute_force(spark):
    texts = passages(random.Random(7))
    want = suffix_brute(dict(enumerate(texts)))
    docs = make(spark, texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.digests(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000
    kept = {r["doc_id"]: r for r in suffix.remove(docs).collect()}
    assert len(kept) == len(texts)
    for i, t in enumerate(texts):
        if t is None:
            assert kept[i]["text"] is None and kept[i]["n_chars"] is None
        else:
            assert want[i][0] - want[i][1] <= len(kept[i]["text"].encode()) <= want[i][0] - want[i][1] + 8 * max(want[i][2], 0)
            assert kept[i]["n_chars"] == len(kept[i]["text"]) and kept[i]["length"] == "x"


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    w = suffix.words(data)
    at = np.arange(len(data) - 20 + 1)
    order, group = suffix.multikey_order(lambda which, place: w[at[which] + place], suffix.key_places(20), len(at))
    strings = [data[i : i + 20].tobytes() for i in range(len(at))]
    assert [strings[i] for i in order] == sorted(strings)
    assert len(set(group.tolist())) == len(set(strings))


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_under_every_capacity(rule):
    rng = random.Random(3)
    counts = collections.Counter(rng.randint(1, 100) for _ in range(3000))
    for cap in ((100, 100, 10_000), (100, 4, 10_000), (100, 100, 4_000 + 6_000)):
        places = packing.best_fit(counts, cap, rule=rule)
        bins = collections.defaultdict(list)
        for x, n in counts.items():
            for rank in range(n):
                r = int(np.searchsorted(places.first[x], rank, "right")) - 1
                k, each = rank - places.first[x][r], places.each[x][r]
                bins[int(places.sequence[x][r] + k // each)].append((int(places.offset[x][r] + k % each * x), x))
        assert len(bins) == places.n_sequences
        for got in bins.values():
            at = 0
            for offset, x in sorted(got):
                assert offset == at
                at += x
            assert at <= cap[0] and len(got) <= cap[1] and sum(x * x for _, x in got) <= cap[2]
    least = -(-sum(x * n for x, n in counts.items()) // 100)
    assert packing.best_fit(counts, (100, 100, 10_000), rule=rule).n_sequences <= 1.01 * least + 2


def test_packing(spark, sf_dir):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 10**6))
    got = packing.pack(docs, max_tokens=512).collect()
    texts = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(r["text"])
    rows = collections.defaultdict(list)
    for r in got:
        rows[r["doc_id"]].append(r)
    assert set(rows) == set(texts)
    for d, ts in texts.items():
        ids = np.array([*t.encode(ts[0] or "", add_special_tokens=False).ids, 0], "<u4")
        want = sorted((k, a, min(512, len(ids) - a), zlib.crc32(ids[a : a + 512].tobytes())) for k, a in enumerate(range(0, len(ids), 512)))
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows[d]) == sorted(want * len(ts))
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 512
    assert len(seqs) <= -(-sum(r["length"] for r in got) // 512) * 1.02 + 1


def test_word_tokenizer_equals_library():
    path, rng = P.path("word_bpe_49k.json"), random.Random(2)
    ours, t = packing.WordTokenizer(path), Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for _ in range(3000):
        s = "".join(rng.choice("aabeest in\n\t  ABC123é漢😀\x1c '\"-_śΣİK’ß\x85 <|endoftext|>") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(ours.packed(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def test_ann_recall_and_ties(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = v.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    big = spark.createDataFrame([(int(10_000 + i), [float(y) for y in x[i % len(x)]]) for i in range(3000)], "vec_id long, embedding array<float>")
    for df, least in ((v.select("vec_id", "embedding"), 0.9), (big, 0.9)):
        r = df.collect()
        ids, x = np.array([a[0] for a in r]), np.array([a[1] for a in r], float)
        got = collections.defaultdict(list)
        for g in ann.search(df).orderBy("query_id", "rank").collect():
            got[g["query_id"]].append((g["vec_id"], g["score"]))
        hits = total = 0
        for q in np.flatnonzero(ids % 20 == 0):
            s = (x * x[q]).sum(1)
            s[q] = -np.inf
            best = ids[np.lexsort((ids, -s))[:20]]
            mine = got[int(ids[q])]
            assert len(mine) == 20 and all(b == pytest.approx(s[np.flatnonzero(ids == a)[0]], abs=1e-12) for a, b in mine)
            assert [(-b, a) for a, b in mine] == sorted((-b, a) for a, b in mine)
            hits += len(set(best.tolist()) & {a for a, _ in mine})
            total += 20
        assert hits >= least * total


def test_ann_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0]), (8, [])]
    got = [tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 1.0), (0, 2, 20, 0.5), (20, 1, 7, 1.0), (20, 2, 0, 0.5)]


def test_quality_lines(spark):
    body = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    texts = [b + "\nShared footer, line!" for b in body[:30]] + body[30:] + ["Shared  footer line\n" + body[0][:200]] * 3
    docs = make(spark, texts, sources=["h"] * 43)
    got = {r["doc_id"]: r for r in quality.assess(docs, min_docs=10).collect()}
    assert got[0]["n_words_removed"] == 3 and got[0]["kept"] and got[35]["n_words_removed"] == 0
    assert not got[41]["kept"] and got[41]["base_failed"]
    kept = {r["doc_id"]: r for r in quality.clean(docs, min_docs=10).collect()}
    assert set(kept) == {i for i in got if got[i]["kept"]} and kept[0]["text"] == body[0] and kept[0]["n_chars"] == len(body[0]) and kept[35]["text"] == texts[35]


def test_quality_copies_are_one_document(spark):
    body = " ".join(f"w{j}" for j in range(80))
    got = quality.assess(make(spark, [body] * 50 + [" ".join(f"v{i}x{j}" for j in range(60)) for i in range(10)])).collect()
    assert all(r["kept"] and r["n_words_removed"] == 0 for r in got)


def repeat_words(words):
    c = collections.Counter(zip(words, words[1:], words[2:]))
    return len({p for i, g in enumerate(zip(words, words[1:], words[2:])) if c[g] > 1 for p in (i, i + 1, i + 2)})


def test_repeated_windows(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(100)] + [" ".join(str(i) for i in range(50)), "a a a a a"]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.assess(make(spark, texts)).collect()}
    assert got == {i: repeat_words(t.split()) for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_bpe_equals_library(vocabulary, library):
    rng = random.Random(1)
    for _ in range(8000):
        s = "".join(rng.choice("aabeest in\n\t  ABC123é漢😀\x1c '\"-_s") for _ in range(rng.randint(0, 40)))
        assert library.encode_ordinary(s) == vocabulary.encode(s)
        assert vocabulary.decode(vocabulary.packed(s)) == s.encode()
    tokens = list(vocabulary.ranks)
    for _ in range(4000):
        b = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 5)))
        assert library._core_bpe.encode_single_piece(b) == vocabulary.encode_piece(b)


def test_bpe_appends_and_edits(vocabulary, library):
    rng = random.Random(6)
    e, data = bpe.Encoder(vocabulary), b""
    for _ in range(300):
        if rng.random() < 0.6 or len(data) < 4:
            more = bytes(rng.choice(b"aeinrst") for _ in range(rng.randint(1, 4)))
            e.append(more)
            data += more
        else:
            a = rng.randrange(len(data))
            b, by = min(len(data), a + rng.randint(0, 5)), bytes(rng.choice(b"aeinrst") for _ in range(rng.randint(0, 4)))
            e.splice(a, b, by)
            data = data[:a] + by + data[b:]
        assert e.ids() == (library._core_bpe.encode_single_piece(data) if data and data not in vocabulary.ranks else e.ids())
    assert e.ids() == vocabulary.walk(vocabulary.extend(data, []))


def test_bpe_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_fingerprint():
    text = "A quick Brown fox jumps é"
    w = text.encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint("one") == xxhash.xxh64_intdigest(b"one", 42) and simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def brute_components(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("heavy", [2000, 3])
@pytest.mark.parametrize("shape", [(1, 1), (0, 0, 0, 0), (1, 0, 0), (2, -1, 0, -1, 2), (3,)])
def test_links_of_any_partition(spark, monkeypatch, heavy, shape):
    if shape == (2, -1, 0, -1, 2) and heavy == 2000:
        pytest.skip("covered by the small one")
    if sum(shape) != 3 - len(shape) + 1:
        pytest.skip("not a partition for this radius")
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 6)).astype(np.uint64), initial=np.uint64(0)) for _ in range(300)], np.uint64)
    fps = np.unique(base[rng.integers(0, 20, 300)] ^ flips)
    parts = tuple(map(tuple, simhash.group_bits(simhash.bits_of(fps), len(shape))))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, simhash.Plan(parts, shape))).collect()}
    want = brute_components(fps)
    ours = [found.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert [ours.index(x) for x in ours] == [want.index(x) for x in want]


def test_plan_covers_the_radius():
    rng = np.random.default_rng(2)
    for n in (10, 10**6, 10**11):
        p = simhash.plan(rng.integers(0, 1 << 63, 500, dtype=np.uint64), n)
        assert sum(p.limits) == 3 - len(p.parts) + 1 and sorted(b for part in p.parts for b in part) == list(range(64))
    assert sum(simhash.plan(np.zeros(0, np.uint64), 0).limits) >= 0


def test_simhash_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = np.array([simhash.fingerprint(r["text"]) for r in rows], np.uint64)
    want = {r["doc_id"]: (f"{int(fp):016x}", rows[c]["doc_id"]) for r, fp, c in zip(rows, fps, brute_components(fps))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op8_simhash_near_dedup"](spark, sf_dir).collect()}
    assert got == want
    kept = simhash.keep_one(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] == [] and q["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"sec", "ecr", "cre", "ret"}) in q["assign"] and frozenset({"api", "pik", "ike", "key"}) in q["assign"] and frozenset({"api", "pi_", "i_k", "_ke", "key"}) in q["assign"]
    rng = random.Random(1)
    for r in secrets.RULES:
        for s in ("password = abcdefgh", "API_KEY:'abcdef12'", "AKIA" + "A" * 16, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-" + "1" * 20, "eyJabc.eyJdef.ghi", "sk_live_" + "a" * 20):
            for m in regex.finditer(r.pattern, s):
                tri = {m[0].lower()[i : i + 3] for i in range(len(m[0]) - 2)}
                assert not q[r.kind] or any(c <= tri for c in q[r.kind])
    assert rng


def test_secret_spans(spark):
    texts = ["é password = 'abcdef12' x", "token:abc secret=a1b2c3d4", "AKIA" + "Z" * 15 + " AKIA" + "Z" * 16, "f" * 23 + " " + "0" * 24, "ghp_" + "Gx" * 20, None, "api_key:token:abcdef", "x  passwd= passwd=abcdefg"]
    got = {r["doc_id"]: r for r in secrets.scan(make(spark, texts)).collect()}
    assert [got[i]["spans"] for i in range(8)] == ["assign:2:22", "assign:10:25", "access:20:40", "hex:24:48", "git_token:0:44", "", "", "assign:13:27"]
    assert got[5]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["base_sha256"] == got[5]["base_sha256"]
    red = {r["doc_id"]: r for r in secrets.redact(make(spark, texts)).collect()}
    assert red[0]["text"] == "é [SECRET]' x" and red[0]["n_chars"] == 13 and red[1]["text"] == "token:abc [SECRET]" and red[5]["text"] is None and red[6]["text"] == texts[6]
    both = {r["doc_id"]: r["text"] for r in secrets.redact(make(spark, ["secret=" + "ab" * 20 + ".", "0" * 30])).collect()}
    assert both == {0: "[SECRET]", 1: "[SECRET]"}


def test_language_held_out(spark, sf_dir):
    got = langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in got if r["n"] > 50]) >= 0.9


def test_language_edges(spark):
    docs = make(spark, ["der die das und", "the of and to", None, "123 !!", ""] * 30, langs=["de", "en", None, "en", "de"] * 30)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == ("de", "en", "und", "und", "und")[i % 5] for i in got)
    assert {r["lang_pred"] for r in langid.identify(make(spark, ["ab", "cd"], langs=[None, None])).collect()} == {"und"}
    one = langid.identify(make(spark, ["ab", "cd"] * 20, langs=["xx"] * 40)).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("xx", 1.0)}


def test_codewords():
    for k in (2, 3, 4, 7, 12):
        c = langid.codewords(k)
        gap = (c.shape[1] - c @ c.T) / 2 + np.eye(k) * 99
        assert gap.min() >= (1 if k == 2 else 2)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r["doc_id"]: r["text"] for r in docs.collect()}
    verdict = {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, now, sf_dir)
        assert nxt.columns == docs.columns, name
        now = spark.createDataFrame(nxt.collect(), docs.schema)
        if name == "quality_rules":
            assert {r["doc_id"] for r in now.collect()} == {d for d, k in verdict.items() if k}
        if name == "near_dedup":
            left = [r["text"] for r in now.collect()]
            assert len(left) == len(set(left))
    assert secrets.scan(now).where("n_assign + n_access + n_hex > 0").count() == 0
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in now.collect()} and set(verdict) == set(ids)
