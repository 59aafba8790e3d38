"""Language identification by error-correcting output codes.

Each language has a codeword; one linear classifier over hashed byte n-grams predicts each bit; the language whose
codeword has the least weighted loss wins. The classifiers are fitted on a bounded sample of labelled rows
(``max_rows`` in all, or ``min_rows`` for each language if there are many); prediction covers every row and whole texts.

Defined results: a null text, an empty one or one without a letter is ``und`` with score 0 and not ambiguous; without
any labelled row every text is ``und``; with one learned language every text with a letter is that language with score
1. Equal losses go to the language that comes first in the alphabet. Repeated rows are predicted one by one. A very long
text takes memory in proportion to its length. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.llm.common import crc_mod, utf8

DIM = 2048
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def features(text: str, dim: int = DIM) -> np.ndarray:
    """Damped counts of the hashed byte bigrams, trigrams and four-grams of the lower-cased text, of unit length."""
    b = np.frombuffer(b" " + utf8(" ".join(text.lower().split())) + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(dim, np.float32)
    gram = b
    for n in (2, 3, 4):
        if len(b) < n:
            break
        gram = gram[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
        out += np.bincount(((gram * np.uint32(0x9E3779B1)) >> np.uint32(21)) % np.uint32(dim), minlength=dim)
    out = np.sqrt(out)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of -1 and 1: the exhaustive code up to 7 languages, else the best of some random codes."""
    if k <= 7:
        cols = [[1 if i == 0 or not c >> (i - 1) & 1 else -1 for i in range(k)] for c in range(1, 2 ** (k - 1))]
        return np.array(cols, np.float32).T.reshape(k, -1)
    rng, n = np.random.default_rng(seed), int(np.ceil(12 * np.log2(k)))
    best, best_d = None, -1.0
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (k, n))
        gap = (n - code @ code.T) / 2 + n * np.eye(k)
        useful = (np.abs(code.sum(0)) < k).all()
        if useful and gap.min() > best_d:
            best, best_d = code, gap.min()
    return best if best is not None else rng.choice(np.array([-1, 1], np.float32), (k, n))


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weights: np.ndarray
    margin: float

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Rows by languages: the mean logistic loss of the bits against each codeword, weighted by the bits' accuracy."""
        f = np.einsum("if,fb->ib", x, self.weights) + self.bias  # row by row, so that a row is the same in any batch
        w = self.bit_weights / self.bit_weights.sum()
        return (np.logaddexp(0, -f[:, None, :] * self.code[None]) * w).sum(2)

    def predict(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        pred, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        at = [i for i, t in enumerate(texts) if self.langs and isinstance(t, str) and any(map(str.isalpha, t))]
        if not at:
            return pred, score, unsure
        if len(self.langs) == 1:
            for i in at:
                pred[i], score[i] = self.langs[0], 1.0
            return pred, score, unsure
        loss = self.losses(np.stack([features(texts[i]) for i in at]))
        p = np.exp(-self.code.shape[1] * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = np.sort(p, 1)
        for j, i in enumerate(at):
            pred[i], score[i], unsure[i] = self.langs[best[j]], min(1.0, float(p[j, best[j]])), top[j, -1] - top[j, -2] < self.margin
        return pred, score, unsure


def fit(sample: list[tuple[str, np.ndarray]], steps: int = 300, margin: float = 0.2) -> Model:
    langs = sorted({lang for lang, _ in sample})
    code = codewords(len(langs)) if len(langs) > 1 else np.zeros((len(langs), 0), np.float32)
    bits = code.shape[1]
    w, b, acc = np.zeros((DIM, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits, np.float32)
    if bits:
        x = np.stack([v for _, v in sample])
        lang = np.array([langs.index(s) for s, _ in sample])
        y = code[lang]
        share = (1 / np.bincount(lang, minlength=len(langs)))[lang][:, None] / len(langs)  # languages weigh the same
        vw, vb = w.copy(), b.copy()
        for _ in range(steps):  # heavy-ball descent of the logistic loss; rows have unit length
            g = -y / (1 + np.exp(y * (x @ w + b))) * share
            vw = 0.9 * vw - 8.0 * (x.T @ g + 1e-5 * w)
            vb = 0.9 * vb - 8.0 * g.sum(0)
            w, b = (w + vw).astype(np.float32), (b + vb).astype(np.float32)
        acc = np.clip((((x @ w + b) * y > 0) * share).sum(0) * 2 - 1, 0.05, 1).astype(np.float32)
    return Model(langs, code, w, b, acc, margin)


def train(docs: DataFrame, is_train: Column, max_rows: int = 2400, min_rows: int = 20) -> Model:
    """Fits on at most max(max_rows, min_rows * languages) rows with a language, spread evenly over the languages.

    Of each language those with the lowest hashes of the text are taken, so how rows are dealt out makes no difference.
    """
    labelled = docs.where(is_train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([])
    each = max(min_rows, max_rows // len(counts))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 2 * each / n))])
    drawn = F.xxhash64("text")
    low = labelled.where(F.pmod(drawn, F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).select("lang", "text", F.pmod(drawn, F.lit(1 << 20)).alias("low"), drawn.alias("hash"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("low", "hash"))  # equal hashes are equal texts
    picked = low.withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "text")

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"lang": p["lang"], "x": [features(t).astype(np.float16).tobytes() for t in p["text"]]})

    rows = [(r["lang"], np.frombuffer(bytes(r["x"]), np.float16).astype(np.float32)) for r in picked.mapInPandas(vectors, "lang string, x binary").collect()]  # at most `each` a language
    return fit(sorted(rows, key=lambda x: (x[0], x[1].tobytes())))


def predict(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM times the code's length, whatever the corpus

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            pred, score, unsure = shared.value.predict(p["text"].tolist())
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "held_out": p["held_out"], "lang_pred": pred, "score": score, "ambiguous": unsure})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out")).mapInPandas(run, SCHEMA)


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, **how) -> DataFrame:
    """Learns from the rows outside one fold of crc32(doc_id) and predicts every row."""
    held = crc_mod("doc_id", folds) == fold
    return predict(docs, train(docs, ~held, **how), held)
