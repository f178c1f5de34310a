"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit a binary n-gram classifier (naive Bayes log ratios of
hashed byte n-grams, calibrated by a logistic fit) predicts its value. Decoding takes the codeword
of least loss, each bit's logistic loss weighted by the bit's accuracy, and flags near ties.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import sample_texts, split_rest, text_batches

SIZES, BITS = (1, 2, 3), 14
#: Learning rows of each language, at most about so many (picked by hash of the id).
PER_LANGUAGE = 500
CODE_BITS = 15
#: Share by which the best codeword must beat the next, else the text is flagged.
MARGIN = 0.05
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")  # letters, and numerals that are no decimal digits


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter: fractions, circled and Roman numerals are none."""
    return bool(text) and any(any(map(str.isalpha, m[0])) for m in _WORD.finditer(text))


def codewords(k: int, bits: int = CODE_BITS, seed: int = 5) -> np.ndarray:
    """k codewords of -1 and 1 with the greatest least distance found; no bit is constant."""
    if k <= 1:
        return np.ones((k, bits), np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    need = max(bits, 2 * int(np.ceil(np.log2(k))) + 1)
    for _ in range(400):
        c = rng.integers(0, 2, (k, need)) * 2 - 1
        flat = np.abs(c.sum(axis=0)) == k
        c[0, flat] *= -1
        apart = min(int((c[i] != c[j]).sum()) for i in range(k) for j in range(i))
        if apart > far:
            best, far = c, apart
    return best.astype(np.int8)


@dataclass
class LanguageModel:
    names: list[str]
    codes: np.ndarray  # languages x bits
    ratio: np.ndarray  # n-grams x bits
    scale: np.ndarray
    shift: np.ndarray
    weight: np.ndarray  # of each bit

    def bits(self, counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return (counts @ self.ratio) / total * self.scale + self.shift

    def decode(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and flag of each text."""
        f = self.bits(ngrams.count_matrix(texts, SIZES, BITS)) if self.names else np.zeros((len(texts), 0))
        loss = np.zeros((len(texts), len(self.names)))
        for i, c in enumerate(self.codes):
            loss[:, i] = np.logaddexp(0, -f * c) @ self.weight
        names, score, flag = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            if not self.names or not has_letter(t):
                names.append(UNKNOWN)
                continue
            p = np.exp(loss[i].min() - loss[i])
            p /= p.sum()
            best = int(p.argmax())
            names.append(self.names[best])
            score[i] = p[best]
            flag[i] = len(p) > 1 and p[best] - np.partition(p, -2)[-2] < MARGIN
        return names, score, flag


def fit(texts: list[str | None], langs: list[str]) -> LanguageModel:
    names = sorted(set(langs))
    codes = codewords(len(names))
    of = np.array([names.index(x) for x in langs], np.int64)
    d, bits = 1 << BITS, codes.shape[1]
    if not names:  # nothing to learn from: every text is ``und``
        return LanguageModel(names, codes, np.zeros((d, bits), np.float32), np.ones(bits), np.zeros(bits), np.ones(bits))
    per = np.zeros((len(names), d))
    means = []
    for at in range(0, len(texts), 256):
        c = ngrams.count_matrix(texts[at : at + 256], SIZES, BITS)
        freq = c / np.maximum(c.sum(axis=1, keepdims=True), 1)
        for k in range(len(names)):
            per[k] += freq[of[at : at + 256] == k].sum(axis=0)
    per /= np.maximum(per.sum(axis=1, keepdims=True), 1e-9)
    ratio = np.zeros((d, codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        if (codes[:, b] == codes[0, b]).all():
            continue
        pos, neg = per[codes[:, b] > 0].mean(axis=0), per[codes[:, b] < 0].mean(axis=0)
        ratio[:, b] = np.log((pos + 1e-6) / (neg + 1e-6))
    model = LanguageModel(names, codes, ratio, np.ones(codes.shape[1]), np.zeros(codes.shape[1]), np.ones(codes.shape[1]))
    for at in range(0, len(texts), 256):
        means.append(model.bits(ngrams.count_matrix(texts[at : at + 256], SIZES, BITS)))
    x, y = np.concatenate(means), codes[of].astype(float)
    a, c = np.full(x.shape[1], 4.0), np.zeros(x.shape[1])
    for _ in range(300):  # logistic calibration of each bit
        p = ngrams.sigmoid(-(a * x + c) * y)
        a += 4.0 * ((p * y * x).mean(axis=0) - 1e-3 * a)
        c += 1.0 * (p * y).mean(axis=0)
    right = ((a * x + c) * y > 0).mean(axis=0)
    model.scale, model.shift, model.weight = a, c, np.maximum(2 * right - 1, 0.01)
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, held_out: int = 2, mod: int = 4) -> LanguageModel:
    """Learns from text and non-null lang of rows whose crc32(doc_id) modulo ``mod`` isn't ``held_out``.

    At most about ``per_language`` rows of each language are picked, by hash of their id, so a
    language with few rows keeps them all; their texts are bounded in bytes too (``sample_texts``).
    A doc_id of several languages counts for the least. Nothing to learn from gives ``und`` for all.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (split_rest(F.col("doc_id"), mod) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("lang").cast("string")).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return fit([], [])
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    rows = sample_texts(docs.where("text IS NOT NULL"), picked, 2 * per_language * len(sizes))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, ambiguous.

    ``und`` with score 0 where text is null or has no letter; only the text is looked at, all of
    it. Repeated rows each have their row, a null doc_id stays null and is split as an
    empty id, further columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            names, score, flag = sent.value.decode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(flag)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (split_rest(F.col("doc_id"), 4) == 2).alias("held_out"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of ``docs``, with their columns, in a language that the model knows: neither ``und`` nor flagged as a near tie.

    Null and empty texts and texts without a letter go; repeated rows stay or go alike; an empty
    table stays empty.
    """
    spark = docs.sparkSession
    text_batches(spark)
    sent, at, schema = spark.sparkContext.broadcast(model), docs.columns.index("text"), docs.schema

    def run(batches):
        for b in batches:
            names, _, flag = sent.value.decode(b.column(at).to_pylist())
            ok = [n != UNKNOWN and not f for n, f in zip(names, flag, strict=True)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, schema)
