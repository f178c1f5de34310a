"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import sample_texts, split_rest, text_batches

SIZES, BITS = (5, 8), 20
#: Labelled rows to learn from, at most (picked by hash of the id).
LEARN = 5000
#: An n-gram counts if so many learning texts hold it and its ratio is at least so far from 0.
LEAST_TEXTS, LEAST_RATIO = 4, 1.5


@dataclass
class ToxicModel:
    weight: np.ndarray  # weight times log-count ratio, by hashed n-gram
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.weight[ngrams.distinct(ngrams.lowered(t), SIZES, BITS)].sum(dtype=np.float64) for t in texts])
        return ngrams.sigmoid(z + self.bias)


def fit(texts: list[str | None], labels: list[int], rounds: int = 300, penalty: float = 1e-4) -> ToxicModel:
    """Log-count ratios of presence, then logistic weights on the ratios (full-batch Adam).

    The rarer class weighs more, by the square root of how much rarer it is.
    """
    y = np.array(labels, np.float64)
    d = 1 << BITS
    if not len(y) or y.min() == y.max():
        prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return ToxicModel(np.zeros(d, np.float32), prior)
    pos, neg = np.zeros(d, np.float32), np.zeros(d, np.float32)
    for t, v in zip(texts, y, strict=True):
        (pos if v else neg)[ngrams.distinct(ngrams.lowered(t), SIZES, BITS)] += 1
    ratio = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / (len(y) - y.sum() + 2))
    ratio[(pos + neg < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    kept = np.flatnonzero(ratio)
    spot = np.full(d, -1, np.int32)
    spot[kept] = np.arange(len(kept))
    cols = [spot[ngrams.distinct(ngrams.lowered(t), SIZES, BITS)] for t in texts]  # again: keeping all would cost memory
    cols = [c[c >= 0] for c in cols]
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    cols = np.concatenate(cols)
    r = ratio[kept]
    heavy = np.where(y > 0, np.sqrt((len(y) - y.sum()) / y.sum()), 1.0)
    w, b = np.full(len(kept), 0.05), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        z = np.bincount(rows, (w * r)[cols], minlength=len(y)) + b
        e = (ngrams.sigmoid(z) - y) * heavy
        g = np.bincount(cols, e[rows], minlength=len(kept)) * r / len(y) + penalty * w
        gb = e.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.01 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        b -= 0.02 * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-8)
    weight = np.zeros(d, np.float32)
    weight[kept] = w * r
    return ToxicModel(weight, b)


def labelled(docs: DataFrame, labels: DataFrame, col: str, bound: int, where) -> list[tuple[int, str, int]]:
    """At most ``bound`` (doc_id, text, label) rows in order of doc_id, bounded in bytes too (``sample_texts``).

    Null labels and ids are left out; an id of several labels has the greatest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(where)
    return [tuple(r) for r in sample_texts(docs, known.groupBy("doc_id").agg(F.max("y").alias("y")), bound)]


def train(docs: DataFrame, labels: DataFrame, bound: int = LEARN, mod: int = 5) -> ToxicModel:
    """Learns from at most ``bound`` labelled rows whose crc32(doc_id) modulo ``mod`` isn't 0; from none it learns nothing."""
    rows = labelled(docs, labels, "toxic", bound, split_rest(F.col("doc_id"), mod) != 0)
    return fit([r[1] for r in rows], [int(r[2] > 0) for r in rows])


def toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The score depends on the whole text alone; null counts as empty, which scores as the prior does.
    Repeated rows each have their row, a null doc_id stays null and is split as an empty id, further
    columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = sent.value.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (split_rest(F.col("doc_id"), 5) == 0).alias("held_out"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
