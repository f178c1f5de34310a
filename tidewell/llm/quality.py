"""Quality: ordinal cumulative-link regression on graded ratings.

One weight for each hashed n-gram is shared by all grades, P(grade >= k) = sigmoid(w.x - t_k), and
the thresholds t_1 < t_2 < ... are ordered by construction. The result is each text's expected
grade and tail probabilities, by which texts are selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import text_batches
from .toxicity import labelled

SIZES, BITS = (1, 2, 3), 12
#: Rated rows to learn from, at most (picked by hash of the id).
LEARN = 4000
GRADES = 3


@dataclass
class QualityModel:
    weight: np.ndarray
    cuts: np.ndarray  # ascending

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades-1, a row for each text."""
        z = features(texts) @ self.weight
        return ngrams.sigmoid(z[:, None] - self.cuts[None, :])


def features(texts: list[str | None]) -> np.ndarray:
    """Square roots of hashed n-gram counts, scaled to length 10 (so long and short texts compare)."""
    x = np.sqrt(ngrams.count_matrix(texts, SIZES, BITS))
    return x * (10 / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))


def fit(texts: list[str | None], grades: list[int], n_grades: int = GRADES, rounds: int = 250, penalty: float = 1e-4) -> QualityModel:
    d = 1 << BITS
    y = np.array(grades, np.int64)
    k = n_grades - 1
    if not len(y):
        return QualityModel(np.zeros(d, np.float32), np.arange(k, dtype=float))
    x = np.concatenate([features(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    share = np.clip([(y >= j).mean() for j in range(1, n_grades)], 0.01, 0.99)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(k))
    theta = np.concatenate(([start[0]], np.log(np.maximum(np.diff(start), 1e-2))))  # first cut, log gaps
    w = np.zeros(d)
    state = [[np.zeros(d), np.zeros(d)], [np.zeros(k), np.zeros(k)]]
    for t in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate(([theta[0]], np.exp(theta[1:]))))
        p = ngrams.sigmoid((x @ w.astype(np.float32)).astype(np.float64)[:, None] - cuts)  # tails
        full = np.concatenate((np.ones((len(y), 1)), p, np.zeros((len(y), 1))), axis=1)
        mass = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-9)
        slope = np.concatenate((np.zeros((len(y), 1)), p * (1 - p), np.zeros((len(y), 1))), axis=1)
        up, down = slope[np.arange(len(y)), y] / mass, slope[np.arange(len(y)), y + 1] / mass
        dz = -(up - down) / len(y)
        gw = (dz.astype(np.float32) @ x).astype(np.float64) + penalty * w
        dc = np.zeros(k)
        for j in range(1, n_grades):  # a higher cut lowers that tail
            dc[j - 1] = (up[y == j].sum() - down[y == j - 1].sum()) / len(y)
        tail = np.cumsum(dc[::-1])[::-1]
        gt = np.concatenate(([tail[0]], tail[1:] * np.exp(theta[1:])))
        for (m, v), g, target, rate in ((state[0], gw, w, 0.02), (state[1], gt, theta, 0.05)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            target -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    cuts = np.cumsum(np.concatenate(([theta[0]], np.exp(theta[1:]))))
    return QualityModel(w.astype(np.float32), cuts)


def train(docs: DataFrame, ratings: DataFrame, grade: str = "grade", bound: int = LEARN, n_grades: int = GRADES) -> QualityModel:
    """Learns from at most ``bound`` rated rows; ``ratings`` has doc_id and a grade from 0 to n_grades-1.

    Rows whose grade is null or outside that range are left out.
    """
    rows = labelled(docs, ratings, grade, bound, f"y BETWEEN 0 AND {n_grades - 1}")
    return fit([r[1] for r in rows], [r[2] for r in rows], n_grades)


def quality(docs: DataFrame, model: QualityModel, least: int = 1, chance: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, tails (P(grade >= k), k from 1), selected.

    Selected are texts whose P(grade >= least) is at least ``chance``. The whole text counts. Null, empty
    and blank texts hold nothing to rate: their tails are 0, and they aren't selected. Repeated rows each have their row, a null doc_id
    stays null, further columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            p = sent.value.tails(texts).astype(np.float64)
            p[[not (t and t.strip()) for t in texts]] = 0.0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(list(p), pa.list_(pa.float64())), pa.array(p[:, least - 1] >= chance)], names=["doc_id", "expected_grade", "tails", "selected"]
            )

    plain = docs.selectExpr("cast(doc_id AS long) doc_id", "cast(text AS string) text")
    return plain.mapInArrow(run, "doc_id long, expected_grade double, tails array<double>, selected boolean")
