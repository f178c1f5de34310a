"""Documents to packed training windows: five stages, each written and read again before the next.

1. language ID: rows whose language isn't known (``und``, or flagged as a near tie) go;
2. exact deduplication: of equal texts the row with the least doc_id stays;
3. near-deduplication: of each component of near-duplicates the least doc_id stays;
4. personal data: spans are replaced by their kind's name;
5. packing: the texts' token ids are packed into windows of 2048.

Every stage works on all rows that its predecessor kept, and gives an empty table for an empty one. Stages 1 to 4 return the columns of
``documents``; the last returns one row per piece. SQL can't express the models, so there is no
ORACLE_SQL; ``tests/llm/test_pipeline.py`` holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import exact_dedup, language, near_dedup, packing, pii
from tidewell.llm.common import Scratch, table

ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows in a language learned from ``docs``; null, empty and letterless texts and near ties go."""
    return language.keep_known(docs, language.train(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, that of the least doc_id (null ids last); null text is empty text."""
    return exact_dedup.drop_copies(docs, Scratch(spark, "pipeline-exact"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each component (five words, 0.8); rows without words or doc_id stay."""
    return near_dedup.keep_one(docs, Scratch(spark, "pipeline-near"), width=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all rows, with spans masked; null and empty texts stay as they are."""
    return pii.masked(docs, pii.train_on(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece; every row is packed, null text as its end id alone."""
    return packing.pack(docs, Scratch(spark, "pipeline-pack"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
