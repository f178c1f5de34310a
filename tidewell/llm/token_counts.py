"""Token counts without ids: pieces once per distinct pre-token, joined to per-document pre-token frequencies.

The distinct pre-tokens of all texts form a table, and the BPE model is asked once for each of them
for its number of pieces. The frequencies (row, pre-token, how often) are then joined to it and summed
for each row. Pre-tokens are as hot as keys get ("the"), so those that most rows have are broadcast, a
bounded number of bounded length, and all others meet by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, is_empty, join_counted, text_batches
from .pretokens import pre_tokens, vocabulary

#: Pre-tokens that are broadcast, at most, and their length in characters: at most about 30 MB.
HOT, HOT_LENGTH = 200_000, 64


def _distinct(vocab: str | None):
    """Distinct pre-tokens of each batch and the number of texts in it that have them."""

    def run(batches):
        tokens = pre_tokens(vocab or vocabulary())
        for b in batches:
            _, names, name, _ = tokens.frequencies(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.bincount(name, minlength=len(names)), pa.int64())], names=["token", "n"])

    return run


def _sizes(vocab: str | None):
    def run(batches):
        tokens = pre_tokens(vocab or vocabulary())
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("token"), b.column("n"), pa.array(tokens.sizes(b.column("token").to_pylist()), pa.int64())], names=["token", "n", "pieces"])

    return run


def _frequencies(vocab: str | None):
    def run(batches):
        tokens = pre_tokens(vocab or vocabulary())
        for b in batches:
            text, names, name, n = tokens.frequencies(b.column("text").to_pylist())
            token = pa.array(names, pa.string()).take(pa.array(name, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(text, pa.int64())), token, pa.array(n, pa.int64())], names=["row", "token", "times"])

    return run


def token_counts(docs: DataFrame, scratch: Scratch, vocab: str | None = None, limit: int = 2048, stored: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows each have
    their row; an empty table gives an empty result; further columns are ignored. Special strings in
    a text count as the library counts them. ``stored`` says that ``docs`` is a plain read of Parquet
    files; otherwise it is saved first, as rows are numbered by their places.
    """
    text_batches(docs.sparkSession)
    plain = docs.selectExpr("cast(doc_id AS long) doc_id", "coalesce(cast(text AS string), '') text")
    plain = (plain if stored else scratch.table(plain, "texts")).withColumn("row", F.monotonically_increasing_id())
    distinct = plain.select("text").mapInArrow(_distinct(vocab), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    pieces = scratch.table(distinct.mapInArrow(_sizes(vocab), "token string, n long, pieces long"), "pieces")
    # the hot ones by a least frequency: from the histogram of their magnitudes, at most HOT of them
    size = F.floor(F.log2("n") * 8)
    able = pieces.where(F.length("token") <= HOT_LENGTH)
    least, left = None, HOT
    for r in able.groupBy(size.alias("size")).agg(F.count("*").alias("tokens")).orderBy(F.desc("size")).collect():  # some hundred rows
        left -= r["tokens"]
        if left < 0:
            break
        least = r["size"]
    hot = scratch.table(able.where(F.lit(False) if least is None else size >= least).select("token", "pieces"), "hot")
    cold = scratch.table(pieces.join(F.broadcast(hot.select("token")), "token", "left_anti"), "cold")
    per_row = plain.select("row", "text").mapInArrow(_frequencies(vocab), "row long, token string, times long")
    found = per_row.join(F.broadcast(hot), "token").select("row", (F.col("times") * F.col("pieces")).alias("tokens"))
    if not is_empty(cold):
        rest = join_counted(per_row.join(F.broadcast(hot.select("token")), "token", "left_anti"), cold, "token")
        found = found.unionByName(rest.select("row", (F.col("times") * F.col("pieces")).alias("tokens")))
    rows = plain.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("tokens"))
    every = rows.unionByName(found, allowMissingColumns=True).groupBy("row")
    out = every.agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
