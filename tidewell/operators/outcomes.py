"""Calls and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def first_outcome(calls: DataFrame, results: DataFrame, key: list[str], order: str = "line_no", save=None, parts: int | None = None) -> DataFrame:
    """Each call with the verdict of its first result at or after it, else ``unknown`` (deferred resolution).

    Calls and results of a key are read once from the last to the first, in ranges of their order, so
    a key of many of either costs neither pairs nor one long task; identical calls each keep their row.
    """
    both = calls.withColumn("_verdict", F.lit(None).cast("string")).withColumn("_call", F.lit(True)).unionByName(
        results.select(*key, order, F.col("verdict").alias("_verdict"), F.lit(False).alias("_call")), allowMissingColumns=True
    )
    back = scan.Ordered(both, key, [F.desc(order), F.col("_call")], save, parts).values(_near=scan.last("_verdict")).plain()
    return back.where("_call").select(*calls.columns, F.coalesce("_near", F.lit("unknown")).alias("verdict"))


def last_outcome(calls: DataFrame, results: DataFrame, key: list[str], order: str = "line_no") -> DataFrame:
    """Each call with the verdict of the last result of its key, else ``unknown`` (file counts)."""
    last = results.groupBy(*key).agg(F.max_by("verdict", order).alias("verdict"))
    return calls.join(last, key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("unknown")))


def admits(verdict: Column, reached: Column) -> Column:
    """Whether a use certainly happened: rejected never, always-reached else, on-success only after ok."""
    return (verdict != "rejected") & ((reached == "always") | ((verdict == "ok") & (reached == "on-success")))


def reached_and(outer: Column, inner: Column) -> Column:
    """Reach of a nested command."""
    return F.when(outer == "always", inner).when(inner == "always", outer).when((outer == "on-success") & (inner == "on-success"), F.lit("on-success")).otherwise("sometimes")


def with_refusals(calls: DataFrame, refusals: DataFrame, key: str = "call_id") -> DataFrame:
    """Calls with the directories that the shell refused them (an empty array without any)."""
    return calls.join(refusals, key, "left").withColumn("refused", F.coalesce("refused", F.array().cast("array<string>")))
