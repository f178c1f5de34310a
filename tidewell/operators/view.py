"""What a reader of a transcript sees: merged text, runs of tool calls, landmarks by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import islands

def is_command(text: Column) -> Column:
    """A slash command: one word after the slash, without a second slash in it."""
    return text.rlike(r"^/[A-Za-z][A-Za-z0-9_:-]*(\s|$)")


def merged_text(entries: DataFrame, by: str = "session", order: str = "seq", save=None, parts: int | None = None) -> DataFrame:
    """Consecutive entries of one kind as one: first place, number of parts, characters."""
    n = islands(entries, ["kind"], by, order, save, parts)
    return n.groupBy(by, "run", "kind").agg(F.min(order).alias("first"), F.count("*").alias("parts"), F.sum(F.char_length("text")).alias("chars")).drop("run")


def tool_runs(entries: DataFrame, least: int = 2, by: str = "session", order: str = "seq", save=None, parts: int | None = None) -> DataFrame:
    """Blocks of at least ``least`` consecutive settled tool entries, with how their calls went."""
    settled = (F.col("kind") == "tool") & F.col("settled")
    n = islands(entries.withColumn("_ok", settled), ["_ok"], by, order, save, parts).where("_ok")
    counts = [F.count("*").alias("calls"), F.count_if(F.col("verdict") == "failed").alias("failed"), F.count_if(F.col("verdict").isNull()).alias("unrecorded")]
    return n.groupBy(by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), *counts).where(F.col("calls") >= least).drop("run")


def landmarks_by_day(marks: DataFrame) -> DataFrame:
    """Landmarks of each day; undated ones last."""
    return marks.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("landmarks")).orderBy(F.desc_nulls_last("day"))


def index_entry_cost(index: Column, name: Column) -> Column:
    """Bytes of the index line that links a note, with its line end; 0 if there is none."""
    line = F.call_function("regexp_extract", index, F.concat(F.lit(r"(?m)^(.*\]\("), name, F.lit(r"\.md\).*)$")), F.lit(1))
    return F.when(line != "", F.octet_length(line) + 2).otherwise(0)


def run_counts(entries: DataFrame, by: str = "session") -> DataFrame:
    """Tool entries (settled, verdict) of each session: calls, failed, running, and settled ones without a record."""
    tool, settled, verdict = F.col("kind") == "tool", F.col("settled"), F.col("verdict")
    return entries.where(tool).groupBy(by).agg(F.count("*").alias("calls"), F.count_if(settled & (verdict == "failed")).alias("failed"), F.count_if(~settled).alias("running"), F.count_if(settled & verdict.isNull()).alias("unrecorded"))
