"""Structured Streaming over session events: counts since compaction, state, landmarks, usage.

Each has a batch twin in ``operators``; run to the end over the same events both give the same.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import usage
from ..ship import ship


def landmarks(lines: DataFrame) -> DataFrame:
    """Stateless: prompts, commands and compactions as they arrive, with their sign.

    A line number below 0 says that the file was replaced; it is passed on as ``restarted``, and what was
    given for the file before it counts no more.
    """
    from ..functions.text import sign

    mark = F.when(F.col("line_no") < 0, "restarted").when(F.col("is_compaction"), "compacted").when(F.col("text").startswith("/"), "command").when(F.col("is_prompt"), "prompt")
    return lines.select("file", "line_no", mark.alias("mark"), sign(F.col("text")).alias("sign")).where("mark IS NOT NULL")


def session_state(events: DataFrame) -> DataFrame:
    """The batch fold is itself an aggregation by key, so it streams as it is (update mode)."""
    return usage.session_state(events)


def _count(key, frames, state):
    """Prompts since the last compaction, and the last context after it."""
    seen, interactions, context = state.get if state.exists else (-1, 0, None)
    rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.line_no)
    for r in rows:
        if r.line_no <= seen:
            continue  # delivered again
        seen = r.line_no
        if r.is_compaction:
            interactions, context = 0, None
            continue
        interactions += bool(r.is_prompt)
        if r.context is not None and not pd.isna(r.context):
            context = int(r.context)
    state.update((int(seen), int(interactions), context))
    yield pd.DataFrame({"file": [key[0]], "line_no": [int(seen)], "interactions": [int(interactions)], "context": pd.array([context], dtype="Int64")})


def incremental_count(lines: DataFrame) -> DataFrame:
    """Per file the count so far, from appended lines only; lines already seen don't count again."""
    ship(lines.sparkSession)
    return lines.groupBy("file").applyInPandasWithState(_count, "file long, line_no long, interactions long, context long", "seen long, interactions long, context long", "update", "NoTimeout")


def _appended(key, frames, state):
    """Prompts since the last compaction and the last context after it, by byte offset; a replaced file starts again."""
    through, interactions, context = state.get if state.exists else (0, 0, None)
    for r in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.at):
        if r.at < 0:
            through, interactions, context = 0, 0, None
            continue
        if r.at < through:
            continue  # delivered again
        through = r.next
        if r.is_compaction:
            interactions, context = 0, None
            continue
        interactions += bool(r.is_prompt)
        if r.context is not None and not pd.isna(r.context):
            context = int(r.context)
    state.update((int(through), int(interactions), context))
    yield pd.DataFrame({"file": [key[0]], "through": [int(through)], "interactions": [int(interactions)], "context": pd.array([context], dtype="Int64")})


def appended_count(rows: DataFrame) -> DataFrame:
    """The count of each file of appended lines (file, at, next, is_prompt, is_compaction, context) so far.

    Only bytes that were appended are read and counted. A row with ``at`` below 0 says that its file was
    replaced: what was counted is of a file that is gone.
    """
    ship(rows.sparkSession)
    return rows.groupBy("file").applyInPandasWithState(_appended, "file string, through long, interactions long, context long", "through long, interactions long, context long", "update", "NoTimeout")


def _fresher(key, frames, state):
    held = tuple(state.get) if state.exists else None
    rows = sorted(((r.resets_at, r.utilization, r.at) for f in frames for r in f.itertuples(index=False)), key=lambda r: r[2])
    held = usage.fold_fresher([*([held] if held else []), *rows])
    state.update((int(held[0]), float(held[1]), int(held[2])))
    yield pd.DataFrame({"window": [key[0]], "resets_at": [int(held[0])], "utilization": [float(held[1])], "at": [int(held[2])]})


def usage_merge(readings: DataFrame) -> DataFrame:
    """The reading that counts for each window, folded in order of observation."""
    ship(readings.sparkSession)
    return readings.groupBy("window").applyInPandasWithState(_fresher, "window string, resets_at long, utilization double, at long", "resets_at long, utilization double, at long", "update", "NoTimeout")


def distinct_calls(calls: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each call id once, as long as its copies come within the watermark."""
    return calls.withWatermark("stamp", lateness).dropDuplicatesWithinWatermark(["call_id"])


def newest(updates: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last of the updates of each key."""
    rest = [c for c in updates.columns if c not in by]
    return updates.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*by, "x.*")


def _started(stream: DataFrame, where: str, mode: str, trigger: dict):
    def put(df: DataFrame, n: int) -> None:
        df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{where}/out/{n}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(**trigger).foreachBatch(put).start()


def _put_out(spark, where: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{where}/out")


def run_once(stream: DataFrame, where: str, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there and returns what it put out, batch by batch (column ``batch``).

    Not for timers by the clock, which leave always one more batch to run: see ``run_for``.
    """
    _started(stream, where, mode, {"availableNow": True}).awaitTermination()
    return _put_out(stream.sparkSession, where)


def run_for(stream: DataFrame, where: str, seconds: int, every: str = "1 second", mode: str = "update") -> DataFrame:
    """Runs a stream for some seconds, a batch ``every`` so often, and returns what it put out."""
    query = _started(stream, where, mode, {"processingTime": every})
    query.awaitTermination(seconds)
    query.stop()
    return _put_out(stream.sparkSession, where)
