"""Streams run to the end give what their batch twins give, however the input is cut into files."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators import timeline, usage
from tidewell.plans.tables import lines
from tidewell.streaming import sessions


@pytest.fixture
def cut(spark, sf, tmp_path):
    """Conversation lines in three files, turn by turn."""
    df = lines(spark, sf)
    for lo, hi in ((0, 2), (2, 4), (4, 99)):
        df.where((F.col("line_no") >= lo) & (F.col("line_no") < hi)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), tmp_path


def test_incremental_count_equals_the_batch(cut):
    df, stream, where = cut
    out = sessions.run_once(sessions.incremental_count(stream), str(where / "run"))
    got = {r.file: (r.interactions, r.context) for r in sessions.newest(out, ["file"], "line_no").collect()}
    want = {r.file: (r.interactions, r.context) for r in timeline.since_compaction(df).collect()}
    last = {r.file: 0 for r in df.where("is_compaction").collect()}
    assert {k: v for k, v in got.items() if k in want} == want and all(got[k] == (0, None) for k in set(got) - set(want)) and set(got) - set(want) <= set(last)


def test_session_state_equals_the_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "error", "exit").otherwise("other").alias("kind"), F.col("value").alias("cost"))
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = sessions.run_once(sessions.session_state(stream), f"{tmp_path}/run")
    got = {tuple(r) for r in sessions.newest(out, ["session"], "batch").drop("batch").collect()}
    assert got == {tuple(r) for r in usage.session_state(e).collect()}


def test_landmarks_and_usage(spark, cut, tmp_path):
    _, stream, where = cut
    marks = sessions.run_once(sessions.landmarks(stream), str(where / "marks"), mode="append")
    assert {r.mark for r in marks.collect()} <= {"prompt", "compacted", "command"} and marks.count() > 0
    rows = [("w", 100, 0.5, 1), ("w", 130, 0.4, 2), ("w", 500, 0.1, 3), ("w", 480, 0.3, 4), ("v", 10, 0.2, 1)]
    r = spark.createDataFrame(rows, "window string, resets_at long, utilization double, at long")
    r.coalesce(1).write.parquet(f"{tmp_path}/u")
    out = sessions.run_once(sessions.usage_merge(spark.readStream.schema(r.schema).parquet(f"{tmp_path}/u")), f"{tmp_path}/urun")
    assert {x.window: (x.resets_at, x.utilization) for x in out.collect()} == {"w": (480, 0.3), "v": (10, 0.2)}
    assert {x.window: (x.resets_at, x.utilization) for x in usage.fresher(r).collect()} == {"w": (480, 0.3), "v": (10, 0.2)}
