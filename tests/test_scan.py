"""Running values over ranges of ordered rows equal plain windows, also where all rows are of one key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import outcomes, scan, timeline, transcript, usage, view
from tidewell.sources.scratch import Scratch


def rows_of(spark, keys, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), i, rng.choice([None, rng.randint(-5, 5)]), rng.choice("abc")) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, seq long, x int, kind string")


@pytest.mark.parametrize("keys", [["one"], ["a", "b", None, "c" * 50], [str(i) for i in range(150)]])
@pytest.mark.parametrize("parts", [None, 7])
def test_values(spark, keys, parts):
    rows = rows_of(spark, keys)
    o = scan.Ordered(rows, "k", ["seq"], None, parts)
    got = o.values(total=scan.total("x"), n=scan.count(), high=scan.highest("x"), low=scan.lowest("x"), last=scan.last("x"), above=scan.above("x")).plain()
    at = Window.partitionBy("k").orderBy("seq")
    run = at.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("*", F.coalesce(F.sum("x").over(run), F.lit(0)).alias("total"), F.count("*").over(run).alias("n"), F.max("x").over(run).alias("high"), F.min("x").over(run).alias("low"), F.last("x", ignorenulls=True).over(run).alias("last"), F.lag(F.struct(F.col("x").alias("v"))).over(at).alias("above"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    if parts:
        spread = o.rows.groupBy("k").agg(F.countDistinct("_part").alias("n")).agg(F.max("n")).first()[0]
        assert spread > 1  # a large key spans several ranges


def test_nothing(spark):
    got = scan.Ordered(rows_of(spark, ["a"]).where("false"), "k", ["seq"]).values(n=scan.count()).plain()
    assert got.collect() == []


def test_one_session_is_many_tasks(spark):
    """Operators over ordered rows give the same on one session cut into ranges, and no window is over a session's raw rows."""
    rng = random.Random(3)
    lines = spark.createDataFrame([("s", i, rng.random() < 0.1, rng.random() < 0.5, rng.randint(1, 4)) for i in range(500)], "file string, line_no long, is_prompt boolean, is_work boolean, n_events long")
    entries = spark.createDataFrame([("s", i, rng.choice(["tool", "tool", "text"]), "t", rng.random() < 0.9, rng.choice(["ok", "failed", None])) for i in range(500)], "session string, seq long, kind string, text string, settled boolean, verdict string")
    calls = spark.createDataFrame([("k", i) for i in range(0, 300, 3)], "key string, line_no long")
    results = spark.createDataFrame([("k", i, rng.choice(["ok", "failed"])) for i in range(0, 290, 7)], "key string, line_no long, verdict string")
    cases = [
        lambda p: timeline.episodes(lines, parts=p), lambda p: timeline.reverse_page(lines, None, 90, parts=p), lambda p: usage.replay(entries.select("session", "seq"), 450, 70, parts=p),
        lambda p: view.tool_runs(entries, parts=p), lambda p: view.merged_text(entries, parts=p), lambda p: outcomes.first_outcome(calls, results, ["key"], parts=p),
    ]
    for case in cases:
        one, many = case(1), case(6)
        assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect())) and many.count() > 0
        plan = many._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.split("\n") if "Window [" in x]
        assert windows and all("_part" in x for x in windows)


def stack(ops):
    """Plain form: nameless results take the latest call that has no answer yet."""
    open_, out = [], {}
    for seq, op, until in sorted(ops):
        open_ = [c for c in open_ if c[1] > seq]
        if op == "call":
            open_.append((seq, until if until is not None else 1 << 60))
        elif open_:
            out[seq] = open_.pop()[0]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_nameless_results_find_their_calls(spark, seed):
    rng = random.Random(seed)
    ops, want = [], {}
    for s in ("s", "t", "u"):
        mine = []
        for i in range(rng.choice([5, 40])):
            op = rng.choice(["call", "call", "pop"])
            mine.append((2 * i, op, 2 * i + 2 * rng.randint(1, 8) + 1 if op == "call" and rng.random() < 0.6 else None))
        ops += [(s, *m) for m in mine]
        want |= {(s, k): v for k, v in stack(mine).items()}
    got = transcript.unanswered(spark.createDataFrame([(s, q, op, u) for s, q, op, u in ops], "session string, seq long, op string, until long"), Scratch(spark, "t").table, parts=3)
    assert {(r.session, r.seq): r.call_seq for r in got.collect()} == want
