"""Co-use in as many partitions as rows ask for, against brute force."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from tidewell.operators import couse


def test_partitions_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(couse, "ROWS_OF_A_TASK", 100)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(9)]), rng.randrange(60), rng.randrange(12)) for _ in range(900)] + [(1, 1000, n) for n in range(50)]
    mentions = spark.createDataFrame(rows, "session int, turn int, name int")
    basket = couse.baskets(mentions)
    assert basket.rdd.getNumPartitions() == 10  # a task's rows stay bounded, whatever Spark would make of so small a shuffle
    turns = {}
    for s, t, n in rows:
        turns.setdefault((s, t), set()).add(n)
    kept = {k: v for k, v in turns.items() if 2 <= len(v) <= 40}
    assert sorted((r.session, r.turn, r.name) for r in basket.where("session IS NOT NULL").collect()) == sorted((*k, n) for k, v in kept.items() if k[0] is not None for n in v)
    want = {}
    for (s, _), names in kept.items():
        for p in combinations(sorted(names), 2) if s is not None else ():
            want.setdefault(p, []).append(s)
    got = {(r.a, r.b): (r.sessions, r.turns) for r in couse.pairs(basket, 10).collect()}
    assert got == {p: (len(set(s)), len(s)) for p, s in want.items() if len(set(s)) >= 3}
    full = mentions.select("*", F.lit("read").alias("role"), F.lit("2024").alias("stamp"), F.lit(1).alias("project"))
    sessions = {r.name: r.sessions for r in couse.usage(full, basket).collect()}
    assert sessions == {n: len({s for (s, _), v in kept.items() if n in v and s is not None}) for n in {r[2] for r in rows}}
