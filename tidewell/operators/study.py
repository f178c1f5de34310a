"""Matched difference-in-differences study."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(opens: DataFrame, at: int, days: int = 28) -> DataFrame:
    """Opens (name, day) to counts in [at-days, at) and [at, at+days)."""
    d = F.col("day")
    return opens.groupBy("name").agg(F.count_if((d >= at - days) & (d < at)).alias("pre"), F.count_if((d >= at) & (d < at + days)).alias("post"))


def match(subjects: DataFrame) -> DataFrame:
    """Each treated subject with the next unused control of equal pre count, both by name."""
    rn = F.row_number().over(Window.partitionBy("treated", "pre").orderBy("name"))
    n = subjects.withColumn("rn", rn)
    t = n.where("treated").select("pre", "rn", F.col("name").alias("treated_name"), F.col("post").alias("treated_post"), "role")
    c = n.where("NOT treated").select("pre", "rn", F.col("name").alias("control_name"), F.col("post").alias("control_post"))
    return t.join(c, ["pre", "rn"])


def unmatched(subjects: DataFrame, pairs: DataFrame) -> DataFrame:
    return subjects.where("treated").join(pairs.select(F.col("treated_name").alias("name")), "name", "left_anti")


def estimate(pairs: DataFrame, arm: str = "all", where: Column | None = None) -> DataFrame:
    """One row; an arm without pairs is all zeros."""
    p = pairs if where is None else pairs.where(where)
    t, c = F.col("treated_post") - F.col("pre"), F.col("control_post") - F.col("pre")
    zero = F.lit(0.0)
    return p.agg(F.count("*").alias("pairs"), F.count_if(F.col("pre") > 0).alias("informative"), F.coalesce(F.avg(t), zero).alias("treated_change"), F.coalesce(F.avg(c), zero).alias("control_change"), F.coalesce(F.avg(t) - F.avg(c), zero).alias("did")).withColumn("arm", F.lit(arm))


def by_arm(pairs: DataFrame) -> DataFrame:
    """All pairs, two name prefixes and two roles; the arms overlap."""
    name, role = F.col("treated_name"), F.col("role")
    arms = [("all", None), ("reference_", name.startswith("reference_")), ("project_", name.startswith("project_")), ("role: tripwire", role == "tripwire"), ("role: pointer", role == "pointer")]
    return reduce(DataFrame.unionByName, [estimate(pairs, a, w) for a, w in arms])


def demotion_candidates(standings: DataFrame, most_read: float = 1.0, k: int = 25) -> DataFrame:
    """Indexed notes that are no rules, read at most ``most_read`` (weighted) and linked from a reachable note."""
    ok = standings.where(F.col("indexed") & ~F.col("behavioural") & (F.col("weight") <= most_read) & (F.col("homes") > 0))
    return ok.orderBy("weight", "name").limit(k)


def stability(full: DataFrame, halved: DataFrame, k: int = 30) -> DataFrame:
    """How many of the top k by one weight aren't among the top k by the other."""
    a = full.orderBy(F.desc("weight"), "name").limit(k)
    b = halved.orderBy(F.desc("weight"), "name").limit(k)
    return a.join(b, "name", "left_anti").agg(F.count("*").alias("changed"))


def snapshot_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Treated are names that went; controls those that stayed."""
    gone = before.select("name").join(after, "name", "left_anti").distinct().withColumn("treated", F.lit(True))
    return gone.unionByName(after.select("name").distinct().withColumn("treated", F.lit(False)))


#: Rows of a list; most weighted reads of what is rarely opened; least of what is still consulted.
LISTED, RARELY, CONSULTED = 15, 1.0, 0.5


def lists(standings: DataFrame) -> DataFrame:
    """(list, name, weight, place): indexed notes without a home that are rarely opened (by name), notes off the
    index that are still consulted (most first), and indexed rules (never opened ones first)."""
    s, w = standings, F.col("weight")

    def top(name: str, where, order):
        few = s.where(where).orderBy(*order).limit(LISTED)
        return few.select(F.lit(name).alias("list"), "name", "weight", F.row_number().over(Window.orderBy(*order)).alias("place"))

    homeless = top("no home", F.col("indexed") & (F.col("homes") == 0) & (w <= RARELY) & ~F.col("behavioural"), ["name"])
    archive = top("still consulted", ~F.col("indexed") & (w > CONSULTED), [F.desc("weight"), "name"])
    rules = top("rules", F.col("behavioural") & F.col("indexed"), ["weight", "name"])
    return homeless.unionByName(archive).unionByName(rules)


def rule_counts(standings: DataFrame) -> DataFrame:
    """Indexed rules, and how many of them were never opened."""
    return standings.where(F.col("behavioural") & F.col("indexed")).agg(F.count("*").alias("rules"), F.count_if(F.col("weight") == 0).alias("never"))
