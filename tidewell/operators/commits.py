"""Commits: attribution by hash mention, renames followed, lines by agent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import attributable


def attribute(commits: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each commit's (sha) first mention (agent, hash, stamp, seq) by a prefix of its hash; ties keep the first seen.

    Joined on the first seven signs, then tested on the whole prefix.
    """
    c = commits.select("sha", F.substring("sha", 1, 7).alias("k"))
    m = mentions.select("agent", "hash", "stamp", "seq", F.substring("hash", 1, 7).alias("k"))
    hit = c.join(m, "k").where(F.col("sha").startswith(F.col("hash")))
    first = hit.groupBy("sha").agg(F.min(F.struct("stamp", "seq", "agent")).alias("x"))
    return commits.join(first, "sha", "left").withColumn("agent", F.col("x.agent")).drop("x")


def lines(deltas: DataFrame) -> DataFrame:
    """Added, deleted and commits by agent and path; generated files and leftovers are nobody's work."""
    return deltas.where(attributable(F.col("path"))).groupBy("agent", "path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count_distinct("sha").alias("commits"))


def follow_renames(steps: DataFrame, hops: int = 8) -> DataFrame:
    """(path, now): old names to present ones over at most ``hops`` newest steps (was, path, at).

    Steps to itself don't count, and a walk that comes back to its start ends before that.
    """
    one = steps.where("was <> path").groupBy("was").agg(F.max_by("path", "at").alias("to"))
    walk = one.select(F.col("was").alias("path"), F.col("to").alias("now"))
    for _ in range(hops - 1):
        nxt = one.select(F.col("was").alias("now"), F.col("to").alias("next"))
        walk = walk.join(nxt, "now", "left").select("path", F.when(F.col("next").isNotNull() & (F.col("next") != F.col("path")), F.col("next")).otherwise(F.col("now")).alias("now"))
    return walk


def fold_renames(facts: DataFrame, renames: DataFrame, sums: list[str]) -> DataFrame:
    """Facts by (agent, path) with old names replaced and summed again."""
    moved = facts.join(renames, "path", "left").withColumn("path", F.coalesce("now", "path"))
    return moved.groupBy("agent", "path").agg(*[F.sum(c).alias(c) for c in sums])


def first_writers(writes: DataFrame, notes: DataFrame) -> DataFrame:
    """(name, session, at) of the earliest write (path, session, at) to each note that states no session itself.

    Writes by tools and by shells count alike; a path belongs to the note whose file name it ends with.
    """
    wanted = notes.where(F.coalesce("origin_session", F.lit("")) == "").select("name")
    named = writes.withColumn("name", F.regexp_extract("path", r"([^/]+)\.md$", 1)).where("at IS NOT NULL")
    return named.join(wanted, "name", "left_semi").groupBy("name").agg(F.min_by("session", F.struct("at", "session")).alias("session"), F.min("at").alias("at"))
