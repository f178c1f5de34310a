"""Co-use: baskets of names by turn, pairs, normalised pointwise mutual information, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of a turn, names of a line, and sessions that support a pair.
LEAST_NAMES, MOST_NAMES, MOST_IN_LINE, LEAST_SESSIONS = 2, 40, 6, 3
#: Rows of a task that groups rows by keys of which nearly each is its own group, and so holds them all.
ROWS_OF_A_TASK = 250_000


def parts_for(rows: int) -> int:
    """In how many partitions so many rows are grouped: their number grows and not a task's memory."""
    return rows // ROWS_OF_A_TASK + 1


def baskets(mentions: DataFrame, least: int = LEAST_NAMES, most: int = MOST_NAMES, parts: int | None = None) -> DataFrame:
    """(session, turn, name) rows of turns that name from ``least`` to ``most`` distinct names.

    The count is joined back, so a turn's names are never gathered in an array. Rows are dealt once, by turn,
    in ``parts`` partitions (by the number of mentions, unless given), and stay there.
    """
    dealt = mentions.select("session", "turn", "name").repartition(parts or parts_for(mentions.count()), "session", "turn")
    distinct = dealt.distinct()
    sizes = distinct.groupBy("session", "turn").agg(F.count("*").alias("k")).where(F.col("k").between(least, most))
    return distinct.join(sizes.drop("k").hint("merge"), ["session", "turn"], "left_semi")


def _sessions(basket: DataFrame, parts: int) -> DataFrame:
    """In how many sessions each name is."""
    return basket.select("name", "session").repartition(parts, "name", "session").distinct().groupBy("name").agg(F.count("*").alias("sessions"))


def short_lines(mentions: DataFrame, line: list[str], most: int = MOST_IN_LINE) -> DataFrame:
    """Mentions of lines that name at most ``most`` names."""
    sizes = mentions.groupBy(*line).agg(F.count_distinct("name").alias("k")).where(F.col("k") <= most).drop("k")
    return mentions.join(sizes, line, "left_semi")


def pairs(basket: DataFrame, transcripts, support: int = LEAST_SESSIONS) -> DataFrame:
    """Pairs a < b of names used in one turn: sessions, turns and npmi, of at least ``support`` sessions.

    ``transcripts`` is their number, or a scalar subquery for it; ``basket`` is read three times, so
    it had better be saved. A basket holds at most MOST_NAMES names, so a turn makes at most 780 pairs. Where npmi is 0/0 it is null.
    Pairs are counted by session first, in as many partitions as the rows ask for.
    """
    parts = parts_for(basket.count())
    dealt = basket.repartition(parts, "session", "turn")
    left = dealt.withColumnRenamed("name", "a")
    right = dealt.withColumnRenamed("name", "b")
    both = left.hint("merge").join(right, ["session", "turn"]).where("a < b").select("session", "a", "b")
    of_session = both.repartition(parts, "a", "b", "session").groupBy("a", "b", "session").agg(F.count("*").alias("turns"))
    of_pair = of_session.groupBy("a", "b").agg(F.count("session").alias("sessions"), F.sum("turns").alias("turns")).where(F.col("sessions") >= support)
    single = _sessions(basket.where("session IS NOT NULL"), parts).withColumnRenamed("sessions", "s")
    n = F.lit(float(transcripts)) if isinstance(transcripts, (int, float)) else transcripts
    joined = of_pair.join(single.select(F.col("name").alias("a"), F.col("s").alias("sa")), "a").join(single.select(F.col("name").alias("b"), F.col("s").alias("sb")), "b")
    pab = F.col("sessions") / n
    npmi = F.try_divide(F.ln(pab / ((F.col("sa") / n) * (F.col("sb") / n))), -F.ln(pab))
    return joined.select("a", "b", "sessions", "turns", npmi.alias("npmi"))


def usage(mentions: DataFrame, basket: DataFrame, parts: int | None = None) -> DataFrame:
    """Per name: lines that mention it, reads, edits, last stamp, projects; sessions only of kept baskets."""
    out = mentions.groupBy("name").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "read").alias("reads"), F.count_if(F.col("role") == "write").alias("edits"), F.max("stamp").alias("last"), F.count_distinct("project").alias("projects"))
    sessions = _sessions(basket.where("session IS NOT NULL"), parts or parts_for(basket.count()))
    return out.join(sessions, "name", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))


def usage_by_project(mentions: DataFrame) -> DataFrame:
    """(name, project, turns): in how many lines of each project a name is mentioned."""
    return mentions.groupBy("name", "project").agg(F.count("*").alias("turns"))


def unlinked(pair: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs without a written link in either direction."""
    known = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pair.join(known, ["a", "b"], "left_anti")


def companions(pair: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """Names used with ``root``, flagged as linked or not, by npmi and name."""
    both = pair.select(F.col("a").alias("root"), F.col("b").alias("name"), "npmi").unionByName(pair.select(F.col("b").alias("root"), F.col("a").alias("name"), "npmi"))
    near = links.where((F.col("src") == root) | (F.col("dst") == root)).select(F.when(F.col("src") == root, F.col("dst")).otherwise(F.col("src")).alias("name")).distinct().withColumn("linked", F.lit(True))
    return both.where(F.col("root") == root).join(near, "name", "left").select("name", "npmi", F.coalesce("linked", F.lit(False)).alias("linked")).orderBy(F.desc_nulls_last("npmi"), "name")
