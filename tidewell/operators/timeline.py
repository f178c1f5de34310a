"""Timeline and effects: rows (agent, project, kind, t, n, verdict, seq) and (agent, path, did, t)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

PAGE = 200


def filtered(rows: DataFrame, agent: str | None = None, project: str | None = None, kind: str | None = None, before: int | None = None) -> DataFrame:
    """Names match whatever their case; an unknown name gives nothing."""
    for col, value in (("agent", agent), ("project", project), ("kind", kind)):
        if value is not None:
            rows = rows.where(F.lower(col) == value.lower())
    return rows if before is None else rows.where(F.col("t") < before)


def summary(rows: DataFrame) -> DataFrame:
    """Over the whole filtered range: sum of n and failed rows of each kind."""
    return rows.groupBy("kind").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("total"), F.count_if(F.col("verdict") == "failed").alias("failed"))


def page(rows: DataFrame, limit: int = PAGE) -> DataFrame:
    """The newest rows, by minute and then by place; at most ``limit``, PAGE at the highest."""
    return rows.orderBy(F.desc("t"), F.desc("seq")).limit(min(limit, PAGE))


def evidence(effects: DataFrame, agent: str | None = None, at: int | None = None, path: str | None = None) -> DataFrame:
    """Totals over the filter: all effects and those without a name; the path filter minds case."""
    if agent is not None:
        effects = effects.where(F.lower("agent") == agent.lower())
    if at is not None:
        effects = effects.where(F.col("t") == at)
    if path is not None:
        effects = effects.where(F.col("path").contains(path))
    return effects.agg(F.count("*").alias("total"), F.count_if(F.col("did") == "unnamed").alias("unnamed"))


def with_effect_counts(rows: DataFrame, effects: DataFrame) -> DataFrame:
    counts = effects.groupBy("agent", "t").agg(F.count("*").alias("effects"))
    return rows.join(counts, ["agent", "t"], "left").withColumn("effects", F.coalesce("effects", F.lit(0)))


def episodes(lines: DataFrame, source: str = "file", order: str = "line_no", save=None, parts: int | None = None) -> DataFrame:
    """Lines (source, order, is_prompt, is_work) to episodes that hold work.

    A prompt opens an episode; work before the first prompt of a source belongs to none. A source of
    any size is read in ranges of its order.
    """
    numbered = scan.Ordered(lines.select(source, order, "is_prompt", "is_work"), source, [order], save, parts).values(episode=scan.total(F.col("is_prompt").cast("long"))).plain()
    work = numbered.where(F.col("is_work") & (F.col("episode") > 0))
    return work.groupBy(source, "episode").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"))


def heads(rows: DataFrame, save=None, parts: int | None = None) -> DataFrame:
    """Newest first, a row heads its episode when the row above it is of another."""
    seen = scan.Ordered(rows, "source", [F.desc("seq")], save, parts).values(_above=scan.above("episode")).plain()
    return seen.withColumn("heads", ~F.coalesce(F.col("_above.v").eqNullSafe(F.col("episode")), F.lit(False))).drop("_above")


def failed_share(rows: DataFrame, by: list[str]) -> DataFrame:
    failed = F.count_if(F.col("verdict") == "failed")
    return rows.groupBy(*by).agg(F.coalesce(F.try_divide(failed, F.count("*")), F.lit(0.0)).alias("failed_share"))


def reverse_page(lines: DataFrame, before: int | None, most: int = 400, source: str = "file", order: str = "line_no", save=None, parts: int | None = None) -> DataFrame:
    """Lines of each source from the cursor back until ``most`` events; a line is never split, one at least."""
    if before is not None:
        lines = lines.where(F.col(order) < before)
    run = scan.Ordered(lines, source, [F.desc(order)], save, parts).values(_sum=scan.total("n_events"), _rn=scan.count()).plain()
    return run.where((F.col("_sum") <= most) | (F.col("_rn") == 1)).drop("_sum", "_rn")


def since_compaction(lines: DataFrame, source: str = "file", order: str = "line_no") -> DataFrame:
    """Prompts after the last compaction of each source, and the last context figure after it."""
    last = lines.where("is_compaction").groupBy(source).agg(F.max(order).alias("_cut"))
    after = lines.join(last, source, "left").where(F.col("_cut").isNull() | (F.col(order) > F.col("_cut")))
    return after.groupBy(source).agg(F.count_if("is_prompt").alias("interactions"), F.max_by("context", F.when(F.col("context").isNotNull(), F.col(order))).alias("context"))
