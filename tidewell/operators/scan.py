"""Running values over the ordered rows of a key, without gathering a key in one task.

Rows are dealt into ranges of (key, order) and saved in that order; a key of any size spans as many
ranges as it needs. Running values are made within each range; what lies in earlier ranges of the same
key is added from one row per range. As ranges follow each other, at most one key of a range began in an
earlier one, so those rows are no more than the ranges and are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


@dataclass(frozen=True)
class Value:
    """A running value: over the rows of a range, of a whole range, over earlier ranges, and how two parts make one."""

    local: Callable
    whole: Callable
    earlier: Callable
    joined: Callable


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(c) -> Value:
    """Sum at or before a row."""
    c = _col(c)
    return Value(lambda run, at: F.sum(c).over(run), lambda: F.sum(c), lambda x, w: F.sum(x).over(w), lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)))


def count() -> Value:
    """The number of a row within its key, from 1."""
    return total(F.lit(1))


def highest(c) -> Value:
    c = _col(c)
    return Value(lambda run, at: F.max(c).over(run), lambda: F.max(c), lambda x, w: F.max(x).over(w), F.greatest)


def lowest(c) -> Value:
    c = _col(c)
    return Value(lambda run, at: F.min(c).over(run), lambda: F.min(c), lambda x, w: F.min(x).over(w), F.least)


def last(c) -> Value:
    """The last value at or before a row that isn't null."""
    c = _col(c)
    return Value(lambda run, at: F.last(c, ignorenulls=True).over(run), lambda: F.max_by(c, F.when(c.isNotNull(), F.col("_row"))), lambda x, w: F.last(x, ignorenulls=True).over(w), lambda old, new: F.coalesce(new, old))


def above(c) -> Value:
    """The value of the row before, wrapped in ``v`` (null where there is no such row)."""
    c = F.struct(_col(c).alias("v"))
    return Value(lambda run, at: F.lag(c).over(at), lambda: F.max_by(c, "_row"), lambda x, w: F.last(x, ignorenulls=True).over(w), lambda old, new: F.coalesce(new, old))


class Ordered:
    """Rows of keys ``by`` in ``order`` (columns, ascending unless they say otherwise); ties keep the order they are saved in."""

    def __init__(self, rows: DataFrame, by: str | list[str], order: list, save=None, parts: int | None = None):
        self.by = [by] if isinstance(by, str) else list(by)
        keys = [F.col(f"`{b}`") for b in self.by] + [_col(o) for o in order]
        dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
        save = save or Scratch(rows.sparkSession, "ordered").table
        saved = save(dealt.sortWithinPartitions(*keys))
        at = saved.metadataColumn("_metadata")
        part = F.regexp_extract(at["file_path"], r"part-(\d+)[^/]*$", 1).cast("int")
        self.rows = saved.select("*", part.alias("_part"), at["row_index"].alias("_row"))

    def values(self, **wanted: Value) -> Ordered:
        """The same rows with further columns of running values."""
        at = Window.partitionBy(*self.by, "_part").orderBy("_row")
        run = at.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = self.rows.select("*", *[v.local(run, at).alias(f"_l_{k}") for k, v in wanted.items()])
        wholes = self.rows.groupBy(*self.by, "_part").agg(*[v.whole().alias(f"_w_{k}") for k, v in wanted.items()])
        before = Window.partitionBy(*self.by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = wholes.select(*[F.col(f"`{b}`").alias(f"_k_{b}") for b in self.by], F.col("_part").alias("_p"), F.count(F.lit(1)).over(before).alias("_n"), *[v.earlier(F.col(f"_w_{k}"), before).alias(f"_e_{k}") for k, v in wanted.items()])
        carried = F.broadcast(carried.where("_n > 0"))  # at most one row for each range
        same = F.col("_part") == F.col("_p")
        for b in self.by:
            same = same & F.col(f"`{b}`").eqNullSafe(F.col(f"_k_{b}"))
        met = local.join(carried, same, "left")
        out = Ordered.__new__(Ordered)
        out.by = self.by
        out.rows = met.select(*[F.col(f"`{c}`") for c in self.rows.columns], *[v.joined(F.col(f"_e_{k}"), F.col(f"_l_{k}")).alias(k) for k, v in wanted.items()])
        return out

    def with_columns(self, **cols: Column) -> Ordered:
        out = Ordered.__new__(Ordered)
        out.by, out.rows = self.by, self.rows.withColumns(cols)
        return out

    def plain(self) -> DataFrame:
        """The rows without their places."""
        return self.rows.drop("_part", "_row")


def islands(rows: DataFrame, same: list[str], by: str, order: str, save=None, parts: int | None = None) -> DataFrame:
    """Numbers the maximal runs of consecutive rows of a key that agree on ``same`` (column ``run``, from 1)."""
    key = F.struct(*same)
    seen = Ordered(rows, by, [order], save, parts).values(_above=above(key))
    starts = (~F.coalesce(F.col("_above.v").eqNullSafe(key), F.lit(False))).cast("long")
    return seen.with_columns(_starts=starts).values(run=total("_starts")).plain().drop("_above", "_starts")
