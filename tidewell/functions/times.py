"""Day and minute numbers, stamps and recency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE = 14.0


def day_number(stamp: Column) -> Column:
    """Days since 1970 of the date that a stamp starts with; null if it starts with none.

    Months go from 1 to 12 and days from 1 to 31 in every month; a day that a month hasn't counts on into the next.
    """
    y, m, d = (F.try_element_at(F.regexp_extract_all(stamp, F.lit(r"^(\d{4})-(\d{2})-(\d{2})"), i), F.lit(1)).cast("int") for i in (1, 2, 3))
    return F.when(m.between(1, 12) & d.between(1, 31), F.unix_date(F.make_date(y, m, F.lit(1))) + d - 1)


def minute(stamp: Column) -> Column:
    """Minutes since 1970 of a stamp's first sixteen characters, whose hours and minutes aren't checked for their range.

    Of the date months beyond 12 count on into later years, as days do into later months.
    """
    y, m, d, h, n = (F.try_element_at(F.regexp_extract_all(stamp, F.lit(r"^(\d{4}).(\d{2}).(\d{2}).(\d{2}).(\d{2})"), i), F.lit(1)).cast("long") for i in (1, 2, 3, 4, 5))
    first = F.unix_date(F.make_date((y + F.floor((m - 1) / 12)).cast("int"), (F.pmod(m - 1, F.lit(12)) + 1).cast("int"), F.lit(1)))
    return ((first + d - 1) * 24 + h) * 60 + n


def stamp(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def decay(day: Column, today: Column, half_life: float = HALF_LIFE) -> Column:
    """Weight of one day: half for each half-life that lies between it and today."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0), today - day) / F.lit(half_life))
