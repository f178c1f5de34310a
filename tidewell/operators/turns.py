"""Turn inheritance and message trees, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def inherit(nodes: DataFrame, save=None) -> DataFrame:
    """(session, uuid, turn): the nearest promptId at or above a message, else its own uuid.

    ``nodes`` have session, uuid, parent, prompt and line_no; of several parents the last counts.
    Each round doubles the distance looked at, until no message without a turn has an ancestor left
    to look at; as no chain is longer than the number of messages, its log2 bounds the rounds, and
    what then has none hangs on a cycle and finds nothing. ``save`` cuts the lineage between rounds.
    """
    save = save or Scratch(nodes.sparkSession, "turns").table
    one = nodes.groupBy("session", "uuid").agg(F.max_by("parent", F.when(F.col("parent").isNotNull(), F.col("line_no"))).alias("up"), F.max_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("line_no"))).alias("turn"))
    one = save(one)
    for _ in range((one.count() - 1).bit_length()):
        if one.where("turn IS NULL AND up IS NOT NULL").isEmpty():
            break
        above = one.select("session", F.col("uuid").alias("up"), F.col("up").alias("up2"), F.col("turn").alias("turn2"))
        one = one.join(above, ["session", "up"], "left").select("session", "uuid", F.when(F.col("turn").isNull(), F.col("up2")).alias("up"), F.coalesce("turn", "turn2").alias("turn"))
        one = save(one)
    return one.select("session", "uuid", F.coalesce("turn", "uuid").alias("turn"))


def cycles(nodes: DataFrame, save=None) -> DataFrame:
    """One row for each cycle of parents: session, through (its least uuid), loop (its messages).

    Jumps of doubling length end on cycles; there the least uuid met in jumps of doubling length is
    the cycle's own, so what groups by it is one cycle. The rounds are the log2 of the messages.
    Rounds are merged, not broadcast: else each would send its table through the driver.
    """
    save = save or Scratch(nodes.sparkSession, "cycles").table
    up = save(nodes.groupBy("session", "uuid").agg(F.min_by("parent", "line_no").alias("up")).where("up IS NOT NULL"))
    rounds = max(1, up.count().bit_length())
    far = up
    for _ in range(rounds):
        above = far.select("session", F.col("uuid").alias("up"), F.col("up").alias("up2"))
        far = save(far.join(above.hint("merge"), ["session", "up"]).select("session", "uuid", F.col("up2").alias("up")))
        if far.isEmpty():
            break
    on = save(far.select("session", F.col("up").alias("uuid")).distinct())
    now = save(up.join(on.hint("merge"), ["session", "uuid"]).select("session", "uuid", "up", F.least("uuid", "up").alias("low")))
    for _ in range(rounds if not now.isEmpty() else 0):
        above = now.select("session", F.col("uuid").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        now = save(now.join(above.hint("merge"), ["session", "up"]).select("session", "uuid", F.col("up2").alias("up"), F.least("low", "low2").alias("low")))
    return now.groupBy("session", F.col("low").alias("through")).agg(F.count("*").alias("loop"))
