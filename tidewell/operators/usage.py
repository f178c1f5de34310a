"""Usage windows: which of several readings counts, and sessions folded from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan

#: Resets within so many seconds are the same window.
SAME_WINDOW = 60


def fresher(readings: DataFrame) -> DataFrame:
    """Per window one reading: the latest reset, of those within a minute of it the highest use, then the latest.

    The tolerance makes pairwise merging depend on order; here it is measured from the latest reset.
    """
    last = readings.groupBy("window").agg(F.max("resets_at").alias("_top"))
    near = readings.join(last, "window").where(F.col("_top").isNull() | (F.col("resets_at") >= F.col("_top") - SAME_WINDOW))
    best = near.groupBy("window").agg(F.max(F.struct("utilization", "at", "resets_at")).alias("x"))
    return best.select("window", "x.utilization", "x.resets_at", "x.at")


def fold_fresher(rows):
    """The same in strict order of observation, for one window: an ordered fold over (resets_at, utilization, at)."""
    held = None
    for r in rows:
        if held is None or (r[0] or 0) > (held[0] or 0) + SAME_WINDOW or (abs((r[0] or 0) - (held[0] or 0)) <= SAME_WINDOW and r[1] > held[1]):
            held = r
        elif abs((r[0] or 0) - (held[0] or 0)) <= SAME_WINDOW and r[1] == held[1] and r[2] > held[2]:
            held = r
    return held


def reading(picked: DataFrame, now: int) -> DataFrame:
    """Picked readings without those whose window has reset, with their age."""
    return picked.where(F.col("resets_at").isNull() | (F.col("resets_at") > now)).withColumn("age", F.lit(now) - F.col("at"))


# Events after which a session works, and after which it doesn't.
WORKING, RESTING = ["text", "tool", "result", "context", "prompt"], ["turn", "exit", "start", "joined"]


def session_state(events: DataFrame, by: str = "session", order: str = "seq") -> DataFrame:
    """The newest state of each session: working, last value of each field (cost is a running total), events."""
    works = F.when(F.col("kind").isin(WORKING), True).when(F.col("kind").isin(RESTING), False)

    def last(value):
        return F.max_by(value, F.when(value.isNotNull(), F.col(order)))

    fields = [last(F.col(c)).alias(c) for c in ("model", "context", "cost", "limit") if c in events.columns]
    return events.groupBy(by).agg(F.coalesce(last(works), F.lit(False)).alias("working"), *fields, F.max(order).alias("last_seq"), F.count("*").alias("events"))


def open_background(events: DataFrame, by: str = "session", order: str = "seq") -> DataFrame:
    """Begun and not ended: an end names the call or the task; ``joined`` clears all before it."""
    out = events.where(F.col("kind") == "begin").select(by, order, "call_id", "task_id")
    # of each id its last end decides; one equality join for each of the two names
    ended = events.where(F.col("kind") == "end").groupBy(F.col(by).alias("_s"), F.col("ends").alias("_id")).agg(F.max(order).alias("_at"))
    for name in ("call_id", "task_id"):
        out = out.join(ended, (out[by] == ended["_s"]) & (out[name] == ended["_id"]) & (ended["_at"] > out[order]), "left_anti")
    clear = events.where(F.col("kind") == "joined").groupBy(F.col(by).alias("_s")).agg(F.max(order).alias("_at"))
    return out.join(clear, (out[by] == clear["_s"]) & (clear["_at"] > out[order]), "left_anti")


def deaf_after(idle, oldest, decided, compacting, now):
    """Milliseconds of silence once they reach 90 s (15 min while compacting), else null.

    A prompt is unread from the later of idling and its arrival (both must be known); silence counts
    from the earlier of that and the last decision.
    """
    unread = F.when(idle.isNotNull() & oldest.isNotNull(), F.greatest(idle, oldest))
    quiet = now - F.least(unread, decided)
    return F.when(quiet >= F.when(compacting, 15 * 60_000).otherwise(90_000), quiet)


def replay(events: DataFrame, after: int | None, ring: int = 5000, by: str = "session", order: str = "seq", save=None, parts: int | None = None) -> DataFrame:
    """Events after ``after`` if the ring of the newest still holds that place, else all that it holds."""
    back = scan.Ordered(events, by, [F.desc(order)], save, parts).values(_rn=scan.count()).plain()
    kept = back.where(F.col("_rn") <= ring).drop("_rn")
    if after is None:
        return kept
    low = kept.groupBy(by).agg(F.min(order).alias("_low"))
    return kept.join(low, by).where((F.col(order) > after) | (F.col("_low") > after + 1)).drop("_low")


def sweep(now: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Fresh and gone between two sweeps."""
    fresh = now.join(seen, key, "left_anti").select(key, F.lit("fresh").alias("change"))
    return fresh.unionByName(seen.join(now, key, "left_anti").select(key, F.lit("gone").alias("change")))


def task_counts(tasks: DataFrame, strays: DataFrame) -> DataFrame:
    """Open and total tasks of each holder and its stray files; all-zero rows go, unmatched strays stay."""
    t = tasks.groupBy("holder").agg(F.count_if("open").alias("open"), F.count("*").alias("total"))
    j = t.join(strays, "holder", "full_outer")
    zero = F.lit(0)
    out = j.select("holder", F.coalesce("open", zero).alias("open"), F.coalesce("total", zero).alias("total"), F.coalesce("strays", zero).alias("strays"))
    return out.where("open + total + strays > 0")


def commonest(rows: DataFrame, col: str, order: str) -> DataFrame:
    """The most frequent value, ties to the one counted first."""
    return rows.groupBy(col).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").limit(1).drop("_first")


# Directories whose conversations aren't listed.
DISPOSABLE = ["/tmp/", "/private/tmp/", "/var/folders/"]


def listed(conversations: DataFrame, running: DataFrame) -> DataFrame:
    """Conversations (id, name, dir, modified) outside scratch directories, newest first, and whether a running
    process has their id or their name as an argument (running: argument)."""
    scratch = F.lit(False)
    for d in DISPOSABLE:
        scratch = scratch | F.coalesce(F.col("dir"), F.lit("")).startswith(d)
    said = running.select("argument").distinct()
    by_id = said.select(F.col("argument").alias("id"), F.lit(True).alias("_a"))
    by_name = said.select(F.col("argument").alias("name"), F.lit(True).alias("_b"))
    out = conversations.where(~scratch).join(by_id, "id", "left").join(by_name, "name", "left")
    return out.select(*conversations.columns, F.coalesce("_a", "_b", F.lit(False)).alias("busy")).orderBy(F.desc("modified"), "id")


def ranked(live: DataFrame, past: DataFrame, off: int = 9) -> DataFrame:
    """Live sessions (id, rank, at) and past conversations (id, at) that aren't live, by rank, then newest."""
    gone = past.join(live.select("id"), "id", "left_anti").select("id", F.lit(off).alias("rank"), "at")
    return live.select("id", "rank", "at").unionByName(gone).orderBy("rank", F.desc("at"), "id")


def idlest(sessions: DataFrame) -> DataFrame:
    """The session to ask: one that doesn't work before one that does, then the one heard last (session, working, last_heard)."""
    return sessions.agg(F.max_by("session", F.struct((~F.col("working")).alias("idle"), "last_heard", "session")).alias("session"))


# Statuses of tasks, whether they are open, and their rank.
STANDING = [("doing", True, 0), ("open", True, 1), ("done", False, 2), ("dropped", False, 3)]
UNKNOWN_RANK = 1


def shown_tasks(tasks: DataFrame, everything: bool = False) -> DataFrame:
    """Open tasks (session, seq, status), or all, by the rank of their status and then as they were made; an
    unknown status is open and ranks as open."""
    ranks = tasks.sparkSession.createDataFrame(STANDING, "status string, open boolean, rank int")
    t = tasks.join(F.broadcast(ranks), "status", "left").withColumn("open", F.coalesce("open", F.lit(True))).withColumn("rank", F.coalesce("rank", F.lit(UNKNOWN_RANK)))
    t = t if everything else t.where("open")
    return t.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("rank", "seq"))).select("session", "seq", "status", "place")


#: How a window's own hearing is named, and what begins the name of a model's window.
HERE, MODEL_PREFIX = "here", "model:"


def combined(own: DataFrame, published: DataFrame, now: int) -> DataFrame:
    """Own readings (window, utilization, resets_at, at) judged against published ones (also host), per window.

    The published one counts where it is fresher: a later reset, or within a minute of it the higher
    use, then the later hearing. Windows of models are the own hearing only. Windows that have reset
    are left out; ``age`` is of what is shown.
    """
    p = published.where(~F.col("window").startswith(MODEL_PREFIX)).select("window", *[F.col(c).alias(f"_{c}") for c in ("utilization", "resets_at", "at", "host")])
    apart = F.coalesce("_resets_at", F.lit(0)) - F.coalesce("resets_at", F.lit(0))
    same = F.abs(apart) <= SAME_WINDOW
    later = F.struct("_utilization", "_at") > F.struct("utilization", "at")
    theirs = F.col("_at").isNotNull() & (F.col("at").isNull() | (apart > SAME_WINDOW) | (same & later))
    j = own.join(p, "window", "full_outer").withColumn("_theirs", F.coalesce(theirs, F.lit(False)))
    cols = [F.when(F.col("_theirs"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("utilization", "resets_at", "at")]
    return reading(j.select("window", *cols, F.when(F.col("_theirs"), F.col("_host")).otherwise(HERE).alias("host")), now)
