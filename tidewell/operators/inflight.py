"""What a session has been told and hasn't read, since when it is silent, and its state folded from all events.

Events are rows: session, seq, at (milliseconds), kind, id, name, text, tokens, cost. Messages are
``accepted`` when written to a session and come back as ``prompt`` when it reads them. The streaming
twin is ``streaming.fold``; both give the same over the same events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from . import scan

# Events by which a session speaks of its own accord; of those all but the end of a turn make it busy.
SPOKE = ["text", "tool", "result", "context", "prompt", "turn"]
# Events from which nothing runs.
AT_REST = ["turn", "started", "joined"]
STOPPED = [*AT_REST, "exited"]
# Milliseconds of silence that count as deaf, and while a conversation is compacted.
DEAF_MS, DEAF_COMPACTING_MS = 90_000, 900_000

def _kind() -> Column:
    return F.col("kind")


def receipts(events: DataFrame, save=None, parts: int | None = None) -> DataFrame:
    """(session, text, at, told, read): each accepted message and the place of the prompt that read it, null if none did.

    A prompt reads the oldest message of the same text that is still held, and none if none is. How
    many were read so far follows from the running sum of messages less prompts, kept from going below 0.
    """
    one = F.when(_kind() == "accepted", 1).otherwise(-1)
    e = events.where(_kind().isin("accepted", "prompt")).select("session", "seq", "at", "kind", F.coalesce("text", F.lit("")).alias("text"), one.alias("one"))
    run = scan.Ordered(e, ["session", "text"], ["seq"], save, parts).values(cum=scan.total("one"), n=scan.total(F.when(_kind() == "accepted", 1).otherwise(0)))
    run = run.values(low=scan.lowest("cum")).plain()
    gone = F.col("n") - (F.col("cum") - F.least("low", F.lit(0)))
    told = run.where(_kind() == "accepted").select("session", "text", "at", F.col("seq").alias("told"), F.col("n").alias("k"))
    read = run.where(_kind() == "prompt").groupBy("session", "text", gone.alias("k")).agg(F.min("seq").alias("read"))
    return told.join(read, ["session", "text", "k"], "left").where("read IS NULL OR read > told").select("session", "text", "at", "told", "read")


def _marker(*arms: tuple[Column, Column | None]) -> Column:
    """A wrapped value that the first fitting arm sets (None: clears), null where nothing changes."""
    out = None
    for when, value in arms:
        wrapped = F.struct((F.lit(None).cast("long") if value is None else value).alias("v"))
        out = F.when(when, wrapped) if out is None else out.when(when, wrapped)
    return out


def standing(events: DataFrame, save=None, parts: int | None = None) -> DataFrame:
    """Every event with what holds after it: idle_since, decided, compacting, working, alive, unread, oldest (unread), prompts.

    A session is idle from the end of a turn, or from its start, until it speaks. ``decided`` is the first
    answer that it hasn't acted on. ``oldest`` is when the oldest message that it hasn't read was written.
    """
    save = save or Scratch(events.sparkSession, "inflight").table
    pairs = save(receipts(events, save, parts))
    # the head of the queue changes where all earlier messages are read
    never = F.lit(2**62)
    queue = scan.Ordered(pairs, "session", ["told"], save, parts).values(upto=scan.highest(F.coalesce("read", never))).values(_prev=scan.above("upto")).plain()
    since = F.greatest("told", F.coalesce(F.col("_prev.v"), F.lit(-1)))
    heads = queue.where(F.coalesce(F.col("_prev.v"), F.lit(-1)) < F.coalesce("read", never)).select("session", since.alias("seq"), F.col("at").alias("head"))
    reads = pairs.where("read IS NOT NULL").select("session", F.col("read").alias("seq"), F.lit(1).alias("took"))
    e = events.select("session", "seq", "at", "kind", "text").join(heads, ["session", "seq"], "left").join(reads, ["session", "seq"], "left")

    spoke, busy = _kind().isin(SPOKE), _kind().isin(SPOKE) & (_kind() != "turn")
    mark = F.when(_kind() == "answered", "a").when(spoke, "c")
    run = scan.Ordered(e, "session", ["seq"], save, parts).values(
        _idle=scan.last(_marker((_kind().isin(AT_REST), F.col("at")), (busy, None))), compacting=scan.last(F.when((_kind() == "command") & F.col("text").startswith("/compact"), True).when(spoke, False)),
        working=scan.last(F.when(busy, True).when(_kind().isin(STOPPED), False)), alive=scan.last(F.when(_kind() == "exited", False)), _mark=scan.last(mark), prompts=scan.total(F.when(_kind() == "prompt", 1).otherwise(0)),
        unread=scan.total(F.when(_kind() == "accepted", 1).otherwise(0) - F.coalesce("took", F.lit(0))), _head=scan.last("head"),
    )
    run = run.values(_before=scan.above("_mark"))
    opens = (_kind() == "answered") & ~F.coalesce(F.col("_before.v") == "a", F.lit(False))
    run = run.values(_decided=scan.last(_marker((opens, F.col("at")), (spoke, None)))).plain()
    flag = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    return run.select(
        "session", "seq", "at", "kind", F.col("_idle.v").alias("idle_since"), F.col("_decided.v").alias("decided"), flag("compacting", False), flag("working", False), flag("alive", True),
        "unread", F.when(F.col("unread") > 0, F.col("_head")).alias("oldest"), "prompts",
    )


def waits() -> tuple[Column, Column]:
    """Of rows of ``standing``: since when a session keeps somebody waiting (null if it doesn't), and how long it may."""
    unread = F.when(F.col("idle_since").isNotNull() & F.col("oldest").isNotNull(), F.greatest("idle_since", "oldest"))
    return F.when(F.col("alive"), F.least(unread, F.col("decided"))), F.when(F.col("compacting"), DEAF_COMPACTING_MS).otherwise(DEAF_MS)


def silences(stood: DataFrame, until, save=None, parts: int | None = None) -> DataFrame:
    """(session, at, unread, waited): each silence once, when it has lasted as long as it may, up to the time ``until``.

    After a report there is none until the session reads a prompt.
    """
    since, allowed = waits()
    ahead = scan.Ordered(stood, "session", [F.desc("seq")], save, parts).values(_next=scan.above("at")).plain()
    due = ahead.select("session", "seq", "prompts", "unread", allowed.alias("waited"), (since + allowed).alias("due"), F.coalesce(F.col("_next.v"), F.lit(until)).alias("end"))
    first = due.where("due <= end").groupBy("session", "prompts").agg(F.min_by(F.struct("due", "unread", "waited"), "seq").alias("x"))
    return first.select("session", F.col("x.due").cast("long").alias("at"), F.col("x.unread").cast("long").alias("unread"), F.col("x.waited").cast("long").alias("waited"))


def folded(events: DataFrame, stood: DataFrame) -> DataFrame:
    """The newest state of each session, from all its events and their ``standing``.

    Of every scalar the last event decides that sets or clears it; a member of the two sets (questions
    asked and not answered; work left running) stands if the last event about it opened it and nothing
    cleared the whole set since.
    """
    seq = F.col("seq")
    last = lambda marker: F.max_by(marker, F.when(marker.isNotNull(), seq))
    text = lambda c: F.struct(c.cast("string").alias("v"))
    nothing = F.struct(F.lit(None).cast("string").alias("v"))
    scalars = events.groupBy("session").agg(
        F.max("seq").alias("seq"), last(F.when(_kind() == "started", F.col("name"))).alias("model"),
        last(F.when(_kind() == "busy", text(F.col("text"))).when(_kind().isin("turn", "exited"), nothing))["v"].alias("busy"),
        last(_marker((_kind() == "context", F.col("tokens")), (_kind() == "compacted", None)))["v"].alias("context"), last(F.when(_kind() == "turn", F.col("tokens"))).alias("window"),
        last(F.when(_kind() == "turn", F.struct(F.col("cost").alias("v"))))["v"].alias("cost"), F.min_by("text", F.when(_kind() == "prompt", seq)).alias("asked"), last(F.when(_kind() == "limit", F.col("text"))).alias("limit"),
    )
    cut = lambda kind, name: events.where(_kind() == kind).groupBy("session").agg(F.max("seq").alias(name))
    asks = events.where(_kind().isin("ask", "answered")).groupBy("session", "id").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"))
    asks = asks.where(_kind() == "ask").join(cut("exited", "gone"), "session", "left").where("gone IS NULL OR gone < seq")
    pending = asks.groupBy("session").agg(F.array_sort(F.collect_list("id")).alias("pending"))
    # work is named by its call or its task; a later beginning of a call takes the place of an earlier one
    began = events.where(_kind() == "began").groupBy(F.col("session"), F.col("id").alias("call")).agg(F.max("seq").alias("seq"), F.max_by(F.struct("name"), "seq")["name"].alias("task"))
    over = lambda kinds, named, to: events.where(_kind().isin(kinds) & F.col(named).isNotNull()).groupBy("session", F.col(named).alias(to)).agg(F.max("seq").alias("gone"))
    for gone, on in ((over(["ended"], "id", "call"), "call"), (over(["ended", "killed"], "name", "task"), "task")):
        began = began.join(gone, ["session", on], "left").where("gone IS NULL OR gone < seq").drop("gone")
    began = began.join(cut("joined", "gone"), "session", "left").where("gone IS NULL OR gone < seq")
    background = began.groupBy("session").agg(F.array_sort(F.collect_list("call")).alias("background"))
    now = stood.groupBy("session").agg(F.max_by(F.struct("idle_since", "decided", "compacting", "working", "alive", "unread", "oldest"), "seq").alias("s"))
    none = F.array().cast("array<string>")
    out = scalars.join(now, "session").join(pending, "session", "left").join(background, "session", "left")
    return out.select("session", "seq", "model", "busy", "context", "window", "cost", "asked", "limit", "s.*", F.coalesce("pending", none).alias("pending"), F.coalesce("background", none).alias("background"))
