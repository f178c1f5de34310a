"""The page that a session's events make: what was said, asked and done, each as one entry at its place.

Events are rows: session, seq, at, kind, id, call, name, text, ok. Entries come from joins and running
values; no session is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from . import scan
from .inflight import receipts

# Events that show that the session has acted on what it was told.
SPOKE = ["text", "tool", "tool_result", "context", "prompt", "turn"]
# Events that make an entry of their own; what they are called on the page.
ENTRIES = {"command": "asked", "shown": "shown", "turn": "turn", "exited": "note", "trouble": "note", "joined": "note", "compacted": "note", "deaf": "note"}

def _kind() -> Column:
    return F.col("kind")


def said(events: DataFrame, makes: DataFrame, save, parts: int | None = None) -> DataFrame:
    """Runs of text that nothing else on the page interrupts: session, seq (of the first piece), at, text.

    ``makes`` (session, seq) are the events that make or move an entry.
    """
    rows = events.where(_kind() == "text").select("session", "seq", "at", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("is_text"))
    other = makes.select("session", "seq", F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("is_text"))
    run = scan.islands(rows.unionByName(other), ["is_text"], "session", "seq", save, parts).where("is_text")
    pieces = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return run.groupBy("session", "run").agg(F.min("seq").alias("seq"), F.min_by("at", "seq").alias("at"), F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text")).drop("run")


def unanswered(ops: DataFrame, save, parts: int | None = None) -> DataFrame:
    """(session, seq, call_seq): for results that name no known call, the latest call that then had no answer.

    ``ops`` are rows session, seq, op: ``call`` (with ``until``, when a result names it, or null) and ``pop``. A
    call that no nameless result falls within can't be taken by one and goes. What is left is matched like
    brackets: a call raises a running depth, a nameless result lowers it, and a result takes the latest call
    that raised it to where it stands. The first result of a session that meets a call answered by name
    before it is right about all that came earlier, so that call goes and the rest is matched anew. The
    rounds end when no result meets such a call; they are as many as a session has of them.
    """
    pops = ops.where("op = 'pop'").select("session", "seq")
    calls = ops.where("op = 'call'").select("session", "seq", F.coalesce("until", F.lit(2**62)).alias("until"))
    # the next nameless result after each call; if it comes after the call's own answer, the call is out of it
    both = calls.withColumn("pop", F.lit(None).cast("long")).unionByName(pops.select("session", "seq", F.lit(None).cast("long").alias("until"), F.col("seq").alias("pop")))
    ahead = scan.Ordered(both, "session", [F.desc("seq")], save, parts).values(_pop=scan.last("pop")).plain()
    calls = save(ahead.where("until IS NOT NULL AND _pop < until").select("session", "seq", "until"))
    while True:
        both = calls.select("session", "seq", "until", F.lit(1).alias("one")).unionByName(pops.select("session", "seq", F.lit(None).cast("long").alias("until"), F.lit(-1).alias("one")))
        run = scan.Ordered(both, "session", ["seq"], save, parts).values(cum=scan.total("one")).values(low=scan.lowest("cum"))
        run = run.with_columns(depth=F.col("cum") - F.least("low", F.lit(0)))
        run = run.values(_above=scan.above("depth")).plain()
        # a call stands at the depth that it makes, a result at the depth it finds; on the floor it finds nothing
        level = F.when(F.col("one") == 1, F.col("depth")).otherwise(F.coalesce(F.col("_above.v"), F.lit(0)))
        run = run.withColumn("level", level).where("level > 0").select("session", "level", "seq", "until", "one")
        mine = scan.Ordered(run, ["session", "level"], ["seq"], save, parts).values(_call=scan.above(F.struct("seq", "until"))).plain()
        met = save(mine.where("one = -1").select("session", "seq", F.col("_call.v.seq").alias("call_seq"), F.col("_call.v.until").alias("until")).where("call_seq IS NOT NULL"))
        dead = met.where("until <= seq").groupBy("session").agg(F.min_by("call_seq", "seq").alias("seq"))
        if dead.isEmpty():
            return met.select("session", "seq", "call_seq")
        calls = save(calls.join(dead, ["session", "seq"], "left_anti"))


def page(events: DataFrame, save=None, parts: int | None = None) -> DataFrame:
    """Entries: session, place, at, kind, text, call, tool, ok, detail, head, unrecorded, queued, ask, allowed, settling, reply.

    Text that follows text is one entry. A message stands where it was written, marked queued, until the
    session reads it; then it moves there. A call that comes again under its id is passed over. A result
    belongs to the call that it names, else to the latest call without an answer; the last result of a call
    counts, and calls without one when a process took over are marked unrecorded. A question about a call
    is shown on the call. ``settling`` is an answer after which the session hasn't spoken.
    """
    save = save or Scratch(events.sparkSession, "page").table
    e = save(events.select("session", "seq", "at", "kind", "id", "call", "name", "text", "ok"))
    read = receipts(e, save, parts)
    asked = read.select("session", F.coalesce("read", "told").alias("place"), F.col("at").alias("_told"), "text", F.col("read").isNull().alias("queued"))
    taken = save(read.where("read IS NOT NULL").select("session", F.col("read").alias("seq")))
    times = e.select("session", F.col("seq").alias("place"), F.col("at").alias("_read"))
    asked = asked.join(times, ["session", "place"]).select("session", "place", F.coalesce("_read", "_told").alias("at"), F.lit("asked").alias("kind"), "text", "queued")
    typed = e.where(_kind() == "prompt").join(taken, ["session", "seq"], "left_anti").select("session", F.col("seq").alias("place"), "at", F.lit("asked").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))

    # calls, each id once
    named = e.where((_kind() == "tool") & F.col("id").isNotNull()).groupBy("session", "id").agg(F.min_by(F.struct("seq", "at", "name", "text"), "seq").alias("c")).select("session", "id", "c.*")
    calls = save(named.unionByName(e.where((_kind() == "tool") & F.col("id").isNull()).select("session", "id", "seq", "at", "name", "text")))
    known = calls.where("id IS NOT NULL").select("session", "id", F.col("seq").alias("call_seq"))
    results = e.where(_kind() == "tool_result").select("session", "seq", "id", "ok", "text").join(known, ["session", "id"], "left")
    results = save(results.withColumn("call_seq", F.when(F.col("call_seq") < F.col("seq"), F.col("call_seq"))))
    first = results.where("call_seq IS NOT NULL").groupBy("session", "call_seq").agg(F.min("seq").alias("until"))
    ops = calls.select("session", "seq").join(first.withColumnRenamed("call_seq", "seq"), ["session", "seq"], "left").select("session", "seq", F.lit("call").alias("op"), "until")
    ops = ops.unionByName(results.where("call_seq IS NULL").select("session", "seq", F.lit("pop").alias("op"), F.lit(None).cast("long").alias("until")))
    popped = unanswered(ops, save, parts)
    given = results.where("call_seq IS NOT NULL").select("session", "seq", "call_seq").unionByName(popped)
    given = given.join(results.select("session", "seq", "ok", "text"), ["session", "seq"])
    answer = given.groupBy("session", F.col("call_seq").alias("seq")).agg(F.max_by(F.struct("ok", F.col("text").alias("detail")), "seq").alias("r"))
    over = e.where(_kind() == "joined").groupBy("session").agg(F.max("seq").alias("_over"))

    # questions: on the call that they are about, if it is known by then, else entries of their own
    asks = e.where(_kind() == "ask").select("session", "seq", "at", F.col("id").alias("ask"), F.col("call").alias("id"), "name", "text").join(known, ["session", "id"], "left")
    asks = asks.select("session", "seq", "at", "ask", "name", "text", F.when(F.col("call_seq") < F.col("seq"), F.col("call_seq")).alias("call_seq"))
    asks = asks.withColumn("entry", F.coalesce("call_seq", "seq"))
    later = scan.Ordered(asks, ["session", "entry"], [F.desc("seq")], save, parts).values(_next=scan.above("seq")).plain()
    later = save(later.withColumn("until", F.coalesce(F.col("_next.v"), F.lit(2**62))).drop("_next"))
    replies = e.where(_kind() == "answered").select("session", F.col("id").alias("ask"), F.col("seq").alias("a_seq"), "ok", F.col("text").alias("reply"))
    on = later.join(replies, ["session", "ask"]).where("a_seq > seq AND a_seq < until")
    # one answer is for one entry: the first on the page that holds its question
    on = on.groupBy("session", "a_seq").agg(F.min_by(F.struct("entry", "ok", "reply"), "entry").alias("x")).select("session", "a_seq", "x.*")
    on = on.groupBy("session", "entry").agg(F.max_by(F.struct(F.col("ok").alias("allowed"), "reply", "a_seq"), "a_seq").alias("x")).select("session", "entry", "x.*")
    spoke = e.where(_kind().isin(SPOKE)).groupBy("session").agg(F.max("seq").alias("_spoke"))
    on = on.join(spoke, "session", "left").select("session", "entry", "allowed", "reply", (F.coalesce("_spoke", F.lit(-1)) < F.col("a_seq")).alias("settling"))
    titles = later.groupBy("session", "entry").agg(F.max_by("ask", "seq").alias("ask"), F.max_by("text", F.when(F.col("text").isNotNull() & (F.col("text") != ""), F.col("seq"))).alias("title"))

    on_call = calls.join(answer, ["session", "seq"], "left").join(over, "session", "left").join(titles.withColumnRenamed("entry", "seq"), ["session", "seq"], "left").join(on.withColumnRenamed("entry", "seq"), ["session", "seq"], "left")
    tools = on_call.select(
        "session", F.col("seq").alias("place"), "at", F.lit("tool").alias("kind"), F.coalesce("title", "text").alias("text"), F.col("id").alias("call"), F.coalesce("name", F.lit("tool")).alias("tool"), "r.ok", "r.detail",
        F.when(F.col("r").isNotNull(), F.substring_index(F.coalesce("r.detail", F.lit("")), "\n", 1)).alias("head"), (F.col("r").isNull() & F.coalesce(F.col("_over") > F.col("seq"), F.lit(False))).alias("unrecorded"),
        "ask", "allowed", "settling", "reply",
    )
    cards = later.where("call_seq IS NULL").join(on, ["session", "entry"], "left")
    cards = cards.select("session", F.col("seq").alias("place"), "at", F.lit("ask").alias("kind"), "text", F.coalesce("name", F.lit("tool")).alias("tool"), "ask", "allowed", "settling", "reply")
    kind = F.create_map(*[F.lit(x) for kv in ENTRIES.items() for x in kv])[_kind()]
    plain = e.where(_kind().isin(list(ENTRIES))).select("session", F.col("seq").alias("place"), "at", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))

    makes = e.where(_kind().isin(*ENTRIES, "accepted", "prompt")).select("session", "seq").unionByName(calls.select("session", "seq")).unionByName(cards.select("session", F.col("place").alias("seq")))
    words = said(e, makes, save, parts).select("session", F.col("seq").alias("place"), "at", F.lit("said").alias("kind"), "text")
    out = words
    for more in (asked, typed, tools, cards, plain):
        out = out.unionByName(more, allowMissingColumns=True)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("session", "place", "at", "kind", "text", "call", "tool", "ok", "detail", "head", no("unrecorded"), no("queued"), "ask", "allowed", no("settling"), "reply")
