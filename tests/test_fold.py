"""The session fold as a stream: it goes on from its checkpoint, passes over what comes again, and says each silence once."""

import random
import time

from pyspark.sql import functions as F

from tidewell.operators import inflight
from tidewell.sources.scratch import Scratch
from tidewell.streaming import fold, sessions

EVENT = "session string, seq long, at long, kind string, id string, name string, text string, tokens long, cost double"
KINDS = ["accepted", "accepted", "prompt", "prompt", "turn", "text", "tool", "result", "context", "answered", "ask", "command", "started", "joined", "exited", "busy", "limit", "began", "ended", "killed", "compacted"]


def made(rng, sessions_, n):
    rows = []
    for s in range(sessions_):
        at = 1000 + rng.randrange(1000)
        for q in range(n):
            at += rng.choice([100, 5_000, 60_000, 95_000, 1_000_000])
            kind = rng.choice(KINDS if rng.random() < 0.9 else ["accepted", "turn"])
            if kind == "exited" and rng.random() < 0.97:
                kind = "turn"
            name = rng.choice(["t1", "t2", None]) if kind in ("began", "ended", "killed") else rng.choice(["m1", "m2"])
            rows.append((f"s{s}", q, at, kind, rng.choice(["i1", "i2", "i3"]), name, rng.choice(["/compact", "b", None]) if kind == "command" else rng.choice("ab"), rng.choice([None, 5, 9]) if kind == "turn" else 7, rng.choice([None, 1.5, 2.5])))
    return rows


def plain(rows):
    """Event by event, with the same step as the stream and maps of its own."""
    state, silences = {}, []
    until = max(r[2] for r in rows)
    names = [c.split()[0] for c in EVENT.split(", ")]
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(r[0], []).append(type("E", (), dict(zip(names, r, strict=True))))
    for key, events in by.items():
        s, unread, pending, work = dict.fromkeys(fold.NAMES) | {"seq": -1, "compacting": False, "working": False, "alive": True, "announced": False}, [], set(), {}
        for i, e in enumerate(events):
            fold.step(s, unread, e)
            if e.kind == "ask":
                pending.add(e.id)
            elif e.kind == "answered":
                pending.discard(e.id)
            elif e.kind == "exited":
                pending.clear()
            elif e.kind == "began":
                work[e.id] = e.name
            elif e.kind == "joined":
                work.clear()
            elif e.kind in ("ended", "killed"):
                if e.kind == "ended":
                    work.pop(e.id, None)
                if e.name is not None:
                    work = {k: v for k, v in work.items() if v != e.name}
            when, end = fold.due(s, unread), events[i + 1].at if i + 1 < len(events) else until
            if when is not None and when[0] <= end:
                silences.append((key, when[0], len(unread), when[1]))
                s["announced"] = True
        state[key] = tuple(s[c] for c in fold.NAMES if c != "announced") + (len(unread), unread[0][1] if unread else None, tuple(sorted(pending)), tuple(sorted(work)))
    return state, sorted(silences)


COLS = [c for c in fold.NAMES if c != "announced"] + ["unread", "oldest", "pending", "background"]


def test_batch_and_stream_equal_event_by_event(spark, tmp_path):
    rng = random.Random(8)
    rows = made(rng, 12, 60)
    want, silences = plain(rows)
    events = spark.createDataFrame(rows, EVENT)
    save = Scratch(spark, "t").table
    stood = save(inflight.standing(events, save, parts=5))
    got = {r.session: tuple(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in COLS) for r in inflight.folded(events, stood).collect()}
    assert got == want
    until = max(r[2] for r in rows)
    assert sorted(tuple(r) for r in inflight.silences(stood, until, save, parts=4).collect()) == silences and len(silences) > 20

    # the stream gets the events in order of time, in three runs from one checkpoint, some of them twice
    rows.sort(key=lambda r: r[2])
    cuts, said = [0, 250, 500, len(rows)], []
    with fold.in_rocksdb(spark):
        for low, high in zip(cuts, cuts[1:], strict=False):
            again = rows[low:high] + rows[high - 3 : high]
            spark.createDataFrame(again, EVENT).withColumn("stamp", F.timestamp_millis("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(EVENT + ", stamp timestamp").parquet(f"{tmp_path}/in").withWatermark("stamp", "0 seconds")
            out = sessions.run_once(fold.session_fold(stream), f"{tmp_path}/run")
    state = sessions.newest(out.where("report = 'state'"), ["session"], "batch").collect()
    assert {r.session: tuple(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in COLS) for r in state} == want
    said = sorted((r.session, r.at, r.unread, r.waited) for r in out.where("report = 'deaf'").collect())
    assert said == silences


def test_silence_by_the_clock_is_said_once(spark, tmp_path):
    now = int(time.time() * 1000)

    def run(*events):
        full = [(s, q, at, kind, None, None, text, None, None) for s, q, at, kind, text in events]
        spark.createDataFrame(full, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with fold.in_rocksdb(spark):
            out = sessions.run_for(fold.session_fold(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), event_time=False), f"{tmp_path}/run", seconds=9)
        return sorted((r.session, r.unread) for r in out.where("report = 'deaf'").collect())

    idle = [("s", 1, now - 200_000, "turn", None), ("s", 2, now - 150_000, "accepted", "a"), ("busy", 1, now - 150_000, "accepted", "a"), ("new", 1, now, "turn", None), ("new", 2, now, "accepted", "a")]
    assert run(*idle) == [("s", 1)]
    assert run(("other", 1, now, "turn", None)) == [("s", 1)]  # not again
    assert run(("s", 3, now, "accepted", "b")) == [("s", 1)]  # nor for another message of the same silence
    back = [("s", 4, now, "prompt", "a"), ("s", 5, now - 120_000, "turn", None)]
    assert run(*back) == [("s", 1)]  # the message that is left is not old enough
    assert run(("s", 6, now, "prompt", "b"), ("s", 7, now - 120_000, "turn", None), ("s", 8, now - 100_000, "accepted", "c")) == [("s", 1), ("s", 1)]
