"""The session fold as a stream: scalars, the queue of unread messages, open questions and running work as keyed state.

State is kept in RocksDB per session: one value of scalars, a list of unread messages, a map of open
questions and one of running work. Silence is a timer: it is set for when a session will have been deaf,
moved by every event, and reports each silence once. The batch twin is ``operators.inflight``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.inflight import AT_REST, DEAF_COMPACTING_MS, DEAF_MS, SPOKE, STOPPED
from ..ship import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCALARS = (
    "seq long, model string, busy string, context long, window long, cost double, asked string, limit string, idle_since long, decided long, "
    "compacting boolean, working boolean, alive boolean, announced boolean"
)
NAMES = [c.split()[0] for c in SCALARS.split(", ")]
OUT = (
    "session string, report string, seq long, model string, busy string, context long, window long, cost double, asked string, limit string, idle_since long, decided long, "
    "compacting boolean, working boolean, alive boolean, unread long, oldest long, pending array<string>, background array<string>, at long, waited long"
)
OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]


def step(s: dict, unread: list, e) -> None:
    """One event over the scalars and the queue of (text, at), both changed in place."""
    kind = e.kind
    s["seq"] = e.seq
    if kind == "started":
        s["model"] = e.name
    elif kind == "busy":
        s["busy"] = e.text
    elif kind == "context":
        s["context"] = e.tokens
    elif kind == "compacted":
        s["context"] = None
    elif kind == "turn":
        s["window"] = s["window"] if e.tokens is None else e.tokens
        s["busy"], s["cost"] = None, e.cost  # a running total, so it is set
    elif kind == "limit":
        s["limit"] = e.text
    elif kind == "exited":
        s["busy"], s["alive"] = None, False
    elif kind == "accepted":
        unread.append((e.text or "", e.at))
    elif kind == "prompt":
        s["asked"] = e.text if s["asked"] is None else s["asked"]
        at = next((i for i, held in enumerate(unread) if held[0] == (e.text or "")), None)
        if at is not None:
            unread.pop(at)
        s["announced"] = False
    elif kind == "command" and (e.text or "").startswith("/compact"):
        s["compacting"] = True
    elif kind == "answered" and s["decided"] is None:
        s["decided"] = e.at
    if kind in AT_REST:
        s["idle_since"] = e.at
    if kind in STOPPED:
        s["working"] = False
    if kind in SPOKE:
        s["compacting"], s["decided"] = False, None
        if kind != "turn":
            s["idle_since"], s["working"] = None, True


def due(s: dict, unread: list) -> tuple[int, int] | None:
    """When a session will have been silent for as long as it may, and how long that is; None if nobody waits or it was said."""
    if not s["alive"] or s["announced"]:
        return None
    waiting = [max(s["idle_since"], unread[0][1])] if s["idle_since"] is not None and unread else []
    waiting += [s["decided"]] if s["decided"] is not None else []
    allowed = DEAF_COMPACTING_MS if s["compacting"] else DEAF_MS
    return (min(waiting) + allowed, allowed) if waiting else None


class SessionFold(StatefulProcessor):
    """Events of one session; gives its state after each batch, and a ``deaf`` row for each silence.

    Events that come again (a place already seen) are passed over. With event time a silence that ended
    within the batch is reported too, at its own time; with processing time silence is only what the
    timer finds.
    """

    def __init__(self, event_time: bool):
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scalars = handle.getValueState("scalars", SCALARS)
        self.unread = handle.getListState("unread", "text string, at long")
        self.pending = handle.getMapState("pending", "id string", "tool string")
        self.background = handle.getMapState("background", "call string", "task string")

    def _load(self) -> tuple[dict, list]:
        if not self.scalars.exists():
            return dict.fromkeys(NAMES) | {"seq": -1, "compacting": False, "working": False, "alive": True, "announced": False}, []
        return dict(zip(NAMES, self.scalars.get(), strict=True)), [(t, at) for t, at in self.unread.get()]

    def _members(self, e) -> None:
        """The maps: questions by id, work by call (or, when it ends, by task)."""
        if e.kind == "ask":
            self.pending.updateValue((e.id,), (e.name,))
        elif e.kind == "answered" and self.pending.containsKey((e.id,)):
            self.pending.removeKey((e.id,))
        elif e.kind == "exited":
            self.pending.clear()
        elif e.kind == "began":
            self.background.updateValue((e.id,), (e.name,))
        elif e.kind == "joined":
            self.background.clear()
        elif e.kind in ("ended", "killed"):
            if e.kind == "ended" and e.id is not None and self.background.containsKey((e.id,)):
                self.background.removeKey((e.id,))
            if e.name is not None:
                for call in [k[0] for k, v in list(self.background.iterator()) if v[0] == e.name]:
                    self.background.removeKey((call,))

    def _deaf(self, key, s: dict, unread: list, at: int, waited: int) -> Row:
        s["announced"] = True
        given = {"session": key[0], "report": "deaf", "seq": s["seq"], "unread": len(unread), "at": at, "waited": waited}
        return Row(**{c: given.get(c) for c in OUT_NAMES})

    def _keep(self, s: dict, unread: list) -> None:
        self.scalars.update(tuple(s[c] for c in NAMES))
        if unread:
            self.unread.put(unread)
        else:
            self.unread.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if (when := due(s, unread)) is not None:
            self.handle.registerTimer(when[0])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s, unread = self._load()
        for e in sorted(rows, key=lambda e: e.seq):
            if e.seq <= s["seq"]:
                continue
            if self.event_time and (when := due(s, unread)) is not None and when[0] <= e.at:
                yield self._deaf(key, s, unread, *when)
            step(s, unread, e)
            self._members(e)
        self._keep(s, unread)
        open_ = {"pending": sorted(k[0] for k, _ in self.pending.iterator()), "background": sorted(k[0] for k, _ in self.background.iterator())}
        given = s | open_ | {"session": key[0], "report": "state", "unread": len(unread), "oldest": unread[0][1] if unread else None}
        yield Row(**{c: given.get(c) for c in OUT_NAMES})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s, unread = self._load()
        when = due(s, unread)
        now = expiredTimerInfo.getExpiryTimeInMs()
        if when is not None and when[0] <= now:
            yield self._deaf(key, s, unread, *when)
            self._keep(s, unread)


def session_fold(events: DataFrame, event_time: bool = True) -> DataFrame:
    """States and silences of a stream of events (session, seq, at, kind, id, name, text, tokens, cost; with event time also ``stamp``, a timestamp with a watermark)."""
    ship(events.sparkSession)
    mode = "EventTime" if event_time else "ProcessingTime"
    return events.groupBy("session").transformWithState(SessionFold(event_time), OUT, "Update", mode)


@contextmanager
def in_rocksdb(spark):
    """Keyed state of this kind needs the RocksDB provider; what was set before is put back."""
    keys = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
