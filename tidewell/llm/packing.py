"""Bounded-space online packing of token ids into windows.

Each partition keeps a fixed number of open windows. A piece goes to the open window that it fills
best; when none has room for it, the fullest is filled to the brim with the piece's head, emitted,
and the tail goes on. At the end of a partition its leftover windows are merged, and what is left
of each partition is merged with the others', level by level, never more than a bounded number at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_batches
from .pretokens import vocabulary, word_pieces

SIZE = 2048
#: Open windows of a partition.
OPEN = 64
#: Partitions whose leftovers one task merges.
FAN = 256
#: A window that lacks at most so many tokens is emitted without cutting a piece to fill it.
SLACK = 16

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, partial int, part int"


class Packer:
    """Open windows of one partition; ``emit`` takes a finished window."""

    def __init__(self, emit, size: int = SIZE, open_windows: int = OPEN, slack: int = SLACK):
        self.emit, self.size, self.most, self.slack = emit, size, open_windows, slack
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)

    def add(self, doc, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        while len(ids):
            n = len(ids)
            if n >= self.size:  # a whole window of its own
                self.emit(self.size, [(doc, start, ids[: self.size], total)])
                start, ids = start + self.size, ids[self.size :]
                continue
            fits = [(self.size - used, i) for i, (used, _) in enumerate(self.open) if self.size - used >= n]
            if fits:
                self._put(min(fits)[1], doc, ids, start, total)
                return
            if len(self.open) < self.most:
                self.open.append((0, []))
                self._put(len(self.open) - 1, doc, ids, start, total)
                return
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
            room = self.size - self.open[fullest][0]
            if room > self.slack:
                self._put(fullest, doc, ids[:room], start, total)  # fills it, which emits it
                start, ids = start + room, ids[room:]
            else:
                self.emit(*self.open.pop(fullest))

    def _put(self, i: int, doc, ids, start, total) -> None:
        used, pieces = self.open[i]
        pieces.append((doc, start, ids, total))
        self.open[i] = (used + len(ids), pieces)
        if used + len(ids) == self.size:
            self.emit(*self.open.pop(i))

    def finish(self) -> tuple[int, list] | None:
        """Merges the leftovers, fullest first, cutting the last piece of each; returns what fills no window."""
        left = sorted(self.open, key=lambda x: -x[0])
        self.open = []
        used, pieces = 0, []
        for _, more in left:
            for doc, start, ids, total in more:
                while len(ids):
                    k = min(self.size - used, len(ids))
                    pieces.append((doc, start, ids[:k], total))
                    used, start, ids = used + k, start + k, ids[k:]
                    if used == self.size:
                        self.emit(used, pieces)
                        used, pieces = 0, []
        return (used, pieces) if used else None


def _pack(vocab: str | None, size: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokens = word_pieces(vocab or vocabulary())
        rows, made = [], 0

        def emit(used, pieces, partial=0):
            nonlocal made
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, (part << 40) + made, at, partial, part))
                at += len(ids)
            made += 1

        def out():
            t = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int32() if i > 6 else pa.int64()) for i in range(9)], names=[x.split()[0] for x in _PIECES.split(", ")]
            )
            rows.clear()
            return t

        packer = Packer(emit, size)
        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), tokens.encode(b.column("text").to_pylist()), strict=True):
                packer.add(doc, np.append(ids, np.int32(end_id)).astype("<u4"))
            if rows:
                yield out()
        if left := packer.finish():
            emit(*left, partial=1)
        if rows:
            yield out()

    return run


def _merge(size: int):
    """Best fit of leftover windows (window, used) into shared ones; one row per leftover.

    Windows come a bounded number at a time (``grp``); the emptiest shared one goes to the next level,
    as all others are more than half full.
    """

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        left = sorted(zip(t.column("used").to_pylist(), t.column("window").to_pylist(), strict=True), reverse=True)
        bins: list[list] = []  # [room, name]
        window, into, shift = [], [], []
        for used, name in left:
            fits = [b for b in bins if b[0] >= used]
            b = min(fits) if fits else [size, name]
            if not fits:
                bins.append(b)
            window.append(name), into.append(b[1]), shift.append(size - b[0])
            b[0] -= used
        used_of = {b[1]: size - b[0] for b in bins}
        return pa.table({"window": pa.array(window, pa.int64()), "into": pa.array(into, pa.int64()), "shift": pa.array(shift, pa.int64()), "used": pa.array([used_of[x] for x in into], pa.int64()), "grp": pa.array([key[0].as_py()] * len(into), pa.int64())})

    return run


def pack(docs: DataFrame, scratch: Scratch, vocab: str | None = None, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and then ``end_id``; null and empty texts have that id
    alone. Every row of ``docs``, repeated ones and those without doc_id too, is packed; an empty
    table gives no pieces; further columns are ignored.
    """
    text_batches(docs.sparkSession)
    plain = docs.selectExpr("cast(doc_id AS long) doc_id", "cast(text AS string) text")
    pieces = scratch.table(plain.mapInArrow(_pack(vocab, size, end_id), _PIECES), "pieces")
    # leftovers: one window of each partition, FAN partitions to a group
    left = pieces.where("partial = 1").groupBy("window", "part").agg(F.sum("length").alias("used"))
    left = left.select("window", "used", F.floor(F.col("part") / FAN).alias("grp"))
    merged = "window long, into long, shift long, used long, grp long"
    placed, level = scratch.table(left.groupBy("grp").applyInArrow(_merge(size), merged), "placed"), 0
    while placed.where("grp > 0").limit(1).count():  # the emptiest of each group, FAN groups to a group
        level += 1
        upper = F.floor(F.col("grp") / FAN).alias("grp")
        left = placed.groupBy("grp").agg(F.min_by("into", F.struct("used", "into")).alias("window"), F.min("used").alias("used")).select("window", "used", upper)
        above = left.groupBy("grp").applyInArrow(_merge(size), merged).selectExpr("window AS into", "into AS top", "shift AS more", "used AS sum")
        placed = placed.join(above, "into", "left").select("window", F.coalesce("top", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"), F.coalesce("sum", "used").alias("used"), upper)
        placed = scratch.table(placed, f"placed{level}")
    placed = placed.select("window", "into", "shift")
    moved = pieces.where("partial = 1").join(placed, "window").select(*[c for c in pieces.columns if c not in ("window", "offset")], F.col("into").alias("window"), (F.col("offset") + F.col("shift")).alias("offset"))
    out = pieces.where("partial = 0").unionByName(moved)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset")
