"""Near-duplicate documents: universal hash minima, banding, signature check, full check, components.

The links that count are those confirmed on full shingle sets (of 128-bit digests). MinHash only
proposes pairs: bands and rows follow from the least similarity, so that a pair that just reaches it is
missed by the bands with probability ``MISS`` at most, and by the signature check with about 1e-8.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import Scratch, is_empty, join_counted, small_side, text_batches
from .components import components

#: Probability with which the bands miss a pair of just the least similarity, and minima in a signature, at most
#: (or one row a band where that many don't do).
MISS, MOST_MINIMA = 1.01e-7, 400
#: Deviations below the least similarity at which signatures may agree.
DEVIATIONS = 5.6
#: Rows, and bytes of their sets, on either side of a block of comparisons.
BLOCK, BLOCK_BYTES = 4096, 32 << 20


def _coefficients(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


@dataclass(frozen=True)
class Banding:
    """How signatures are made and met for a least similarity in percent."""

    percent: int
    rows: int
    bands: int

    @classmethod
    def of(cls, percent: int) -> Banding:
        """The most rows a band whose bands still fit; for 80 percent 53 bands of 6, for 50 percent 121 of 3."""
        if not 1 <= percent <= 100:
            raise ValueError(f"percent must be from 1 to 100, not {percent}")
        share, best = percent / 100, None
        for rows in range(1, 33):
            meets = share**rows
            bands = 1 if meets >= 1 else math.ceil(math.log(MISS) / math.log1p(-meets))
            if best is None or rows * bands <= MOST_MINIMA:
                best = cls(percent, rows, bands)
        return best

    @property
    def minima(self) -> int:
        return self.rows * self.bands

    @property
    def least_agree(self) -> float:
        """Pairs whose signatures agree on a smaller share are not looked at further."""
        share = self.percent / 100
        return share - DEVIATIONS * math.sqrt(share * (1 - share) / self.minima)

    @cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return _coefficients(self.minima)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """Minima of universal (linear, modulo 2**32) hashes of a set of digests."""
        a, b = self.hashes
        x = (s[0] >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 256):
            np.minimum(best, (a[:, None] * x[None, at : at + 256] + b[:, None]).min(axis=1), out=best)
        return best

    def keys(self, sigs: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band of each signature; the band's number is part of it."""
        x = sigs.reshape(len(sigs), self.bands, self.rows).astype(np.uint64)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for i in range(self.rows):
            h = words.mix(h ^ (x[:, :, i] + np.uint64(i) * np.uint64(0x100000001B3)))
        return h

    def near(self, rows: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.count_nonzero(rows == one, axis=1) >= self.least_agree * self.minima


def short(sigs: np.ndarray) -> np.ndarray:
    """The low byte of each minimum: enough to tell how far two signatures agree (unlike minima agree by chance in 1 of 256)."""
    return sigs.astype(np.uint8)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on two sets of digests as ``words.shingle_sets`` gives them."""
    n, m = x.shape[1], y.shape[1]
    if not n or not m or percent * max(n, m) > 100 * min(n, m):
        return False
    at = np.searchsorted(y[0], x[0])
    at[at == m] = 0
    high = y[0][at] == x[0]
    low = high & (y[1][at] == x[1])
    both = int(low.sum())
    if both != int(high.sum()):  # equal halves of different digests
        both = len(set(zip(*x.tolist(), strict=True)) & set(zip(*y.tolist(), strict=True)))
    return 100 * both >= percent * (n + m - both)


def _sign(width: int, banding: Banding):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = words.shingle_sets(b.column("text").to_pylist(), width)
            digests, made = [], {None: (None, None)}
            for s in sets:
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.shape[1] else None
                if d not in made:  # copies within a batch share their signature
                    sig = banding.signature(s)
                    made[d] = banding.keys(sig[None, :])[0].view(np.int64), short(sig).tobytes()
                digests.append(d)
            cols = [pa.array([made[d][i] for d in digests], schema.types[3 + i]) for i in range(2)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.shape[1] for s in sets], pa.int64()), pa.array(digests, pa.binary()), *cols], schema=schema)

    return run


def _bytes(col, kind, n: int) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), n)


def _likely(banding: Banding):
    """Pairs whose signatures agree far enough."""

    def run(batches):
        for b in batches:
            x, y = (_bytes(b.column(c), np.uint8, banding.minima) for c in ("sa", "sb"))
            ok = pa.array(banding.near(x, y), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return run


def _confirm(percent: int, width: int):
    def run(batches):
        for b in batches:
            x, y = (words.shingle_sets(b.column(c).to_pylist(), width) for c in ("ta", "tb"))
            ok = pa.array([similar(f, g, percent) for f, g in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return run


class _Block:
    """One block of a bucket: minor rows against home rows, and which pairs are to be looked at."""

    def __init__(self, t: pa.Table, banding: Banding):
        self.banding = banding
        self.rep, self.comp, self.home, self.minor = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "comp", "home", "minor"))
        self.sig, self.bands = _bytes(t.column("sig"), np.uint8, banding.minima), t.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, banding.bands)
        self.pos = t.column("pos")[0].as_py()
        self.rows, self.others = np.flatnonzero(self.home), np.flatnonzero(~self.home)

    def partners(self, i: int) -> np.ndarray:
        """Home rows of other components that are likely near row i and meet it first in this bucket."""
        # two minor rows meet twice; the greater looks at the lesser
        other = self.rows[(self.comp[self.rows] != self.comp[i]) & (~self.minor[self.rows] | (self.rep[self.rows] < self.rep[i]))]
        other = other[self.banding.near(self.sig[other], self.sig[i])]
        return other[(self.bands[other] == self.bands[i]).argmax(axis=1) == self.pos]


def _meet(banding: Banding):
    """The rows of a block that have a partner in it."""

    def run(t: pa.Table) -> pa.Table:
        b = _Block(t, banding)
        some = np.zeros(len(b.rep), bool)
        for i in b.others.tolist():
            other = b.partners(i)
            some[other] = True
            some[i] |= len(other) > 0
        return t.select(["band", "hb", "mb", "pos", "rep", "comp", "minor", "home"]).filter(pa.array(some))

    return run


def _cross(banding: Banding, width: int):
    """Confirmed links between different components in one block, on full sets.

    Pairs are not tried once their components hang together here; so the links that come out are
    fewer than the rows, while no pair that could join two components goes untested.
    """

    def run(t: pa.Table) -> pa.Table:
        b, sets = _Block(t, banding), words.shingle_sets(t.column("text").to_pylist(), width)
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        out = []
        for i in b.others.tolist():
            for j in b.partners(i).tolist():
                x, y = top(int(b.comp[i])), top(int(b.comp[j]))
                if x != y and similar(sets[i], sets[j], banding.percent):
                    up[max(x, y)] = min(x, y)
                    out.append((int(b.rep[i]), int(b.rep[j])))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, text) of the documents that ``ids`` (rep), a saved table, names; other texts aren't sent anywhere."""
    return docs.join(small_side(ids.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text")


def _confirmed(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, banding: Banding, width: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) whose signatures agree and whose full sets, made again from the texts of those alone, are similar enough."""

    def ends(pair: DataFrame, of: DataFrame, col: str, name: str) -> DataFrame:
        for end in ("a", "b"):
            pair = pair.join(of.select(F.col("rep").alias(end), F.col(col).alias(name + end)), end)
        return pair

    likely = scratch.table(ends(pairs, sigs, "sig", "s").select("a", "b", "sa", "sb").mapInArrow(_likely(banding), "a long, b long").distinct(), "likely")
    ids = scratch.table(likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "ids")
    return ends(likely, _texts(docs, ids), "text", "t").select("a", "b", "ta", "tb").mapInArrow(_confirm(banding.percent, width), "a long, b long").distinct()


def _nearest(star: DataFrame) -> DataFrame:
    """For each node the one heart that it shares most buckets with (then the least), as a pair (node, heart)."""
    shared = star.groupBy("rep", "heart").agg(F.count("*").alias("n"))
    best = shared.groupBy("rep").agg(F.max(F.struct("n", (-F.col("heart")).alias("low"))).alias("best"))
    return best.select(F.col("rep").alias("a"), (-F.col("best.low")).alias("b"))


def _rest(mixed: DataFrame, sigs: DataFrame, docs: DataFrame, banding: Banding, width: int, scratch: Scratch) -> DataFrame:
    """Links between different components of the nodes that share a bucket: none that counts is left out.

    ``mixed`` holds band, pos, rep, n_shingles and comp. In each bucket the rows outside its largest
    component (minor) meet all its rows (home), block by block of either; a pair is looked at in its
    first common bucket only. Signatures meet first; texts go only to the blocks in which their row
    has a partner, and become sets there.
    """
    rows = mixed.withColumn("w", F.col("n_shingles") * 32 + banding.minima + 8 * banding.bands)
    sizes = rows.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "comp", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    parts = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_BYTES), F.lit(1)).cast("int")
    main = main.select("band", F.col("main.comp").alias("main"), "n", parts(F.col("n"), F.col("w")).alias("nh"), parts(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("nm"))
    rows = join_counted(rows, scratch.table(main, "main"), "band").withColumn("minor", F.col("comp") != F.col("main"))
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cols = ("band", "pos", "rep", "comp", "minor", "home", "hb", "mb")
    as_home = rows.withColumn("home", F.lit(True)).withColumn("hb", mine("nh")).withColumn("mb", F.explode(all_of("nm"))).select(*cols)
    as_minor = rows.where("minor").withColumn("home", F.lit(False)).withColumn("mb", mine("nm")).withColumn("hb", F.explode(all_of("nh"))).select(*cols)
    signed = as_home.unionByName(as_minor).join(sigs, "rep")
    kept = "band long, hb int, mb int, pos int, rep long, comp long, minor boolean, home boolean"
    met = scratch.table(signed.groupBy("band", "hb", "mb").applyInArrow(_meet(banding), kept), "met")
    ids = scratch.table(met.select("rep").distinct(), "ids")
    return met.join(sigs, "rep").join(_texts(docs, ids), "rep").groupBy("band", "hb", "mb").applyInArrow(_cross(banding, width), "a long, b long")


def near_groups(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * intersection >= percent * union of their sets of ``width``-word
    shingles. Null, empty and blank texts have no shingles and are linked with nothing, as are rows
    without doc_id (their component_id is null, and they are kept). Rows of one doc_id are one
    document, whose links are those of all its texts. An empty table gives an empty result; further
    columns are ignored. Any length of text is read whole.

    Documents with equal sets are one node, named by the least doc_id. Each node is first compared
    with the one least node of its buckets that it shares most of them with (a star, not all pairs).
    In buckets that then still hold several components all pairs of different components are
    tested, in blocks of bounded size. Bands follow from ``percent`` (``Banding.of``).
    """
    banding = Banding.of(percent)
    text_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.table(plain.mapInArrow(_sign(width, banding), "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"), "signed")
    able = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    alone = scratch.table(signed.where(~able).select("doc_id", "n_shingles"), "alone")
    nodes = scratch.table(signed.where(able).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    member = scratch.table(join_counted(signed.where(able).select("doc_id", "digest", "n_shingles"), nodes, "digest").drop("n"), "member")
    reps = signed.where(able).join(nodes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
    reps = scratch.table(reps.select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sig"), "reps")
    scratch.drop(signed)
    sigs = reps.select("rep", "sig", "bands")
    banded = reps.select("rep", "n_shingles", F.posexplode("bands").alias("pos", "band"))
    bucket = scratch.table(banded.groupBy("band").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1"), "bucket")
    banded = scratch.table(join_counted(banded, bucket, "band").select("band", "pos", "rep", "n_shingles", "first"), "banded")

    # a document of several texts hangs together by its id
    several = member.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x < y").select("doc_id")
    own = member.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    first = banded.where("rep > first").select("rep", F.col("first").alias("heart"))
    links = scratch.table(_confirmed(_nearest(first), reps.select("rep", "sig"), plain, banding, width, scratch).unionByName(own), "links")
    comp = scratch.table(components(links, scratch), "component")
    # buckets in which more than one component is left
    now = banded.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("band", "pos", "rep", "n_shingles", F.coalesce("component", "rep").alias("comp"))
    now = scratch.table(now, "now")
    mixed = scratch.table(now.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high"), "several")
    now = scratch.table(join_counted(now, mixed, "band").drop("low", "high", "n"), "mixed")
    if not is_empty(now):
        new = scratch.table(_rest(now, sigs, plain, banding, width, scratch), "links")
        if not is_empty(new):
            comp = scratch.table(components(links.unionByName(new), scratch), "component")
    joined = member.select("doc_id", "n_shingles", "rep").join(comp, member["rep"] == comp["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return joined.unionByName(alone.withColumn("component_id", F.col("doc_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component that with the least doc_id.

    Rows without shingles (null, empty and blank texts) or without doc_id stay, and so do all rows of a
    doc_id that stays, however often it repeats; further columns are kept, and an empty table stays empty.
    """
    drop = near_groups(docs, scratch, width, percent).where("NOT kept").select(F.col("doc_id").alias("_drop_id")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_drop_id"], "left_anti").select(*docs.columns)
