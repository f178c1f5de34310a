"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are rotated onto their principal axes; cosine >= c means a distance of at most
eps = sqrt(2 - 2c). Vectors are sorted by their grid cells (side eps) on the leading axes and cut
into sequence intervals (blocks). The join recurses over pairs of intervals, halving them, and
leaves out pairs whose bounding boxes on the leading axes are provably farther apart than eps; what
is left are pairs of small blocks, which are compared in full (double precision decides).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted, small_side, text_batches
from .components import components

#: Leading principal axes that bound distances, and those of them that the grid order uses.
AXES, GRID = 24, 6
#: Bytes and rows of a block at most; an interval has FAN intervals of the next depth (or blocks) in it.
BLOCK_BYTES, BLOCK, FAN = 1 << 20, 1024, 8
#: Range partitions at most; their block counts (a number each) are all that the driver sees of them.
PARTS = 2000
#: Partial sums that the driver adds up, at most, when it looks for the principal axes.
SUMS = 64


def _moments(dim: int):
    def run(batches):
        from pyspark import TaskContext

        n, total, outer = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = unit(b.column("v"), dim)
            n, total, outer = n + len(x), total + x.sum(axis=0), outer + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()]), pa.array([outer.tobytes()])], names=["k", "n", "total", "outer"])

    return run


def _add(t: pa.Table) -> pa.Table:
    total, outer = (sum(np.frombuffer(x) for x in t.column(c).to_pylist()) for c in ("total", "outer"))
    return pa.table({"k": t.column("k")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "total": pa.array([total.tobytes()]), "outer": pa.array([outer.tobytes()])})


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def unit(col: pa.Array, dim: int) -> np.ndarray:
    x = matrix(col, dim)
    top = np.abs(x).max(axis=1, keepdims=True)  # first by the largest part, so that no square over- or underflows
    x = x / np.where(top > 0, top, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(parts: list, dim: int) -> np.ndarray:
    """Orthonormal axes (columns) by falling variance, from sums over all vectors."""
    n = sum(p["n"] for p in parts)
    total = sum((np.frombuffer(p["total"]) for p in parts), np.zeros(dim))
    outer = sum((np.frombuffer(p["outer"]).reshape(dim, dim) for p in parts), np.zeros((dim, dim)))
    mean = total / max(n, 1)
    _, axes = np.linalg.eigh(outer / max(n, 1) - np.outer(mean, mean))
    return axes[:, ::-1].copy()


def _join_labels(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Gives both ends of each link (p, q), and all that hang together with them, the least label."""
    while len(p):
        lp, lq = label[p], label[q]
        apart = lp != lq
        if not apart.any():
            return
        p, q, lp, lq = p[apart], q[apart], lp[apart], lq[apart]
        low = np.minimum(lp, lq)
        np.minimum.at(label, lp, low)  # the roots hang on each other
        np.minimum.at(label, lq, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _apart(al, ah, bl, bh) -> np.ndarray:
    """Squared distance of boxes on the leading axes."""
    gap = np.maximum(0, np.maximum(al - bh, bl - ah))
    return (gap * gap).sum(axis=-1)


def _tile(axes: np.ndarray, eps: float, dim: int, least: float):
    """Links of one tile: for each vector with links their weight (copies count) and a spanning edge."""
    margin = 2 * (dim + 4) * 2.0**-24  # single-precision products of unit vectors are off by less

    def run(t: pa.Table) -> pa.Table:
        rep, copies, block = (t.column(c).to_numpy() for c in ("rep", "copies", "block"))
        one = t.column("ti")[0].as_py() == t.column("tj")[0].as_py()
        tile = {c: t.column(c)[0].as_py() for c in ("ti", "tj", "fan")}
        x = unit(t.column("v"), dim)
        f, lead = x.astype(np.float32), x @ axes
        of = {b: np.flatnonzero(block == b) for b in np.unique(block).tolist()}
        box = {b: (lead[r].min(axis=0), lead[r].max(axis=0)) for b, r in of.items()}
        count, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i in (b for b in of if b // tile["fan"] == tile["ti"]):
            for j in (b for b in of if b // tile["fan"] == tile["tj"] and (not one or b >= i)):
                if _apart(*box[i], *box[j]) > (eps + 1e-7) ** 2:
                    continue
                c, d = of[i], of[j]
                near = f[c] @ f[d].T
                link = near >= least + margin
                p, q = np.nonzero((near >= least - margin) & ~link)  # too close to tell in single precision
                link[p, q] = np.einsum("ij,ij->i", x[c[p]], x[d[q]]) >= least
                if i == j:
                    link = np.triu(link, 1)
                count[c] += link @ copies[d]
                count[d] += link.T @ copies[c]
                p, q = np.nonzero(link)
                _join_labels(label, c[p], d[q])
        some = np.flatnonzero(count)
        return pa.table({"rep": pa.array(rep[some], pa.int64()), "links": pa.array(count[some], pa.int64()), "other": pa.array(rep[label[some]], pa.int64())})

    return run


def _boxes(rows: DataFrame, by: Column, lead: int) -> DataFrame:
    return rows.groupBy(by.alias("at")).agg(*[F.min(f"l{i}").alias(f"l{i}") for i in range(lead)], *[F.max(f"h{i}").alias(f"h{i}") for i in range(lead)])


def near_intervals(boxes: DataFrame, n: int, lead: int, eps: float, scratch: Scratch) -> DataFrame:
    """Pairs (i, j), i <= j, of the blocks 0 to n-1 that aren't provably farther apart than ``eps``.

    ``boxes`` has a row for each block: at, and its bounds l0, h0, l1, ... From the whole sequence
    down, each near pair of intervals gives the pairs of their parts whose boxes are near too.
    """
    levels = [boxes]
    while n > 1:
        levels.append(scratch.table(_boxes(levels[-1], F.floor(F.col("at") / FAN), lead), "level"))
        n = -(-n // FAN)
    pairs = boxes.sparkSession.range(1).select(F.col("id").alias("i"), F.col("id").alias("j"))
    for level in reversed(levels[:-1]):
        part = level.withColumn("up", F.floor(F.col("at") / FAN))
        x, y = part.alias("x"), part.alias("y")
        both = pairs.join(x, F.col("i") == F.col("x.up")).join(y, F.col("j") == F.col("y.up")).where("x.at <= y.at")
        gap = [F.greatest(F.lit(0.0), F.col(f"x.l{k}") - F.col(f"y.h{k}"), F.col(f"y.l{k}") - F.col(f"x.h{k}")) for k in range(lead)]
        pairs = scratch.table(both.where(sum((g * g for g in gap), F.lit(0.0)) <= eps * eps).select(F.col("x.at").alias("i"), F.col("y.at").alias("j")), "pairs")
    return pairs


def _links(nodes: DataFrame, dim: int, n: int, least: float, scratch: Scratch) -> DataFrame:
    """(rep, links, other) of the links among ``n`` distinct vectors of one length."""
    moments = "k int, n long, total binary, outer binary"
    parts = nodes.select("v").mapInArrow(_moments(dim), moments).groupBy("k").applyInArrow(_add, moments).collect()
    axes, eps = principal_axes(parts, dim), float(np.sqrt(max(0.0, 2 - 2 * least)))
    lead = min(AXES, dim)
    axes = axes[:, :lead].copy()

    def place(batches):
        for b in batches:
            x = unit(b.column("v"), dim) @ axes
            cell = np.floor(x[:, : min(GRID, lead)] / eps).astype(np.int64) if eps else np.zeros((len(x), 1), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(cell), pa.list_(pa.int64())), pa.array(list(x), pa.list_(pa.float64()))], names=[*b.schema.names, "cell", "axes"])

    placed = nodes.mapInArrow(place, "v array<double>, rep long, copies long, cell array<long>, axes array<double>")
    # grid order, cut into blocks: a range partitioning, then runs of rows within each partition
    order = [F.get("cell", F.lit(i)) for i in range(min(GRID, lead))] + [F.get("axes", F.lit(0)), F.col("rep")]
    block = max(16, min(BLOCK, BLOCK_BYTES // (8 * dim)))
    ranged = placed.repartitionByRange(max(1, min(PARTS, -(-n // (4 * block)))), *order).sortWithinPartitions(*order)

    def blocks(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            k = (np.arange(seen, seen + b.num_rows) // block).astype(np.int64)
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("v", "rep", "copies", "axes")), pa.array(np.full(b.num_rows, part, np.int64)), pa.array(k)], names=["v", "rep", "copies", "axes", "part", "k"])

    cut = scratch.table(ranged.mapInArrow(blocks, "v array<double>, rep long, copies long, axes array<double>, part long, k long"), "blocks")
    sizes = sorted(cut.groupBy("part").agg((F.max("k") + 1).alias("n")).collect())
    first, at = {}, 0
    for r in sizes:
        first[r["part"]], at = at, at + r["n"]
    offset = cut.sparkSession.createDataFrame(list(first.items()), "part long, first long")
    cut = cut.join(F.broadcast(offset), "part").withColumn("block", F.col("first") + F.col("k"))  # at most PARTS rows
    bounds = cut.select("block", *[F.get("axes", F.lit(i)).alias(f"{s}{i}") for s in "lh" for i in range(lead)])
    boxes = scratch.table(_boxes(bounds, F.col("block"), lead), "boxes")
    pairs = near_intervals(boxes, at, lead, eps + 1e-9, scratch)
    # tiles of pairs; each block goes to the tiles in which it has a partner
    fan = max(1, min(FAN, at // 10))  # few blocks: smaller tiles, so that there are enough to share out
    tiles = pairs.select("i", "j", F.floor(F.col("i") / fan).alias("ti"), F.floor(F.col("j") / fan).alias("tj"))
    where = tiles.select(F.col("i").alias("block"), "ti", "tj").unionByName(tiles.select(F.col("j").alias("block"), "ti", "tj")).distinct()
    went = cut.select("v", "rep", "copies", "block").join(small_side(scratch.table(where, "where")), "block").withColumn("fan", F.lit(fan))
    return scratch.table(went.groupBy("ti", "tj").applyInArrow(_tile(axes, eps, dim, least), "rep long, links long, other long"), "found")


def near_vectors(vectors: DataFrame, scratch: Scratch, least: float = 0.9, key: str = "vec_id", col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Linked are vectors of one length and of cosine >= ``least``. Null or empty vectors, zero vectors
    and vectors with a null or non-finite component link with nothing, and neither do rows without
    vec_id, which no other row counts; they have no component and are kept. A vector is a vec_id
    with its values: a row that repeats both is the same vector and no link of its own. Equal vectors
    are joined once and counted as many. An empty table gives an empty result; further columns are
    ignored.
    """
    text_batches(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.transform(F.col(col).cast("array<double>"), lambda x: x + 0.0).alias("v"))  # -0.0 becomes 0.0
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    able = F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    exact = F.sha2(F.to_json(F.struct("v")).cast("binary"), 256)  # a digest of the exact values
    keyed = scratch.table(rows.select("vec_id", F.when(able, exact).alias("d")), "keyed")
    ids = keyed.where("d IS NOT NULL").groupBy("d", "vec_id").agg(F.count("*").alias("n"))
    # copies: one node for each distinct vector, named by its least id
    counts = scratch.table(ids.groupBy("d").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.sum("n").alias("n")), "counts")
    distinct = rows.where(able).select("v").distinct().withColumn("d", exact)
    nodes = scratch.table(distinct.join(counts, "d").select("v", "rep", "copies"), "nodes")
    found = nodes.sparkSession.createDataFrame([], "rep long, links long, other long")
    for dim, n in sorted(tuple(r) for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).where("n > 1").collect()):
        found = found.unionByName(_links(nodes.where(F.size("v") == dim), dim, n, least, scratch))
    comp = scratch.table(components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")), scratch), "component")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = counts.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    known = scratch.table(known.select("d", "n", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    out = join_counted(keyed, known, "d").select("vec_id", "n_links", "component_id")
    rest = keyed.where("d IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
