"""A Merkle manifest of a table: leaves by row, a tree in each group, and a tree of the groups' roots.

A level is one window: partitioned by group and parent index, the ordered list of hashes over the full
frame gives the parent's preimage and each node's siblings. Every parent is kept once (with its first
child) and forms the next level, so all levels together have less than twice the leaves. Siblings then
go down level by level: each node takes its parent's proof and puts its own siblings in front.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<before string, after string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return sha(F.concat(*[field(v) for v in values]))


def numbered(rows: DataFrame, scratch: Scratch, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` (with a never-null column ``g``) with ``i``, the place by ``order`` within ``g`` from 0, and ``n``, the rows of ``g``.

    The rows are dealt by ranges of (g, order) and saved in order; a row's number is its place in its
    file plus what lies in earlier files. So no group is gathered, however large it is.
    """
    keys = [F.col("g"), *[F.col(c).asc_nulls_first() for c in order]]
    ranges = [*keys, F.col("_tie")]  # rows that are equal in all of ``order`` may lie in several ranges
    saved = scratch.table(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*ranges).sortWithinPartitions(*ranges).drop("_tie"), name)
    at = saved.metadataColumn("_metadata")
    saved = saved.select("*", at["file_path"].alias("_file"), at["row_index"].alias("_row"))
    each = saved.groupBy("g", "_file").agg(F.min("_row").alias("_low"), F.count("*").alias("_n"))
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("int")
    so_far = Window.partitionBy("g").orderBy(part, "_file")  # one row per file
    each = each.select(
        "g", "_file", "_low", (F.sum("_n").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_from"),
        F.sum("_n").over(Window.partitionBy("g")).alias("n"),
    )
    each = scratch.table(each, f"{name}-files")
    return saved.join(each, ["g", "_file"]).withColumn("i", F.col("_from") + F.col("_row") - F.col("_low")).drop("_file", "_row", "_low", "_from")


def tree(nodes: DataFrame, scratch: Scratch, fan: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``nodes`` (g, i, n, hash, further columns), and the top of each group: (g, height, hash).

    ``fan`` consecutive nodes have one parent, whose hash is that of theirs together. A level has the
    children's columns and ``parent``, ``before`` and ``after`` (the siblings' hashes on either side).
    """
    levels, tops, height = [], [], 0
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tops.append(nodes.where("n = 1").select("g", F.lit(height).alias("height"), "hash"))
        if most <= 1:
            return levels, scratch.table(reduce(DataFrame.unionByName, tops), f"{name}-tops")
        up = nodes.where("n > 1").withColumn("parent", F.floor(F.col("i") / fan))
        run = F.collect_list("hash").over(Window.partitionBy("g", "parent").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        place = (F.col("i") % fan).cast("int")
        level = up.withColumn("run", run).select(
            *up.columns, F.array_join(F.slice("run", F.lit(1), place), "").alias("before"), F.array_join(F.slice("run", place + 2, F.lit(fan)), "").alias("after"),
            sha(F.array_join("run", "")).alias("above"),
        )
        levels.append(scratch.table(level, f"{name}-{height}"))
        # each parent once: its first child speaks for it
        nodes = levels[-1].where(F.col("i") % fan == 0).select("g", F.col("parent").alias("i"), F.ceil(F.col("n") / fan).alias("n"), F.col("above").alias("hash"))
        most, height = -(-most // fan), height + 1


def proofs(levels: list[DataFrame], tops: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The lowest level's rows with the columns of ``tops`` (g, height, subroot, proof), ``proof`` now from the row to the root.

    A proof lists the steps from below: the hashes that stand before and after the node among its
    parent's children. Rows of groups without a level aren't in it.
    """
    at = lambda h: tops.where(F.col("height") == h).select("g", F.lit(0).cast("long").alias("parent"), "subroot", "proof")
    down = None
    for h in reversed(range(len(levels))):
        above = at(h + 1) if down is None else at(h + 1).unionByName(down)
        met = levels[h].join(above, ["g", "parent"])
        met = met.withColumn("proof", F.concat(F.array(F.struct("before", "after")), "proof")).drop("before", "after", "above", "parent", "n")
        met = scratch.table(met, f"{name}-down-{h}")
        down = met.select("g", F.col("i").alias("parent"), "subroot", "proof") if h else met
    return down


def folded(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, start, lambda have, step: sha(F.concat(step["before"], have, step["after"])))


def manifest(docs: DataFrame, scratch: Scratch, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", found: Mapping[str, Column] | None = None, fan: int = 2) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot, root, proof, folded_root, verified.

    A leaf is the hash of the ``fields`` (``field``). In each ``group`` the leaves ascend by ``key`` (null
    first; rows that repeat a key by their leaf); ``fan`` consecutive nodes become their hash until one
    is left, the subroot. The subroots, by group (null first, by UTF-8 bytes), give the root likewise.
    ``proof`` has the siblings of each level up to the root, as steps (before, after). ``found`` gives
    what is read of fields now, as columns of ``docs``: ``folded_root`` is made from that leaf and the
    recorded siblings, and ``verified`` tells whether it is the root.

    Null and empty fields differ; texts are hashed whole; equal rows are leaves of their own; an empty
    table gives an empty result; further columns are ignored.
    """
    found = found or {}
    own = leaf([F.col(c) for c in fields])
    now = leaf([found.get(c, F.col(c)) for c in fields])
    changed = reduce(lambda a, b: a | b, [~found[c].eqNullSafe(F.col(c)) for c in fields if c in found], F.lit(False))
    rows = docs.select(
        F.concat(F.when(F.col(group).isNull(), "0").otherwise("1"), F.coalesce(F.col(group).cast("string"), F.lit(""))).alias("g"),
        F.col(key).alias("key"), own.alias("hash"), F.when(changed, now).alias("now"),
    )
    rows = scratch.table(rows, "leaves")  # the only pass over the texts
    leaves = numbered(rows, scratch, ["key", "hash", "now"], "numbered")
    levels, tops = tree(leaves, scratch, fan, "group")
    above = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("of"), "hash", "height"), scratch, ["of"], "groups")
    few, top = tree(above, scratch, fan, "root")
    end = top.select("g", F.col("height").alias("height"), F.col("hash").alias("subroot"), F.array().cast(STEP).alias("proof"))
    # a single group's subroot is the root itself, with nothing beside it
    reached = proofs(few, end, scratch, "root") if few else above.withColumn("proof", F.array().cast(STEP))
    ends = scratch.table(reached.select(F.col("of").alias("g"), "height", F.col("hash").alias("subroot"), "proof"), "ends")
    root = top.select("hash").first()
    root = F.lit(root[0] if root else None).cast("string")
    cols = ["key", "hash", "now", "subroot", "proof"]
    out = leaves.where("n = 1").join(ends, "g").select(*cols)
    if levels:
        out = out.unionByName(proofs(levels, ends, scratch, "group").select(*cols))
    out = out.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", root.alias("root"), "proof", folded(F.coalesce("now", "hash"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
