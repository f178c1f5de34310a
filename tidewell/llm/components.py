"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, small: bool, scratch: Scratch) -> DataFrame:
    """One star step over edges (u, v) with u > v.

    The least neighbour of a node comes from a plain grouped minimum, which combines before the
    shuffle, and is joined back; the rows of nodes with very many neighbours are not shuffled for it.
    """
    if small:
        around = edges
    else:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if not small:
        least = least.select("u", F.least("u", "m").alias("m"), "n")
    hung = join_counted(around, scratch.table(least, "least"), "u")
    if small:  # all lower neighbours, and the node itself, hang on the least
        moved = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
    else:  # all higher neighbours hang on the least of the node and its neighbours
        moved = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    Self-loops, repeated edges and either direction are allowed; edges with a null end are ignored.
    """
    x = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = scratch.table(x.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct(), "edges")
    state = _state(now)
    for _ in range(most):
        if not state[0]:
            break
        large = scratch.table(_star(now, False, scratch), "large")
        after = scratch.table(_star(large, True, scratch), "star")
        scratch.drop(now)
        now, was, state = after, state, _state(after)
        if state == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
