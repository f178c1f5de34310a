"""Link graphs: edges, degrees, neighbours, reachability, k-hop, communities, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Saved frontiers that are read side by side before they are put together.
MOST_FRONTS = 12


def build_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (src, dst, relation, pos) to distinct resolvable edges; the first stated relation counts."""
    ok = links.where("src <> dst").join(nodes.select(F.col("name").alias("dst")), "dst", "left_semi")
    return ok.groupBy("src", "dst").agg(F.min_by("relation", F.when(F.col("relation").isNotNull(), F.col("pos"))).alias("relation"), F.min("pos").alias("pos"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In and out degree of every node, isolated ones too."""
    both = edges.select(F.col("src").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = both.groupBy("name").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    out = nodes.select("name").join(sums, "name", "left")
    return out.select("name", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def backlinks(edges: DataFrame, name: str) -> DataFrame:
    return edges.where((F.col("dst") == name) & (F.col("src") != name)).select(F.col("src").alias("name")).distinct()


def outlinks(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct targets of each source in order of first mention, and whether they exist."""
    first = links.where("src <> dst").groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    known = nodes.select(F.col("name").alias("dst"), F.lit(True).alias("exists"))
    return first.join(known, "dst", "left").select("src", "dst", "pos", F.coalesce("exists", F.lit(False)).alias("exists"))


def neighbours(edges: DataFrame, root: str) -> DataFrame:
    """In, out or both, with the last stated relation."""
    out = edges.where(F.col("src") == root).select(F.col("dst").alias("name"), F.lit("out").alias("dir"), "relation", "pos")
    into = edges.where(F.col("dst") == root).select(F.col("src").alias("name"), F.lit("in").alias("dir"), "relation", "pos")
    g = out.unionByName(into).groupBy("name")
    return g.agg(F.when(F.count_distinct("dir") > 1, "both").otherwise(F.min("dir")).alias("dir"), F.max_by("relation", F.when(F.col("relation").isNotNull(), F.col("pos"))).alias("relation"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()


def reach(edges: DataFrame, seeds: DataFrame, save, most: int | None = None) -> DataFrame:
    """(name, depth) of nodes reachable from the seeds along (src, dst), ``most`` steps at the most.

    A frontier at a time; ``save`` writes a table and reads it back, so the plan stays small and a
    lost executor costs one step. The edges are made once, each step reads only the new frontier,
    and what was found is the union of the saved frontiers, which are put together when they are many.
    """
    edges = save(edges.select("src", "dst"))
    fronts, depth = [save(seeds.select("name").distinct().withColumn("depth", F.lit(0)))], 0
    while most is None or depth < most:
        depth += 1
        front = fronts[-1]
        step = front.join(edges, front["name"] == edges["src"]).select(F.col("dst").alias("name")).distinct()
        found = reduce(DataFrame.unionByName, fronts)
        new = save(step.join(found, "name", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        fronts = [*fronts, new] if len(fronts) < MOST_FRONTS else [save(found), new]
    return reduce(DataFrame.unionByName, fronts)


def reachable_without(edges: DataFrame, index: DataFrame, demoted: DataFrame, save) -> DataFrame:
    """From the index without the demoted notes; these are still passed through."""
    return reach(edges, index.join(demoted, "name", "left_anti"), save)


def homes(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """For each target the reachable notes that link to it."""
    return edges.join(reached.select(F.col("name").alias("src")), "src", "left_semi").select(F.col("dst").alias("name"), F.col("src").alias("home"))


def khop(edges: DataFrame, root: str, depth: int, save) -> DataFrame:
    seeds = edges.select(F.col("src").alias("name")).union(edges.select("dst")).where(F.col("name") == root)
    return reach(undirected(edges), seeds, save, most=depth)


def bridges(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """Nodes whose neighbours lie in more than one cluster, and in how many."""
    near = undirected(edges).join(cluster.select(F.col("name").alias("dst"), "cluster"), "dst")
    return near.groupBy(F.col("src").alias("name")).agg(F.count_distinct("cluster").alias("spans")).where("spans > 1")


def cluster_core(cluster: DataFrame, degree: DataFrame) -> DataFrame:
    """Member of each cluster with the most links, then the least name."""
    joined = cluster.join(degree, "name")
    return joined.groupBy("cluster").agg(F.min(F.struct((-F.col("degree")).alias("d"), "name")).alias("x")).select("cluster", F.col("x.name").alias("core"))


def default_grain(levels: DataFrame, wanted: int = 20) -> DataFrame:
    """The level whose number of clusters is nearest to ``wanted``, the earliest of ties."""
    sizes = levels.groupBy("level").agg(F.count_distinct("cluster").alias("n"))
    return sizes.agg(F.min_by("level", F.struct(F.abs(F.col("n") - wanted), "level")).alias("level"))


def metrics(nodes: DataFrame, newest) -> DataFrame:
    """Node weights between 0 and 1 from sessions, reads, edits, projects, age in days and degree."""
    one = F.lit(1.0)

    def root(col: str, full: float):
        return F.least(one, F.sqrt(F.col(col).cast("double")) / F.lit(full))

    spread = F.when(F.col("projects") <= 1, 0.0).otherwise(F.least(one, (F.sqrt(F.col("projects").cast("double")) - 1) / (F.sqrt(F.lit(16.0)) - 1)))
    fresh = F.when(F.col("last_day").isNull(), 0.05).otherwise(F.greatest(F.lit(0.05), 1 - F.least(one, (newest - F.col("last_day")) / F.lit(30.0))))
    use, reads, links = root("sessions", 3.6), root("reads", 5.5), root("degree", 5.5)
    standing = F.least(one, 0.3 * use + 0.25 * reads + 0.2 * spread + 0.15 * links + 0.1 * fresh)
    none = F.col("sessions").isNull()

    def unless(x):
        return F.when(none, 0.05).otherwise(x)

    return nodes.select(
        "name", unless(use).alias("use"), unless(reads).alias("reads"), unless(F.least(one, F.log10(1 + F.col("edits")) / 2.1)).alias("edits"),
        unless(spread).alias("reach"), unless(fresh).alias("freshness"), links.alias("links"), unless(standing).alias("standing"),
    )


def degree_stats(degree: DataFrame) -> DataFrame:
    """Upper median (element n/2 of the sorted list) and maximum."""
    from pyspark.sql import Window

    # ranks by distinct degree: a histogram, small whatever the number of nodes
    hist = degree.groupBy("degree").agg(F.count("*").alias("n"))
    w = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("upto", F.sum("n").over(w))
    half = degree.agg(F.floor(F.count("*") / 2)).scalar()
    return run.agg(F.min(F.when(F.col("upto") > half, F.col("degree"))).alias("median"), F.max("degree").alias("most"))


def louvain(edges: DataFrame) -> DataFrame:
    """(level, name, cluster): multilevel modularity communities of one graph.

    Greedy moves depend on their order, so they are one sequential computation: it runs in one Python
    task. Meant for note graphs (thousands of edges); there is no distributed equivalent with the
    same result. Each level sweeps nodes by name until nothing gains, thirty sweeps at most, then
    merges clusters to nodes, ten levels at most.
    """
    from ..ship import ship

    ship(edges.sparkSession)
    pairs = undirected(edges).where("src < dst").select("src", "dst", F.lit(1).alias("g"))
    return pairs.groupBy("g").applyInPandas(_louvain, "level int, name string, cluster int")


def _louvain(pdf):
    import pandas as pd

    names = sorted({*pdf["src"], *pdf["dst"]})
    number = {n: i for i, n in enumerate(names)}
    weight: dict[int, dict[int, float]] = {i: {} for i in range(len(names))}
    for a, b in sorted(zip(pdf["src"], pdf["dst"], strict=True)):
        a, b = number[a], number[b]
        weight[a][b] = weight[a].get(b, 0.0) + 1.0
        weight[b][a] = weight[b].get(a, 0.0) + 1.0
    owner = list(range(len(names)))  # of each name its node at the present level
    rows, loops = [], dict.fromkeys(weight, 0.0)
    for level in range(10):
        total = sum(sum(w.values()) for w in weight.values()) + sum(loops.values())
        degree = {i: sum(w.values()) + loops[i] for i, w in weight.items()}
        of, mass = {i: i for i in weight}, dict(degree)
        for _ in range(30):
            moved = False
            for i in weight:
                mass[of[i]] -= degree[i]
                links: dict[int, float] = {}
                for j, w in weight[i].items():
                    links[of[j]] = links.get(of[j], 0.0) + w
                best, gain = of[i], links.get(of[i], 0.0) - mass[of[i]] * degree[i] / total
                for c, w in links.items():
                    g = w - mass[c] * degree[i] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                mass[best] += degree[i]
                moved |= best != of[i]
                of[i] = best
            if not moved:
                break
        ids = {c: k for k, c in enumerate(dict.fromkeys(of[i] for i in weight))}
        if len(ids) == len(weight):
            break
        owner = [ids[of[o]] for o in owner]
        rows += [(level, n, owner[k]) for k, n in enumerate(names)]
        merged: dict[int, dict[int, float]] = {k: {} for k in ids.values()}
        inner = dict.fromkeys(merged, 0.0)
        for i, w in weight.items():
            a = ids[of[i]]
            inner[a] += loops[i]
            for j, x in w.items():
                b = ids[of[j]]
                if a == b:
                    inner[a] += x
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + x
        weight, loops = merged, inner
    return pd.DataFrame(rows, columns=["level", "name", "cluster"])


def separation(positions: DataFrame) -> DataFrame:
    """Mean distance within clusters over mean distance between them, for laid-out note graphs."""
    a = positions.select(*[F.col(c).alias(f"a_{c}") for c in ("name", "cluster", "x", "y", "z")])
    b = positions.select(*[F.col(c).alias(f"b_{c}") for c in ("name", "cluster", "x", "y", "z")])
    d = F.sqrt(sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in "yz"), F.pow(F.col("a_x") - F.col("b_x"), 2)))
    both = a.join(b, F.col("a_name") < F.col("b_name")).select(d.alias("d"), (F.col("a_cluster") == F.col("b_cluster")).alias("same"))
    return both.agg(F.try_divide(F.avg(F.when(F.col("same"), F.col("d"))), F.avg(F.when(~F.col("same"), F.col("d")))).alias("separation"))


def enrich(nodes: DataFrame, usage: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Nodes with their usage and the number and strength of their affinities, where those tables exist."""
    out = nodes
    if usage is not None:
        out = out.join(usage, "name", "left")
    if pairs is not None:
        ends = pairs.select(F.col("a").alias("name"), "npmi").unionByName(pairs.select(F.col("b").alias("name"), "npmi"))
        out = out.join(ends.groupBy("name").agg(F.count("*").alias("affinities"), F.max("npmi").alias("strongest")), "name", "left").withColumn("affinities", F.coalesce("affinities", F.lit(0)))
    return out
