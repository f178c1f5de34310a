"""Integrity rules over a note corpus: one query for each rule, united, and joined to its severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The rules and their severities.
SEVERITY = {
    "link-extension": "error", "unknown-relation": "error", "self-link": "warn", "name-mismatch": "error", "uppercase-filename": "error",
    "missing-description": "error", "missing-modified": "error", "missing-name": "error", "unknown-type": "error", "stranded": "error",
    "unreachable": "error", "index-points-nowhere": "error", "dangling-link": "warn", "missing-why": "error", "missing-how": "error",
    "unlinked-co-use": "warn", "untyped-links": "warn", "governs-unreciprocated": "warn", "dead-repo-path": "error", "unresolvable-code-root": "error",
}
SHOWN = 20


def note_rules(notes: DataFrame) -> DataFrame:
    """Rules on single notes (name, raw, description, mtype, body)."""
    raw = F.col("raw")
    kind, said = T.frontmatter_value(raw, "type"), T.frontmatter_value(raw, "name")
    blank = F.trim(F.coalesce("description", F.lit(""))) == ""
    rules = [
        ("uppercase-filename", F.lower("name") != F.col("name"), F.concat("name", F.lit(".md"))),
        ("missing-description", blank, F.lit("no description")),
        ("missing-modified", T.frontmatter_value(raw, "modified").isNull(), F.lit("no `modified:` in frontmatter")),
        ("missing-name", said.isNull(), F.lit("no `name:` in frontmatter")),
        ("unknown-type", kind.isNull() | ~kind.isin(T.NOTE_TYPES), F.coalesce(kind, F.lit("no `type:` in metadata"))),
        ("name-mismatch", said.isNotNull() & (said != F.col("name")), said),
        ("missing-why", (F.col("mtype") == "feedback") & ~T.has_section(F.col("body"), "Why"), F.lit("says no why")),
        ("missing-how", (F.col("mtype") == "feedback") & ~T.has_section(F.col("body"), "How to apply"), F.lit("nothing to act on")),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(r).alias("rule"), detail.alias("detail"))) for r, test, detail in rules]))
    return notes.select(F.col("name").alias("memory"), F.explode(found).alias("f")).select("f.rule", "memory", "f.detail")


def links_of(notes: DataFrame) -> DataFrame:
    """(src, dst, relation, inner, pos) of every wikilink."""
    each = notes.select(F.col("name").alias("src"), F.posexplode(T.wikilinks(F.col("body"))).alias("pos", "inner"))
    return each.select("src", T.target_of(F.col("inner")).alias("dst"), T.relation_of(F.col("inner")).alias("relation"), "inner", "pos")


def link_rules(links: DataFrame, notes: DataFrame) -> DataFrame:
    """For each link the first rule that it breaks: extension, relation, itself, nothing there."""
    known = notes.select(F.col("name").alias("dst"), F.lit(True).alias("there"))
    rule = (
        F.when(F.col("dst").endswith(".md"), "link-extension")
        .when(F.col("relation").isNull() & F.col("dst").contains(":"), "unknown-relation")
        .when(F.col("dst") == F.col("src"), "self-link")
        .when(F.col("there").isNull(), "dangling-link")
    )
    return links.join(known, "dst", "left").select(rule.alias("rule"), F.col("src").alias("memory"), F.col("inner").alias("detail")).where("rule IS NOT NULL")


def graph_rules(notes: DataFrame, edges: DataFrame, links: DataFrame, reached: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """Stranded, governs without return, untyped links; with an index, unreachable and pointing nowhere."""
    names = notes.select(F.col("name").alias("memory"))
    linked = edges.select(F.col("src").alias("memory")).union(edges.select("dst")).distinct()
    out = [names.join(linked, "memory", "left_anti").select(F.lit("stranded").alias("rule"), "memory", F.lit("no links").alias("detail"))]
    governs = edges.where(F.col("relation") == "governs").select("src", "dst")
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    child = edges.where(F.col("relation") == "part-of").select(F.col("src").alias("child"), F.col("dst").alias("dst"))
    by_child = child.join(edges.select(F.col("src").alias("child"), F.col("dst").alias("src")), "child").select("src", "dst")
    alone = governs.join(back, ["src", "dst"], "left_anti").join(by_child, ["src", "dst"], "left_anti")
    out.append(alone.select(F.lit("governs-unreciprocated").alias("rule"), F.col("dst").alias("memory"), F.col("src").alias("detail")))
    few = links.agg(F.count("*").alias("n"), F.count("relation").alias("typed")).where("typed * 20 < n")
    out.append(few.select(F.lit("untyped-links").alias("rule"), F.lit("").alias("memory"), F.concat("typed", F.lit(" of "), "n").alias("detail")))
    if index is not None and reached is not None:
        out.append(names.join(reached.select(F.col("name").alias("memory")), "memory", "left_anti").select(F.lit("unreachable").alias("rule"), "memory", F.lit("no path from the index").alias("detail")))
        out.append(index.select(F.col("name").alias("memory")).join(names, "memory", "left_anti").select(F.lit("index-points-nowhere").alias("rule"), "memory", F.lit("no such note").alias("detail")))
    return reduce(DataFrame.unionByName, out)


def world_rules(mentions: DataFrame, repos: DataFrame) -> DataFrame:
    """Repositories named but absent and not said to be archived; once a note."""
    dead = mentions.where("NOT archived").join(repos, "repo", "left_anti")
    return dead.select(F.lit("dead-repo-path").alias("rule"), F.col("note").alias("memory"), F.col("repo").alias("detail")).distinct()


def top_unlinked(pairs: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first pairs by npmi, and one row for how many more there are."""
    order = [F.desc_nulls_last("npmi"), F.desc("sessions"), "a", "b"]
    top = pairs.orderBy(*order).limit(shown)
    rest = pairs.agg(F.count("*").alias("n")).where(F.col("n") > shown).select(F.lit("unlinked-co-use").alias("rule"), F.lit("").alias("memory"), F.concat((F.col("n") - shown).cast("string"), F.lit(" more")).alias("detail"))
    return top.select(F.lit("unlinked-co-use").alias("rule"), F.col("a").cast("string").alias("memory"), F.col("b").cast("string").alias("detail")).unionByName(rest)


def with_severity(findings: DataFrame) -> DataFrame:
    rules = findings.sparkSession.createDataFrame(sorted(SEVERITY.items()), "rule string, severity string")
    return findings.join(F.broadcast(rules), "rule").orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "rule", "memory")


def tally(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("findings"))


def passed(findings: DataFrame) -> DataFrame:
    """One row: whether no finding is an error."""
    return findings.agg((~F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False))).alias("passed"))


def passed_for(findings: DataFrame, notes: DataFrame, session: str) -> DataFrame:
    """As ``passed``, but only the session's own notes and corpus-level errors count."""
    own = notes.where(F.col("origin_session") == session).select(F.col("name").alias("memory"))
    mine = findings.where(F.col("memory") == "").unionByName(findings.join(own, "memory", "left_semi").select(*findings.columns))
    return passed(mine)


# Segments under the code root that are no repository.
NOT_A_REPO = ["check"]


def repos_named(block, code_root: str):
    """Distinct repositories that a block names under ``~/Code/`` or the absolute root, final dots dropped."""
    import re

    prefix = "(?:" + re.escape("~/Code/") + "|" + re.escape(code_root.rstrip("/") + "/") + ")"
    seg = F.transform(F.regexp_extract_all(block, F.lit(prefix + r"([A-Za-z0-9_.-]*)"), 1), lambda x: F.regexp_replace(x, r"\.+$", ""))
    return F.filter(F.array_distinct(seg), lambda x: (x != "") & ~x.isin(NOT_A_REPO))


def check_world(blocks: DataFrame, repos: DataFrame, code_root: str, readable: bool = True) -> DataFrame:
    """Repositories that a note's blocks (name, block) send a reader to and that aren't there, once for each note.

    A block that names the repository's place in the archive says that it is retired. A root that
    can't be read is itself the only finding.
    """
    if not readable:
        row = [("unresolvable-code-root", "(corpus)", f"{code_root} is not a readable directory")]
        return blocks.sparkSession.createDataFrame(row, "rule string, memory string, detail string")
    named = blocks.select("name", "block", F.explode(repos_named(F.col("block"), code_root)).alias("repo"))
    named = named.where(~F.col("block").contains(F.concat(F.lit("~/Archive/"), "repo")))
    dead = named.join(repos, "repo", "left_anti").select("name", "repo").distinct()
    return dead.select(F.lit("dead-repo-path").alias("rule"), F.col("name").alias("memory"), F.concat(F.lit("~/Code/"), "repo", F.lit(" does not exist")).alias("detail"))


def relation_usage(links: DataFrame) -> DataFrame:
    """Links of each stated relation, those without one as null."""
    return links.groupBy("relation").agg(F.count("*").alias("links"))
