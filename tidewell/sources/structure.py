"""Whether transcripts are intact: one finding for each rule that a line breaks, and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.turns import cycles
from .transcripts import UUID

# Types of lines, fields that every conversation line has, and where what may stand.
CONVERSATION = ["assistant", "user", "attachment", "system"]
METADATA = ["last-prompt", "permission-mode", "bridge-session", "mode", "queue-operation", "ai-title", "agent-name", "custom-title", "file-history-snapshot", "file-history-delta", "pr-link", "frame-link"]
REQUIRED = ["sessionId", "timestamp", "cwd", "version", "isSidechain", "userType", "gitBranch"]
WITH_MESSAGE, WITH_PROMPT_ID, ROOTABLE = ["user", "assistant"], "user", ["user", "system"]


def violations(lines: DataFrame, growing: bool = False, save=None) -> DataFrame:
    """(file, at, rule) of lines (file, session, at, raw); a cycle of parents is one finding, at 0.

    ``growing`` says that files are still being written: a last line that can't be parsed is then an
    incomplete tail. Lines are checked each on its own; only repeated uuids, parents and cycles look
    at the others of their file.
    """
    v = F.try_parse_json("raw")
    keys = F.from_json("raw", "map<string,string>")
    text = lambda path: F.try_variant_get(v, path, "string")
    once = F.inline(F.array(F.struct(
        v.isNotNull().alias("parsed"), F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("object"), F.coalesce(F.map_keys(keys), F.array().cast("array<string>")).alias("keys"),
        F.coalesce(text("$.type"), F.lit("")).alias("kind"), text("$.uuid").alias("uuid"), text("$.parentUuid").alias("parent"), F.schema_of_variant(F.try_variant_get(v, "$.parentUuid", "variant")).alias("parent_is"),
        text("$.sessionId").alias("claimed"), text("$.message.role").alias("role"),
    )))
    d = lines.select("file", "session", "at", once)
    has = lambda k: F.array_contains("keys", k)
    kind, ok = F.col("kind"), F.col("parsed") & F.col("object")
    talk, meta = ok & kind.isin(CONVERSATION), ok & kind.isin(METADATA)
    last = lines.groupBy("file").agg(F.max("at").alias("_last"))
    rules = [
        ("not-an-object", F.col("parsed") & ~F.col("object")), ("unknown-type", ok & ~kind.isin(CONVERSATION) & ~kind.isin(METADATA)),
        *[("missing-field", talk & ~has(f)) for f in REQUIRED], ("session-mismatch", talk & (F.col("claimed") != F.col("session"))),
        ("missing-field", talk & kind.isin(WITH_MESSAGE) & ~has("message")), ("unexpected-field", talk & ~kind.isin(WITH_MESSAGE) & has("message")), ("role-mismatch", talk & (F.col("role") != kind)),
        ("unexpected-field", talk & (kind != WITH_PROMPT_ID) & has("promptId")), ("missing-uuid", talk & F.col("uuid").isNull()), ("malformed-uuid", talk & ~F.col("uuid").rlike(UUID)),
        ("missing-parent-field", talk & ~has("parentUuid")), ("unrootable-type-at-root", talk & has("parentUuid") & (F.col("parent_is") == "VOID") & ~kind.isin(ROOTABLE)), ("non-string-parent", talk & has("parentUuid") & ~F.col("parent_is").isin("VOID", "STRING")),
        ("metadata-with-uuid", meta & F.col("uuid").isNotNull()), ("metadata-with-parent", meta & has("parentUuid")),
    ]
    single = d.select("file", "at", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), r) for r, test in rules]))).alias("rule"))
    torn = d.where("NOT parsed").join(last, "file").select("file", "at", F.when(F.lit(growing) & (F.col("at") == F.col("_last")), "incomplete-tail").otherwise("unparseable").alias("rule"))
    known = d.where(talk & F.col("uuid").isNotNull())
    first = known.groupBy("file", "uuid").agg(F.min_by("kind", "at").alias("_first"))
    changed = known.join(first, ["file", "uuid"]).where("kind <> _first").select("file", "at", F.lit("uuid-type-change").alias("rule"))
    child = known.where((F.col("parent_is") == "STRING") & F.col("parent").isNotNull())
    dangling = child.join(first.select("file", F.col("uuid").alias("parent")), ["file", "parent"], "left_anti").select("file", "at", F.lit("dangling-parent").alias("rule"))
    loops = cycles(child.select(F.col("file").alias("session"), "uuid", "parent", F.col("at").alias("line_no")), save)
    around = loops.select(F.col("session").alias("file"), F.lit(0).cast("long").alias("at"), F.lit("cycle").alias("rule"))
    return reduce(DataFrame.unionByName, [single, torn, changed, dangling, around.select("file", F.col("at").cast(lines.schema["at"].dataType).alias("at"), "rule")])


def totals(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings and files of each rule; under ``all`` the lines and files that were looked at."""
    each = found.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    return each.unionByName(lines.agg(F.lit("all").alias("rule"), F.count("*").alias("n"), F.count_distinct("file").alias("files")))
