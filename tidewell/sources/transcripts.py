"""Append-only JSONL transcripts, and the tables decoded from them.

Lines are read with Spark's splittable text reader, so a file of many gigabytes is many tasks. The
place of a line is ``at``: the split's first byte (in MiB) and the line's number within the task,
which together grow with the file; ``line_no`` (a window over each file) is there for those who
need dense numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import refused_dirs
from ..operators import scan

# What a refusal begins with; tracked tools and their roles.
REFUSAL = "The user doesn't want to proceed with this tool use"
ROLES = {"Read": "read", "Write": "write", "Edit": "write", "Grep": "none", "Agent": "none", "WebFetch": "none", "WebSearch": "none"}
UUID = r"^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"
_BLOCKS = "array<struct<type:string,id:string,name:string,input:variant,tool_use_id:string,is_error:boolean,content:variant,text:string>>"


def is_transcript(path):
    return path.rlike(r"\.jsonl$")


def is_conversation(path):
    """A transcript whose stem is a lower-case hex uuid."""
    return F.regexp_extract(path, r"([^/]+)\.jsonl$", 1).rlike(UUID)


def lines(spark: SparkSession, root: str) -> DataFrame:
    """file, session, delegated, at, raw of every non-empty line under ``root``.

    A file directly under a project directory is a main transcript owned by its stem; what lies
    deeper is delegated and owned by the directory two below the root.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    file = F.col("_metadata.file_path")
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = F.shiftleft(F.floor(F.col("_metadata.file_block_start") / (1 << 20)), 33) + index
    got = text.select(file.alias("file"), at.alias("at"), F.col("value").alias("raw"))
    base = root.rstrip("/").split("://")[-1].split("file:")[-1]
    parts = F.split(F.substring_index(F.col("file"), base + "/", -1), "/")
    delegated = F.size(parts) > 2
    session = F.when(delegated, parts[1]).otherwise(F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", ""))
    return got.where("raw <> ''").select("file", session.alias("session"), delegated.alias("delegated"), "at", "raw")


def numbered(line: DataFrame, save=None, parts: int | None = None) -> DataFrame:
    """Dense line numbers within each file; a file of any size is numbered in ranges."""
    return scan.Ordered(line, "file", ["at"], save, parts).values(line_no=scan.count()).plain()


def decode(line: DataFrame) -> DataFrame:
    """Lines with their parsed head fields and blocks; a line that isn't JSON has nulls.

    Parsed JSON decides (not the first textual occurrence of a key).
    """
    v = F.try_parse_json("raw")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    return line.select(
        *line.columns, get("$.type").alias("type"), get("$.uuid").alias("uuid"), get("$.parentUuid").alias("parent"), get("$.promptId").alias("prompt_id"),
        F.nullif(get("$.cwd"), F.lit("")).alias("cwd"), get("$.timestamp").alias("stamp"), get("$.sessionId").alias("of_session"),
        get("$.message.content", _BLOCKS).alias("blocks"), get("$.message.content").alias("said"), get("$.agentName").alias("agent_name"), get("$.customTitle").alias("custom_title"),
        (get("$.message.usage.input_tokens", "long") + F.coalesce(get("$.message.usage.cache_creation_input_tokens", "long"), F.lit(0)) + F.coalesce(get("$.message.usage.cache_read_input_tokens", "long"), F.lit(0))).alias("prompt_tokens"),
    )


def _exploded(decoded: DataFrame, kind: str) -> DataFrame:
    wanted = decoded.where(F.col("raw").contains(f'"{kind}"'))  # cheap, before the blocks are opened
    return wanted.select("file", "session", "delegated", "at", "cwd", "stamp", F.posexplode("blocks").alias("block", "b")).where(F.col("b.type") == kind)


def calls(decoded: DataFrame) -> DataFrame:
    """Tool calls: call_id, tool, role, path, command, with line cwd and stamp."""
    b = _exploded(decoded, "tool_use")
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.col("b.name")]
    get = lambda k: F.try_variant_get(F.col("b.input"), f"$.{k}", "string")
    path = F.when(role.isin("read", "write"), F.coalesce(get("file_path"), get("notebook_path"), get("path")))
    label = F.substring(F.coalesce(*[F.nullif(F.trim(get(k)), F.lit("")) for k in ("description", "command", "prompt")]), 1, 60)
    return b.select("file", "session", "delegated", "at", "block", "cwd", "stamp", F.col("b.id").alias("call_id"), F.col("b.name").alias("tool"), role.alias("role"), path.alias("path"), F.when(F.col("b.name") == "Bash", get("command")).alias("command"), label.alias("label"))


def results(decoded: DataFrame) -> DataFrame:
    """Tool results: call_id, verdict, text, and the directories that a shell refused."""
    b = _exploded(decoded, "tool_result")
    content = F.col("b.content")
    text = F.coalesce(F.array_join(F.try_variant_get(content, "$", "array<struct<text:string>>")["text"], "\n"), F.try_variant_get(content, "$", "string"))
    verdict = F.when(F.coalesce(text, F.lit("")).startswith(REFUSAL), "rejected").when(F.coalesce("b.is_error", F.lit(False)), "failed").otherwise("ok")
    return b.select("file", "session", "at", "block", F.col("b.tool_use_id").alias("call_id"), verdict.alias("verdict"), text.alias("text"), refused_dirs(F.coalesce(text, F.lit(""))).alias("refused"))


def prompts(decoded: DataFrame) -> DataFrame:
    """User lines without a tool result."""
    return decoded.where((F.col("type") == "user") & ~F.exists(F.coalesce("blocks", F.array().cast(_BLOCKS)), lambda x: x["type"] == "tool_result"))


def command_corpus(call: DataFrame, result: DataFrame) -> DataFrame:
    """One row for each distinct Bash call id of a file: cmd, cwd, ran, at, refused."""
    bash = call.where("tool = 'Bash' AND command IS NOT NULL")
    first = bash.groupBy("file", "call_id").agg(F.min_by(F.struct("command", "cwd", "stamp"), F.struct("at", "block")).alias("c"))
    last = result.groupBy("call_id").agg(F.max_by(F.struct("verdict", "refused"), F.struct("at", "block")).alias("r"))
    j = first.join(last, "call_id", "left")
    return j.select("file", "call_id", F.col("c.command").alias("cmd"), F.col("c.cwd").alias("cwd"), F.coalesce("r.verdict", F.lit("unknown")).alias("ran"), F.col("c.stamp").alias("at"), F.col("r.refused").alias("refused"))


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Session names; empty ones are left out."""
    r = spark.read.schema("sessionId string, name string").option("multiLine", "true").option("pathGlobFilter", "*.json").json(root)
    return r.where("sessionId IS NOT NULL AND name <> ''").select(F.col("sessionId").alias("session_id"), "name")


def transcript_ids(line: DataFrame) -> DataFrame:
    return line.where("NOT delegated").select("session", "file").distinct()


def appended(spark: SparkSession, root: str, **options) -> DataFrame:
    """Complete lines of the transcripts under ``root`` by byte offset (``sources.appended``): file, at, next, raw.

    ``tailBytes`` or ``headBytes`` read only so much of each file's end or beginning.
    """
    from . import appended as source

    source.register(spark)
    return spark.read.format("appended_lines").options(path=root, **options).load()


def put(line: DataFrame, root: str) -> None:
    """Writes lines (file, raw), each file's in one partition and in order, as files under ``root`` (``sources.appended``)."""
    from . import appended as source

    source.register(line.sparkSession)
    line.select("file", "raw").write.format("appended_lines").mode("overwrite").save(root)


def tails(decoded: DataFrame) -> DataFrame:
    """Of lines of each file's end: the last context figure (none once compacted), when it last spoke, and its name.

    The last title that a person chose goes before the last name of the agent.
    """
    at = F.col("at")
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), at))
    raw = F.try_parse_json("raw")
    boundary = (F.col("type") == "system") & (F.try_variant_get(raw, "$.subtype", "string") == "compact_boundary")
    context = F.when(boundary, F.struct(F.lit(None).cast("long").alias("v"))).when(F.col("prompt_tokens").isNotNull(), F.struct(F.col("prompt_tokens").alias("v")))
    spoke = F.when(F.col("type").isin("user", "assistant") | boundary, F.col("stamp"))
    name = F.coalesce(last(F.nullif(F.trim("custom_title"), F.lit(""))), last(F.nullif(F.trim("agent_name"), F.lit(""))))
    return decoded.groupBy("file").agg(last(context)["v"].alias("context"), last(spoke).alias("spoke"), name.alias("name"))


def first_directory(decoded: DataFrame) -> DataFrame:
    """Of lines of each file's beginning: the first working directory that a line tells."""
    return decoded.groupBy("file").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("at"))).alias("cwd"))


def ends(decoded: DataFrame) -> DataFrame:
    """First cwd, last stamp and last context of each file (what head and tail reads look for)."""
    return decoded.groupBy("file").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("at"))).alias("first_cwd"), F.max("stamp").alias("last_spoke"), F.max_by("prompt_tokens", F.when(F.col("prompt_tokens").isNotNull(), F.col("at"))).alias("context"))


def strays(spark: SparkSession, root: str) -> DataFrame:
    """JSON files in each directory, from the listing alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).select("path")
    return f.groupBy(F.element_at(F.split("path", "/"), -2).alias("holder")).agg(F.count("*").alias("strays"))


def processes(spark: SparkSession, path: str, parent: int) -> DataFrame:
    """Defunct children of ``parent`` in a process table (pid ppid state command)."""
    w = F.split(F.trim("value"), r"\s+", 4)
    t = spark.read.text(path).select(F.try_to_number(w[0], F.lit("9999999")).cast("long").alias("pid"), F.try_to_number(w[1], F.lit("9999999")).cast("long").alias("ppid"), w[2].alias("state"), F.get(w, F.lit(3)).alias("command"))
    return t.where((F.col("ppid") == parent) & F.col("state").startswith("Z"))


# The attachment whose content may be emptied.
REMINDER = "task_reminder"


def slim(line: DataFrame) -> DataFrame:
    """What emptying reminders would leave: lines emptied, already empty and untouched, bytes read and written.

    Only lines that speak of reminders are parsed. One whose attachment is a reminder with content would
    be written anew, compact and without it; all others stay as they are. Line ends count.
    """
    v = F.try_parse_json("raw")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    speaks = F.col("raw").contains(REMINDER)
    full = speaks & (get("$.attachment.type", "string") == REMINDER) & (F.size(get("$.attachment.content", "array<variant>")) > 0)
    full, size = F.coalesce(full, F.lit(False)), F.octet_length("raw") + 1
    left = F.octet_length(F.to_json(v)) - F.octet_length(F.to_json(get("$.attachment.content", "variant"))) + 3
    return line.agg(
        F.count_if(full).alias("emptied"), F.count_if(speaks & ~full).alias("already_empty"), F.count_if(~speaks).alias("untouched"),
        F.sum(size).alias("bytes"), F.sum(F.when(full, left).otherwise(size)).alias("written"),
    )


def project(path, code_root: str):
    return P.project_of(path, code_root)
