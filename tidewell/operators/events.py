"""Transcript lines as typed events, and what results say of work left running.

An event is a row: file, at, pos (its place in the line), kind, id, name, text, ok, cut, tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

# The length of a result that is kept, and what stands for a picture.
RESULT_SNIPPET, PICTURE = 2000, "[an image]"
# Tags that begin what a program put into a prompt; the note that ties a picture to its copy.
PLUMBING = ["<command-name>", "<local-command-stdout>", "<local-command-caveat>", "<system-reminder>", "<command-message>"]
ALSO_AT = "(the image is also at "
# How a result opens that left work running, and what its id follows.
DETACHED = [
    ("Command running in background with ID: ", "Command running in background with ID: "),
    ("Command did not complete within its", "and was moved to the background (ID: "),
    ("Async agent launched successfully", "\nagentId: "),
    ("Monitor started (task ", "Monitor started (task "),
]
STOPPED = '{"message":"Successfully stopped task: '
# Ends of background work that name no call.
TIMED_OUT, NO_RECORD = "[Monitor timed out — re-arm if needed.]", "No completion record was found for background agent"

EVENT = "kind string, id string, name string, text string, ok boolean, cut int, tokens long"


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the next ``end``; null without both."""
    after = F.when(text.contains(start), F.substr(text, F.call_function("instr", text, F.lit(start)) + len(start)))
    return F.when(after.contains(end), F.substring_index(after, end, 1))


def is_notification(text: Column) -> Column:
    return text.contains("<task-notification>") & F.regexp_replace(text, r"\s+$", "").endswith("</task-notification>")


def commanded(text: Column) -> Column:
    """A slash command with its arguments, if the text is the echo of one."""
    head = F.regexp_replace(text, r"^\s+", "")
    said = F.concat_ws(" ", between(head, "<command-name>", "</command-name>"), F.coalesce(between(head, "<command-args>", "</command-args>"), F.lit("")))
    echo = (head.startswith("<command-name>") | head.startswith("<command-message>")) & between(head, "<command-name>", "</command-name>").isNotNull()
    return F.when(echo, F.trim(said))


def is_plumbing(text: Column) -> Column:
    head, out = F.regexp_replace(text, r"^\s+", ""), F.lit(False)
    for tag in PLUMBING:
        out = out | head.startswith(tag)
    return out


def id_at(rest: Column) -> Column:
    """The letters and digits that a text begins with."""
    return F.nullif(F.regexp_extract(rest, "^[A-Za-z0-9]+", 0), F.lit(""))


def detached(said: Column) -> tuple[Column, Column]:
    """Whether a result says that it left work running, and under which id (null if that can't be read)."""
    began, task = F.lit(False), F.lit(None).cast("string")
    for opens, before in reversed(DETACHED):
        rest = F.when(said.contains(before), F.substr(said, F.call_function("instr", said, F.lit(before)) + len(before)))
        began, task = said.startswith(opens) | began, F.when(said.startswith(opens), id_at(rest)).otherwise(task)
    return began, task


def stopped(said: Column) -> Column:
    """The task that a result says was stopped."""
    return F.when(said.startswith(STOPPED), id_at(F.substr(said, F.lit(len(STOPPED) + 1))))


def _event(kind: str, **given) -> Column:
    cols = {c.split()[0]: c.split()[1] for c in EVENT.split(", ")}
    return F.struct(*[(F.lit(kind) if c == "kind" else given.get(c, F.lit(None)).cast(t)).alias(c) for c, t in cols.items()])


def _finished(text: Column) -> Column:
    """The end of background work that a notification tells of, by its call or, in two cases, by its task."""
    status = F.coalesce(between(text, "<status>", "</status>"), F.lit("done"))
    call, task = between(text, "<tool-use-id>", "</tool-use-id>"), between(text, "<task-id>", "</task-id>")
    nameless = F.coalesce(between(text, "<event>", "</event>") == TIMED_OUT, F.lit(False)) | F.coalesce(between(text, "<summary>", "</summary>").startswith(NO_RECORD), F.lit(False))
    named = F.when(is_notification(text) & call.isNotNull(), _event("background", id=call, text=status))
    return named.when(is_notification(text) & task.isNotNull() & nameless, _event("background", name=task, text=status))


def result_text(content: Column) -> Column:
    """Text of a result's content (a variant: a string, or blocks), pictures as a marker, blocks on lines of their own."""
    blocks = F.try_variant_get(content, "$", "array<struct<type:string,text:string>>")
    said = F.transform(blocks, lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).when(b["type"] == "image", PICTURE))
    return F.coalesce(F.array_join(F.array_compact(said), "\n"), F.try_variant_get(content, "$", "string"), F.lit(""))


def recorded(decoded: DataFrame) -> DataFrame:
    """Typed events of decoded lines (``transcripts.decode``).

    Consecutive prompts of one message are one, with a blank line between; what the program itself
    put into a prompt is none. A message that carries a picture tells its name, then the words.
    """
    raw = F.try_parse_json("raw")
    get = lambda path: F.try_variant_get(raw, path, "string")
    plain = F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("input"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("boolean").alias("is_error"), F.lit(None).cast("variant").alias("content"), get("$.message.content").alias("text")))
    type_ = F.col("type")
    line = decoded.withColumn("blocks", F.coalesce("blocks", F.when(type_.isin("user", "assistant") & get("$.message.content").isNotNull(), plain)))
    carries = F.exists("blocks", lambda b: b["type"] == "image")

    # generators keep what they make from being made again for each use
    once = lambda **f: F.inline(F.array(F.struct(*[v.alias(k) for k, v in f.items()])))
    head = line.where(type_.isin("queue-operation", "system", "assistant")).select("file", "at", "type", "prompt_tokens", once(operation=get("$.operation"), content=F.coalesce(get("$.content"), F.lit("")), subtype=get("$.subtype")))
    queued = F.when((type_ == "queue-operation") & (F.col("operation") == "enqueue"), _finished(F.col("content")))
    compacted = F.when((type_ == "system") & (F.col("subtype") == "compact_boundary"), _event("compacted"))
    context = F.when((type_ == "assistant") & F.col("prompt_tokens").isNotNull(), _event("context", tokens=F.col("prompt_tokens")))
    heads = head.select("file", "at", F.lit(-1).alias("pos"), F.lit(0).alias("part"), F.coalesce(queued, compacted, context).alias("e"))

    each = line.where(type_.isin("user", "assistant")).select("file", "at", "type", carries.alias("carries"), F.posexplode("blocks").alias("pos", "b"))
    text, whole = F.coalesce("b.text", F.lit("")), F.col("whole")
    each = each.select("file", "at", "type", "carries", "pos", "b", once(whole=F.when(F.col("b.type") == "tool_result", result_text(F.col("b.content"))), text=text))
    each = each.select("*", once(command=commanded(F.col("text")), ended=_finished(F.col("text"))))
    long = F.char_length(whole) > RESULT_SNIPPET
    result = _event("result", id=F.col("b.tool_use_id"), ok=~F.coalesce("b.is_error", F.lit(False)), text=F.when(long, F.substring(whole, 1, RESULT_SNIPPET)).otherwise(whole), cut=F.when(long, F.char_length(whole)))
    # a picture's copy: the last note of it in the text, up to its closing bracket
    note = F.when(F.col("text").contains(ALSO_AT), F.substring_index("text", ALSO_AT, -1))
    note = F.when(note.contains(")"), note)
    file = F.substring_index(F.substring_index(note, ")", 1), "/", -1)
    before = F.substr(F.col("text"), F.lit(1), F.char_length("text") - F.char_length(note) - len(ALSO_AT))
    words = F.when(note.isNull(), F.col("text")).otherwise(F.trim(F.concat(before, F.substr(note, F.call_function("instr", note, F.lit(")")) + 1))))
    user = F.col("type") == "user"
    said = (F.col("b.type") == "text") & user
    own = ~is_notification(F.col("text"))
    prompt = F.when(own & F.col("command").isNotNull(), _event("command", text=F.col("command"))).when(own & ~is_plumbing(F.col("text")), _event("prompt", text=F.col("text")))
    first = (
        F.when((F.col("b.type") == "text") & ~user, _event("text", text=F.col("text")))
        .when((F.col("b.type") == "tool_use") & ~user, _event("tool", id=F.col("b.id"), name=F.col("b.name"), text=F.to_json("b.input")))
        .when((F.col("b.type") == "tool_result") & user, result)
        .when(said & F.col("carries"), F.when(note.isNotNull(), _event("shown", name=file)))
        .when(said, F.coalesce("ended", prompt))
    )
    second = F.when(said & F.col("carries") & (words != ""), _event("prompt", text=words))
    events = each.select("file", "at", "pos", F.posexplode(F.array(first, second)).alias("part", "e")).unionByName(heads).where("e IS NOT NULL")
    events = events.select("file", "at", "pos", "part", "e.*")
    # prompts that follow each other in a message
    order = Window.partitionBy("file", "at").orderBy("pos", "part")
    begins = ~((F.col("kind") == "prompt") & F.coalesce(F.lag("kind").over(order) == "prompt", F.lit(False)))
    run = F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = events.withColumn("run", run)
    joined = numbered.groupBy("file", "at", "run").agg(
        F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "text"))), lambda x: x["text"]), "\n\n").alias("_said"), F.count("text").alias("_n"),
        *[F.min_by(c, F.struct("pos", "part")).alias(c) for c in ("kind", "id", "name", "ok", "cut", "tokens")],
    )
    return joined.select("file", "at", F.col("run").alias("pos"), "kind", "id", "name", F.when(F.col("_n") > 0, F.col("_said")).alias("text"), "ok", "cut", "tokens")


# The model of a message that nothing generated.
SYNTHETIC = "<synthetic>"


def live(decoded: DataFrame, save=None, parts: int | None = None) -> DataFrame:
    """Events of a session's live output: file, at, pos, kind, id, call, name, text, ok, cut, tokens, cost, resets_at, utilization.

    Text comes from its pieces, assembled by message, block and order of arrival, at the place of the
    first: a message begins with its ``message_start`` (those of a delegated session run beside the
    session's own). Calls and context come from the completed message, whose text counts only where nothing
    generated it. Prompts and results are read as they are from a transcript.
    """
    v = F.try_parse_json("raw")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    of = lambda t: decoded.where(F.col("type") == t)
    cols = {"id": "string", "call": "string", "name": "string", "text": "string", "ok": "boolean", "cut": "int", "tokens": "long", "cost": "double", "resets_at": "long", "utilization": "double"}

    def one(rows: DataFrame, kind, pos=None, **given) -> DataFrame:
        return rows.select("file", "at", (F.lit(0) if pos is None else pos).cast("int").alias("pos"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in cols.items()])

    pieces = of("stream_event").select(
        "file", "at", F.coalesce(get("$.parent_tool_use_id"), F.lit("")).alias("under"), get("$.event.type").alias("what"), get("$.event.message.id").alias("begins"),
        get("$.event.index", "long").alias("block"), get("$.event.delta.type").alias("delta"), get("$.event.delta.text").alias("text"),
    )
    pieces = scan.Ordered(pieces, ["file", "under"], ["at"], save, parts).values(message=scan.last(F.when(F.col("what") == "message_start", F.coalesce("begins", F.lit(""))))).plain()
    pieces = pieces.where("what = 'content_block_delta' AND delta = 'text_delta' AND text IS NOT NULL")
    # of each block its pieces only, which a message bounds
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    spoken = pieces.groupBy("file", "under", "message", "block").agg(F.min("at").alias("at"), whole.alias("text"))

    message = of("assistant").select("file", "at", "prompt_tokens", "blocks", get("$.message.model").alias("model"))
    block = message.select("file", "at", "model", F.posexplode("blocks").alias("pos", "b")).withColumn("pos", F.col("pos") + 1)
    turn = of("result").withColumn("windows", F.map_values(get("$.modelUsage", "map<string, struct<contextWindow: bigint>>"))["contextWindow"])
    limit, ask = of("rate_limit_event"), of("control_request").where(get("$.request.subtype") == "can_use_tool")
    about = lambda k, kind="string": get(f"$.rate_limit_info.{k}", kind)
    window = F.array_max("windows")
    told = recorded(of("user"))
    out = [
        one(spoken, "text", text=F.col("text")), one(of("system").where(get("$.subtype") == "init"), "started", name=get("$.model")), one(of("system").where(get("$.subtype") == "status"), "busy", text=get("$.status")),
        one(message.where("prompt_tokens IS NOT NULL"), "context", tokens=F.col("prompt_tokens")), one(block.where("b.type = 'tool_use'"), "tool", F.col("pos"), id=F.col("b.id"), name=F.col("b.name"), text=F.to_json("b.input")),
        one(block.where((F.col("b.type") == "text") & (F.col("model") == SYNTHETIC) & (F.trim("b.text") != "")), "text", F.col("pos"), text=F.col("b.text")),
        one(turn, "turn", tokens=F.when(window > 0, window), cost=F.coalesce(get("$.total_cost_usd", "double"), F.lit(0.0)), text=get("$.stop_reason")),
        one(limit, "limit", name=about("rateLimitType"), text=about("status"), resets_at=about("resetsAt", "long"), utilization=about("utilization", "double")),
        one(ask, "ask", id=get("$.request_id"), call=get("$.request.tool_use_id"), name=get("$.request.tool_name"), text=get("$.request.title")),
        one(told, F.col("kind"), F.col("pos"), **{c: F.col(c) for c in ("id", "name", "text", "ok", "cut", "tokens")}),
    ]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def running(events: DataFrame) -> DataFrame:
    """What events say of background work: file, at, pos, says (began, killed, ended, gone), call and task."""
    began, task = detached(F.col("text"))
    result = F.col("kind") == "result"
    says = F.when(result & began, "began").when(result & stopped(F.col("text")).isNotNull(), "killed").when(F.col("kind") == "background", "ended").when(F.col("kind") == "joined", "gone")
    call = F.when(F.col("says").isin("began", "ended"), F.col("id"))
    named = F.when(F.col("says") == "began", task).when(F.col("says") == "killed", stopped(F.col("text"))).when(F.col("says") == "ended", F.col("name"))
    return events.withColumn("says", says).where("says IS NOT NULL").select("file", "at", "pos", "says", call.alias("call"), named.alias("task"))
