"""Queries over live sessions: what is unread, silences, the session fold, and its streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inflight
from ..sources.scratch import Scratch
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Conversations as the events of live sessions. A row of a role gives those of its events whose
# condition holds, at its turn's time and in this order: (role, kind, condition, id, name, text, tokens,
# cost), in SQL that Spark and DuckDB both read; c is the conversation, t the turn, n the text's length.
_MADE = [
    ("user", "accepted", "true", None, None, "'m' || (n % 3)", None, None),
    ("user", "prompt", "(c + t) % 3 <> 0", None, None, "'m' || (n % 3)", None, None),
    ("user", "command", "(c + 2 * t) % 5 = 0", None, None, "'/compact now'", None, None),
    ("user", "prompt", "n % 7 = 0", None, None, "'own'", None, None),
    ("user", "began", "n % 2 = 0", "'c' || t", "'t' || (t % 3)", None, None, None),
    ("user", "joined", "n % 17 = 0", None, None, None, None, None),
    ("assistant", "started", "t = 1", None, "'model' || (c % 3)", None, None, None),
    ("assistant", "busy", "true", None, None, "'thinking'", None, None),
    ("assistant", "text", "n % 5 <> 0", None, None, "'words'", None, None),
    ("assistant", "ask", "n % 3 = 0", "'q' || t", "'Bash'", None, None, None),
    ("assistant", "answered", "n % 4 <> 0", "'q' || (t - n % 2)", None, None, None, None),
    ("assistant", "context", "n % 5 <> 1", None, None, None, "n", None),
    ("assistant", "ended", "n % 3 = 1", "'c' || (t - 1)", None, None, None, None),
    ("assistant", "ended", "n % 10 = 4", None, "'t' || (n % 3)", None, None, None),
    ("assistant", "killed", "n % 7 = 3", None, "'t' || (n % 3)", None, None, None),
    ("assistant", "turn", "n % 6 <> 0", None, None, None, "CASE WHEN n % 2 = 0 THEN 200000 + c END", "CASE WHEN n % 9 <> 0 THEN n / 4.0 END"),
    ("assistant", "limit", "n % 8 < 2", None, None, "CASE WHEN n % 8 = 0 THEN 'allowed' ELSE 'warning' END", None, None),
    ("assistant", "compacted", "n % 13 = 0", None, None, None, None, None),
    ("assistant", "exited", "n % 11 = 0", None, None, None, None, None),
    ("system", "joined", "true", None, None, None, None, None),
]
_FIELDS = {"id": "STRING", "name": "STRING", "text": "STRING", "tokens": "BIGINT", "cost": "DOUBLE"}
_AT = "1000 + t * 60000 * (1 + c % 17) + c % 7 * 1000"
_ROWS = "SELECT conv_id AS c, turn AS t, role, CAST(length(text) AS BIGINT) AS n FROM conversations"


def _sql(made, fields) -> str:
    each = [(p, m, ", ".join(f"CAST({v or 'NULL'} AS {kind}) AS {k}" for (k, kind), v in zip(fields.items(), m[3:], strict=True))) for p, m in enumerate(made)]
    return "(" + "\n UNION ALL ".join(f"SELECT CAST(c AS STRING) AS session, t * 32 + {p} AS seq, {_AT} + {p * 100} AS \"at\", '{m[1]}' AS kind, {values} FROM ({_ROWS}) WHERE role = '{m[0]}' AND {m[2]}" for p, m, values in each) + ")"


def _made(spark, d, made, fields):
    """The same as one pass over the table."""
    rows = table(spark, d, "conversations").selectExpr("conv_id AS c", "turn AS t", "role", "CAST(length(text) AS BIGINT) AS n")
    one = []
    for p, m in enumerate(made):
        values = ", ".join(f"'{k}', CAST({v or 'NULL'} AS {kind})" for (k, kind), v in zip(fields.items(), m[3:], strict=True))
        one.append(F.expr(f"CASE WHEN role = '{m[0]}' AND {m[2]} THEN named_struct('seq', t * 32 + {p}, 'at', {_AT} + {p * 100}, 'kind', '{m[1]}', {values}) END"))
    return rows.select(F.col("c").cast("string").alias("session"), F.explode(F.array_compact(F.array(*one))).alias("e")).select("session", "e.*")


EVENTS = _sql(_MADE, _FIELDS)


def events(spark, d):
    return _made(spark, d, _MADE, _FIELDS)


# One event after the other: the queue of unread messages and the clocks, as a recursive query over each session's events.
_MACHINE = f"""e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn, lead("at") OVER (PARTITION BY session ORDER BY seq) AS next_at FROM {EVENTS}),
 s AS (SELECT session, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS kind, CAST([] AS STRUCT(t VARCHAR, w BIGINT)[]) AS q, CAST(NULL AS BIGINT) AS idle_since, CAST(NULL AS BIGINT) AS decided, false AS compacting, false AS working, true AS alive,
  false AS announced, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS allowed, false AS reports FROM e GROUP BY session
  UNION ALL SELECT session, rn, kind, q, idle_since, decided, compacting, working, alive, announced OR coalesce(due <= coalesce(next_at, until), false), due, allowed, NOT announced AND coalesce(due <= coalesce(next_at, until), false) FROM (
   SELECT *, CASE WHEN alive THEN least(CASE WHEN idle_since IS NOT NULL AND len(q) > 0 THEN greatest(idle_since, q[1].w) END, decided) + allowed END AS due FROM (
    SELECT s.session, e.rn, e.kind, e.next_at, (SELECT max("at") FROM e) AS until,
     CASE WHEN e.kind = 'accepted' THEN list_append(q, {{t: e.text, w: e."at"}}) WHEN e.kind = 'prompt' AND list_contains(list_transform(q, lambda x: x.t), e.text)
      THEN q[:list_position(list_transform(q, lambda x: x.t), e.text) - 1] || q[list_position(list_transform(q, lambda x: x.t), e.text) + 1:] ELSE q END AS q,
     CASE WHEN e.kind IN ('turn', 'started', 'joined') THEN e."at" WHEN e.kind IN ('text', 'tool', 'result', 'context', 'prompt') THEN NULL ELSE idle_since END AS idle_since,
     CASE WHEN e.kind = 'answered' THEN coalesce(decided, e."at") WHEN e.kind IN ('text', 'tool', 'result', 'context', 'prompt', 'turn') THEN NULL ELSE decided END AS decided,
     CASE WHEN e.kind = 'command' AND starts_with(e.text, '/compact') THEN true WHEN e.kind IN ('text', 'tool', 'result', 'context', 'prompt', 'turn') THEN false ELSE compacting END AS compacting,
     CASE WHEN e.kind IN ('text', 'tool', 'result', 'context', 'prompt') THEN true WHEN e.kind IN ('turn', 'exited', 'started', 'joined') THEN false ELSE working END AS working,
     alive AND e.kind <> 'exited' AS alive, announced AND e.kind <> 'prompt' AS announced,
     CASE WHEN (CASE WHEN e.kind = 'command' AND starts_with(e.text, '/compact') THEN true WHEN e.kind IN ('text', 'tool', 'result', 'context', 'prompt', 'turn') THEN false ELSE compacting END) THEN 900000 ELSE 90000 END AS allowed
    FROM s JOIN e ON e.session = s.session AND e.rn = s.rn + 1)))"""


@query(f'WITH RECURSIVE {_MACHINE} SELECT session, due AS "at", CAST(len(q) AS BIGINT) AS unread, CAST(allowed AS BIGINT) AS waited FROM s WHERE reports')
def deaf_silences(spark, d):
    e = events(spark, d)
    save = Scratch(spark, "silences").table
    until = e.agg(F.max("at")).first()[0]
    return inflight.silences(save(inflight.standing(e, save)), until, save)


_SET = f"""asks AS (SELECT session, id, max(seq) AS seq, arg_max(kind, seq) AS kind FROM {EVENTS} WHERE kind IN ('ask', 'answered') GROUP BY session, id),
 pend AS (SELECT session, string_agg(id, ',' ORDER BY id) AS pending FROM asks a WHERE kind = 'ask' AND NOT EXISTS (SELECT 1 FROM e WHERE e.session = a.session AND e.kind = 'exited' AND e.seq > a.seq) GROUP BY session),
 work AS (SELECT session, id AS call, max(seq) AS seq, arg_max(name, seq) AS task FROM {EVENTS} WHERE kind = 'began' GROUP BY session, id),
 back AS (SELECT session, string_agg(call, ',' ORDER BY call) AS background FROM work w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session = w.session AND e.seq > w.seq
  AND (e.kind = 'joined' OR e.kind = 'ended' AND e.id = w.call OR e.kind IN ('ended', 'killed') AND e.name = w.task)) GROUP BY session),
 scal AS (SELECT session, max(seq) AS seq, arg_max(name, seq) FILTER (kind = 'started') AS model, arg_max({{v: CASE WHEN kind = 'busy' THEN text END}}, seq) FILTER (kind IN ('busy', 'turn', 'exited')) AS busy,
  arg_max({{v: CASE WHEN kind = 'context' THEN tokens END}}, seq) FILTER (kind IN ('context', 'compacted')) AS context, arg_max(tokens, seq) FILTER (kind = 'turn' AND tokens IS NOT NULL) AS win,
  arg_max({{v: cost}}, seq) FILTER (kind = 'turn') AS cost, arg_min(text, seq) FILTER (kind = 'prompt') AS asked, arg_max(text, seq) FILTER (kind = 'limit') AS lim FROM e GROUP BY session),
 now AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY rn DESC) = 1)"""
_FOLD = f"""WITH RECURSIVE {_MACHINE}, {_SET} SELECT session, seq, model, busy.v AS busy, context.v AS context, win AS "window", cost.v AS cost, asked, lim AS "limit", idle_since, decided, compacting, working, alive,
 CAST(len(q) AS BIGINT) AS unread, q[1].w AS oldest, coalesce(pending, '') AS pending, coalesce(background, '') AS background FROM scal JOIN now USING (session) LEFT JOIN pend USING (session) LEFT JOIN back USING (session)"""


def _listed(df):
    return df.withColumns({c: F.array_join(c, ",") for c in ("pending", "background")})


@query(_FOLD)
def session_fold(spark, d):
    e = events(spark, d)
    save = Scratch(spark, "fold").table
    return _listed(inflight.folded(e, save(inflight.standing(e, save))))


def _folded_stream(spark, d):
    """All that the fold puts out over the events as a stream of three files, in order of time."""
    from ..streaming import fold, sessions

    scratch = Scratch(spark, "fold-stream")
    e = scratch.table(events(spark, d).withColumn("stamp", F.timestamp_millis("at")))
    for low, high in ((0, 200_000), (200_000, 900_000), (900_000, 2**62)):
        e.where((F.col("at") >= low) & (F.col("at") < high)).coalesce(1).write.mode("append").parquet(f"{scratch.path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch.path}/in").withWatermark("stamp", "0 seconds")
    with fold.in_rocksdb(spark):
        return sessions.run_once(fold.session_fold(stream), f"{scratch.path}/run")


@query(_FOLD)
def stream_session_fold(spark, d):
    from ..streaming import sessions

    out = sessions.newest(_folded_stream(spark, d).where("report = 'state'"), ["session"], "batch")
    return _listed(out.drop("batch", "report", "announced", "at", "waited"))


@query(ORACLE_SQL["deaf_silences"])
def stream_deaf_silences(spark, d):
    return _folded_stream(spark, d).where("report = 'deaf'").select("session", "at", "unread", "waited")


@query(f"""WITH RECURSIVE {_MACHINE}, m AS (SELECT session, text, "at", seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS k FROM {EVENTS} WHERE kind = 'accepted'),
 held AS (SELECT session, rn, list_transform(q, lambda x: x.w) AS w FROM s) SELECT m.session, m.text, m."at", (SELECT min(x.seq) FROM e x JOIN held h ON h.session = x.session AND h.rn = x.rn WHERE x.session = m.session AND x.seq > m.seq AND NOT list_contains(h.w, m."at")) AS read FROM m""")
def read_receipts(spark, d):
    return inflight.receipts(events(spark, d)).select("session", "text", "at", "read")


# Conversations as what a page is made of: (role, kind, condition, id, call, name, text, ok).
_PAGE_MADE = [
    ("user", "accepted", "true", None, None, None, "'m' || (n % 3)", None),
    ("user", "prompt", "(c + t) % 3 <> 0", None, None, None, "'m' || (n % 3)", None),
    ("user", "command", "(c + 2 * t) % 5 = 0", None, None, None, "'/compact'", None),
    ("user", "prompt", "n % 7 = 0", None, None, None, "'own'", None),
    ("assistant", "text", "n % 5 <> 0", None, None, None, "'one '", None),
    ("assistant", "context", "true", None, None, None, None, None),
    ("assistant", "text", "n % 3 = 0", None, None, None, "'two '", None),
    ("assistant", "tool", "true", "'k' || t", None, "'Bash'", "'ls ' || t", None),
    ("assistant", "tool", "n % 2 = 0", "'k' || (t - n % 4)", None, "'Read'", "'again'", None),
    ("assistant", "tool", "n % 3 <> 1", None, None, "'Grep'", "'nameless'", None),
    ("assistant", "ask", "n % 4 = 1", "'q' || t", "'k' || (t - n % 3)", "'Bash'", "CASE WHEN n % 8 = 1 THEN 'May I?' END", None),
    ("assistant", "ask", "n % 6 = 2", "'p' || t", None, "'Write'", "'A card'", None),
    ("assistant", "answered", "n % 5 < 3", "'q' || t", None, None, "'reply' || n % 2", "n % 2 = 0"),
    ("assistant", "answered", "n % 5 > 2", "'p' || t", None, None, None, "true"),
    ("assistant", "tool_result", "n % 7 < 3", "'k' || t", None, None, "'first' || chr(10) || 'second'", "n % 3 > 0"),
    ("assistant", "tool_result", "n % 7 > 4", None, None, None, "'some one''s'", "n % 3 > 0"),
    ("assistant", "tool_result", "n % 11 > 5", "'k' || (t - 2)", None, None, "'late'", "true"),
    ("assistant", "tool_result", "n % 13 > 8", "'nobody'", None, None, None, "false"),
    ("assistant", "turn", "n % 6 > 2", None, None, None, "'3 requests'", None),
    ("assistant", "compacted", "n % 9 = 0", None, None, None, "'compacted'", None),
    ("assistant", "text", "n % 4 = 0", None, None, None, "'three'", None),
    ("assistant", "shown", "n % 10 = 3", None, None, None, "'a.png'", None),
    ("assistant", "joined", "n % 8 = 5", None, None, None, "'joined'", None),
    ("system", "joined", "true", None, None, None, "'joined'", None),
]
_PAGE_FIELDS = {"id": "STRING", "call": "STRING", "name": "STRING", "text": "STRING", "ok": "BOOLEAN"}
_PAGE = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn FROM {_sql(_PAGE_MADE, _PAGE_FIELDS)}),
 s AS (SELECT session, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST([] AS STRUCT(t VARCHAR, q BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS told, CAST([] AS BIGINT[]) AS open, CAST([] AS STRUCT(i VARCHAR, q BIGINT)[]) AS known, CAST(NULL AS BIGINT) AS hit, true AS makes FROM e GROUP BY session
  UNION ALL SELECT session, rn, seq, CASE WHEN kind = 'accepted' THEN list_append(held, {{t: text, q: seq}}) ELSE list_filter(held, lambda x: told IS NULL OR x.q <> told) END, told,
   CASE WHEN kind = 'tool' AND fresh THEN list_append(open, seq) WHEN hit IS NOT NULL THEN list_filter(open, lambda x: x <> hit) ELSE open END, CASE WHEN kind = 'tool' AND fresh AND id IS NOT NULL THEN list_append(known, {{i: id, q: seq}}) ELSE known END, hit,
   kind IN ('accepted', 'prompt', 'command', 'shown', 'turn', 'exited', 'joined', 'compacted') OR kind = 'tool' AND fresh OR kind = 'ask' AND on_call IS NULL
  FROM (SELECT s.session, e.rn, e.seq, e.kind, e.id, e.text, s.held, s.open, s.known, id IS NULL OR NOT list_contains(list_transform(s.known, lambda x: x.i), id) AS fresh, list_filter(s.known, lambda x: x.i = e.call)[1].q AS on_call,
    CASE WHEN e.kind = 'prompt' THEN list_filter(s.held, lambda x: x.t = e.text)[1].q END AS told, CASE WHEN e.kind = 'tool_result' THEN coalesce(list_filter(s.known, lambda x: x.i = e.id)[1].q, s.open[-1]) END AS hit FROM s JOIN e ON e.session = s.session AND e.rn = s.rn + 1)),
 m AS (SELECT e.*, s.told, s.hit, s.makes, list_filter(s.known, lambda x: x.i = e.call)[1].q AS on_call FROM e JOIN s USING (session, rn)),
 calls AS (SELECT * FROM m WHERE kind = 'tool' AND makes),
 answer AS (SELECT session, hit, arg_max({{ok: ok, detail: text}}, seq) AS r FROM m WHERE kind = 'tool_result' AND hit IS NOT NULL GROUP BY session, hit),
 asks AS (SELECT session, seq, "at", id AS ask, name, text, on_call, coalesce(on_call, seq) AS entry, coalesce(lead(seq) OVER (PARTITION BY session, coalesce(on_call, seq) ORDER BY seq), 9000000) AS until FROM m WHERE kind = 'ask'),
 replies AS (SELECT a.session, min(entry) AS entry, r.seq, any_value(r.ok) AS allowed, any_value(r.text) AS reply FROM m r JOIN asks a ON a.session = r.session AND a.ask = r.id AND r.seq > a.seq AND r.seq < a.until WHERE r.kind = 'answered' GROUP BY a.session, r.seq),
 rep AS (SELECT session, entry, arg_max({{allowed: allowed, reply: reply}}, seq) AS x, NOT EXISTS (SELECT 1 FROM m WHERE m.session = replies.session AND m.seq > max(replies.seq) AND m.kind IN ('text', 'tool', 'tool_result', 'context', 'prompt', 'turn')) AS settling FROM replies GROUP BY session, entry),
 tit AS (SELECT session, entry, arg_max(ask, seq) AS ask, arg_max(text, seq) FILTER (text <> '') AS title FROM asks GROUP BY session, entry),
 piece AS (SELECT *, sum(CASE WHEN kind <> 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS run FROM m WHERE kind = 'text' OR makes),
 page AS (SELECT session, min(seq) AS place, arg_min("at", seq) AS "at", 'said' AS kind, string_agg(text, '' ORDER BY seq) AS text, NULL::VARCHAR AS call, NULL::VARCHAR AS tool, NULL::BOOLEAN AS ok, NULL::VARCHAR AS detail, NULL::VARCHAR AS head, false AS unrecorded, false AS queued, NULL::VARCHAR AS ask, NULL::BOOLEAN AS allowed, false AS settling, NULL::VARCHAR AS reply FROM piece WHERE kind = 'text' GROUP BY session, run
  UNION ALL SELECT session, seq, "at", 'asked', text, NULL, NULL, NULL, NULL, NULL, false, false, NULL, NULL, false, NULL FROM m WHERE kind IN ('prompt', 'command')
  UNION ALL SELECT session, seq, "at", 'asked', text, NULL, NULL, NULL, NULL, NULL, false, true, NULL, NULL, false, NULL FROM m WHERE kind = 'accepted' AND NOT EXISTS (SELECT 1 FROM m x WHERE x.session = m.session AND x.told = m.seq)
  UNION ALL SELECT session, seq, "at", CASE kind WHEN 'shown' THEN 'shown' WHEN 'turn' THEN 'turn' ELSE 'note' END, text, NULL, NULL, NULL, NULL, NULL, false, false, NULL, NULL, false, NULL FROM m WHERE kind IN ('shown', 'turn', 'exited', 'joined', 'compacted')
  UNION ALL SELECT session, seq, "at", 'ask', text, NULL, name, NULL, NULL, NULL, false, false, a.ask, x.allowed, coalesce(settling, false), x.reply FROM asks a LEFT JOIN rep USING (session, entry) WHERE on_call IS NULL
  UNION ALL SELECT c.session, c.seq, c."at", 'tool', coalesce(title, c.text), c.id, c.name, r.ok, r.detail, CASE WHEN r IS NOT NULL THEN string_split(coalesce(r.detail, ''), chr(10))[1] END,
   r IS NULL AND EXISTS (SELECT 1 FROM m x WHERE x.session = c.session AND x.kind = 'joined' AND x.seq > c.seq), false, t.ask, x.allowed, coalesce(settling, false), x.reply
   FROM calls c LEFT JOIN answer w ON w.session = c.session AND w.hit = c.seq LEFT JOIN tit t ON t.session = c.session AND t.entry = c.seq LEFT JOIN rep p ON p.session = c.session AND p.entry = c.seq)
 SELECT * FROM page"""


@query(_PAGE)
def transcript_page(spark, d):
    from ..operators import transcript

    return transcript.page(_made(spark, d, _PAGE_MADE, _PAGE_FIELDS), Scratch(spark, "page").table)


# Conversations as files of lines, one folder each; a line's padding makes lengths differ, some past ASCII.
_RAW = """'{"type":"' || CASE role WHEN 'system' THEN 'system' ELSE role END || '"' || CASE role WHEN 'system' THEN ',"subtype":"compact_boundary"' ELSE '' END
 || CASE WHEN role = 'assistant' AND n % 3 > 0 THEN ',"message":{"usage":{"input_tokens":' || n || '}}' ELSE '' END || CASE WHEN n % 5 = 1 THEN ',"customTitle":"title ' || t || '"' WHEN n % 5 = 2 THEN ',"agentName":"agent ' || t || '"' ELSE '' END
 || CASE WHEN n % 4 = 0 THEN ',"cwd":"/w/' || t || '"' ELSE '' END || ',"timestamp":"2024-01-0' || (t % 9 + 1) || '","pad":"' || repeat('é-', CAST(n % 40 AS INT)) || '"}'"""
_FILES = f"(SELECT c, t, role, n, {_RAW} AS raw FROM ({_ROWS}))"


_FILES_OF_A_TASK = 500


def _files(spark, d) -> str:
    """Writes them and gives their folder."""
    from ..sources import transcripts

    path = f"{Scratch(spark, 'files').path}/in"
    rows = table(spark, d, "conversations").selectExpr("conv_id AS c", "turn AS t", "role", "CAST(length(text) AS BIGINT) AS n").selectExpr("c", "t", f"{_RAW} AS value")
    parts = rows.agg(F.approx_count_distinct("c").alias("n")).first().n // _FILES_OF_A_TASK + 1
    ordered = rows.repartition(parts, "c").sortWithinPartitions("c", "t")
    transcripts.put(ordered.select(F.concat(F.lit("c="), "c", F.lit("/lines.txt")).alias("file"), F.col("value").alias("raw")), path)
    return path


def _file_of(df):
    return df.withColumn("file", F.regexp_extract("file", r"/c=(\d+)/", 1))


def _counted(rows):
    role = F.try_variant_get(F.try_parse_json("raw"), "$.type", "string")
    tokens = F.try_variant_get(F.try_parse_json("raw"), "$.message.usage.input_tokens", "long")
    return rows.select("file", "at", "next", (role == "user").alias("is_prompt"), (role == "system").alias("is_compaction"), tokens.alias("context"))


_COUNTED = f"""WITH l AS (SELECT * FROM {_FILES}), cut AS (SELECT c, max(t) AS cut FROM l WHERE role = 'system' GROUP BY c)
 SELECT CAST(l.c AS VARCHAR) AS file, count(*) FILTER (role = 'user' AND (cut IS NULL OR t > cut)) AS interactions, arg_max(n, t) FILTER (role = 'assistant' AND n % 3 > 0 AND (cut IS NULL OR t > cut)) AS context,
 CAST(sum(octet_length(encode(raw)) + 1) AS BIGINT) AS through FROM l LEFT JOIN cut ON cut.c = l.c GROUP BY l.c"""


@query(_COUNTED)
def appended_count(spark, d):
    from ..operators import timeline
    from ..sources import transcripts

    # saved, as it is read three times and opening many files takes longer
    rows = Scratch(spark, "counted").table(_file_of(_counted(transcripts.appended(spark, _files(spark, d), suffix=".txt", splitBytes=4096))))
    size = rows.groupBy("file").agg(F.max("next").alias("through"))
    return size.join(timeline.since_compaction(rows, order="at"), "file", "left").select("file", F.coalesce("interactions", F.lit(0)).alias("interactions"), "context", "through")


@query(_COUNTED)
def stream_appended_count(spark, d):
    from ..sources import appended
    from ..streaming import sessions

    path = _files(spark, d)
    appended.register(spark)
    rows = _counted(spark.readStream.format("appended_lines").options(path=path, suffix=".txt").load())
    out = sessions.newest(sessions.run_once(sessions.appended_count(rows), f"{path.removesuffix('/in')}/run"), ["file"], "through")
    return _file_of(out.drop("batch"))


_TAIL, _HEAD = 250, 200


@query(f"""WITH l AS (SELECT *, sum(octet_length(encode(raw)) + 1) OVER (PARTITION BY c ORDER BY t DESC) AS back FROM {_FILES}),
 k AS (SELECT *, role IN ('user', 'assistant', 'system') AS spoke FROM l WHERE back <= {_TAIL})
 SELECT CAST(c AS VARCHAR) AS file, arg_max({{v: CASE WHEN role = 'assistant' THEN n END}}, t) FILTER (role = 'system' OR role = 'assistant' AND n % 3 > 0)['v'] AS context, arg_max('2024-01-0' || (t % 9 + 1), t) AS spoke,
 coalesce(arg_max('title ' || t, t) FILTER (n % 5 = 1), arg_max('agent ' || t, t) FILTER (n % 5 = 2)) AS name FROM k GROUP BY c""")
def transcript_tails(spark, d):
    from ..sources import transcripts

    read = transcripts.appended(spark, _files(spark, d), suffix=".txt", tailBytes=_TAIL)
    return transcripts.tails(transcripts.decode(_file_of(read)))


@query(f"""WITH l AS (SELECT *, sum(octet_length(encode(raw)) + 1) OVER (PARTITION BY c ORDER BY t) AS upto FROM {_FILES})
 SELECT CAST(c AS VARCHAR) AS file, arg_min('/w/' || t, t) FILTER (n % 4 = 0) AS cwd FROM l WHERE upto <= {_HEAD} GROUP BY c""")
def transcript_first_directory(spark, d):
    from ..sources import transcripts

    read = transcripts.appended(spark, _files(spark, d), suffix=".txt", headBytes=_HEAD)
    return transcripts.first_directory(transcripts.decode(_file_of(read)))


# What a live session prints for a row: (role, condition, place in the turn, line). A message's pieces come one by
# one, with those of a delegated session between them.
_PIECES = [(10 + 2 * k + side, k, side) for k in range(6) for side in (0, 1)]
_WIRE = [
    ("system", "true", "5", """'{"type":"system","subtype":"init","model":"m' || (c % 3) || '","cwd":"/w","tools":[]}'"""),
    ("user", "true", "5", """'{"type":"user","message":{"content":[{"type":"text","text":"said ' || t || '"}]}}'"""),
    ("user", "n % 2 = 0", "6", """'{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"k' || (t - 1) || '","is_error":' || (n % 4 = 0) || ',"content":"out ' || n || '"}]}}'"""),
    ("assistant", "true", "5", """'{"type":"system","subtype":"status","status":"thinking"}'"""),
    ("assistant", "true", "8", """'{"type":"stream_event","event":{"type":"message_start","message":{"id":"a' || t || '"}}}'"""),
    ("assistant", "true", "9", """'{"type":"stream_event","parent_tool_use_id":"k","event":{"type":"message_start","message":{"id":"b' || t || '"}}}'"""),
    *[
        ("assistant", f"n % 6 >= {k}", str(at), f"""'{{"type":"stream_event",{'"parent_tool_use_id":"k",' if side else ''}"event":{{"type":"content_block_delta","index":{k // 3},"delta":{{"type":"text_delta","text":"{'xw'[1 - side]}{k} "}}}}}}'""")
        for at, k, side in _PIECES
    ],
    ("assistant", "true", "30", """'{"type":"stream_event","event":{"type":"content_block_delta","index":0,"delta":{"type":"input_json_delta","partial_json":"{"}}}'"""),
    ("assistant", "true", "60", """'{"type":"assistant","message":{"model":"m","usage":{"input_tokens":' || n || ',"cache_read_input_tokens":5},"content":[{"type":"text","text":"again"},{"type":"tool_use","id":"k' || t || '","name":"Bash","input":{"command":"ls"}}]}}'"""),
    ("assistant", "n % 4 = 0", "61", """'{"type":"assistant","message":{"model":"<synthetic>","content":[{"type":"text","text":"a table"},{"type":"text","text":"  "}]}}'"""),
    ("assistant", "true", "70", """'{"type":"result","total_cost_usd":' || (n / 4.0) || ',"stop_reason":"end","modelUsage":{"a":{"contextWindow":200000},"b":{"contextWindow":' || (n * 1000) || '}}}'"""),
    ("assistant", "n % 3 = 0", "80", """'{"type":"rate_limit_event","rate_limit_info":{"rateLimitType":"five_hour","status":"allowed","resetsAt":' || (n * 10) || ',"utilization":0.5}}'"""),
    ("assistant", "n % 3 = 1", "81", """'{"type":"control_request","request_id":"q' || t || '","request":{"subtype":"can_use_tool","tool_name":"Bash","tool_use_id":"k' || t || '","input":{}' || CASE WHEN n % 2 = 0 THEN ',"title":"May I?"' ELSE '' END || '}}'"""),
    ("assistant", "n % 3 = 2", "82", "'{torn'"),
]


def _wire_sql() -> str:
    one = lambda role, cond, at, kind, pos="0", **given: f"SELECT 'c' || c AS file, t * 100 + {at} AS \"at\", CAST({pos} AS INT) AS pos, '{kind}' AS kind, " + ", ".join(f"CAST({given.get(k, 'NULL')} AS {v}) AS {k}" for k, v in {"id": "VARCHAR", "call": "VARCHAR", "name": "VARCHAR", "text": "VARCHAR", "ok": "BOOLEAN", "tokens": "BIGINT", "cost": "DOUBLE", "resets_at": "BIGINT", "utilization": "DOUBLE"}.items()) + f" FROM ({_ROWS}) WHERE role = '{role}' AND {cond}"
    parts = [
        one("system", "true", 5, "started", name="'m' || (c % 3)"), one("user", "true", 5, "prompt", "1", text="'said ' || t"), one("user", "n % 2 = 0", 6, "result", "1", id="'k' || (t - 1)", text="'out ' || n", ok="n % 4 <> 0"),
        one("assistant", "true", 5, "busy", text="'thinking'"), one("assistant", "true", 60, "context", tokens="n + 5"), one("assistant", "true", 60, "tool", "2", id="'k' || t", name="'Bash'", text="'{\"command\":\"ls\"}'"),
        one("assistant", "n % 4 = 0", 61, "text", "1", text="'a table'"), one("assistant", "true", 70, "turn", tokens="greatest(200000, n * 1000)", cost="n / 4.0", text="'end'"),
        one("assistant", "n % 3 = 0", 80, "limit", name="'five_hour'", text="'allowed'", resets_at="n * 10", utilization="0.5"),
        one("assistant", "n % 3 = 1", 81, "ask", id="'q' || t", call="'k' || t", name="'Bash'", text="CASE WHEN n % 2 = 0 THEN 'May I?' END"),
    ]
    for side, sign in ((0, "w"), (1, "x")):
        parts += [one("assistant", f"n % 6 >= {3 * b}", 10 + 6 * b + side, "text", text=f"array_to_string(list_transform(range({3 * b}, least(n % 6 + 1, {3 * b + 3})), lambda k: '{sign}' || k || ' '), '')") for b in (0, 1)]
    return "\n UNION ALL ".join(parts)


@query(_wire_sql())
def live_wire(spark, d):
    from ..operators import events as typed
    from ..sources import transcripts

    rows = table(spark, d, "conversations").selectExpr("conv_id AS c", "turn AS t", "role", "CAST(length(text) AS BIGINT) AS n")
    one = [F.expr(f"CASE WHEN role = '{role}' AND {cond} THEN named_struct('at', t * 100 + {at}, 'raw', {raw}) END") for role, cond, at, raw in _WIRE]
    made = rows.select(F.concat(F.lit("c"), "c").alias("file"), F.explode(F.array_compact(F.array(*one))).alias("e")).select("file", "e.*")
    found = typed.live(transcripts.decode(made), Scratch(spark, "wire").table)
    return found.select("file", "at", "pos", "kind", "id", "call", "name", "text", "ok", "tokens", "cost", "resets_at", "utilization")


_SLIM = """CASE n % 4 WHEN 0 THEN '{"attachment":{"content":[{"id":' || n || '},2],"type":"task_reminder"},"type":"attachment"}' WHEN 1 THEN '{"attachment":{"content":[],"type":"task_reminder"},"type":"attachment"}'
 WHEN 2 THEN '{"type":"user","words":"a task_reminder"}' ELSE '{"type":"user"}' END"""


@query(f"""WITH l AS (SELECT n, octet_length(encode({_SLIM})) + 1 AS size, CASE WHEN n % 4 = 0 THEN octet_length(encode('{{"attachment":{{"content":[],"type":"task_reminder"}},"type":"attachment"}}')) + 1 END AS slim FROM ({_ROWS}))
 SELECT count(*) FILTER (n % 4 = 0) AS emptied, count(*) FILTER (n % 4 IN (1, 2)) AS already_empty, count(*) FILTER (n % 4 = 3) AS untouched, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(coalesce(slim, size)) AS BIGINT) AS written FROM l""")
def slim_report(spark, d):
    from ..sources import transcripts

    rows = table(spark, d, "conversations").selectExpr("CAST(length(text) AS BIGINT) AS n")
    return transcripts.slim(rows.selectExpr(f"{_SLIM} AS raw"))


# Calls of several tools, whose path isn't always their first field, and results with each verdict.
_TOOL = """CASE n % 6 WHEN 0 THEN '"Read","input":{"file_path":"/code/a' || t || '.py"}' WHEN 1 THEN '"Edit","input":{"replace_all":true,"file_path":"/code/b' || t || '.py","old_string":"file_path"}'
 WHEN 2 THEN '"Bash","input":{"command":"ls ' || t || '","description":" list it "}' WHEN 3 THEN '"Write","input":{"content":"file_path","file_path":"/code/c' || t || '.md"}'
 WHEN 4 THEN '"Agent","input":{"prompt":"' || repeat('ask ', 20) || '"}' ELSE '"Grep","input":{"pattern":"x","path":"/code"}' END"""
_ANSWER = """CASE n % 4 WHEN 0 THEN '"is_error":true,"content":"The user doesn' || chr(39) || 't want to proceed with this tool use right now"' WHEN 1 THEN '"is_error":true,"content":"bash: cd: d' || t || ': No such file or directory"'
 WHEN 2 THEN '"content":"fine"' ELSE '"is_error":false,"content":[{"type":"text","text":"zsh"},{"type":"text","text":"cd:1: no such file or directory: z' || t || '"}]' END"""
_CALL_LINES = f"""CASE role WHEN 'assistant' THEN '{{"type":"assistant","message":{{"content":[{{"type":"text","text":"x"}},{{"type":"tool_use","id":"k' || t || '","name":' || {_TOOL} || '}}]}}}}'
 WHEN 'user' THEN '{{"type":"user","message":{{"content":[{{"type":"tool_result","tool_use_id":"k' || (t - 1) || '",' || {_ANSWER} || '}}]}}}}' ELSE '{{"type":"system"}}' END"""


def _call_lines(spark, d):
    from ..sources import transcripts

    rows = table(spark, d, "conversations").selectExpr("conv_id AS c", "turn AS t", "role", "CAST(length(text) AS BIGINT) AS n").selectExpr("concat('c', c) AS file", "concat('c', c) AS session", "false AS delegated", "t AS at", f"{_CALL_LINES} AS raw")
    return transcripts.decode(rows)


@query(f"""SELECT 'c' || c AS file, t AS "at", 'k' || t AS call_id, ['Read', 'Edit', 'Bash', 'Write', 'Agent', 'Grep'][n % 6 + 1] AS tool, ['read', 'write', NULL, 'write', 'none', 'none'][n % 6 + 1] AS role,
 CASE n % 6 WHEN 0 THEN '/code/a' || t || '.py' WHEN 1 THEN '/code/b' || t || '.py' WHEN 3 THEN '/code/c' || t || '.md' END AS path, CASE WHEN n % 6 = 2 THEN 'ls ' || t END AS command,
 CASE n % 6 WHEN 2 THEN 'list it' WHEN 4 THEN left(trim(repeat('ask ', 20)), 60) END AS label FROM ({_ROWS}) WHERE role = 'assistant'""")
def transcript_tools(spark, d):
    from ..sources import transcripts

    return transcripts.calls(_call_lines(spark, d)).select("file", "at", "call_id", "tool", "role", "path", "command", "label")


@query(f"""SELECT 'c' || c AS file, t AS "at", 'k' || (t - 1) AS call_id, ['rejected', 'failed', 'ok', 'ok'][n % 4 + 1] AS verdict, CASE n % 4 WHEN 1 THEN 'd' || t WHEN 3 THEN 'z' || t ELSE '' END AS refused FROM ({_ROWS}) WHERE role = 'user'""")
def transcript_verdicts(spark, d):
    from ..sources import transcripts

    return transcripts.results(_call_lines(spark, d)).select("file", "at", "call_id", "verdict", F.array_join("refused", ",").alias("refused"))
