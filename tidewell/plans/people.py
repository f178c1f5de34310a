"""Queries over agents, sessions, note lists, claims about repositories, message trees and typed events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commits, events, graph, lint, roster, search, study, turns, usage, view
from ..sources import transcripts
from .activity import _ENT, _SURE, TODAY, _entries
from .corpus import _NL, _NOTES, _PAIRS, _bm25, _pairs, _raw_notes, _save
from .tables import NODES, WORK, notes, page_links, table, work

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT 's' || k AS session, arg_min(agent, (user_id % 10, agent)) AS agent FROM {WORK} GROUP BY k")
def session_names(spark, d):
    return roster.name_of_session(work(spark, d).select("agent", F.concat(F.lit("s"), "k").alias("session"), (F.col("user_id") % 10).alias("rank")))


_CALLS = f"""(SELECT agent, '/code/p' || (k % 7) || CASE WHEN k % 10 = 0 THEN '/node_modules/x' ELSE '/f' || k || CASE WHEN k % 9 = 0 THEN '.log' ELSE '.rs' END END AS path, '/mem/' || CASE WHEN k % 8 = 0 THEN 'MEMORY' ELSE 'n' || (k % 30) END || '.md' AS note,
 CASE kind WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' ELSE 'none' END AS role, kind IN ('purchase', 'signup') AS write, CASE seq % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'failed' ELSE 'ok' END AS verdict,
 CASE seq % 3 WHEN 0 THEN 'always' WHEN 1 THEN 'on-success' ELSE 'sometimes' END AS reached, k % 7 AS p, seq FROM {WORK})"""


def _calls(spark, d):
    k, s = F.col("k"), F.col("seq")
    name = F.when(k % 10 == 0, "/node_modules/x").otherwise(F.concat(F.lit("/f"), k, F.when(k % 9 == 0, ".log").otherwise(".rs")))
    return work(spark, d).select(
        "agent", F.concat(F.lit("/code/p"), k % 7, name).alias("path"), F.concat(F.lit("/mem/"), F.when(k % 8 == 0, "MEMORY").otherwise(F.concat(F.lit("n"), k % 30)), F.lit(".md")).alias("note"),
        F.when(F.col("kind") == "view", "read").when(F.col("kind") == "purchase", "write").otherwise("none").alias("role"), F.col("kind").isin("purchase", "signup").alias("write"),
        F.when(s % 4 == 0, "rejected").when(s % 4 == 1, "failed").otherwise("ok").alias("verdict"), F.when(s % 3 == 0, "always").when(s % 3 == 1, "on-success").otherwise("sometimes").alias("reached"), (k % 7).alias("p"), "seq",
    )


_FILES = f"(SELECT agent, substr(path, 7) AS path, count(*) FILTER (role = 'read') AS reads, count(*) FILTER (role = 'write') AS edits FROM {_CALLS} WHERE verdict = 'ok' AND NOT contains(path, 'node_modules') AND NOT ends_with(path, '.log') GROUP BY ALL)"


@query(f"SELECT agent, path, reads, edits FROM {_FILES}")
def tool_path_use(spark, d):
    return roster.tool_uses(_calls(spark, d), "/code")


_MEM = f"""(SELECT agent, regexp_extract(note, '/mem/(.*)\\.md', 1) AS memory, count(*) FILTER (NOT write AND sure) AS reads, count(*) FILTER (write AND sure) AS edits, count(*) FILTER (NOT write AND NOT sure) AS maybe_reads, count(*) FILTER (write AND NOT sure) AS maybe_edits
 FROM (SELECT agent, note, role = 'write' AS write, true AS sure FROM {_CALLS} WHERE verdict = 'ok' UNION ALL SELECT agent, note, write, {_SURE} FROM {_CALLS} WHERE verdict <> 'rejected') WHERE note <> '/mem/MEMORY.md' GROUP BY ALL)"""


def _memories(spark, d):
    c = _calls(spark, d).withColumn("path", F.col("note"))
    return roster.memory_uses(c, c, "/mem")


@query(f"SELECT * FROM {_MEM}")
def memory_use(spark, d):
    return _memories(spark, d)


@query("SELECT 'a' || (conv_id % 13) AS agent, count(*) FILTER (conv_id % 3 > 0) AS transcripts, count(*) FILTER (conv_id % 3 = 0) AS delegated, count(DISTINCT conv_id % 50) AS sessions FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY ALL")
def transcript_counts(spark, d):
    f = table(spark, d, "conversations").select("conv_id").distinct()
    i = F.col("conv_id")
    return roster.transcript_counts(f.select(F.concat(F.lit("a"), i % 13).alias("agent"), (i % 50).alias("owner"), (i % 3 == 0).alias("delegated")))


@query(f"SELECT agent, path, reads, edits, CAST(row_number() OVER (PARTITION BY agent ORDER BY edits DESC, reads DESC, path) AS INT) AS place FROM {_FILES}")
def work_files_order(spark, d):
    return roster.work_order(roster.tool_uses(_calls(spark, d), "/code"))


@query(f"SELECT agent AS name, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(reads) AS BIGINT) AS reads FROM {_FILES} GROUP BY agent")
def work_matches(spark, d):
    return roster.work_matches(roster.tool_uses(_calls(spark, d), "/code"))


@query(f"""WITH t AS (SELECT agent, 'p' || p AS name, count(*) FILTER (role = 'read') AS reads, count(*) FILTER (role = 'write') AS writes FROM {_CALLS} WHERE verdict = 'ok' GROUP BY ALL),
 r AS (SELECT agent, project AS name, sum(CASE WHEN kind = 'view' THEN pow(0.5, greatest(0, {TODAY} - day) / 14.0) END) AS read, sum(CASE WHEN kind = 'purchase' THEN pow(0.5, greatest(0, {TODAY} - day) / 14.0) END) AS wrote FROM (SELECT DISTINCT agent, project, kind, day FROM {WORK} WHERE kind IN ('view', 'purchase')) GROUP BY ALL),
 w AS (SELECT t.*, coalesce(r.wrote, 0) + coalesce(r.read, 0) / 1000 AS w FROM t LEFT JOIN r ON t.agent = r.agent AND t.name = r.name),
 p AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY w DESC, writes DESC, name) AS place, max(w) OVER (PARTITION BY agent) AS top FROM w),
 h AS (SELECT agent, 'h' || (p % 5) AS name, count(*) FILTER (NOT write) AS reads, count(*) FILTER (write) AS writes FROM {_CALLS} WHERE verdict <> 'rejected' GROUP BY ALL), h2 AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY reads + writes DESC, name) AS place FROM h),
 n AS (SELECT agent, memory AS name, reads, edits AS writes, row_number() OVER (PARTITION BY agent ORDER BY reads + edits DESC, edits DESC, memory) AS place FROM {_MEM})
 SELECT agent, 'place' AS what, name, reads, writes, round(coalesce(w / nullif(top, 0), 0), 6) AS share, CAST(place AS INT) AS place FROM p WHERE place <= 6 UNION ALL SELECT agent, 'machine', name, reads, writes, NULL, CAST(place AS INT) FROM h2 WHERE place <= 4
 UNION ALL SELECT agent, 'note', name, reads, writes, NULL, CAST(place AS INT) FROM n WHERE place <= 5 UNION ALL SELECT agent, 'total', '', CAST(sum(reads) AS BIGINT), CAST(sum(writes) AS BIGINT), NULL, 0 FROM t GROUP BY agent""")
def agent_page(spark, d):
    c = _calls(spark, d)
    project = F.concat(F.lit("p"), "p").alias("project")
    tool = c.where("verdict = 'ok'").groupBy("agent", project).agg(F.count_if(F.col("role") == "read").alias("reads"), F.count_if(F.col("role") == "write").alias("writes"))
    days = roster.recency(work(spark, d).where("kind IN ('view', 'purchase')"), TODAY, ["agent", "project", "kind"])
    recent = days.groupBy("agent", "project").agg(F.sum(F.when(F.col("kind") == "view", F.col("weight"))).alias("read"), F.sum(F.when(F.col("kind") == "purchase", F.col("weight"))).alias("wrote"))
    remote = roster.remote_uses(c.withColumn("path", F.lit("/srv/x")).withColumn("host", F.concat(F.lit("h"), F.col("p") % 5)))
    return roster.agent_page(tool, recent, remote, _memories(spark, d)).withColumn("share", F.round("share", 6))


_STAND = f"(SELECT agent AS name, round(sum(pow(0.5, greatest(0, {TODAY} - day) / 14.0)), 6) AS weight, CAST(substr(agent, 2) AS INT) % 4 > 0 AS indexed, CAST(substr(agent, 2) AS INT) % 7 = 0 AS behavioural, CAST(substr(agent, 2) AS INT) % 3 AS homes FROM (SELECT DISTINCT agent, day FROM {WORK} WHERE kind = 'signup') GROUP BY agent)"


def _standings(spark, d):
    w = roster.recency(work(spark, d).where("kind = 'signup'"), TODAY, ["agent"])
    i = F.substring("agent", 2, 9).cast("int")
    return w.select(F.col("agent").alias("name"), F.round("weight", 6).alias("weight"), (i % 4 > 0).alias("indexed"), (i % 7 == 0).alias("behavioural"), (i % 3).alias("homes"))


@query(f"""WITH s AS {_STAND}, l AS (SELECT 'no home' AS list, name, weight, row_number() OVER (ORDER BY name) AS place FROM s WHERE indexed AND homes = 0 AND weight <= 1 AND NOT behavioural
 UNION ALL SELECT 'still consulted', name, weight, row_number() OVER (ORDER BY weight DESC, name) FROM s WHERE NOT indexed AND weight > 0.5 UNION ALL SELECT 'rules', name, weight, row_number() OVER (ORDER BY weight, name) FROM s WHERE behavioural AND indexed)
 SELECT list, name, weight, CAST(place AS INT) AS place FROM l WHERE place <= 15""")
def standing_lists(spark, d):
    return study.lists(_standings(spark, d))


@query(f"SELECT count(*) AS rules, count(*) FILTER (weight = 0) AS never FROM {_STAND} WHERE behavioural AND indexed")
def rule_counts(spark, d):
    return study.rule_counts(_standings(spark, d))


_CONV = "(SELECT 'c' || conv_id AS id, 'n' || (conv_id % 20) AS name, CASE conv_id % 5 WHEN 0 THEN '/tmp/x' WHEN 1 THEN '/var/folders/y' ELSE '/code/p' || conv_id END AS dir, max(turn) * 100 + conv_id AS modified FROM conversations GROUP BY conv_id)"


def _conversations(spark, d):
    i = F.col("conv_id")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t"))
    return c.select(F.concat(F.lit("c"), i).alias("id"), F.concat(F.lit("n"), i % 20).alias("name"), F.when(i % 5 == 0, "/tmp/x").when(i % 5 == 1, "/var/folders/y").otherwise(F.concat(F.lit("/code/p"), i)).alias("dir"), (F.col("t") * 100 + i).alias("modified"))


@query(f"SELECT id, name, dir, modified, id IN (SELECT 'c' || k FROM {WORK} WHERE k % 3 = 0) OR name IN (SELECT 'n' || k FROM {WORK} WHERE k % 6 = 1) AS busy FROM {_CONV} WHERE NOT starts_with(dir, '/tmp/') AND NOT starts_with(dir, '/var/folders/')")
def conversations_listed(spark, d):
    k = F.col("k")
    said = work(spark, d).select(F.when(k % 3 == 0, F.concat(F.lit("c"), k)).when(k % 6 == 1, F.concat(F.lit("n"), k)).alias("argument")).where("argument IS NOT NULL")
    return usage.listed(_conversations(spark, d), said)


@query(f"""WITH l AS (SELECT 'c' || k AS id, CAST(min(k % 4) AS INT) AS rank, max(seq) AS "at" FROM {WORK} GROUP BY k), r AS (SELECT id, rank, "at" FROM l UNION ALL SELECT id, 9, modified FROM {_CONV} WHERE id NOT IN (SELECT id FROM l))
 SELECT id, rank, "at", CAST(row_number() OVER (ORDER BY rank, "at" DESC, id) AS INT) AS place FROM r ORDER BY place LIMIT 100""")
def sessions_ranked(spark, d):
    live = work(spark, d).groupBy("k").agg(F.max("seq").alias("at")).select(F.concat(F.lit("c"), "k").alias("id"), (F.col("k") % 4).cast("int").alias("rank"), "at")
    top = usage.ranked(live, _conversations(spark, d).select("id", F.col("modified").alias("at"))).limit(100)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy("rank", F.desc("at"), "id")))  # a hundred rows


@query(f"SELECT arg_max(session, (NOT working, last_heard, session)) AS session FROM (SELECT agent AS session, arg_max(kind IN ('view', 'click'), seq) AS working, max(t) AS last_heard FROM {WORK} GROUP BY agent)")
def idlest_session(spark, d):
    s = work(spark, d).groupBy(F.col("agent").alias("session")).agg(F.max_by(F.col("kind").isin("view", "click"), "seq").alias("working"), F.max("t").alias("last_heard"))
    return usage.idlest(s)


@query(f"""WITH t AS (SELECT agent AS session, seq, CASE kind WHEN 'view' THEN 'open' WHEN 'click' THEN 'done' WHEN 'error' THEN 'dropped' WHEN 'signup' THEN 'doing' ELSE 'else' END AS status FROM {WORK})
 SELECT session, seq, status, CAST(row_number() OVER (PARTITION BY session ORDER BY CASE status WHEN 'doing' THEN 0 ELSE 1 END, seq) AS INT) AS place FROM t WHERE status NOT IN ('done', 'dropped')""")
def open_tasks(spark, d):
    k = F.col("kind")
    status = F.when(k == "view", "open").when(k == "click", "done").when(k == "error", "dropped").when(k == "signup", "doing").otherwise("else")
    return usage.shown_tasks(work(spark, d).select(F.col("agent").alias("session"), "seq", status.alias("status")))


@query(f"SELECT session, count(*) AS calls, count(*) FILTER (settled AND verdict = 'failed') AS failed, count(*) FILTER (NOT settled) AS running, count(*) FILTER (settled AND verdict IS NULL) AS unrecorded FROM {_ENT} WHERE kind = 'tool' GROUP BY session")
def run_counts(spark, d):
    return view.run_counts(_entries(spark, d))


@query(f"""WITH x AS ({_bm25(["erst", "tion"], "erst tion", True).replace("round(score, 5) AS score", "score")}), t AS (SELECT x.name, x.score, n.description, n.body, CASE WHEN contains(lower(body), 'tion') THEN instr(lower(body), 'tion') WHEN contains(lower(body), 'erst') THEN instr(lower(body), 'erst') END AS hit FROM x JOIN {_NOTES} n ON n.name = x.name),
 g AS (SELECT *, greatest(hit - 80, 1) AS a, least(hit + 9 + 80, length(body) + 1) AS z FROM t)
 SELECT name, description, CASE WHEN hit IS NULL THEN '' ELSE CASE WHEN a > 1 THEN '…' ELSE '' END || replace(substr(body, a, z - a), E'\\n', ' ') || CASE WHEN z <= length(body) THEN '…' ELSE '' END END AS snippet, floor(score * 100 + 0.5) / 100 AS score FROM g""")
def search_hits(spark, d):
    n = notes(spark, d)
    return search.shaped(search.rank(n, "Erst tion"), n, "Erst tion")


_BLOCKS = "(SELECT 'd' || doc_id AS name, 'see ~/Code/' || source || CASE WHEN doc_id % 4 = 0 THEN '...' ELSE '/x' END || ' and /root/Code/r' || (doc_id % 6) || CASE WHEN doc_id % 5 = 0 THEN ' kept in ~/Archive/' || source ELSE '' END AS block, source, doc_id AS i FROM documents)"


def _blocks(spark, d):
    i = F.col("doc_id")
    said = F.concat(F.lit("see ~/Code/"), "source", F.when(i % 4 == 0, "...").otherwise("/x"), F.lit(" and /root/Code/r"), i % 6, F.when(i % 5 == 0, F.concat(F.lit(" kept in ~/Archive/"), "source")).otherwise(""))
    return table(spark, d, "documents").where("source IS NOT NULL").select(F.concat(F.lit("d"), i).alias("name"), said.alias("block"))


@query(f"""SELECT DISTINCT 'dead-repo-path' AS rule, name AS memory, '~/Code/' || repo || ' does not exist' AS detail FROM (SELECT name, source AS repo FROM {_BLOCKS} WHERE source IS NOT NULL AND i % 5 > 0 UNION ALL SELECT name, 'r' || (i % 6) FROM {_BLOCKS} WHERE source IS NOT NULL)
 WHERE repo NOT IN ('src1', 'src2', 'r3', 'check')""")
def repo_claims(spark, d):
    return lint.check_world(_blocks(spark, d), spark.createDataFrame([("src1",), ("src2",), ("r3",)], "repo string"), "/root/Code")


@query("SELECT 'unresolvable-code-root' AS rule, '(corpus)' AS memory, '/gone is not a readable directory' AS detail")
def repo_root_gone(spark, d):
    return lint.check_world(_blocks(spark, d), spark.createDataFrame([], "repo string"), "/gone", readable=False)


@query(f"SELECT relation, count(*) AS links FROM {_NL} GROUP BY relation")
def relation_usage(spark, d):
    return lint.relation_usage(lint.links_of(_raw_notes(spark, d)))


# rings of 2 to 6 messages, with chains that hang under them, and sessions that end at a root
@query("""SELECT conv_id AS session, min(conv_id || '-' || lpad(CAST(turn AS VARCHAR), 3, '0')) AS through, count(*) AS loop FROM conversations WHERE conv_id % 3 > 0 AND turn < 2 + conv_id % 5 GROUP BY conv_id HAVING max(turn) >= 1""")
def tree_cycles(spark, d):
    c = table(spark, d, "conversations")
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), F.lpad(t.cast("string"), 3, "0"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ring = F.least(F.col("last"), 1 + F.col("conv_id") % 5)  # the place at which the ring closes
    n = c.join(last, "conv_id").where("last >= 1")
    parent = F.when(F.col("turn") > 0, name(F.col("turn") - 1)).when(F.col("conv_id") % 3 > 0, name(ring))
    return turns.cycles(n.select(F.col("conv_id").alias("session"), name(F.col("turn")).alias("uuid"), parent.alias("parent"), F.col("turn").alias("line_no")), _save(spark))


@query(f"SELECT name, arg_min(agent, (stamp, agent)) AS session, min(stamp) AS at FROM (SELECT 'n' || k AS name, agent, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, k FROM {WORK} WHERE kind = 'purchase') WHERE k % 4 > 0 GROUP BY name")
def first_writers(spark, d):
    w = work(spark, d).where("kind = 'purchase'").select(F.concat(F.lit("/mem/n"), "k", F.lit(".md")).alias("path"), F.col("agent").alias("session"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    n = work(spark, d).select("k").distinct().select(F.concat(F.lit("n"), "k").alias("name"), F.when(F.col("k") % 4 == 0, "s").alias("origin_session"))
    return commits.first_writers(w, n)


@query(f"""WITH u AS (SELECT 'p' || k AS name, count(*) AS reads FROM {WORK} WHERE kind = 'view' GROUP BY k), a AS (SELECT 'p' || a AS name, npmi FROM {_PAIRS} UNION ALL SELECT 'p' || b, npmi FROM {_PAIRS}), c AS (SELECT name, count(*) AS affinities, max(npmi) AS strongest FROM a GROUP BY name)
 SELECT n.name AS name, u.reads AS reads, coalesce(c.affinities, 0) AS affinities, c.strongest AS strongest FROM {NODES} n LEFT JOIN u ON u.name = n.name LEFT JOIN c ON c.name = n.name""")
def graph_enriched(spark, d):
    nodes, _ = page_links(spark, d)
    read = work(spark, d).where("kind = 'view'").groupBy(F.concat(F.lit("p"), "k").alias("name")).agg(F.count("*").alias("reads"))
    p = _pairs(spark, d).select(F.concat(F.lit("p"), "a").alias("a"), F.concat(F.lit("p"), "b").alias("b"), "npmi")
    return graph.enrich(nodes, read, p)


_T = "(SELECT *, conv_id % 6 AS way FROM conversations)"
_NOTE = "'<task-notification><tool-use-id>c' || turn || '</tool-use-id><status>ok</status></task-notification>'"


def _lines(spark, d):
    """Conversations as transcript lines of every kind that the decoder knows."""
    t = table(spark, d, "conversations").withColumn("way", F.col("conv_id") % 6)
    turn = F.col("turn").cast("string")
    block = lambda **f: F.struct(*[v.alias(k) for k, v in f.items()])
    said = lambda *texts: F.to_json(F.array(*[block(type=F.lit("text"), text=x) for x in texts]))
    note = F.concat(F.lit("<task-notification><tool-use-id>c"), turn, F.lit("</tool-use-id><status>ok</status></task-notification>"))
    user = (
        F.when(F.col("way") == 0, said(F.col("text"), F.concat(F.lit("again "), turn)))
        .when(F.col("way") == 1, F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2))  # the bare string
        .when(F.col("way") == 2, said(F.concat(F.lit("<command-name>/go</command-name><command-args>"), turn, F.lit("</command-args>"))))
        .when(F.col("way") == 3, F.to_json(F.array(block(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("t"), turn), is_error=F.col("turn") % 4 == 0, content=F.array(block(type=F.lit("text"), text=F.repeat("text", F.lit(9))), block(type=F.lit("image"), text=F.lit(None).cast("string")))))))
        .when(F.col("way") == 4, said(note, F.lit("<system-reminder>not said</system-reminder>")))
        .otherwise(F.to_json(F.array(block(type=F.lit("image"), text=F.lit(None).cast("string")), block(type=F.lit("text"), text=F.concat(F.lit("look "), turn, F.lit(" (the image is also at /tmp/a/b.png)"))))))
    )
    reply = F.to_json(F.array(block(type=F.lit("text"), text=F.col("text"), id=F.lit(None).cast("string"), name=F.lit(None).cast("string"), input=F.lit(None).cast("struct<command:string>")), block(type=F.lit("tool_use"), text=F.lit(None).cast("string"), id=F.concat(F.lit("t"), turn), name=F.lit("Bash"), input=block(command=F.lit("ls")))))
    raw = (
        F.when(F.col("role") == "user", F.concat(F.lit('{"type":"user","message":{"content":'), user, F.lit("}}")))
        .when(F.col("role") == "assistant", F.concat(F.lit('{"type":"assistant","message":{"usage":{"input_tokens":'), F.char_length("text").cast("string"), F.lit('},"content":'), reply, F.lit("}}")))
        .otherwise(F.lit('{"type":"system","subtype":"compact_boundary"}'))
    )
    return t.select(F.concat(F.lit("c"), "conv_id").alias("file"), F.concat(F.lit("c"), "conv_id").alias("session"), F.lit(False).alias("delegated"), F.col("turn").alias("at"), raw.alias("raw"))


@query(f"""WITH t AS {_T}, u AS (SELECT * FROM t WHERE role = 'user'), a AS (SELECT * FROM t WHERE role = 'assistant'), r AS (SELECT *, repeat(text, 9) || E'\\n[an image]' AS whole FROM u WHERE way = 3),
 e AS (SELECT conv_id, turn, 1 AS pos, 'prompt' AS kind, NULL AS id, NULL AS name, CASE way WHEN 0 THEN text || E'\\n\\nagain ' || turn ELSE text END AS text, NULL AS ok, NULL AS cut, NULL AS tokens FROM u WHERE way < 2
 UNION ALL SELECT conv_id, turn, 1, 'command', NULL, NULL, '/go ' || turn, NULL, NULL, NULL FROM u WHERE way = 2
 UNION ALL SELECT conv_id, turn, 1, 'result', 't' || turn, NULL, left(whole, 2000), turn % 4 <> 0, CASE WHEN length(whole) > 2000 THEN length(whole) END, NULL FROM r
 UNION ALL SELECT conv_id, turn, 1, 'background', 'c' || turn, NULL, 'ok', NULL, NULL, NULL FROM u WHERE way = 4
 UNION ALL SELECT conv_id, turn, 1, 'shown', NULL, 'b.png', NULL, NULL, NULL, NULL FROM u WHERE way = 5 UNION ALL SELECT conv_id, turn, 2, 'prompt', NULL, NULL, 'look ' || turn, NULL, NULL, NULL FROM u WHERE way = 5
 UNION ALL SELECT conv_id, turn, 1, 'context', NULL, NULL, NULL, NULL, NULL, length(text) FROM a UNION ALL SELECT conv_id, turn, 2, 'text', NULL, NULL, text, NULL, NULL, NULL FROM a UNION ALL SELECT conv_id, turn, 3, 'tool', 't' || turn, 'Bash', '{{"command":"ls"}}', NULL, NULL, NULL FROM a
 UNION ALL SELECT conv_id, turn, 1, 'compacted', NULL, NULL, NULL, NULL, NULL, NULL FROM t WHERE role = 'system')
 SELECT 'c' || conv_id AS file, turn AS at, CAST(pos AS BIGINT) AS pos, kind, id, name, text, ok, CAST(cut AS INT) AS cut, CAST(tokens AS BIGINT) AS tokens FROM e""")
def typed_events(spark, d):
    return events.recorded(transcripts.decode(_lines(spark, d)))


_SAID = f"""(SELECT agent AS file, seq AS at, k, CASE k % 7 WHEN 0 THEN 'Command running in background with ID: b' || k || '. Output' WHEN 1 THEN 'Command did not complete within its timeout and was moved to the background (ID: m' || k || ')' WHEN 2 THEN E'Async agent launched successfully\\nagentId: a' || k || ' (internal)'
 WHEN 3 THEN 'Monitor started (task x' || k || ', timeout)' WHEN 4 THEN '{{"message":"Successfully stopped task: s' || k || ' (x)"}}' WHEN 5 THEN 'Async agent launched successfully' ELSE 'quoted: Command running in background with ID: q' END AS text FROM {WORK})"""


@query(f"""SELECT file, "at", 0 AS pos, CASE WHEN k % 7 = 4 THEN 'killed' ELSE 'began' END AS says, CASE WHEN k % 7 <> 4 THEN 't' || k END AS call, CASE k % 7 WHEN 0 THEN 'b' || k WHEN 1 THEN 'm' || k WHEN 2 THEN 'a' || k WHEN 3 THEN 'x' || k WHEN 4 THEN 's' || k END AS task FROM {_SAID} WHERE k % 7 < 6""")
def background_says(spark, d):
    k = F.col("k")
    text = (
        F.when(k % 7 == 0, F.concat(F.lit("Command running in background with ID: b"), k, F.lit(". Output")))
        .when(k % 7 == 1, F.concat(F.lit("Command did not complete within its timeout and was moved to the background (ID: m"), k, F.lit(")")))
        .when(k % 7 == 2, F.concat(F.lit("Async agent launched successfully\nagentId: a"), k, F.lit(" (internal)"))).when(k % 7 == 3, F.concat(F.lit("Monitor started (task x"), k, F.lit(", timeout)")))
        .when(k % 7 == 4, F.concat(F.lit('{"message":"Successfully stopped task: s'), k, F.lit(' (x)"}'))).when(k % 7 == 5, "Async agent launched successfully").otherwise("quoted: Command running in background with ID: q")
    )
    e = work(spark, d).select(F.col("agent").alias("file"), F.col("seq").alias("at"), F.lit(0).alias("pos"), F.lit("result").alias("kind"), F.concat(F.lit("t"), k).alias("id"), F.lit(None).cast("string").alias("name"), text.alias("text"))
    return events.running(e)


_OWN = f"""(WITH r AS (SELECT CASE kind WHEN 'purchase' THEN 'model:' || kind ELSE kind END AS "window", CAST(seq // 50 AS BIGINT) * 40 AS resets_at, value AS utilization, seq AS "at" FROM {WORK} WHERE kind <> 'signup'), t AS (SELECT "window", max(resets_at) AS top FROM r GROUP BY "window")
 SELECT "window", utilization, resets_at, "at" FROM (SELECT r.*, row_number() OVER (PARTITION BY r."window" ORDER BY utilization DESC, "at" DESC) AS rn FROM r JOIN t ON r."window" = t."window" AND r.resets_at >= t.top - 60) WHERE rn = 1)"""
_PUB = f"""(SELECT CASE kind WHEN 'purchase' THEN 'model:' || kind ELSE kind END AS "window", max(value) AS utilization, CASE kind WHEN 'click' THEN 100 WHEN 'error' THEN -100 ELSE 30 END + max(CAST(seq // 50 AS BIGINT) * 40) AS resets_at, max(seq) - 7 AS "at", 'dash' AS host FROM {WORK} GROUP BY kind)"""


@query(f"""WITH j AS (SELECT coalesce(o."window", p."window") AS "window", o.utilization AS ou, o.resets_at AS o_r, o."at" AS oa, p.utilization AS pu, p.resets_at AS p_r, p."at" AS pa, p.host AS host FROM {_OWN} o FULL OUTER JOIN (SELECT * FROM {_PUB} WHERE NOT starts_with("window", 'model:')) p ON o."window" = p."window"),
 k AS (SELECT *, pa IS NOT NULL AND (oa IS NULL OR p_r > o_r + 60 OR (abs(p_r - o_r) <= 60 AND (pu > ou OR (pu = ou AND pa > oa)))) AS theirs FROM j)
 SELECT "window", CASE WHEN theirs THEN pu ELSE ou END AS utilization, CASE WHEN theirs THEN p_r ELSE o_r END AS resets_at, CASE WHEN theirs THEN pa ELSE oa END AS "at", CASE WHEN theirs THEN host ELSE 'here' END AS host, CAST(500 - CASE WHEN theirs THEN pa ELSE oa END AS BIGINT) AS age FROM k WHERE CASE WHEN theirs THEN p_r ELSE o_r END > 500""")
def usage_combined(spark, d):
    k = F.col("kind")
    w = work(spark, d).select(k.alias("kind"), F.when(k == "purchase", "model:purchase").otherwise(k).alias("window"), (F.floor(F.col("seq") / 50) * 40).alias("resets_at"), F.col("value").alias("utilization"), F.col("seq").alias("at"))
    own = usage.fresher(w.where("kind <> 'signup'").drop("kind"))
    more = F.when(k == "click", 100).when(k == "error", -100).otherwise(30)
    pub = w.groupBy("kind", "window").agg(F.max("utilization").alias("utilization"), F.max("resets_at").alias("r"), (F.max("at") - 7).alias("at"))
    return usage.combined(own, pub.select("window", "utilization", (F.col("r") + more).alias("resets_at"), "at", F.lit("dash").alias("host")), 500)
