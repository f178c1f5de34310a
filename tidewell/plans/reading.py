"""Queries over transcripts as they are read: calls, results, prompts, commands, structure; and small functions of paths and stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions import times
from ..operators import roster
from ..sources import structure, transcripts
from .corpus import _save
from .people import _T, _lines
from .tables import WORK, table, work

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _decoded(spark, d):
    return transcripts.decode(_lines(spark, d))


@query(f"""SELECT 'c' || conv_id AS file, turn AS "at", 't' || turn AS call_id, 'Bash' AS tool, 'ls' AS command, 'ls' AS label FROM {_T} WHERE role = 'assistant'""")
def transcript_calls(spark, d):
    return transcripts.calls(_decoded(spark, d)).select("file", "at", "call_id", "tool", "command", "label")


@query(f"""SELECT 'c' || conv_id AS file, turn AS "at", 't' || turn AS call_id, CASE WHEN turn % 4 = 0 THEN 'failed' ELSE 'ok' END AS verdict FROM {_T} WHERE role = 'user' AND way = 3""")
def transcript_results(spark, d):
    return transcripts.results(_decoded(spark, d)).select("file", "at", "call_id", "verdict")


@query(f"SELECT 'c' || conv_id AS file, count(*) AS prompts FROM {_T} WHERE role = 'user' AND way <> 3 GROUP BY conv_id")
def transcript_prompts(spark, d):
    return transcripts.prompts(_decoded(spark, d)).groupBy("file").agg(F.count("*").alias("prompts"))


@query(f"""WITH r AS (SELECT 't' || turn AS call_id, max(CASE WHEN turn % 4 = 0 THEN 'failed' ELSE 'ok' END) AS ran FROM {_T} WHERE role = 'user' AND way = 3 GROUP BY turn)
 SELECT 'c' || conv_id AS file, 't' || turn AS call_id, 'ls' AS cmd, coalesce(r.ran, 'unknown') AS ran FROM {_T} t LEFT JOIN r ON r.call_id = 't' || turn WHERE role = 'assistant'""")
def command_corpus(spark, d):
    dec = _decoded(spark, d)
    return transcripts.command_corpus(transcripts.calls(dec), transcripts.results(dec)).select("file", "call_id", "cmd", "ran")


@query(f"SELECT 'c' || conv_id AS file, CAST(arg_max(length(text), turn) FILTER (role = 'assistant') AS BIGINT) AS context, count(*) AS lines FROM {_T} GROUP BY conv_id")
def transcript_ends(spark, d):
    dec = _decoded(spark, d)
    return transcripts.ends(dec).select("file", "context").join(transcripts.numbered(dec).groupBy("file").agg(F.max("line_no").cast("long").alias("lines")), "file")


_UUID = "(left(h, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || right(h, 12))"
_HASHED = f"(SELECT conv_id, turn, role, CAST((conv_id * 7 + turn) % 23 AS INT) AS fault, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations)"


def _faulty(spark, d):
    """Healthy transcript lines, of which one in 23 of each way is broken in one field."""
    c = table(spark, d, "conversations")
    name = lambda t: F.regexp_replace(F.md5(F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string")).cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    fault = (F.col("conv_id") * 7 + F.col("turn")) % 23
    kind = F.col("role")
    j = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    at = lambda n, good, bad: F.when(fault == n, bad).otherwise(good)
    file = F.concat(F.lit("c"), "conv_id")
    parent = F.when(F.col("turn") == 0, "null").otherwise(j(name(F.col("turn") - 1)))
    none, comma = F.lit(None).cast("string"), ","
    talk = F.concat_ws(
        comma, F.concat(F.lit('"type":'), j(kind)), at(2, F.concat(F.lit('"uuid":'), at(3, j(name(F.col("turn"))), F.lit('"nope"'))), none), at(4, F.concat(F.lit('"parentUuid":'), at(5, parent, F.lit("7"))), none),
        F.concat(F.lit('"sessionId":'), at(6, j(file), F.lit('"other"'))), F.lit('"timestamp":"2024-01-01T00:00:00Z","cwd":null'), at(7, F.lit('"version":"1"'), none), F.lit('"isSidechain":false,"userType":"x","gitBranch":""'),
        F.when(kind != "system", F.concat(F.lit('"message":{"role":'), at(8, j(kind), F.lit('"robot"')), F.lit("}"))).when(fault == 9, F.lit('"message":{}')), F.when((kind == "user") | (fault == 10), F.lit('"promptId":"p"')),
    )
    whole = F.concat(F.lit("{"), talk, F.lit("}"))
    raw = F.when(fault == 11, F.lit('{"type":"user"')).when(fault == 12, F.lit("[1]")).when(fault == 13, F.lit('{"type":"strange"}')).when(fault == 14, F.lit('{"type":"mode","uuid":"u","parentUuid":null}')).otherwise(whole)
    return c.select(file.alias("file"), file.alias("session"), F.col("turn").alias("at"), raw.alias("raw"))


_VIOLATIONS = f"""(WITH f AS {_HASHED}, t AS (SELECT *, fault BETWEEN 11 AND 14 AS other FROM f), k AS (SELECT * FROM t WHERE NOT other),
 r AS (SELECT conv_id, turn, 'missing-uuid' AS rule FROM k WHERE fault = 2 UNION ALL SELECT conv_id, turn, 'malformed-uuid' FROM k WHERE fault = 3 UNION ALL SELECT conv_id, turn, 'missing-parent-field' FROM k WHERE fault = 4 UNION ALL SELECT conv_id, turn, 'non-string-parent' FROM k WHERE fault = 5
 UNION ALL SELECT conv_id, turn, 'session-mismatch' FROM k WHERE fault = 6 UNION ALL SELECT conv_id, turn, 'missing-field' FROM k WHERE fault = 7 UNION ALL SELECT conv_id, turn, 'role-mismatch' FROM k WHERE fault = 8 AND role <> 'system' UNION ALL SELECT conv_id, turn, 'unexpected-field' FROM k WHERE fault = 9 AND role = 'system'
 UNION ALL SELECT conv_id, turn, 'unexpected-field' FROM k WHERE fault = 10 AND role <> 'user' UNION ALL SELECT conv_id, turn, 'unrootable-type-at-root' FROM k WHERE turn = 0 AND fault NOT IN (4, 5) AND role = 'assistant'
 UNION ALL SELECT conv_id, turn, CASE WHEN turn = top THEN 'incomplete-tail' ELSE 'unparseable' END FROM t WHERE fault = 11 UNION ALL SELECT conv_id, turn, 'not-an-object' FROM t WHERE fault = 12 UNION ALL SELECT conv_id, turn, 'unknown-type' FROM t WHERE fault = 13
 UNION ALL SELECT conv_id, turn, unnest(['metadata-with-uuid', 'metadata-with-parent']) FROM t WHERE fault = 14
 UNION ALL SELECT k.conv_id, k.turn, 'dangling-parent' FROM k WHERE turn > 0 AND fault NOT IN (2, 4, 5) AND NOT EXISTS (SELECT 1 FROM k p WHERE p.conv_id = k.conv_id AND p.turn = k.turn - 1 AND p.fault NOT IN (2, 3)))
 SELECT 'c' || conv_id AS file, turn AS "at", rule FROM r)"""


@query(f"SELECT * FROM {_VIOLATIONS}")
def transcript_violations(spark, d):
    return structure.violations(_faulty(spark, d), growing=True, save=_save(spark))


@query(f"SELECT rule, count(*) AS n, count(DISTINCT file) AS files FROM {_VIOLATIONS} GROUP BY rule UNION ALL SELECT 'all', count(*), count(DISTINCT conv_id) FROM conversations")
def violation_totals(spark, d):
    lines = _faulty(spark, d)
    return structure.totals(structure.violations(lines, growing=True, save=_save(spark)), lines)





@query(f"""SELECT doc_id, doc_id % 4 <> 3 AS transcript, doc_id % 4 = 0 AS conversation FROM documents""")
def transcript_names(spark, d):
    u = F.regexp_replace(F.md5(F.col("doc_id").cast("string").cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    i = F.col("doc_id") % 4
    path = F.when(i == 0, F.concat(F.lit("/p/a/"), u, F.lit(".jsonl"))).when(i == 1, F.concat(F.lit("/p/a/"), F.upper(u), F.lit("X.jsonl"))).when(i == 2, F.lit("/p/notes.jsonl")).otherwise(F.concat(F.lit("/p/a/"), u, F.lit(".json")))
    return table(spark, d, "documents").select("doc_id", transcripts.is_transcript(path).alias("transcript"), transcripts.is_conversation(path).alias("conversation"))


@query(f"""SELECT seq, CAST(day AS INT) AS day, t AS minute, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM {WORK}""")
def stamps(spark, d):
    w = work(spark, d)
    said = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return w.select("seq", times.day_number(said).cast("int").alias("day"), times.minute(said).alias("minute"), times.stamp(F.unix_timestamp("ts")).alias("stamp"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/' || p_brand || '/x.rs' WHEN 1 THEN p_brand || '.rs' END AS was, CASE p_partkey % 3 WHEN 0 THEN 'a/' || p_partkey || '/x.rs' WHEN 1 THEN 'b' || p_partkey || '.rs' ELSE p_brand || '.md' END AS path FROM part""")
def rename_syntax(spark, d):
    p, b, i = F.col("p_partkey").cast("string"), F.col("p_brand"), F.col("p_partkey") % 3
    said = F.when(i == 0, F.concat(F.lit("a/{"), b, F.lit(" => "), p, F.lit("}/x.rs"))).when(i == 1, F.concat(b, F.lit(".rs => b"), p, F.lit(".rs"))).otherwise(F.concat(b, F.lit(".md")))
    return table(spark, d, "part").select("p_partkey", P.renamed_from(said).alias("was"), P.renamed_to(said).alias("path"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '10.0.0.' || (s_suppkey % 200) ELSE 'box' || s_suppkey END AS machine FROM supplier")
def ssh_machines(spark, d):
    k = F.col("s_suppkey")
    target = F.when(k % 3 == 0, F.concat(F.lit("me@10.0.0."), k % 200)).when(k % 3 == 1, F.concat(F.lit("box"), k, F.lit(".lan.example"))).otherwise(F.concat(F.lit("u@box"), k))
    return table(spark, d, "supplier").select("s_suppkey", P.machine(target).alias("machine"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN '' WHEN 1 THEN 'd' || o_custkey ELSE 'd' || o_custkey || '|e' || o_orderkey END AS refused FROM orders")
def refused_directories(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    bash = F.concat(F.lit("bash: line 1: cd: d"), c, F.lit(": No such file or directory\n"))
    said = F.when(k % 3 == 0, F.concat(bash, F.lit("zsh:cd:3: not a directory: e"), k, F.lit("\n"), bash)).when(k % 3 == 1, F.concat(F.lit("ok\n"), bash)).otherwise(F.lit("cd: nothing here\n"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.refused_dirs(said), "|").alias("refused"))


@query("""WITH c AS (SELECT conv_id AS owner, max(turn) AS top FROM conversations GROUP BY conv_id)
 SELECT 's' || owner AS owner, CASE owner % 5 WHEN 0 THEN 'agent ' || top WHEN 1 THEN 'title ' || top WHEN 2 THEN 'reg ' || owner WHEN 3 THEN 'said 0' ELSE 's' || owner END AS name FROM c""")
def agent_naming(spark, d):
    i, t = F.col("conv_id"), F.col("turn")
    c = table(spark, d, "conversations")
    own = F.concat(F.lit("s"), i)
    lines = c.select(
        own.alias("owner"), F.lit(False).alias("delegated"), t.alias("line_no"), F.when(i % 5 == 0, F.concat(F.lit("agent "), t)).when(i % 5 == 1, F.repeat(F.lit("x"), F.lit(60))).alias("agent_name"),
        F.when(i % 5 == 1, F.concat(F.lit("title "), t)).alias("custom_title"), F.when(i % 5 == 4, "someone").otherwise(own).alias("of_session"), F.when(i % 5 == 3, F.concat(F.lit("said "), t)).alias("stated"),
    )
    reg = c.where(i % 5 == 2).select(own.alias("session_id"), F.concat(F.lit("reg "), i).alias("name")).distinct()
    return roster.agent_names(lines, reg)


@query("SELECT conv_id AS file, count(*) AS lines FROM conversations WHERE conv_id % 4 > 0 OR conv_id IN (SELECT conv_id FROM conversations WHERE conv_id % 3 = 0 AND turn = 1) GROUP BY conv_id")
def without_titling(spark, d):
    i = F.col("conv_id")
    c = table(spark, d, "conversations").select(i.alias("file"), ((i % 3 == 0) & (F.col("turn") == 1)).alias("has_tool_use"), ((i % 4 == 0) & (F.col("turn") == 0)).alias("is_titling"))
    return roster.without_titling(c).groupBy("file").agg(F.count("*").alias("lines"))
