"""Queries over activity: timeline, effects, roster, outcomes, usage and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commits, outcomes, roster, study, timeline, usage
from .tables import LINES, WORK, lines, table, work

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TODAY = 19753  # 2024-01-31


@query(f"SELECT agent, kind, round(sum(pow(0.5, greatest(0, {TODAY} - day) / 14.0)), 6) AS weight, count(*) AS days FROM (SELECT DISTINCT agent, kind, day FROM {WORK}) GROUP BY agent, kind")
def recency_weight(spark, d):
    return roster.recency(work(spark, d), TODAY, ["agent", "kind"]).withColumn("weight", F.round("weight", 6))


@query(f"SELECT agent, kind, count(DISTINCT day) AS days FROM {WORK} GROUP BY agent, kind")
def distinct_days(spark, d):
    return work(spark, d).groupBy("agent", "kind").agg(F.count_distinct("day").alias("days"))


@query(f"SELECT agent, min(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS earliest, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS latest FROM {WORK} GROUP BY agent")
def activity_span(spark, d):
    return roster.activity_span(work(spark, d).withColumn("stamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), ["agent"])


@query(f"SELECT agent, project, count(*) FILTER (kind IN ('view', 'click')) AS reads, count(*) FILTER (kind IN ('purchase', 'signup')) AS writes FROM {WORK} WHERE verdict = 'ok' GROUP BY agent, project")
def reads_writes(spark, d):
    role = F.when(F.col("kind").isin("view", "click"), "read").when(F.col("kind").isin("purchase", "signup"), "write")
    return roster.reads_writes(work(spark, d).withColumn("role", role))


_USES = f"(SELECT agent, 'f' || (k % 20) AS path, kind IN ('purchase', 'signup') AS write, CASE seq % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'failed' WHEN 2 THEN 'ok' ELSE 'unknown' END AS verdict, CASE seq % 3 WHEN 0 THEN 'always' WHEN 1 THEN 'on-success' ELSE 'sometimes' END AS reached, CASE seq % 5 WHEN 0 THEN '/tmp/' ELSE '/srv/' END AS dir, seq FROM {WORK})"
_SURE = "(verdict <> 'rejected' AND (reached = 'always' OR (verdict = 'ok' AND reached = 'on-success')))"


def _uses(spark, d):
    s = F.col("seq")
    return work(spark, d).select(
        "agent", F.concat(F.lit("f"), F.col("k") % 20).alias("path"), F.col("kind").isin("purchase", "signup").alias("write"),
        F.when(s % 4 == 0, "rejected").when(s % 4 == 1, "failed").when(s % 4 == 2, "ok").otherwise("unknown").alias("verdict"),
        F.when(s % 3 == 0, "always").when(s % 3 == 1, "on-success").otherwise("sometimes").alias("reached"), F.when(s % 5 == 0, "/tmp/").otherwise("/srv/").alias("dir"), "seq",
    )


@query(f"""SELECT agent, path, count(*) FILTER (NOT write AND {_SURE}) AS reads, count(*) FILTER (write AND {_SURE}) AS edits,
 count(*) FILTER (NOT write AND NOT {_SURE}) AS maybe_reads, count(*) FILTER (write AND NOT {_SURE}) AS maybe_edits FROM {_USES} WHERE verdict <> 'rejected' GROUP BY agent, path""")
def shell_path_use(spark, d):
    return roster.shell_uses(_uses(spark, d))


@query(f"SELECT agent, 'box' AS host, dir || path AS path, count(*) FILTER (NOT write) AS reads, count(*) FILTER (write) AS edits FROM {_USES} WHERE verdict <> 'rejected' AND dir <> '/tmp/' GROUP BY ALL")
def remote_path_use(spark, d):
    return roster.remote_uses(_uses(spark, d).withColumn("path", F.concat("dir", "path")).withColumn("host", F.lit("box")))


_VERDICT = "CASE k % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'ok' WHEN 2 THEN 'failed' ELSE 'rejected' END"
_REACH = "CASE {0} % 3 WHEN 0 THEN 'always' WHEN 1 THEN 'on-success' ELSE 'sometimes' END"


@query(f"""SELECT verdict, reached, verdict <> 'rejected' AND (reached = 'always' OR (verdict = 'ok' AND reached = 'on-success')) AS admitted, count(*) AS uses
 FROM (SELECT {_VERDICT} AS verdict, {_REACH.format('seq')} AS reached FROM {WORK}) GROUP BY ALL""")
def admission(spark, d):
    rows = work(spark, d).select(F.expr(_VERDICT).alias("verdict"), F.expr(_REACH.format("seq")).alias("reached"))
    return rows.withColumn("admitted", outcomes.admits(F.col("verdict"), F.col("reached"))).groupBy("verdict", "reached", "admitted").agg(F.count("*").alias("uses"))


@query(f"""SELECT o AS outer_reach, i AS inner_reach, CASE WHEN o = 'always' THEN i WHEN i = 'always' THEN o WHEN o = 'on-success' AND i = 'on-success' THEN 'on-success' ELSE 'sometimes' END AS reached, count(*) AS uses
 FROM (SELECT {_REACH.format('k')} AS o, {_REACH.format('seq')} AS i FROM {WORK}) GROUP BY ALL""")
def reached_composition(spark, d):
    rows = work(spark, d).select(F.expr(_REACH.format("k")).alias("outer_reach"), F.expr(_REACH.format("seq")).alias("inner_reach"))
    return rows.withColumn("reached", outcomes.reached_and(F.col("outer_reach"), F.col("inner_reach"))).groupBy("outer_reach", "inner_reach", "reached").agg(F.count("*").alias("uses"))


def _calls(spark, d):
    w = work(spark, d)
    calls = w.where("kind <> 'error'").select("agent", "k", F.col("seq").alias("line_no"))
    verdict = F.when(F.col("seq") % 3 == 0, "failed").when(F.col("seq") % 3 == 1, "ok").otherwise("rejected")
    return calls, w.where("kind = 'error'").select("agent", "k", F.col("seq").alias("line_no"), verdict.alias("verdict"))


_R = f"(SELECT agent, k, seq AS line_no, CASE seq % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'ok' ELSE 'rejected' END AS verdict FROM {WORK} WHERE kind = 'error')"
_C = f"(SELECT agent, k, seq AS line_no FROM {WORK} WHERE kind <> 'error')"


@query(f"SELECT c.agent AS agent, c.k AS k, c.line_no AS line_no, coalesce(arg_min(r.verdict, r.line_no), 'unknown') AS verdict FROM {_C} c LEFT JOIN {_R} r ON c.agent = r.agent AND c.k = r.k AND r.line_no >= c.line_no GROUP BY c.agent, c.k, c.line_no")
def verdict_join_first(spark, d):
    return outcomes.first_outcome(*_calls(spark, d), ["agent", "k"])


@query(f"SELECT c.agent AS agent, c.k AS k, c.line_no AS line_no, coalesce(r.verdict, 'unknown') AS verdict FROM {_C} c LEFT JOIN (SELECT agent, k, arg_max(verdict, line_no) AS verdict FROM {_R} GROUP BY agent, k) r ON c.agent = r.agent AND c.k = r.k")
def verdict_join_last(spark, d):
    return outcomes.last_outcome(*_calls(spark, d), ["agent", "k"])


@query(f"SELECT c.agent AS agent, c.k AS k, c.line_no AS line_no, coalesce(len(r.refused), 0) AS refused_dirs FROM {_C} c LEFT JOIN (SELECT agent, k, list_distinct(list('/d' || (line_no % 4))) AS refused FROM {_R} GROUP BY agent, k) r ON c.agent = r.agent AND c.k = r.k")
def call_refusals(spark, d):
    calls, results = _calls(spark, d)
    key = F.concat_ws("/", "agent", "k").alias("call_id")
    refused = results.select(key, F.concat(F.lit("/d"), F.col("line_no") % 4).alias("x")).distinct().groupBy("call_id").agg(F.collect_set("x").alias("refused"))  # four directories at most
    return outcomes.with_refusals(calls.withColumn("call_id", key), refused).select("agent", "k", "line_no", F.size("refused").cast("long").alias("refused_dirs"))


@query(f"SELECT kind, CAST(sum(n) AS BIGINT) AS n, count(*) AS total, count(*) FILTER (verdict = 'failed') AS failed FROM {WORK} WHERE lower(project) = 'p3' GROUP BY kind")
def timeline_summary(spark, d):
    return timeline.summary(timeline.filtered(work(spark, d), project="P3"))


@query(f"SELECT agent, project, kind, t, seq FROM {WORK} ORDER BY t DESC, seq DESC LIMIT 200")
def timeline_page(spark, d):
    return timeline.page(work(spark, d)).select("agent", "project", "kind", "t", "seq")


@query(f"SELECT agent, project, kind, t, seq FROM {WORK} WHERE lower(agent) = 'u7' AND lower(kind) = 'click' AND t < {TODAY * 1440 - 8000} ORDER BY t DESC, seq DESC LIMIT 50")
def timeline_filter(spark, d):
    return timeline.page(timeline.filtered(work(spark, d), agent="U7", kind="CLICK", before=TODAY * 1440 - 8000), 50).select("agent", "project", "kind", "t", "seq")


@query(f"SELECT agent, project, kind, t, seq FROM {WORK} WHERE agent = 'nobody'")
def timeline_unknown_name(spark, d):
    return timeline.filtered(work(spark, d), agent="nobody").select("agent", "project", "kind", "t", "seq")


_EFFECTS = f"(SELECT agent, t, CASE WHEN k = 0 THEN 'unnamed' WHEN kind = 'view' THEN 'read' WHEN kind = 'click' THEN 'searched' ELSE 'wrote' END AS did, '/code/P' || k || '.txt' AS path FROM {WORK})"


def _effects(spark, d):
    did = F.when(F.col("k") == 0, "unnamed").when(F.col("kind") == "view", "read").when(F.col("kind") == "click", "searched").otherwise("wrote")
    return work(spark, d).select("agent", "t", did.alias("did"), F.concat(F.lit("/code/P"), "k", F.lit(".txt")).alias("path"))


@query(f"SELECT count(*) AS total, count(*) FILTER (did = 'unnamed') AS unnamed FROM {_EFFECTS} WHERE lower(agent) = 'u7'")
def effects_evidence(spark, d):
    return timeline.evidence(_effects(spark, d), agent="U7")


@query(f"SELECT count(*) AS total, count(*) FILTER (did = 'unnamed') AS unnamed FROM {_EFFECTS} WHERE contains(path, '/P1')")
def effects_by_path(spark, d):
    return timeline.evidence(_effects(spark, d), path="/P1")


@query(f"SELECT w.agent AS agent, w.t AS t, w.seq AS seq, coalesce(e.effects, 0) AS effects FROM {WORK} w LEFT JOIN (SELECT agent, t, count(*) AS effects FROM {_EFFECTS} WHERE did <> 'read' GROUP BY agent, t) e ON w.agent = e.agent AND w.t = e.t")
def effects_per_minute(spark, d):
    return timeline.with_effect_counts(work(spark, d).select("agent", "t", "seq"), _effects(spark, d).where("did <> 'read'"))


@query(f"SELECT agent, did, count(*) AS uses, count(DISTINCT path) AS paths FROM {_EFFECTS} GROUP BY agent, did")
def effects_report(spark, d):
    return _effects(spark, d).groupBy("agent", "did").agg(F.count("*").alias("uses"), F.count_distinct("path").alias("paths"))


_EPISODES = f"""(SELECT file, episode, min(line_no) AS first, max(line_no) AS last, count(*) AS rows FROM (
 SELECT *, sum(CAST(is_prompt AS BIGINT)) OVER (PARTITION BY file ORDER BY line_no) AS episode FROM {LINES}) WHERE is_work AND episode > 0 GROUP BY file, episode)"""


@query(f"SELECT file, CAST(episode AS BIGINT) AS episode, first, last, rows FROM {_EPISODES}")
def episodes(spark, d):
    return timeline.episodes(lines(spark, d))


@query(f"""WITH r AS (SELECT file AS source, line_no AS seq, CAST(sum(CAST(is_prompt AS BIGINT)) OVER (PARTITION BY file ORDER BY line_no) AS BIGINT) AS episode FROM {LINES})
 SELECT source, seq, episode, coalesce(lag(episode) OVER (PARTITION BY source ORDER BY seq DESC) <> episode, true) AS heads FROM r""")
def episode_heads(spark, d):
    from ..operators import scan

    rows = lines(spark, d).select(F.col("file").alias("source"), F.col("line_no").alias("seq"), F.col("is_prompt").cast("long").alias("p"))
    return timeline.heads(scan.Ordered(rows, "source", ["seq"]).values(episode=scan.total("p")).plain().drop("p"))


@query(f"SELECT agent, round(coalesce(count(*) FILTER (verdict = 'failed') / count(*), 0), 6) AS failed_share FROM {WORK} GROUP BY agent")
def failed_share(spark, d):
    return timeline.failed_share(work(spark, d), ["agent"]).withColumn("failed_share", F.round("failed_share", 6))


@query(f"""SELECT file, line_no, n_events FROM (SELECT file, line_no, n_events, sum(n_events) OVER (PARTITION BY file ORDER BY line_no DESC) AS s, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS rn
 FROM {LINES} WHERE line_no < 6) WHERE s <= 8 OR rn = 1""")
def reverse_page(spark, d):
    return timeline.reverse_page(lines(spark, d), before=6, most=8).select("file", "line_no", "n_events")


@query(f"""WITH l AS {LINES}, c AS (SELECT file, max(line_no) AS cut FROM l WHERE is_compaction GROUP BY file)
 SELECT l.file AS file, count(*) FILTER (is_prompt) AS interactions, arg_max(context, line_no) FILTER (context IS NOT NULL) AS context FROM l LEFT JOIN c ON l.file = c.file WHERE cut IS NULL OR line_no > cut GROUP BY l.file""")
def since_compaction(spark, d):
    return timeline.since_compaction(lines(spark, d))


@query(f"SELECT file, max(line_no) AS seed FROM {LINES} WHERE is_compaction GROUP BY file")
def seed_offset(spark, d):
    return lines(spark, d).where("is_compaction").groupBy("file").agg(F.max("line_no").alias("seed"))


_RW = f"(SELECT agent, count(*) FILTER (kind = 'view') AS reads, count(*) FILTER (kind = 'purchase') AS writes FROM {WORK} GROUP BY agent)"


@query(f"SELECT agent, reads, writes FROM {_RW} ORDER BY reads + writes DESC, agent LIMIT 40")
def roster_order(spark, d):
    r = work(spark, d).groupBy("agent").agg(F.count_if(F.col("kind") == "view").alias("reads"), F.count_if(F.col("kind") == "purchase").alias("writes"))
    return r.orderBy(F.desc(F.col("reads") + F.col("writes")), "agent").limit(40)


@query(f"""SELECT agent, project, CAST(n AS BIGINT) AS n, CAST(place AS INT) AS place FROM (SELECT agent, project, n, row_number() OVER (PARTITION BY agent ORDER BY n DESC, project) AS place
 FROM (SELECT agent, project, count(*) AS n FROM {WORK} GROUP BY agent, project)) WHERE place <= 3""")
def agent_places(spark, d):
    facts = work(spark, d).groupBy("agent", "project").agg(F.count("*").alias("n"))
    return roster.top_places(facts, "agent", "n", "project", 3)


@query(f"""WITH a AS (SELECT DISTINCT agent AS name, day FROM {WORK} WHERE day >= 19738), b AS (SELECT DISTINCT agent AS name, day FROM {WORK} WHERE day < 19740),
 u AS (SELECT name, day, 1 AS now FROM a UNION ALL SELECT name, day, 0 FROM b)
 SELECT name, count(DISTINCT day) AS days, count(DISTINCT day) - count(DISTINCT day) FILTER (now = 1) AS carried FROM u GROUP BY name""")
def carry_forward(spark, d):
    w = work(spark, d).select(F.col("agent").alias("name"), "day").distinct()
    sets = [w.where(c).groupBy("name").agg(F.array_sort(F.collect_set("day")).alias("days")) for c in ("day >= 19738", "day < 19740")]  # days, not rows: bounded by the calendar
    return roster.carry_forward(*sets).select("name", F.size("days").cast("long").alias("days"), "carried")


@query("""WITH f AS (SELECT s.s_name AS agent, p.p_name || '/' || p.p_brand AS path, l.l_returnflag AS flag FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)
 SELECT agent, path, CAST(count(*) FILTER (flag <> 'R') AS BIGINT) AS reads, CAST(count(*) FILTER (flag = 'R') AS BIGINT) AS edits FROM f WHERE contains(lower(path), 'ring/brand#2') OR contains(lower(path), 'widget/brand#11') GROUP BY agent, path""")
def who_works_on(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_name", "p_brand").alias("path"))
    who = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("agent"))
    f = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").join(part, "l_partkey").join(who, "l_suppkey")
    tool = f.where("l_returnflag <> 'R'").groupBy("agent", "path").agg(F.count("*").alias("reads"))
    shell = f.where("l_returnflag = 'R'").groupBy("agent", "path").agg(F.count("*").alias("edits"))
    former = part.where(F.lower("path").contains("widget/brand#11")).select("path", F.lit("old/RING/Brand#2").alias("former")).distinct()
    return roster.works_on([tool, shell], "  Ring/Brand#2 ", former)


_STEPS = f"(SELECT CAST(k AS VARCHAR) AS was, CAST((k * 7 + user_id) % 100 AS VARCHAR) AS path, seq AS at_ FROM {WORK} WHERE kind = 'signup')"
_HOPS = "".join(f", w{i} AS (SELECT w.path, CASE WHEN o.dst IS NOT NULL AND o.dst <> w.path THEN o.dst ELSE w.now END AS now FROM w{i - 1} w LEFT JOIN o ON w.now = o.was)" for i in range(1, 8))


@query(f"WITH o AS (SELECT was, arg_max(path, at_) AS dst FROM {_STEPS} WHERE was <> path GROUP BY was), w0 AS (SELECT was AS path, dst AS now FROM o){_HOPS} SELECT path, now FROM w7")
def rename_closure(spark, d):
    w = work(spark, d).where("kind = 'signup'")
    return commits.follow_renames(w.select(F.col("k").cast("string").alias("was"), ((F.col("k") * 7 + F.col("user_id")) % 100).cast("string").alias("path"), F.col("seq").alias("at")))


@query(f"""WITH s AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS sha FROM documents), m AS (SELECT agent, left(md5(CAST(seq % 2000 AS VARCHAR)), CAST(7 + seq % 5 AS INT)) AS hash, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, seq FROM {WORK})
 SELECT s.sha AS sha, arg_min(m.agent, (m.stamp, m.seq)) AS agent FROM s LEFT JOIN m ON starts_with(s.sha, m.hash) GROUP BY s.sha""")
def commit_attribution(spark, d):
    sha = table(spark, d, "documents").select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("sha"))
    hashed = F.md5((F.col("seq") % 2000).cast("string").cast("binary"))
    m = work(spark, d).select("agent", F.substr(hashed, F.lit(1), (7 + F.col("seq") % 5).cast("int")).alias("hash"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), "seq")
    return commits.attribute(sha, m)


_DELTA_PATH = "CASE seq % 5 WHEN 0 THEN 'node_modules/f' || (k % 9) || '.js' WHEN 1 THEN 'src/f' || (k % 9) || '.orig' ELSE 'src/f' || (k % 9) || '.rs' END"


@query(f"SELECT agent, {_DELTA_PATH} AS path, CAST(sum(k) AS BIGINT) AS added, CAST(sum(seq % 13) AS BIGINT) AS deleted, count(DISTINCT seq // 3) AS commits FROM {WORK} WHERE seq % 5 > 1 GROUP BY ALL")
def commit_lines(spark, d):
    deltas = work(spark, d).select("agent", F.expr(_DELTA_PATH).alias("path"), F.col("k").cast("long").alias("added"), (F.col("seq") % 13).alias("deleted"), F.floor(F.col("seq") / 3).alias("sha"))
    return commits.lines(deltas)


_SUBJECTS = f"""(SELECT agent AS name, any_value(user_id) % 3 = 0 AS treated, count(*) FILTER (kind = 'view' AND day >= 19730 AND day < 19740) AS pre, count(*) FILTER (kind = 'view' AND day >= 19740 AND day < 19750) AS post,
 CASE any_value(user_id) % 2 WHEN 0 THEN 'tripwire' ELSE 'pointer' END AS role FROM {WORK} GROUP BY agent)"""
_PAIRS = f"""(WITH n AS (SELECT *, row_number() OVER (PARTITION BY treated, pre ORDER BY name) AS rn FROM {_SUBJECTS})
 SELECT t.pre AS pre, t.rn AS rn, t.name AS treated_name, t.post AS treated_post, t.role AS role, c.name AS control_name, c.post AS control_post FROM n t JOIN n c ON t.treated AND NOT c.treated AND t.pre = c.pre AND t.rn = c.rn)"""


def _subjects(spark, d):
    w = work(spark, d)
    ids = w.groupBy(F.col("agent").alias("name")).agg(F.first("user_id").alias("u"))
    counts = study.windows(w.where("kind = 'view'").select(F.col("agent").alias("name"), "day"), 19740, 10)
    role = F.when(F.col("u") % 2 == 0, "tripwire").otherwise("pointer")
    return ids.join(counts, "name", "left").select("name", (F.col("u") % 3 == 0).alias("treated"), F.coalesce("pre", F.lit(0)).alias("pre"), F.coalesce("post", F.lit(0)).alias("post"), role.alias("role"))


@query(f"SELECT pre, treated_name, control_name, treated_post, control_post FROM {_PAIRS}")
def did_matching(spark, d):
    return study.match(_subjects(spark, d)).select("pre", "treated_name", "control_name", "treated_post", "control_post")


@query(f"SELECT name, pre, post FROM {_SUBJECTS} WHERE treated AND name NOT IN (SELECT treated_name FROM {_PAIRS})")
def did_unmatched(spark, d):
    s = _subjects(spark, d)
    return study.unmatched(s, study.match(s)).select("name", "pre", "post")


def _did(where: str, arm: str) -> str:
    return f"""SELECT count(*) AS pairs, count(*) FILTER (pre > 0) AS informative, round(coalesce(avg(treated_post - pre), 0), 6) AS treated_change, round(coalesce(avg(control_post - pre), 0), 6) AS control_change,
 round(coalesce(avg(treated_post - pre) - avg(control_post - pre), 0), 6) AS did, '{arm}' AS arm FROM {_PAIRS} WHERE {where}"""


def _tidy(df):
    return df.select("pairs", "informative", *[F.round(c, 6).alias(c) for c in ("treated_change", "control_change", "did")], "arm")


@query(_did("true", "all"))
def did_estimate(spark, d):
    return _tidy(study.estimate(study.match(_subjects(spark, d))))


@query(" UNION ALL ".join(_did(w, a) for a, w in (("all", "true"), ("reference_", "starts_with(treated_name, 'reference_')"), ("project_", "starts_with(treated_name, 'project_')"), ("role: tripwire", "role = 'tripwire'"), ("role: pointer", "role = 'pointer'"))))
def did_by_arm(spark, d):
    return _tidy(study.by_arm(study.match(_subjects(spark, d))))


def _weights(spark, d, half_life: float):
    return roster.recency(work(spark, d).where("kind = 'view'"), TODAY, ["agent"], half_life).select(F.col("agent").alias("name"), F.round("weight", 6).alias("weight"))


def _wsql(h: float) -> str:
    return f"(SELECT agent AS name, round(sum(pow(0.5, greatest(0, {TODAY} - day) / {h})), 6) AS weight FROM (SELECT DISTINCT agent, day FROM {WORK} WHERE kind = 'view') GROUP BY agent)"


@query(f"SELECT name, weight FROM {_wsql(14.0)} WHERE length(name) <> 2 AND weight <= 4.5 AND CAST(substr(name, 2) AS INT) % 3 > 0 ORDER BY weight, name LIMIT 25")
def demotion_candidates(spark, d):
    s = _weights(spark, d, 14.0).withColumn("indexed", F.length("name") != 2).withColumn("behavioural", F.lit(False)).withColumn("homes", F.substring("name", 2, 9).cast("int") % 3)
    return study.demotion_candidates(s, most_read=4.5).select("name", "weight")


@query(f"SELECT count(*) AS changed FROM (SELECT name FROM {_wsql(14.0)} ORDER BY weight DESC, name LIMIT 30) WHERE name NOT IN (SELECT name FROM {_wsql(7.0)} ORDER BY weight DESC, name LIMIT 30)")
def rank_stability(spark, d):
    return study.stability(_weights(spark, d, 14.0), _weights(spark, d, 7.0))


@query(f"""WITH b AS (SELECT DISTINCT agent AS name FROM {WORK} WHERE day < 19740 AND kind = 'view'), a AS (SELECT DISTINCT agent AS name FROM {WORK} WHERE day >= 19740 AND kind = 'view')
 SELECT name, true AS treated FROM b WHERE name NOT IN (SELECT name FROM a) UNION ALL SELECT name, false FROM a""")
def snapshot_difference(spark, d):
    w = work(spark, d).where("kind = 'view'").withColumn("name", F.col("agent"))
    return study.snapshot_difference(w.where("day < 19740"), w.where("day >= 19740"))


_READ = f"(SELECT kind AS \"window\", CAST(seq // 50 AS BIGINT) * 40 AS resets_at, value AS utilization, seq AS \"at\" FROM {WORK})"


@query(f"""WITH r AS {_READ}, t AS (SELECT "window", max(resets_at) AS top FROM r GROUP BY "window"), n AS (SELECT r.* FROM r JOIN t ON r."window" = t."window" AND r.resets_at >= t.top - 60)
 SELECT "window", utilization, resets_at, "at" FROM (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY utilization DESC, "at" DESC) AS rn FROM n) WHERE rn = 1""")
def usage_latest(spark, d):
    r = work(spark, d).select(F.col("kind").alias("window"), (F.floor(F.col("seq") / 50) * 40).alias("resets_at"), F.col("value").alias("utilization"), F.col("seq").alias("at"))
    return usage.fresher(r)


_EV = f"(SELECT agent AS session, seq, CASE kind WHEN 'view' THEN 'text' WHEN 'click' THEN 'tool' WHEN 'error' THEN 'exit' WHEN 'signup' THEN 'turn' ELSE 'other' END AS kind, CASE WHEN kind = 'view' THEN 'm' || (k % 3) END AS model, CASE WHEN kind = 'click' THEN k END AS context, CASE WHEN kind = 'purchase' THEN value END AS cost FROM {WORK})"


@query(f"""SELECT session, coalesce(arg_max(CASE WHEN kind IN ('text', 'tool') THEN true WHEN kind IN ('turn', 'exit') THEN false END, seq) FILTER (kind <> 'other'), false) AS working,
 arg_max(model, seq) FILTER (model IS NOT NULL) AS model, arg_max(context, seq) FILTER (context IS NOT NULL) AS context, arg_max(cost, seq) FILTER (cost IS NOT NULL) AS cost, max(seq) AS last_seq, count(*) AS events FROM {_EV} GROUP BY session""")
def session_state(spark, d):
    k = F.col("kind")
    kind = F.when(k == "view", "text").when(k == "click", "tool").when(k == "error", "exit").when(k == "signup", "turn").otherwise("other")
    e = work(spark, d).select(F.col("agent").alias("session"), "seq", kind.alias("kind"), F.when(k == "view", F.concat(F.lit("m"), F.col("k") % 3)).alias("model"), F.when(k == "click", F.col("k")).alias("context"), F.when(k == "purchase", F.col("value")).alias("cost"))
    return usage.session_state(e)


@query(f"""WITH e AS (SELECT agent, k, seq, kind FROM {WORK}), j AS (SELECT agent, max(seq) AS at FROM e WHERE kind = 'error' AND k < 5 GROUP BY agent)
 SELECT b.agent AS session, b.seq AS seq, 'c' || b.k AS call_id FROM e b LEFT JOIN j ON j.agent = b.agent WHERE b.kind = 'signup' AND (j.at IS NULL OR j.at <= b.seq)
 AND NOT EXISTS (SELECT 1 FROM e x WHERE x.agent = b.agent AND x.kind = 'purchase' AND x.seq > b.seq AND (x.k = b.k OR x.k = b.k + 1))""")
def open_background(spark, d):
    k = F.col("kind")
    kind = F.when(k == "signup", "begin").when(k == "purchase", "end").when((k == "error") & (F.col("k") < 5), "joined")
    c = F.concat(F.lit("c"), "k")
    e = work(spark, d).select(F.col("agent").alias("session"), "seq", kind.alias("kind"), c.alias("call_id"), F.concat(F.lit("c"), F.col("k") + 1).alias("task_id"), c.alias("ends"))
    return usage.open_background(e).select("session", "seq", "call_id")


@query(f"""SELECT session, seq FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS rn, min(seq) OVER (PARTITION BY session) AS x FROM (SELECT agent AS session, seq FROM {WORK}))
 q WHERE rn <= 40 AND (seq > 9000 OR (SELECT min(seq) FROM (SELECT seq FROM {WORK} w WHERE w.agent = q.session ORDER BY seq DESC LIMIT 40)) > 9001)""".replace("q WHERE", " q WHERE"))
def resumable_replay(spark, d):
    return usage.replay(work(spark, d).select(F.col("agent").alias("session"), "seq"), after=9000, ring=40)


@query(f"""WITH a AS (SELECT DISTINCT user_id AS pid FROM {WORK} WHERE day = 19725), b AS (SELECT DISTINCT user_id AS pid FROM {WORK} WHERE day = 19726)
 SELECT pid, 'fresh' AS change FROM b WHERE pid NOT IN (SELECT pid FROM a) UNION ALL SELECT pid, 'gone' FROM a WHERE pid NOT IN (SELECT pid FROM b)""")
def sweep_difference(spark, d):
    w = work(spark, d).withColumn("pid", F.col("user_id"))
    return usage.sweep(w.where("day = 19726").select("pid").distinct(), w.where("day = 19725").select("pid").distinct(), "pid")


@query(f"""WITH t AS (SELECT agent AS holder, count(*) FILTER (kind = 'click') AS open, count(*) AS total FROM {WORK} WHERE kind IN ('click', 'view') GROUP BY agent), s AS (SELECT agent AS holder, count(*) AS strays FROM {WORK} WHERE kind = 'error' GROUP BY agent)
 SELECT coalesce(t.holder, s.holder) AS holder, coalesce(open, 0) AS open, coalesce(total, 0) AS total, coalesce(strays, 0) AS strays FROM t FULL OUTER JOIN s ON t.holder = s.holder""")
def task_counts(spark, d):
    w = work(spark, d).withColumn("holder", F.col("agent"))
    strays = w.where("kind = 'error'").groupBy("holder").agg(F.count("*").alias("strays"))
    return usage.task_counts(w.where("kind IN ('click', 'view')").select("holder", (F.col("kind") == "click").alias("open")), strays)


@query(f"SELECT project, count(*) AS n FROM {WORK} GROUP BY project ORDER BY n DESC, min(seq) LIMIT 1")
def commonest_directory(spark, d):
    return usage.commonest(work(spark, d), "project", "seq")


@query(f"""WITH m AS (SELECT k % 10 AS idle, CASE WHEN k % 3 > 0 THEN k % 11 END AS oldest, CASE WHEN k % 4 > 0 THEN seq % 9 END AS decided, seq % 5 = 0 AS compacting, seq FROM {WORK}),
 q AS (SELECT seq, compacting, 200000 - least(CASE WHEN idle IS NOT NULL AND oldest IS NOT NULL THEN greatest(idle, oldest) END, decided) * 20000 AS quiet FROM m)
 SELECT seq, CAST(CASE WHEN quiet >= CASE WHEN compacting THEN 900000 ELSE 90000 END THEN quiet END AS BIGINT) AS deaf FROM q""")
def deaf_after(spark, d):
    k, s = F.col("k"), F.col("seq")
    ms = lambda c: (c * 20000).cast("long")
    return work(spark, d).select("seq", usage.deaf_after(ms(k % 10), F.when(k % 3 > 0, ms(k % 11)), F.when(k % 4 > 0, ms(s % 9)), s % 5 == 0, F.lit(200000).cast("long")).alias("deaf"))


# commands made from events, by the last digit of their number; what each uses follows from how it is made
_MADE = f"(SELECT DISTINCT CAST(seq % 10 AS INT) AS way, k, user_id AS u FROM {WORK})"


def _commands(spark, d):
    w = work(spark, d).select((F.col("seq") % 10).cast("int").alias("way"), F.col("k").cast("string").alias("k"), F.col("user_id").cast("string").alias("u"), (F.col("k") % 3 + 1).cast("string").alias("n")).distinct()
    put = lambda *parts: F.concat(*[F.col(x) if x in ("k", "u", "n") else F.lit(x) for x in parts])
    made = [
        put("cat f", "k", ".txt g", "u", ".txt"),
        put("cd d", "k", " && sed -i s/x/y/ m", "u", ".py"),
        put("(cd d", "k", "; cat a", "u", ".txt); rm b", "u", ".txt"),
        put("for i in $(seq 1 ", "n", "); do touch n", "u", ".", "k", "_$i.txt; done"),
        put("diff <(sort p", "k", ") <(sort q", "u", ") || cp p", "k", " r", "u"),
        put("ssh me@h", "k", ".lan 'cat /etc/c", "u", "'"),
        put("x=$(cat l", "u", ".", "k", ") && rm $x"),
        put("cat f", "k", " 'torn ", "u"),
        put("cargo test && git commit -m x", "k", ".", "u"),
        put("! grep -n foo s", "k", ".rs > o", "u", ".log &"),
    ]
    return w.select(F.element_at(F.array(*made), F.col("way") + 1).alias("cmd"), F.lit("/code/app").alias("cwd"))


def _read(spark, d, *want):
    from ..shell.extract import read_commands

    return read_commands(_commands(spark, d), "/home/example", want)


_CMD = """(CASE way WHEN 0 THEN 'cat f' || k || '.txt g' || u || '.txt' WHEN 1 THEN 'cd d' || k || ' && sed -i s/x/y/ m' || u || '.py'
 WHEN 2 THEN '(cd d' || k || '; cat a' || u || '.txt); rm b' || u || '.txt' WHEN 3 THEN 'for i in $(seq 1 ' || (k % 3 + 1) || '); do touch n' || u || '.' || k || '_$i.txt; done'
 WHEN 4 THEN 'diff <(sort p' || k || ') <(sort q' || u || ') || cp p' || k || ' r' || u WHEN 5 THEN 'ssh me@h' || k || '.lan ''cat /etc/c' || u || '''' WHEN 6 THEN 'x=$(cat l' || u || '.' || k || ') && rm $x'
 WHEN 7 THEN 'cat f' || k || ' ''torn ' || u WHEN 8 THEN 'cargo test && git commit -m x' || k || '.' || u WHEN 9 THEN '! grep -n foo s' || k || '.rs > o' || u || '.log &' END)"""


@query(f"""WITH m AS {_MADE}, u AS (
 SELECT way, k, u, NULL AS host, 'f' || k || '.txt' AS path, false AS write, 'always' AS reached FROM m WHERE way = 0 UNION ALL SELECT way, k, u, NULL, 'g' || u || '.txt', false, 'always' FROM m WHERE way = 0
 UNION ALL SELECT way, k, u, NULL, 'd' || k || '/m' || u || '.py', true, 'on-success' FROM m WHERE way = 1 UNION ALL SELECT way, k, u, NULL, 'd' || k || '/a' || u || '.txt', false, 'always' FROM m WHERE way = 2 UNION ALL SELECT way, k, u, NULL, 'b' || u || '.txt', true, 'always' FROM m WHERE way = 2
 UNION ALL SELECT way, k, u, NULL, 'n' || u || '.' || k || '_' || unnest(range(1, k % 3 + 2)) || '.txt', true, 'always' FROM m WHERE way = 3 UNION ALL SELECT way, k, u, NULL, 'p' || k, false, unnest(['always', 'sometimes']) FROM m WHERE way = 4
 UNION ALL SELECT way, k, u, NULL, 'q' || u, false, 'always' FROM m WHERE way = 4 UNION ALL SELECT way, k, u, NULL, 'r' || u, true, 'sometimes' FROM m WHERE way = 4 UNION ALL SELECT way, k, u, 'h' || k, '/etc/c' || u, false, 'always' FROM m WHERE way = 5
 UNION ALL SELECT way, k, u, NULL, 'l' || u || '.' || k, false, 'always' FROM m WHERE way = 6 UNION ALL SELECT way, k, u, NULL, 's' || k || '.rs', false, 'always' FROM m WHERE way = 9 UNION ALL SELECT way, k, u, NULL, 'o' || u || '.log', true, 'always' FROM m WHERE way = 9)
 SELECT {_CMD} AS cmd, host, CASE WHEN starts_with(path, '/') THEN path ELSE '/code/app/' || path END AS path, write, reached FROM u""")
def read_command(spark, d):
    from ..shell.extract import file_uses

    return file_uses(_read(spark, d, "uses")).drop("cwd")


@query(f"""WITH m AS {_MADE}, a AS (SELECT unnest(CASE way WHEN 0 THEN ['inspect'] WHEN 1 THEN ['navigate', 'edit'] WHEN 2 THEN ['navigate', 'inspect', 'edit'] WHEN 3 THEN list_transform(range(k % 3 + 1), lambda x: 'edit') WHEN 4 THEN ['inspect', 'inspect', 'inspect', 'edit']
 WHEN 5 THEN ['inspect', 'observe'] WHEN 6 THEN ['inspect', 'edit'] WHEN 8 THEN ['test', 'version control'] WHEN 9 THEN ['edit'] END) AS activity FROM m WHERE way <> 7) SELECT activity, count(*) AS commands FROM a GROUP BY activity""")
def activity_of_command(spark, d):
    from ..shell.extract import activity_report

    return activity_report(_read(spark, d, "steps"))


@query(f"""WITH m AS {_MADE} SELECT CASE way WHEN 7 THEN 'unclosed single quote' ELSE 'read' END AS reason, count(*) AS commands, CAST(sum(CASE way WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN k % 3 + 1 WHEN 4 THEN 4 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 9 THEN 2 ELSE 0 END) AS BIGINT) AS uses,
 CAST(sum(CASE way WHEN 6 THEN 1 WHEN 7 THEN 1 ELSE 0 END) AS BIGINT) AS undetermined, CAST(sum(octet_length(CAST({_CMD} AS BLOB))) AS BIGINT) AS bytes FROM m GROUP BY 1""")
def parse_report(spark, d):
    from ..shell.extract import report

    return report(_read(spark, d, "uses", "undetermined"))


def _stream(spark, df, files: int):
    """The rows as a stream of several files in the shared folder, and a folder for its run."""
    from ..sources.scratch import Scratch

    s = Scratch(spark, "stream")
    df.repartition(files).write.parquet(f"{s.path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{s.path}/in"), f"{s.path}/run"


@query(ORACLE_SQL["session_state"])
def stream_session_state(spark, d):
    from ..streaming import sessions

    k = F.col("kind")
    kind = F.when(k == "view", "text").when(k == "click", "tool").when(k == "error", "exit").when(k == "signup", "turn").otherwise("other")
    e = work(spark, d).select(F.col("agent").alias("session"), "seq", kind.alias("kind"), F.when(k == "view", F.concat(F.lit("m"), F.col("k") % 3)).alias("model"), F.when(k == "click", F.col("k")).alias("context"), F.when(k == "purchase", F.col("value")).alias("cost"))
    stream, run = _stream(spark, e, 3)
    return sessions.newest(sessions.run_once(sessions.session_state(stream), run), ["session"], "batch").drop("batch")


@query(f"""WITH l AS {LINES}, c AS (SELECT file, max(line_no) AS cut FROM l WHERE is_compaction GROUP BY file)
 SELECT l.file AS file, count(*) FILTER (is_prompt AND (cut IS NULL OR line_no > cut)) AS interactions, arg_max(context, line_no) FILTER (context IS NOT NULL AND (cut IS NULL OR line_no > cut)) AS context FROM l LEFT JOIN c ON l.file = c.file GROUP BY l.file""")
def stream_incremental_count(spark, d):
    from ..streaming import sessions

    stream, run = _stream(spark, lines(spark, d), 1)
    out = sessions.run_once(sessions.incremental_count(stream), run)
    return sessions.newest(out, ["file"], "line_no").select("file", "interactions", "context")


@query(rf"""WITH f AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM {LINES} WHERE is_compaction OR is_prompt)
 SELECT file, line_no, CASE WHEN is_compaction THEN 'compacted' ELSE 'prompt' END AS mark, CASE WHEN length(flat) > 120 THEN left(flat, 120) || '…' ELSE flat END AS sign FROM f""")
def stream_landmarks(spark, d):
    from ..streaming import sessions

    stream, run = _stream(spark, lines(spark, d), 2)
    return sessions.run_once(sessions.landmarks(stream), run, mode="append").select("file", "line_no", "mark", "sign")


@query(f"SELECT DISTINCT 'k' || k || '-' || kind AS call_id FROM {WORK}")
def stream_distinct_calls(spark, d):
    """Calls that come again, in order of time, in three files: each is given once, as all come within the watermark."""
    from ..streaming import sessions

    calls = work(spark, d).select(F.concat(F.lit("k"), "k", F.lit("-"), "kind").alias("call_id"), F.col("ts").cast("timestamp").alias("stamp"))
    stream, run = _stream(spark, calls, 3)
    return sessions.run_once(sessions.distinct_calls(stream, "3650 days"), run, mode="append").select("call_id")


_ENT = f"(SELECT agent AS session, seq, CASE WHEN kind IN ('view', 'click') THEN 'tool' ELSE kind END AS kind, kind AS text, kind <> 'click' OR k % 4 > 0 AS settled, CASE k % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'ok' END AS verdict FROM {WORK})"


def _entries(spark, d):
    k = F.col("k")
    kind = F.when(F.col("kind").isin("view", "click"), "tool").otherwise(F.col("kind"))
    return work(spark, d).select(F.col("agent").alias("session"), "seq", kind.alias("kind"), F.col("kind").alias("text"), ((F.col("kind") != "click") | (k % 4 > 0)).alias("settled"), F.when(k % 3 == 0, "failed").when(k % 3 == 1, "ok").alias("verdict"))


@query(f"""WITH e AS {_ENT}, s AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY session ORDER BY seq) <> kind, true) AS st FROM e), r AS (SELECT *, sum(CAST(st AS INT)) OVER (PARTITION BY session ORDER BY seq) AS run FROM s)
 SELECT session, kind, min(seq) AS first, count(*) AS parts, CAST(sum(length(text)) AS BIGINT) AS chars FROM r GROUP BY session, run, kind""")
def merged_text(spark, d):
    from ..operators import view

    return view.merged_text(_entries(spark, d))


@query(f"""WITH e AS (SELECT *, kind = 'tool' AND settled AS ok FROM {_ENT}), s AS (SELECT *, coalesce(lag(ok) OVER (PARTITION BY session ORDER BY seq) <> ok, true) AS st FROM e), r AS (SELECT *, sum(CAST(st AS INT)) OVER (PARTITION BY session ORDER BY seq) AS run FROM s)
 SELECT session, min(seq) AS first, max(seq) AS last, count(*) AS calls, count(*) FILTER (verdict = 'failed') AS failed, count(*) FILTER (verdict IS NULL) AS unrecorded FROM r WHERE ok GROUP BY session, run HAVING count(*) >= 2""")
def tool_runs(spark, d):
    from ..operators import view

    return view.tool_runs(_entries(spark, d))


@query(f"SELECT CAST(ts AS DATE) AS day, count(*) AS landmarks FROM {WORK} WHERE kind = 'signup' GROUP BY 1")
def landmarks_by_day(spark, d):
    from ..operators import view

    return view.landmarks_by_day(work(spark, d).where("kind = 'signup'").withColumn("at", F.col("ts")))


_ENTRY = "CASE WHEN doc_id % 3 > 0 THEN '# ' || source || chr(10) || '- [Note ' || doc_id || '](note_' || doc_id || '.md) about ' || lang || ' é' || chr(10) || 'end' ELSE '- [Other](other.md)' END"


@query(f"""SELECT 'note_' || doc_id AS name, CASE WHEN doc_id % 3 > 0 THEN octet_length(encode('- [Note ' || doc_id || '](note_' || doc_id || '.md) about ' || lang || ' é')) + 2 ELSE 0 END AS bytes FROM documents""")
def index_entry_cost(spark, d):
    from ..operators import view

    docs = table(spark, d, "documents").select(F.concat(F.lit("note_"), "doc_id").alias("name"), F.expr(_ENTRY).alias("index"))
    return docs.select("name", view.index_entry_cost(F.col("index"), F.col("name")).cast("long").alias("bytes"))
