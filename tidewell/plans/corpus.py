"""Queries over notes, pages, co-use, search, graphs and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import couse, graph, lint, search, turns
from .tables import EDGES, LINKS, NODES, WORK, notes, page_links, table, work

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _save(spark):
    """Writes a table to the shared folder and reads it back."""
    from ..sources.scratch import Scratch

    return Scratch(spark, "graph").table


_TEXT = "(SELECT doc_id, text FROM documents)"
_TOKENS = r"""(SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}-]+')) AS run FROM documents)"""


@query(rf"""WITH r AS {_TOKENS}, p AS (SELECT doc_id, list_filter(string_split(run, '-'), lambda x: x <> '') AS parts FROM r),
 t AS (SELECT doc_id, unnest(CASE WHEN len(parts) > 1 THEN list_concat([array_to_string(parts, '')], parts) ELSE parts END) AS term FROM p)
 SELECT doc_id, count(*) AS terms, count(DISTINCT term) AS distinct_terms FROM t GROUP BY doc_id""")
def tokenize_terms(spark, d):
    # a generator, so that the terms are made once; counted in the row, as doc_id is a key
    t = table(spark, d, "documents").select("doc_id", F.inline(F.array(F.struct(T.tokenize(F.col("text")).alias("t")))))
    return t.where(F.size("t") > 0).select("doc_id", F.size("t").cast("long").alias("terms"), F.size(F.array_distinct("t")).cast("long").alias("distinct_terms"))


@query(r"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(' ' || text || ' ', '[0-9A-Za-z]+')) AS hash FROM documents)
 SELECT doc_id, hash, count(*) AS n FROM h WHERE regexp_full_match(hash, '[0-9a-fA-F]{7,40}') AND regexp_matches(hash, '[a-fA-F]') GROUP BY doc_id, hash""")
def hash_mentions(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.explode(T.hash_candidates(F.col("text"))).alias("hash"))
    return h.groupBy("doc_id", "hash").agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z0-9_]{5,}')) AS name FROM benchmark),
 m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '([a-z0-9_]{5,})[^a-z0-9_]', 1))) AS name FROM documents)
 SELECT name, count(*) AS docs FROM m WHERE name IN (SELECT name FROM w) GROUP BY name""")
def names_in_text(spark, d):
    known = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z0-9_]{5,}"), 0)).alias("name")).distinct()
    m = table(spark, d, "documents").select("doc_id", F.explode(T.names_in(F.col("text"))).alias("name"))
    return m.join(known, "name", "left_semi").groupBy("name").agg(F.count("*").alias("docs"))


_HREF = r"""(SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""


def _hrefs(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


_PLAIN = "array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '' AND x <> '.'), '/')"


@query(rf"""SELECT url, CASE page_id % 4 WHEN 0 THEN '/' || {_PLAIN} WHEN 1 THEN '/a/' || {_PLAIN} WHEN 2 THEN '/' || {_PLAIN} ELSE '/b/c' END AS path FROM pages""")
def path_normalize(spark, d):
    u, i = F.regexp_replace("url", "^[a-z]+://", ""), F.col("page_id") % 4
    up = F.repeat(F.lit("/.."), F.size(F.filter(F.split(u, "/"), lambda x: ~x.isin("", "."))))  # out of all of it again
    said = F.when(i == 0, u).when(i == 1, F.concat(F.lit("/a/x/./y/../../"), u)).when(i == 2, F.concat(F.lit("../../z/.."), F.lit("/"), u)).otherwise(F.concat(F.lit("/b/"), u, up, F.lit("//c/.")))
    return table(spark, d, "pages").select("url", P.normalise(said).alias("path"))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '/') AS path FROM pages)
 SELECT page_id, nullif(split_part(substr(path, 2), '/', 1), '') AS project, CASE WHEN contains(substr(path, 2), '/') THEN substr(path, 2) END AS rel FROM u""")
def path_project(spark, d):
    p = F.regexp_replace("url", "^[a-z]+://", "/")
    return table(spark, d, "pages").select("page_id", P.project_of(p, "/").alias("project"), P.relative_to(p, "/").alias("rel"))


@query(rf"""SELECT href, len(list_intersect(string_split(href, '/'), ['node_modules','dist','build','target','coverage','logs','log','.venv','venv','__pycache__','.gradle','.angular','.next','.cache'])) = 0
 AND NOT regexp_matches(href, '\.(log|bak|tmp|orig|rej)$') AS ok, count(*) AS n FROM {_HREF} GROUP BY href""")
def path_attributable(spark, d):
    return _hrefs(spark, d).groupBy("href").agg(F.count("*").alias("n")).withColumn("ok", P.attributable(F.col("href")))


@query(rf"""SELECT href, starts_with(href, '~') OR contains(href, '/') OR href IN ('Makefile','Dockerfile','README','LICENSE','Cargo.lock','Justfile','Procfile') OR regexp_matches(href, '^.+\.[A-Za-z0-9]{{1,8}}$') AS is_path FROM (SELECT DISTINCT substr(href, 2) AS href FROM {_HREF})""")
def looks_like_path(spark, d):
    return _hrefs(spark, d).select(F.call_function("substr", F.col("href"), F.lit(2)).alias("href")).distinct().withColumn("is_path", P.looks_like_path(F.col("href")))


@query(r"""SELECT split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), '.', 1) AS host, count(*) AS pages FROM pages GROUP BY host""")
def host_names(spark, d):
    host = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")[0]
    return table(spark, d, "pages").groupBy(P.short_name(host).alias("host")).agg(F.count("*").alias("pages"))


#: How a text begins that an arm of the decision list takes, and what the arm says.
_ARMS = [
    ("#!/bin/sh ", "a script with a shebang"), ("select 1 ", "SQL"), ("theorem x ", "Lean"), ("structure a where ", "Lean"), ("def f := ", "Lean"), ("import { x } from ", "TypeScript or JavaScript"), ("export x ", "TypeScript or JavaScript"),
    ("package a ", "Kotlin or Java"), ("import os ", "Python"), ("def f(): ", "Python"), ("x = open(f).read() ", "Python"), ("fn main ", "Rust"), ("let x = 1 in ", "Dhall"), ("---\na: b ", "YAML"), ("[a]\nb=c ", "INI"), ("<p> ", "markup"), ("set -e ", "shell"), ("hello ", "prose, or nothing recognised"),
]


@query("SELECT doc_id, list_extract(" + str([b for _, b in _ARMS]) + f", CAST(doc_id % {len(_ARMS)} + 1 AS INT)) AS language FROM documents")
def sniff_arms(spark, d):
    head = F.element_at(F.array(*[F.lit(a) for a, _ in _ARMS]), (F.col("doc_id") % len(_ARMS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.sniff(F.concat(head, F.coalesce("source", F.lit("")))).alias("language"))


@query(r"""SELECT CASE WHEN starts_with(ltrim(t, E' \n\t\r'), '<') THEN 'markup' WHEN starts_with(t, 'for ') OR contains(t, E'\nfor ') OR contains(t, E'\nif [') THEN 'shell' WHEN regexp_matches(t, '^\s*(?i:SELECT|CREATE|INSERT|UPDATE|DELETE|PRAGMA|ATTACH|BEGIN|WITH)([^A-Za-z]|$)') THEN 'SQL' ELSE 'prose, or nothing recognised' END AS language, count(*) AS bodies
 FROM (SELECT text AS t FROM documents UNION ALL SELECT html FROM pages) GROUP BY language""")
def sniff_language(spark, d):
    # of the decision list only these arms occur in the driver's texts; the others are tested on literals
    t = table(spark, d, "documents").select(F.col("text").alias("t")).unionByName(table(spark, d, "pages").select(F.col("html").alias("t")))
    return t.groupBy(T.sniff(F.col("t")).alias("language")).agg(F.count("*").alias("bodies"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents) SELECT doc_id, CASE WHEN length(flat) > 120 THEN left(flat, 120) || '…' ELSE flat END AS sign, left(flat, 60) AS line FROM f""")
def landmark_sign(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sign(F.col("text")).alias("sign"), T.one_line(F.col("text"), 60).alias("line"))


@query("""WITH f AS (SELECT doc_id, text AS t, instr(lower(text), 'tion') AS hit FROM documents WHERE contains(lower(text), 'tion')), g AS (SELECT *, greatest(hit - 80, 1) AS a, least(hit + 84, length(t) + 1) AS z FROM f)
 SELECT doc_id, CASE WHEN a > 1 THEN '…' ELSE '' END || replace(substr(t, a, z - a), E'\\n', ' ') || CASE WHEN z <= length(t) THEN '…' ELSE '' END AS snippet FROM g""")
def search_snippet(spark, d):
    t = table(spark, d, "documents").where(F.lower("text").contains("tion"))
    return t.select("doc_id", T.snippet(F.col("text"), F.lit("tion")).alias("snippet"))


_NOTES = "(SELECT 'note-' || doc_id AS name, lang || ' ' || source AS description, text AS body, doc_id % 12 AS sessions FROM documents)"


def _bm25(terms: list[str], phrase: str, every: bool) -> str:
    parts = "list_filter(string_split(r, '-'), lambda x: x <> '')"
    tok = r"""flatten(list_transform(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}-]+'), lambda r: CASE WHEN len(PARTS) > 1 THEN list_concat([array_to_string(PARTS, '')], PARTS) ELSE PARTS END))""".replace("PARTS", parts)
    hit = lambda c, t: f"(len(list_filter({c}, lambda x: x = '{t}')) + 0.45 * len(list_filter({c}, lambda x: x <> '{t}' AND starts_with(x, '{t}'))))"
    ok = (" AND " if every else " OR ").join(f"h{i}" for i in range(len(terms)))
    hits = ", ".join(f"contains(hay, '{t}') OR contains(replace(hay, '-', ''), '{t}') AS h{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (h{i}) AS d{i}" for i in range(len(terms)))
    tfs = ", ".join(f"{hit('tn', t)} * 3.0 + {hit('td', t)} * 2.0 + {hit('tb', t)} AS f{i}" for i, t in enumerate(terms))
    part = " + ".join(f"CASE WHEN f{i} > 0 THEN greatest(0, ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1)) * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * len / avg_len)) ELSE 0 END" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    # names hold a hyphen: their joined form is a term of its own
    return rf"""WITH b AS (SELECT *, lower(name || ' ' || description || ' ' || body) AS hay, list_concat([replace(name, '-', '')], string_split(name, '-')) AS tn, {tok.format(c='description')} AS td, {tok.format(c='body')} AS tb FROM {_NOTES}),
 h AS (SELECT *, {hits} FROM b), t AS (SELECT count(*) AS n, {dfs} FROM h), c AS (SELECT *, len(tn) + len(td) + len(tb) AS len FROM h WHERE {ok}), a AS (SELECT greatest(avg(len), 1) AS avg_len FROM c),
 s AS (SELECT name, body, description, sessions, len, {tfs} FROM c), x AS (SELECT name, ({part}) * CASE WHEN contains(lower(body), '{phrase}') OR contains(lower(description), '{phrase}') THEN {1.8 if len(terms) > 1 else 1.0} ELSE 1 END * (1 + 0.35 * least(sqrt(sessions), 3.6) / 3.6) AS score FROM s, t, a WHERE {some})
 SELECT name, round(score, 5) AS score FROM x"""


@query(_bm25(["erst", "tion"], "erst tion", True))
def bm25_search(spark, d):
    return search.rank(notes(spark, d), "Erst tion").select("name", F.round("score", 5).alias("score"))


@query(ORACLE_SQL["bm25_search"])
def bm25_indexed(spark, d):
    """The index is built with older versions of a third of the notes and one that goes, and then brought up to date."""
    from ..operators.postings import Index
    from ..sources.scratch import Scratch

    now, scratch = notes(spark, d), Scratch(spark, "index")
    changed = F.pmod(F.xxhash64("name"), F.lit(3)) == 0
    index = Index(spark, f"{scratch.path}/index", buckets=16)
    index.write(now.withColumn("body", F.when(changed, F.concat_ws(" ", F.lit("erst tion"), F.reverse("body"))).otherwise(F.col("body"))).unionByName(now.limit(1).withColumn("name", F.lit("gone"))))
    index.write(now.where(changed), gone=spark.range(1).select(F.lit("gone").alias("name")), seg=1)
    return index.rank("Erst tion", save=scratch.table).select("name", F.round("score", 5).alias("score"))


@query(_bm25(["erst", "qzx"], "erst qzx", False))
def bm25_relaxed(spark, d):
    found, relaxed = search.search(notes(spark, d), "erst qzx")
    assert relaxed
    return found.select("name", F.round("score", 5).alias("score"))


@query(f"SELECT name, round(1 + 0.35 * least(sqrt(sessions), 3.6) / 3.6, 6) AS prior FROM {_NOTES}")
def usage_prior(spark, d):
    return notes(spark, d).select("name", F.round(search.prior(F.col("sessions")), 6).alias("prior"))


_BASKET = "(WITH x AS (SELECT DISTINCT o_custkey AS session, o_orderkey AS turn, l_partkey AS name FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT * FROM x WHERE turn IN (SELECT turn FROM x GROUP BY session, turn HAVING count(*) BETWEEN 2 AND 40))"


def _mentions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("turn"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("turn"), (F.col("l_partkey") % 97).alias("name"), F.when(F.col("l_returnflag") == "R", "write").otherwise("read").alias("role"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("stamp"), (F.col("l_suppkey") % 5).alias("project"))
    return o.join(li, "turn")


_M97 = _BASKET.replace("l_partkey AS name", "l_partkey % 97 AS name")
_PAIRS = f"""(WITH b AS {_M97}, p AS (SELECT x.name AS a, y.name AS b, count(DISTINCT x.session) AS sessions, count(*) AS turns FROM b x JOIN b y ON x.session = y.session AND x.turn = y.turn AND x.name < y.name GROUP BY ALL HAVING count(DISTINCT x.session) >= 3),
 s AS (SELECT name, count(DISTINCT session) AS s FROM b GROUP BY name), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM customer)
 SELECT p.a, p.b, p.sessions, p.turns, round(ln(p.sessions / n / ((u.s / n) * (v.s / n))) / nullif(-ln(p.sessions / n), 0), 6) AS npmi FROM p JOIN s u ON u.name = p.a JOIN s v ON v.name = p.b, n)"""
_PAIRS = _PAIRS.replace("GROUP BY ALL", "GROUP BY x.name, y.name")


def _parts(spark, d):
    """Partitions for the mentions: a line item makes one at most, and its table's footer has their number."""
    return couse.parts_for(table(spark, d, "lineitem").count())


def _pairs(spark, d):
    n = table(spark, d, "customer").agg(F.count("*").cast("double")).scalar()
    basket = _save(spark)(couse.baskets(_mentions(spark, d), parts=_parts(spark, d)))
    return couse.pairs(basket, n).withColumn("npmi", F.round("npmi", 6))


@query(f"SELECT * FROM {_PAIRS}")
def couse_pairs_npmi(spark, d):
    return _pairs(spark, d)


@query(f"""WITH m AS (SELECT o_custkey AS session, o_orderkey AS turn, l_partkey % 97 AS name, l_returnflag AS flag, strftime(l_shipdate, '%Y-%m-%d') AS stamp, l_suppkey % 5 AS project FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
 u AS (SELECT name, count(*) AS turns, count(*) FILTER (flag <> 'R') AS reads, count(*) FILTER (flag = 'R') AS edits, max(stamp) AS last, count(DISTINCT project) AS projects FROM m GROUP BY name), s AS (SELECT name, count(DISTINCT session) AS sessions FROM {_M97} GROUP BY name)
 SELECT u.*, coalesce(s.sessions, 0) AS sessions FROM u LEFT JOIN s ON u.name = s.name""")
def couse_usage(spark, d):
    m, parts = _mentions(spark, d), _parts(spark, d)
    return couse.usage(m, couse.baskets(m, parts=parts), parts)


@query("SELECT l_partkey % 97 AS name, l_suppkey % 5 AS project, count(*) AS turns FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def couse_usage_by_project(spark, d):
    return couse.usage_by_project(_mentions(spark, d))


@query(f"SELECT * FROM {_PAIRS} WHERE (a + b) % 10 > 0")
def couse_unlinked(spark, d):
    p = _pairs(spark, d)
    written = p.where("(a + b) % 10 = 0").select(F.col("b").alias("src"), F.col("a").alias("dst"))
    return couse.unlinked(p, written)


@query(f"""WITH p AS {_PAIRS}, r AS (SELECT CASE WHEN a = 7 THEN b ELSE a END AS name, npmi FROM p WHERE a = 7 OR b = 7) SELECT name, npmi, (name + 7) % 10 = 0 AS linked FROM r""")
def companions(spark, d):
    p = _pairs(spark, d)
    written = p.where("(a + b) % 10 = 0").select(F.col("b").alias("src"), F.col("a").alias("dst"))
    return couse.companions(p, written, 7)


@query(f"""WITH p AS {_PAIRS}, o AS (SELECT *, row_number() OVER (ORDER BY npmi DESC NULLS LAST, sessions DESC, a, b) AS rn FROM p)
 SELECT 'unlinked-co-use' AS rule, CAST(a AS VARCHAR) AS memory, CAST(b AS VARCHAR) AS detail FROM o WHERE rn <= 20 UNION ALL SELECT 'unlinked-co-use', '', CAST(count(*) - 20 AS VARCHAR) || ' more' FROM p HAVING count(*) > 20""")
def lint_unlinked(spark, d):
    p = _pairs(spark, d)
    return lint.top_unlinked(p)


@query("""WITH RECURSIVE n AS (SELECT conv_id AS session, conv_id || '-' || turn AS uuid, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent, CASE WHEN role = 'user' THEN 'p' || turn END AS prompt FROM conversations),
 w AS (SELECT session, uuid, parent, prompt FROM n UNION ALL SELECT w.session, w.uuid, n.parent, n.prompt FROM w JOIN n ON w.parent = n.uuid WHERE w.prompt IS NULL)
 SELECT n.session AS session, n.uuid AS uuid, coalesce((SELECT max(prompt) FROM w WHERE w.uuid = n.uuid AND w.prompt IS NOT NULL), n.uuid) AS turn FROM n""")
def turn_inheritance(spark, d):
    c = table(spark, d, "conversations")
    uuid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    parent = F.when(F.col("turn") > 0, F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")))
    n = c.select(F.col("conv_id").alias("session"), uuid.alias("uuid"), parent.alias("parent"), F.when(F.col("role") == "user", F.concat(F.lit("p"), "turn")).alias("prompt"), F.col("turn").alias("line_no"))
    return turns.inherit(n, _save(spark))


@query(f"SELECT src, dst, relation, CAST(pos AS INT) AS pos FROM {EDGES}")
def link_edges(spark, d):
    nodes, links = page_links(spark, d)
    return graph.build_edges(links, nodes)


def _graph(spark, d):
    nodes, links = page_links(spark, d)
    return nodes, links, graph.build_edges(links, nodes)


@query(f"""WITH e AS {EDGES} SELECT name, (SELECT count(*) FROM e WHERE dst = name) AS in_degree, (SELECT count(*) FROM e WHERE src = name) AS out_degree FROM {NODES}""")
def link_degrees(spark, d):
    nodes, _, edges = _graph(spark, d)
    return graph.degrees(nodes, edges)


@query(f"SELECT DISTINCT src AS name FROM {EDGES} WHERE dst = 'p2' AND src <> 'p2'")
def backlinks(spark, d):
    return graph.backlinks(_graph(spark, d)[2], "p2")


@query(f"SELECT src, dst, CAST(min(pos) AS INT) AS pos, dst IN (SELECT name FROM {NODES}) AS exists FROM {LINKS} WHERE src <> dst GROUP BY src, dst")
def dangling_links(spark, d):
    nodes, links, _ = _graph(spark, d)
    return graph.outlinks(links, nodes)


@query(f"""WITH e AS {EDGES}, o AS (SELECT dst AS name, 'out' AS dir, relation, pos FROM e WHERE src = 'p10' UNION ALL SELECT src, 'in', relation, pos FROM e WHERE dst = 'p10')
 SELECT name, CASE WHEN count(DISTINCT dir) > 1 THEN 'both' ELSE min(dir) END AS dir, arg_max(relation, pos) FILTER (relation IS NOT NULL) AS relation FROM o GROUP BY name""")
def neighbours(spark, d):
    return graph.neighbours(_graph(spark, d)[2], "p10")


@query(f"""WITH RECURSIVE e AS {EDGES}, r AS (SELECT 'p' || page_id AS name FROM pages WHERE page_id % 40 = 1 AND page_id % 80 <> 1 UNION SELECT e.dst FROM r JOIN e ON e.src = r.name) SELECT name FROM r""")
def reachable_without(spark, d):
    nodes, _, edges = _graph(spark, d)
    p = table(spark, d, "pages")
    seeds = lambda c: p.where(c).select(F.concat(F.lit("p"), "page_id").alias("name"))
    return graph.reachable_without(edges, seeds("page_id % 40 = 1"), seeds("page_id % 80 = 1"), _save(spark)).select("name")


@query(f"""WITH e AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), h1 AS (SELECT dst AS name FROM e WHERE src = 'p10'), h2 AS (SELECT e.dst AS name FROM h1 JOIN e ON e.src = h1.name)
 SELECT name, CAST(min(depth) AS INT) AS depth FROM (SELECT 'p10' AS name, 0 AS depth UNION ALL SELECT name, 1 FROM h1 UNION ALL SELECT name, 2 FROM h2) GROUP BY name""")
def khop(spark, d):
    return graph.khop(_graph(spark, d)[2], "p10", 2, _save(spark))


@query(f"""WITH RECURSIVE e AS {EDGES}, r AS (SELECT 'p1' AS name UNION SELECT e.dst FROM r JOIN e ON e.src = r.name) SELECT dst AS name, src AS home FROM e WHERE src IN (SELECT name FROM r)""")
def homes(spark, d):
    edges = _graph(spark, d)[2]
    return graph.homes(edges, graph.reach(edges, spark.createDataFrame([("p1",)], "name string"), _save(spark)))


@query()
def communities(spark, d):
    return graph.louvain(_graph(spark, d)[2])


_CLUSTER = "(SELECT 'p' || page_id AS name, page_id % 6 AS cluster FROM pages)"


def _cluster(spark, d):
    return table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("name"), (F.col("page_id") % 6).alias("cluster"))


@query(f"""WITH e AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}) SELECT src AS name, count(DISTINCT cluster) AS spans FROM e JOIN {_CLUSTER} c ON e.dst = c.name GROUP BY src HAVING count(DISTINCT cluster) > 1""")
def bridges(spark, d):
    return graph.bridges(_graph(spark, d)[2], _cluster(spark, d))


_DEGREE = f"(SELECT name, (SELECT count(*) FROM {EDGES} WHERE dst = name OR src = name) AS degree FROM {NODES})"


def _degree(spark, d):
    nodes, _, edges = _graph(spark, d)
    return graph.degrees(nodes, edges).select("name", (F.col("in_degree") + F.col("out_degree")).alias("degree"))


@query(f"WITH g AS {_DEGREE} SELECT cluster, name AS core FROM (SELECT c.cluster, g.name, row_number() OVER (PARTITION BY c.cluster ORDER BY degree DESC, g.name) AS rn FROM g JOIN {_CLUSTER} c ON g.name = c.name) WHERE rn = 1")
def cluster_core(spark, d):
    return graph.cluster_core(_cluster(spark, d), _degree(spark, d))


@query("WITH l AS (SELECT 0 AS level, count(DISTINCT page_id % 6) AS n FROM pages UNION ALL SELECT 1, count(DISTINCT page_id % 23) FROM pages UNION ALL SELECT 2, count(DISTINCT page_id % 17) FROM pages) SELECT CAST(level AS INT) AS level FROM l ORDER BY abs(n - 20), level LIMIT 1")
def default_grain(spark, d):
    p = table(spark, d, "pages")
    levels = [p.select(F.lit(i).alias("level"), (F.col("page_id") % m).alias("cluster")) for i, m in enumerate((6, 23, 17))]
    return graph.default_grain(levels[0].unionByName(levels[1]).unionByName(levels[2]))


@query(f"WITH g AS {_DEGREE}, r AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM g) SELECT max(degree) FILTER (i = n // 2) AS median, max(degree) AS most FROM r")
def degree_stats(spark, d):
    return graph.degree_stats(_degree(spark, d))


@query(f"""WITH u AS (SELECT agent AS name, count(*) AS sessions, count(*) FILTER (kind = 'view') AS reads, count(*) FILTER (kind = 'purchase') AS edits, count(DISTINCT project) AS projects, max(day) AS last_day, count(DISTINCT k) AS degree FROM {WORK} GROUP BY agent),
 m AS (SELECT name, least(1, sqrt(sessions) / 3.6) AS use, least(1, sqrt(reads) / 5.5) AS reads, least(1, log10(1 + edits) / 2.1) AS edits, CASE WHEN projects <= 1 THEN 0 ELSE least(1, (sqrt(projects) - 1) / 3.0) END AS reach, greatest(0.05, 1 - least(1, (19753 - last_day) / 30.0)) AS freshness, least(1, sqrt(degree) / 5.5) AS links FROM u)
 SELECT name, round(use, 6) AS use, round(reads, 6) AS reads, round(edits, 6) AS edits, round(reach, 6) AS reach, round(freshness, 6) AS freshness, round(links, 6) AS links, round(least(1, 0.3 * use + 0.25 * reads + 0.2 * reach + 0.15 * links + 0.1 * freshness), 6) AS standing FROM m""")
def node_metrics(spark, d):
    u = work(spark, d).groupBy(F.col("agent").alias("name")).agg(
        F.count("*").alias("sessions"), F.count_if(F.col("kind") == "view").alias("reads"), F.count_if(F.col("kind") == "purchase").alias("edits"),
        F.count_distinct("project").alias("projects"), F.max("day").alias("last_day"), F.count_distinct("k").alias("degree"))
    m = graph.metrics(u, F.lit(19753))
    return m.select("name", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


def _raw_notes(spark, d):
    """Documents dressed as notes with frontmatter, links and sections, some of them broken."""
    i = F.col("doc_id")
    name = F.concat(F.when(i % 31 == 0, "Note_").otherwise("note_"), i)
    kind = F.element_at(F.array(*map(F.lit, ["user", "feedback", "project", "reference", "other"])), (i % 5 + 1).cast("int"))
    body = F.concat(
        F.lit("[[note_"), i + 1, F.lit("]] [["), F.when(i % 7 == 0, "governs:").when(i % 11 == 0, "because:").when(i % 13 == 0, "becuase:").otherwise(""), F.lit("note_"), F.floor(i / 2),
        F.when(i % 17 == 0, ".md").otherwise(""), F.lit("]] `[[code]]` "), F.when(i % 3 == 0, "**Why:** so. ").otherwise(""), F.when(i % 2 == 0, "**how to apply**").otherwise(""))
    raw = F.concat(F.lit("---\n"), F.when(i % 19 > 0, F.concat(F.lit("name: "), F.when(i % 23 == 0, "elsewhere").otherwise(name), F.lit("\n"))).otherwise(""), F.lit("metadata:\n  type: "), kind, F.lit("\n"), F.when(i % 29 > 0, "  modified: 2024-01-01\n").otherwise(""), F.lit("---\n"), body)
    n = table(spark, d, "documents").select("doc_id", name.alias("name"), raw.alias("raw"), F.when(i % 37 == 0, " ").otherwise(F.col("lang")).alias("description"), F.concat(F.lit("s"), i % 4).alias("origin_session"))
    return n.withColumn("mtype", T.frontmatter_value(F.col("raw"), "type")).withColumn("body", T.body(F.col("raw")))


_N = "(SELECT doc_id AS i, CASE WHEN doc_id % 31 = 0 THEN 'Note_' ELSE 'note_' END || doc_id AS name, ['user','feedback','project','reference','other'][CAST(doc_id % 5 + 1 AS INT)] AS kind, 's' || (doc_id % 4) AS origin FROM documents)"
_RULES = f"""(SELECT 'uppercase-filename' AS rule, name AS memory FROM {_N} WHERE i % 31 = 0 UNION ALL SELECT 'missing-description', name FROM {_N} WHERE i % 37 = 0 UNION ALL SELECT 'missing-modified', name FROM {_N} WHERE i % 29 = 0
 UNION ALL SELECT 'missing-name', name FROM {_N} WHERE i % 19 = 0 UNION ALL SELECT 'unknown-type', name FROM {_N} WHERE kind = 'other' UNION ALL SELECT 'name-mismatch', name FROM {_N} WHERE i % 19 > 0 AND i % 23 = 0
 UNION ALL SELECT 'missing-why', name FROM {_N} WHERE kind = 'feedback' AND i % 3 > 0 UNION ALL SELECT 'missing-how', name FROM {_N} WHERE kind = 'feedback' AND i % 2 > 0)"""


@query(f"SELECT rule, memory FROM {_RULES}")
def lint_findings(spark, d):
    return lint.note_rules(_raw_notes(spark, d)).select("rule", "memory")


@query(f"SELECT rule, count(*) AS findings FROM {_RULES} GROUP BY rule")
def lint_tally(spark, d):
    return lint.tally(lint.note_rules(_raw_notes(spark, d)))


_NL = f"""(SELECT name AS src, 0 AS pos, 'note_' || (i + 1) AS dst, CAST(NULL AS VARCHAR) AS relation FROM {_N} UNION ALL
 SELECT name, 1, CASE WHEN i % 7 > 0 AND i % 11 > 0 AND i % 13 = 0 THEN 'becuase:' ELSE '' END || 'note_' || (i // 2) || CASE WHEN i % 17 = 0 THEN '.md' ELSE '' END, CASE WHEN i % 7 = 0 THEN 'governs' WHEN i % 11 = 0 THEN 'because' END FROM {_N})"""


@query(f"SELECT src, dst, relation, CAST(pos AS INT) AS pos FROM {_NL}")
def wikilinks(spark, d):
    return lint.links_of(_raw_notes(spark, d)).select("src", "dst", "relation", "pos")


@query(f"""SELECT rule, count(*) AS findings FROM (SELECT CASE WHEN ends_with(dst, '.md') THEN 'link-extension' WHEN relation IS NULL AND contains(dst, ':') THEN 'unknown-relation' WHEN dst = src THEN 'self-link'
 WHEN dst NOT IN (SELECT name FROM {_N}) THEN 'dangling-link' END AS rule FROM {_NL}) WHERE rule IS NOT NULL GROUP BY rule""")
def link_rules(spark, d):
    n = _raw_notes(spark, d)
    return lint.tally(lint.link_rules(lint.links_of(n), n))


@query(f"""WITH l AS {_NL}, e AS (SELECT src, dst, any_value(relation) FILTER (relation IS NOT NULL) AS relation FROM l WHERE src <> dst AND dst IN (SELECT name FROM {_N}) GROUP BY src, dst),
 s AS (SELECT 'stranded' AS rule, name AS memory FROM {_N} WHERE name NOT IN (SELECT src FROM e) AND name NOT IN (SELECT dst FROM e)),
 g AS (SELECT 'governs-unreciprocated' AS rule, dst AS memory FROM e WHERE relation = 'governs' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src)
  AND NOT EXISTS (SELECT 1 FROM e c JOIN e x ON x.src = c.src WHERE c.relation = 'part-of' AND c.dst = e.dst AND x.dst = e.src)),
 u AS (SELECT 'untyped-links' AS rule, '' AS memory FROM l HAVING count(relation) * 20 < count(*)) SELECT * FROM s UNION ALL SELECT * FROM g UNION ALL SELECT * FROM u""")
def graph_rules(spark, d):
    n = _raw_notes(spark, d)
    links = lint.links_of(n)
    edges = graph.build_edges(links, n)
    return lint.graph_rules(n, edges, links).select("rule", "memory")


@query(f"""WITH RECURSIVE l AS {_NL}, e AS (SELECT DISTINCT src, dst FROM l WHERE src <> dst AND dst IN (SELECT name FROM {_N})), x AS (SELECT CASE WHEN i % 3 = 0 THEN 'no_' ELSE '' END || name AS name FROM {_N} WHERE i % 41 = 5),
 r AS (SELECT name FROM x UNION SELECT e.dst FROM r JOIN e ON e.src = r.name)
 SELECT 'unreachable' AS rule, name AS memory FROM {_N} WHERE name NOT IN (SELECT name FROM r) UNION ALL SELECT 'index-points-nowhere', name FROM x WHERE name NOT IN (SELECT name FROM {_N})""")
def index_findings(spark, d):
    n = _raw_notes(spark, d)
    links = lint.links_of(n)
    edges = graph.build_edges(links, n)
    i = F.regexp_extract("name", r"_(\d+)$", 1).cast("long")
    index = n.where(i % 41 == 5).select(F.concat(F.when(i % 3 == 0, "no_").otherwise(""), "name").alias("name"))
    found = lint.graph_rules(n, edges, links, graph.reach(edges, index, _save(spark)), index)
    return found.where("rule IN ('unreachable', 'index-points-nowhere')").select("rule", "memory")


_ERRORS = f"(SELECT memory FROM {_RULES} WHERE rule IN (SELECT unnest({[r for r, s in lint.SEVERITY.items() if s == 'error']})))"


@query(f"SELECT NOT EXISTS (SELECT 1 FROM {_ERRORS}) AS passed")
def corpus_pass(spark, d):
    return lint.passed(lint.with_severity(lint.note_rules(_raw_notes(spark, d))))


@query(f"SELECT s AS session, NOT EXISTS (SELECT 1 FROM {_ERRORS} e JOIN {_N} n ON n.name = e.memory WHERE n.origin = s) AS passed FROM (SELECT unnest(['s1', 's3', 'nobody']) AS s)")
def session_pass(spark, d):
    n = _raw_notes(spark, d)
    found = lint.with_severity(lint.note_rules(n))
    rows = [lint.passed_for(found, n, s).withColumn("session", F.lit(s)) for s in ("s1", "s3", "nobody")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT DISTINCT 'dead-repo-path' AS rule, 'd' || doc_id AS memory, source AS detail FROM documents WHERE source NOT IN ('src1', 'src2') AND doc_id % 5 > 0")
def dead_repos(spark, d):
    m = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("note"), F.col("source").alias("repo"), (F.col("doc_id") % 5 == 0).alias("archived"))
    return lint.world_rules(m, spark.createDataFrame([("src1",), ("src2",)], "repo string"))
