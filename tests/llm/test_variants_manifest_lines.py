"""Spelling variants, the Merkle manifest and line deduplication against brute force, with the odd cases, and their queries against SQL."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import line_dedup, merkle, queries, spelling
from tidewell.llm.common import Scratch

WHITE = " \t\n\x0b\x0c\r"
lowered = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_merkle_manifest", "op13_line_dedup"])
def test_query_against_sql(name, spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = c.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert collections.Counter(tuple(r[k] for k in cols) for r in got.collect()) == collections.Counter(rel.fetchall())


# --- lines -----------------------------------------------------------------


def line_docs():
    rng = random.Random(5)
    common = [f"This line number {i} is said again and again in many texts" for i in range(12)]
    short = ["short line", "x", "", "   ", "z" * 39]
    rows = []
    for i in range(90):
        lines = [rng.choice(common) if rng.random() < 0.4 else rng.choice(short) if rng.random() < 0.4 else f"a line of its own with the number {rng.random()}" for _ in range(rng.randint(0, 8))]
        lines = [rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "  ", "\r", "\x0b"]) for x in lines]
        rows.append((i, "\n".join(lines), i, "d"))
    rows += [(200, None, None, None), (201, "", 1, "d"), (202, "\n", 1, "d"), (203, "\n\n" + common[0] + "\n", 1, "d"), (None, common[1] + "\n" + common[2], 1, "d"), (None, common[1], 1, "d")]
    rows += [rows[3], rows[3], (204, "\n".join([common[3]] * 50 + ["é" * 40 + "Ä"] * 3), 1, "d"), (205, "\n".join(f"line {k} " + "w" * 60 for k in range(5000)), 1, "d")]
    rows += [(300 + k, "É" * 45 + "a", 1, "d") for k in range(4)] + [(310, "é" * 45 + "A", 1, "d"), (311, "É" * 45 + "A", 1, "d")]
    rows += [(400 + k, "w" * 40 + "\n" + "v" * 39, 1, "d") for k in range(6)]
    return rows


def plain_lines(rows, chars=40, docs=5):
    key = lambda x: lowered(x.strip(WHITE))
    holders = collections.defaultdict(list)
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                holders[k].append(i)
    top = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


LINES = "doc_id long, text string, n long, digest string"


@pytest.mark.parametrize("batches, fan", [(1, 2), (5, 2), (7, 3)])
def test_lines(spark, batches, fan):
    rows = line_docs()
    got = line_dedup.without_common_lines(spark.createDataFrame(rows, LINES).repartition(3), Scratch(spark, "t"), batches=batches, fan=fan).collect()
    assert collections.Counter(tuple(r) for r in got) == plain_lines(rows)


def test_lines_of_nothing(spark):
    got = line_dedup.without_common_lines(spark.createDataFrame([], LINES), Scratch(spark, "t"))
    assert got.collect() == [] and got.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    one = line_dedup.without_common_lines(spark.createDataFrame([(1, None, 1, "d")], LINES), Scratch(spark, "t"))
    assert [tuple(r) for r in one.collect()] == [(1, 1, 0, "")]


def test_runs_go_on_where_they_were(spark):
    """Every hash lies in one run, levels are compacted, and another object goes on with the same folder."""
    path = f"{Scratch(spark, 't').path}/runs"
    want = collections.defaultdict(lambda: [0, -1])
    rng = random.Random(2)
    for b in range(7):
        rows = {rng.randrange(40): (rng.randint(1, 3), rng.randrange(1000)) for _ in range(25)}
        for d, (n, top) in rows.items():
            want[d][0] += n
            want[d][1] = max(want[d][1], top)
        runs = line_dedup.LineRuns(spark, path, fan=2)
        runs.add(spark.createDataFrame([(bytes([d]), n, top) for d, (n, top) in rows.items()], "digest binary, n long, top long"))
        assert [lv for _, lv in sorted(runs.runs, key=lambda r: r[1])] == [k for k in range(4) if (b + 1) >> k & 1]
        held = [r.digest for name, _ in runs.runs for r in spark.table(name).collect()]
        assert len(held) == len(set(held)) == len(want)
        got = {r.digest[0]: [r.n, r.top] for r in runs.common(1).collect()}
        assert got == dict(want)
        assert {r.digest[0] for r in runs.common(9).collect()} == {d for d, (n, _) in want.items() if n >= 9}
        runs.close()
    spark.conf.unset(line_dedup.ORDERED)


def test_runs_are_joined_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, f"{Scratch(spark, 't').path}/runs", fan=9)
    for k in range(2):
        runs.add(spark.range(k * 500, k * 500 + 1000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("digest"), F.lit(1).cast("long").alias("n"), F.col("id").alias("top")))
    a, b = (spark.table(name) for name, _ in runs.runs)
    plan = a.hint("merge").join(b.select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.close()
    spark.conf.unset(line_dedup.ORDERED)


# --- manifest --------------------------------------------------------------


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(hashes, fan):
    """(root, each leaf's steps)."""
    steps = [[] for _ in hashes]
    under = [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        above, over = [], []
        for at in range(0, len(hashes), fan):
            run = hashes[at : at + fan]
            for k in range(len(run)):
                for i in under[at + k]:
                    steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(H("".join(run)))
            over.append([i for k in range(len(run)) for i in under[at + k]])
        hashes, under = above, over
    return hashes[0], steps


def plain_manifest(rows, fan):
    """(doc_id, leaf, subroot, root, steps, folded, verified) of rows (doc_id, text, lang, source, n_chars, seen n_chars)."""
    order = lambda v: (v is not None, v if v is not None else 0)
    groups = collections.defaultdict(list)
    for d, text, lang, source, n, seen in rows:
        groups[lang].append((d, plain_leaf([d, source, lang, n, text]), plain_leaf([d, source, lang, seen, text])))
    for v in groups.values():
        v.sort(key=lambda x: (order(x[0]), x[1], x[2] if x[2] != x[1] else ""))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[1] for x in groups[g]], fan) for g in langs}
    root, tops = plain_tree([trees[g][0] for g in langs], fan)
    out = []
    for g, top in zip(langs, tops, strict=True):
        for (d, leaf, now), steps in zip(groups[g], trees[g][1], strict=True):
            fold = now
            for before, after in steps + top:
                fold = H(before + fold + after)
            out.append((d, leaf, trees[g][0], root, tuple(steps + top), fold, fold == root))
    return out


def manifest_of(spark, rows, fan):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, seen long").withColumn("g", F.lit(1)).withColumn("hash", F.lit("x")).withColumn("n", F.lit(2))
    got = merkle.manifest(docs.repartition(3), Scratch(spark, "t"), found={"n_chars": F.col("seen")}, fan=fan)
    return [(r.doc_id, r.leaf, r.subroot, r.root, tuple(tuple(s) for s in r.proof), r.folded_root, r.verified) for r in got.collect()]


@pytest.mark.parametrize("fan", [2, 3])
def test_manifest(spark, fan):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "é", "", None, "x" * 10_000]), rng.choice(["en", "en", "en", "fr", "é", None, ""]), rng.choice(["s", None]), n := rng.choice([1, None, 20]), n if n is None or i % 3 else n + 1) for i in range(61)]
    rows += [(999, "alone", "zz", "s", 1, 1), (None, "a", "en", None, None, None), (None, "b", "en", None, None, None), rows[5], rows[5]]
    want, got = plain_manifest(rows, fan), manifest_of(spark, rows, fan)
    assert collections.Counter(got) == collections.Counter(want)
    assert any(x[-1] for x in got) and not all(x[-1] for x in got)


@pytest.mark.parametrize("n, langs", [(1, ["a"]), (2, ["a"]), (5, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"])])
def test_small_manifests(spark, n, langs):
    rows = [(i, "t", langs[i % len(langs)], "s", 1, 1) for i in range(n)]
    assert sorted(manifest_of(spark, rows, 2)) == sorted(plain_manifest(rows, 2))


def test_manifest_of_nothing(spark):
    assert manifest_of(spark, [], 2) == []


# --- spelling --------------------------------------------------------------


def plain_counts(rows, drop):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_forms(n):
    near = {w: [] for w in n}
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[:i]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def made_words(rng):
    base = ["".join(rng.choices("abcdeéÿ×", k=rng.randint(7, 13))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "bababab", "ababababa", "aaaaaab", "baaaaaa"]
    n = {}
    for w in base:
        n[w] = rng.choice([2, 3, 30, 400, 5000])
        for _ in range(rng.randint(0, 6)):
            i, c = rng.randrange(len(w) + 1), rng.choice("abcdeéÿz")
            v = rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]])
            if len(v) >= 7:
                n.setdefault(v, rng.choice([2, 3, 20, 300, 5000]))
    return n


@pytest.mark.parametrize("seed", range(4))
def test_forms(spark, seed):
    n = made_words(random.Random(seed))
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_forms(words, Scratch(spark, "t")).collect()}
    assert got == plain_forms(n)


def test_chains_of_forms(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 30, "aaaaabb": 400, "aaaabbb": 5000, "aaabbbb": 60_000, "aabbbbb": 700_000, "abbbbbb": 8_000_000}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r.word: r.root for r in spelling.spelling_forms(words, Scratch(spark, "t")).collect()}
    assert set(got.values()) == {"abbbbbb"}


def test_counts(spark):
    rng = random.Random(1)
    vocab = ["Wordlike", "wordlike", "straße", "ÉLÉPHANT", "éléphant", "a×b÷cdefg", "short", "seventy", "SEVENTY", "naïveté-naïveté", "under_score", "x1y2zzzzzzz"]
    rows = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(40)] + [(None, "wordlike wordlike"), (7, None), (8, ""), (9, "\n"), (3, "seventy " * 2000), (3, "seventy " * 2000)]
    docs = spark.createDataFrame([(i, t, 1, "w", 2) for i, t in rows], "doc_id long, text string, n long, word string, id int")
    for drop in (None, 3, 31):
        assert {r.word: r.n for r in spelling.word_counts(docs, drop_each=drop).collect()} == plain_counts(rows, drop)


def test_forms_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = spelling.spelling_forms(spelling.word_counts(docs), Scratch(spark, "t"))
    assert got.collect() == [] and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
