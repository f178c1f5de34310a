"""Transcripts, notes, history and registry read from files."""

import json

from pyspark.sql import functions as F

from tidewell.functions import paths as P
from tidewell.functions import text as T
from tidewell.functions import times
from tidewell.operators import commits, graph, lint, outcomes, roster, turns
from tidewell.sources import notes, structure, transcripts


def line(**k):
    return json.dumps(k)


def use(i, name, **inp):
    return {"type": "tool_use", "id": i, "name": name, "input": inp}


def result(i, error=False, content="ok"):
    return {"type": "tool_result", "tool_use_id": i, "is_error": error, "content": content}


def tree(tmp_path):
    p = tmp_path / "projects" / "proj"
    (p / "s1" / "subagents").mkdir(parents=True)
    refusal = transcripts.REFUSAL + " right now"
    rows = [
        line(type="user", uuid="u1", cwd="/code/app", timestamp="2026-07-30T09:59:00Z", sessionId="s1", message={"content": "please"}),
        line(type="assistant", uuid="u2", parentUuid="u1", cwd="", timestamp="2026-07-30T10:00:00Z", sessionId="s1", message={"content": [use("c1", "Bash", command="cat a"), use("c2", "Edit", replace_all=True, file_path="/code/app/x.py", old_string="a", new_string="b")]}),
        line(type="user", uuid="u3", parentUuid="u2", sessionId="s1", timestamp="2026-07-30T10:00:05Z", message={"content": [result("c1"), result("c2", True)]}),
        line(type="assistant", uuid="u4", parentUuid="u9", sessionId="s1", timestamp="bad", message={"content": [use("c3", "Write", file_path="/mem/alpha.md", content="file_path")]}),
        line(type="user", uuid="u5", parentUuid="u4", sessionId="s1", timestamp="2026-07-30T10:01:00Z", message={"content": [result("c3", True, refusal)]}),
        line(type="user", uuid="u6", parentUuid="u5", sessionId="s1", timestamp="2026-07-30T10:02:00Z", message={"content": [result("c1", True, [{"type": "text", "text": "bash: cd: nope: No such file or directory"}])]}),
        '{"type":"assis',
    ]
    (p / "s1.jsonl").write_text("\n".join(rows) + "\n\n")
    (p / "s1" / "subagents" / "x.jsonl").write_text(rows[1] + "\n")
    (p / "note.txt").write_text("no")
    return str(tmp_path / "projects")


def test_transcripts(spark, tmp_path):
    d = transcripts.decode(transcripts.lines(spark, tree(tmp_path))).cache()
    assert d.count() == 8
    assert {(r.session, r.delegated) for r in d.select("session", "delegated").distinct().collect()} == {("s1", False), ("s1", True)}
    calls = transcripts.calls(d)
    main = {r.call_id: r for r in calls.where("NOT delegated").collect()}
    assert main["c1"].command == "cat a" and main["c1"].cwd is None and main["c2"].path == "/code/app/x.py" and main["c2"].role == "write"
    res = transcripts.results(d)
    verdicts = [(r.call_id, r.verdict) for r in res.orderBy("at", "block").collect()]
    assert verdicts == [("c1", "ok"), ("c2", "failed"), ("c3", "rejected"), ("c1", "failed")]
    m = calls.where("NOT delegated").select("call_id", F.col("at").alias("line_no"))
    r = res.select("call_id", "verdict", F.col("at").alias("line_no"))
    assert {x.call_id: x.verdict for x in outcomes.first_outcome(m, r, ["call_id"]).collect()} == {"c1": "ok", "c2": "failed", "c3": "rejected"}
    assert {x.call_id: x.verdict for x in outcomes.last_outcome(m, r, ["call_id"]).collect()} == {"c1": "failed", "c2": "failed", "c3": "rejected"}
    corpus = transcripts.command_corpus(calls.where("NOT delegated"), res).collect()
    assert [(x.cmd, x.ran, x.refused) for x in corpus] == [("cat a", "failed", ["nope"])]
    assert transcripts.prompts(d).count() == 1
    found = {x.rule for x in structure.violations(transcripts.lines(spark, tree_path(tmp_path)).where("NOT delegated").withColumn("line_no", F.col("at"))).collect()}
    assert {"unparseable", "dangling-parent", "missing-field", "malformed-uuid"} <= found
    e = transcripts.ends(d.where("NOT delegated")).first()
    assert e.first_cwd == "/code/app"
    assert transcripts.numbered(transcripts.lines(spark, tree_path(tmp_path))).where("NOT delegated").agg(F.max("line_no")).first()[0] == 7


def tree_path(tmp_path):
    return str(tmp_path / "projects")


def test_registry_and_strays(spark, tmp_path):
    s = tmp_path / "sessions"
    (s / "h1").mkdir(parents=True)
    (s / "a.json").write_text(json.dumps({"sessionId": "s1", "name": "Ada"}))
    (s / "b.json").write_text(json.dumps({"sessionId": "s2", "name": ""}))
    (s / "h1" / "t.json").write_text("{}")
    assert [(r.session_id, r.name) for r in transcripts.registry(spark, str(s)).collect()] == [("s1", "Ada")]
    assert {r.holder: r.strays for r in transcripts.strays(spark, str(s)).collect()} == {"sessions": 2, "h1": 1}


NOTE = "---\nname: {n}\ndescription: about {n}\nmetadata:\n  type: {t}\n  originSessionId: s1\n  modified: 2026-01-01\n---\n{b}"


def test_notes(spark, tmp_path):
    files = {
        "MEMORY.md": "# Index\n## Rules\n- [a](feedback_a.md)\n## Work\n- [b](project_b.md) [no](x/y.md) [gone](gone.md)\n",
        "feedback_a.md": NOTE.format(n="feedback_a", t="feedback", b="[[governs:project_b]] `[[project_b]]`\n```\n[[nothing]]\n```\n**Why:** so. **How to apply** it"),
        "project_b.md": NOTE.format(n="project_b", t="project", b="[[project_c|the other]] [[ghost]] [[becuase:feedback_a]]"),
        "project_c.md": "no frontmatter [[project_c]]",
    }
    for k, v in files.items():
        (tmp_path / k).write_text(v)
    n, index = notes.corpus(spark, str(tmp_path))
    n = n.cache()
    assert {r.name: r.mtype for r in n.collect()} == {"feedback_a": "feedback", "project_b": "project", "project_c": "project"}
    assert [r.name for r in index.orderBy("pos").collect()] == ["feedback_a", "project_b", "gone"]
    assert {r.name: r.section for r in notes.index_sections(spark, str(tmp_path)).collect()} == {"feedback_a": "Rules", "project_b": "Work", "gone": "Work"}
    links = lint.links_of(n)
    assert {(r.src, r.dst, r.relation) for r in links.collect()} == {("feedback_a", "project_b", "governs"), ("project_b", "project_c", None), ("project_b", "ghost", None), ("project_b", "becuase:feedback_a", None), ("project_c", "project_c", None)}
    edges = graph.build_edges(links, n)
    from tidewell.sources.scratch import Scratch

    reached = graph.reach(edges, index.join(n, "name", "left_semi"), Scratch(spark, "t").table)
    assert {r.name for r in reached.collect()} == {"feedback_a", "project_b", "project_c"}
    found = lint.note_rules(n).unionByName(lint.link_rules(links, n)).unionByName(lint.graph_rules(n, edges, links, reached, index))
    got = {(r.rule, r.memory) for r in found.collect()}
    assert {("missing-name", "project_c"), ("unknown-type", "project_c"), ("dangling-link", "project_b"), ("unknown-relation", "project_b"), ("self-link", "project_c"), ("governs-unreciprocated", "project_b"), ("index-points-nowhere", "gone")} <= got
    assert not [r for r, m in got if m == "feedback_a"]
    assert lint.with_severity(found).where("severity IS NULL").count() == 0


def test_history(spark):
    rows = [("r", i, v) for i, v in enumerate(["commit aaaa111 2026-01-01T00:00:00Z", "", "3\t1\tsrc/{old => new}/f.rs", "-\t-\tbin.png", "commit bbbb222 2026-01-02T00:00:00Z", "1\t0\ta.txt => b.txt"])]
    h = notes.history(spark.createDataFrame(rows, "repo string, at int, value string"))
    assert [tuple(r) for r in h.orderBy("sha").collect()] == [("aaaa111", "2026-01-01T00:00:00Z", "r/src/new/f.rs", "r/src/old/f.rs", 3, 1), ("bbbb222", "2026-01-02T00:00:00Z", "r/b.txt", "r/a.txt", 1, 0)]
    steps = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("x", "x", 1), ("p", "q", 1), ("q", "p", 2)], "was string, path string, at int")
    assert {r.path: r.now for r in commits.follow_renames(steps).collect()} == {"a": "c", "b": "c", "p": "q", "q": "p"}


def test_functions_on_literals(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    L = F.lit
    assert one(P.normalise(L("/a/./b/../c//d"))) == "/a/c/d"
    assert one(P.resolve(L("~/x"), L("/c"), "/h")) == "/h/x" and one(P.resolve(L("../x"), L("/c/d"), "/h")) == "/c/x"
    assert all(one(P.resolve(L(w), L("/c"), "/h")) is None for w in ("", "-", "http://x/y", "/dev/null", "a$b", "host:path"))
    assert one(P.project_of(L("/code/app/x"), "/code/")) == "app" and one(P.project_of(L("/code"), "/code")) is None and one(P.project_of(L("/code/f"), "/code")) == "f"
    assert one(P.relative_to(L("/code/f"), "/code")) is None and one(P.relative_to(L("/code/a/f"), "/code")) == "a/f"
    assert not one(P.attributable(L("a/dist/x.js"))) and not one(P.attributable(L("a/x.log"))) and one(P.attributable(L("a/x.py")))
    assert one(P.memory_of(L("/mem/a_b.md"), "/mem")) == "a_b" and one(P.memory_of(L("/mem/MEMORY.md"), "/mem")) is None and one(P.memory_of(L("/mem/*.md"), "/mem")) is None
    assert one(P.short_name(L("box.lan"))) == "box" and one(P.short_name(L(""))) == "unknown host" and one(P.machine(L("u@10.0.0.1"))) == "10.0.0.1"
    assert one(T.tokenize(L("Foo-Bar baz_x é1"))) == ["foobar", "foo", "bar", "baz", "x", "é1"]
    assert one(T.hash_candidates(L("abc1234 1234567 deadbeef! xdeadbeef"))) == ["abc1234", "deadbeef"]
    assert one(T.names_in(L("alpha_one beta2 tiny alpha_one."))) == ["alpha_one", "beta2"] and one(T.names_in(L("at_the_end"))) == []
    assert one(T.one_line(L("a\n b\tc"), 4)) == "a b " and one(T.one_line(L("  a  b  "), 10)) == "a b"
    assert one(T.refused_dirs(L("bash: line 1: cd: x: No such file or directory\nzsh:cd:1: no such file or directory: y"))) == ["x", "y"]
    for body, want in [("#!/bin/sh", "a script with a shebang"), ('{"a": 1}', "JSON"), ("select 1", "SQL"), ("import { x } from 'y'", "TypeScript or JavaScript"), ("import os", "Python"), ("import SwiftUI", "Swift"), ("fn main() {}", "Rust"), ("let x = 1 in x", "Dhall"), ("---\na: b", "YAML"), ("[a]\nb=c", "INI"), ("<p>", "markup"), ("set -e\nx", "shell"), ("theorem x", "Lean"), ("package a", "Kotlin or Java"), ("hello", "prose, or nothing recognised")]:
        assert one(T.sniff(L(body))) == want, body
    assert one(times.day_number(L("2026-07-31T00:00:00Z"))) == 20665 and one(times.day_number(L("nope"))) is None
    assert one(times.day_number(L("2024-02-31"))) == 19784 and one(times.day_number(L("2024-13-01"))) is None and one(times.day_number(L("2024-01-32"))) is None
    assert one(times.minute(L("1970-01-01T24:61"))) == 1501 and one(times.minute(L("1970-02-31T00:00"))) == 61 * 1440 and one(times.minute(L("1970-01-01"))) is None
    assert one(times.minute(L("1970-01-02T00:01:30Z"))) == 1441 and one(times.stamp(L(0))) == "1970-01-01T00:00:00Z"


def test_rounds_of_cycles_pass_no_table_through_the_driver(spark):
    from tidewell.sources.scratch import Scratch

    rows = [("s", "a", "b", 1), ("s", "b", "c", 2), ("s", "c", "a", 3), ("s", "d", "a", 4), ("t", "a", "a", 1), ("t", "b", None, 2), ("u", "x", "y", 1), ("u", "y", "x", 2)]
    scratch, plans = Scratch(spark, "cycles"), []

    def save(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return scratch.table(df)

    found = turns.cycles(spark.createDataFrame(rows, "session string, uuid string, parent string, line_no int"), save)
    assert sorted(map(tuple, found.collect())) == [("s", "a", 3), ("t", "a", 1), ("u", "x", 2)]
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_calls_are_read_once(spark, sf):
    """No filter makes a call's path or note anew for each mention, with what it is made of."""
    from tidewell.plans.registry import QUERIES

    for name, mentions in {"tool_path_use": 1, "work_matches": 1, "work_files_order": 1, "memory_use": 2}.items():
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("get_json_object(") == mentions, name


def test_only_a_whole_text_is_json(spark):
    whole = ['{"a": 1} \n', "[1, 2]\n", "12", '"x"', "null", ' \n{"a": [{"b": "]}"}]}']
    more = ["8294846167456848 Inly onhe.", "{} x", "[1] b", "1, 2", "1] x", "1} x", '1, "a": 2', "1\n2", '{"a": 1}\n{"a": 2}', '"x" y', '1], "v": [2', ", 1", ""]
    rows = spark.createDataFrame([(t,) for t in whole + more], "t string").select("t", T.sniff(F.col("t")).alias("l")).collect()
    assert {r.t for r in rows if r.l == "JSON"} == set(whole)


def test_naming_and_turns(spark):
    rows = [("s1", False, 1, "old", None, "s1", None), ("s1", False, 2, "Ada", None, "s1", None), ("s2", False, 1, "Eve", None, "s9", None), ("s3", False, 1, None, None, None, None), ("s4", True, 1, "never", None, "s4", None)]
    lines = spark.createDataFrame(rows, "owner string, delegated boolean, line_no int, agent_name string, custom_title string, of_session string, stated string")
    reg = spark.createDataFrame([("s2", "Bob")], "session_id string, name string")
    assert {r.owner: r.name for r in roster.agent_names(lines, reg).collect()} == {"s1": "Ada", "s2": "Bob", "s3": "s3"}
    n = spark.createDataFrame([("s", "a", None, "p1", 1), ("s", "b", "a", None, 2), ("s", "c", "b", None, 3), ("s", "x", "y", None, 4), ("s", "y", "x", None, 5)], "session string, uuid string, parent string, prompt string, line_no int")
    assert {r.uuid: r.turn for r in turns.inherit(n).collect()} == {"a": "p1", "b": "p1", "c": "p1", "x": "x", "y": "y"}
    assert [tuple(r) for r in turns.cycles(n).collect()] == [("s", "x", 2)]


def test_turns_far_below_their_prompt(spark):
    deep = [("s", f"m{i}", f"m{i - 1}" if i else None, "p" if i == 0 else None, i) for i in range(150)]
    other = [("s", f"o{i}", f"o{i - 1}", None, i) for i in range(70)] + [("t", "m1", "m0", None, 1), ("s", "x", "y", None, 1), ("s", "y", "x", None, 2)]
    n = spark.createDataFrame(deep + other, "session string, uuid string, parent string, prompt string, line_no int")
    got = {(r.session, r.uuid): r.turn for r in turns.inherit(n).collect()}
    assert got == {("s", f"m{i}"): "p" for i in range(150)} | {(s, u): u for s, u, *_ in other}


def test_communities_of_known_graphs(spark):
    """Cliques on a ring fall apart into themselves, and each level's modularity is no less than the one before."""
    from itertools import combinations

    from tidewell.operators import graph

    edges = [(f"{c}{i}", f"{c}{j}") for c in "abcdef" for i, j in combinations(range(5), 2)] + [(f"{x}0", f"{y}1") for x, y in zip("abcdef", "bcdefa", strict=True)]
    rows = graph.louvain(spark.createDataFrame(edges, "src string, dst string")).collect()
    level = lambda n: {r.name: r.cluster for r in rows if r.level == n}
    first = level(0)
    assert len(set(first.values())) == 6 and all(len({first[f"{c}{i}"] for i in range(5)}) == 1 for c in "abcdef")

    def modularity(of):
        m, deg = len(edges), {}
        for a, b in edges:
            deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
        inside = sum(of[a] == of[b] for a, b in edges) / m
        return inside - sum((sum(d for n, d in deg.items() if of[n] == c) / (2 * m)) ** 2 for c in set(of.values()))

    values = [modularity(level(n)) for n in range(max(r.level for r in rows) + 1)]
    assert values == sorted(values) and values[0] > 0.6


def test_cycles_of_messages(spark):
    rows = [("s", "a", "b", 1), ("s", "b", "c", 2), ("s", "c", "a", 3), ("s", "d", "a", 4), ("s", "e", "e", 5), ("s", "f", None, 6), ("s", "g", "f", 7), ("t", "a", "b", 1), ("t", "b", "a", 2)]
    n = spark.createDataFrame(rows, "session string, uuid string, parent string, line_no int")
    assert {tuple(r) for r in turns.cycles(n).collect()} == {("s", "a", 3), ("s", "e", 1), ("t", "a", 2)}
    assert turns.cycles(n.where("uuid IN ('f', 'g')")).count() == 0


def test_a_hit_keeps_its_place_when_letters_grow(spark):
    """Lowering one letter makes it two, and the form of another hangs on what follows: places are those of the text."""
    one, L = lambda c: spark.range(1).select(c.alias("x")).first()["x"], F.lit
    find = lambda text, term: one(T.folded_at(L(text), L(term)))
    assert find("İİ needle", "needle") == 4 and find("xİyİneedle", "needle") == 5 and find("needle İ", "needle") == 1 and find("İ", "needle") == 0
    assert find("ΟΔΟΣ end", "οδοσ") == 1 and find("ΟΔΟΣ END", "end") == 6 and find("STRASSE Straße", "straße") == 9
    assert find("İ\ue000İ needle", "needle") == 5 and find("Idle", "idle") == 1
    cut = lambda text, term: one(T.snippet(L(text), L(term), around=3))
    assert cut("İİİİİİİİ abc needle def", "needle") == "…bc needle de…" and cut("İneedle", "needle") == "İneedle"


def test_slim(spark):
    kept = line(type="user", message={"content": "about a task_reminder"})
    full = line(type="attachment", attachment={"type": "task_reminder", "content": [{"id": "é"}, 2]})
    none = line(type="attachment", attachment={"type": "task_reminder", "content": []})
    rows = [(r,) for r in (kept, full, none, "{}", "torn task_reminder {", "plain")]
    r = transcripts.slim(spark.createDataFrame(rows, "raw string")).first()
    size = lambda x: len(x.encode()) + 1
    left = json.dumps({"type": "attachment", "attachment": {"type": "task_reminder", "content": []}}, separators=(",", ":"))
    assert (r.emptied, r.already_empty, r.untouched) == (1, 3, 2)
    assert r.bytes == sum(size(x) for x, in rows) and r.written == r.bytes - size(full) + size(left)
