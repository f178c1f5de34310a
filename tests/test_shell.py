"""The shell reader on commands whose uses are known."""

import pytest

from tidewell.shell import embedded, extract, parse, verbs

HOME = "/home/example"
CASES = [
    ("cat a.txt b.txt", [("r", "/code/app/a.txt", "always"), ("r", "/code/app/b.txt", "always")]),
    ("cd src && sed -i s/x/y/ m.py", [("w", "/code/app/src/m.py", "on-success")]),
    ("(cd src; cat m.py); cat m.py", [("r", "/code/app/src/m.py", "always"), ("r", "/code/app/m.py", "always")]),
    ("cp a.txt b.txt", [("r", "/code/app/a.txt", "always"), ("w", "/code/app/b.txt", "always")]),
    ("for f in a.txt b.txt; do wc $f; done", [("r", "/code/app/a.txt", "always"), ("r", "/code/app/b.txt", "always")]),
    ("for f in *.log; do cat $f; done", []),
    ("ssh u@box.lan 'cat /etc/hosts'", [("r", "box:/etc/hosts", "always")]),
    ("cat $(git rev-parse HEAD)", []),
    ("sed -n 1,5p src/x.py | grep foo > out.log", [("r", "/code/app/src/x.py", "always"), ("w", "/code/app/out.log", "always")]),
    ("grep -rn foo src || cat a.txt", [("r", "/code/app/src", "always"), ("r", "/code/app/a.txt", "sometimes")]),
    ("if test -f a; then cat a.txt; else rm b.txt; fi", [("r", "/code/app/a.txt", "sometimes"), ("w", "/code/app/b.txt", "sometimes")]),
    ("X=src/y.py; cat $X ${X}", [("r", "/code/app/src/y.py", "always")] * 2),
    ("cat <<'EOF' > notes.md\nhello $x\nEOF", [("w", "/code/app/notes.md", "always")]),
    ("bash -c 'cd /tmp && cat z.txt'", [("r", "/tmp/z.txt", "on-success")]),
    ("sudo -u me head -n 3 ~/x.txt", [("r", "/home/example/x.txt", "always")]),
    ("for i in $(seq 1 3); do touch f$i.txt; done", [("w", f"/code/app/f{i}.txt", "always") for i in (1, 2, 3)]),
    ("python3 -c \"p='a.json'\nopen(p); open('b.json','w')\"", [("r", "/code/app/a.json", "always"), ("w", "/code/app/b.json", "always")]),
    ("node -e \"const fs=require('fs'); fs.writeFileSync('o.txt', fs.readFileSync('./i.txt'))\"", [("w", "/code/app/o.txt", "always"), ("r", "/code/app/i.txt", "always")]),
    ("git -C sub checkout -- f.rs && git add .", [("w", "/code/app/sub/f.rs", "always")]),
    ("curl -s https://x.y/z -o out/z.bin", [("w", "/code/app/out/z.bin", "always")]),
    ("cat ../lib/./m.c", [("r", "/code/lib/m.c", "always")]),
]


@pytest.mark.parametrize("cmd,want", CASES)
def test_uses(cmd, want):
    got = extract.extract(cmd, "/code/app", HOME)
    assert got.refused is None
    assert sorted(("w" if w else "r", f"{h}:{p}" if h else p, r) for h, p, w, r in got.uses) == sorted(want)


def test_bounded_and_undetermined():
    assert extract.extract("for f in *.log; do cat $f; done", "/c", HOME).patterns == ["*.log"]
    assert extract.extract("cat $(git rev-parse HEAD)", "/c", HOME).undetermined() == 1


def test_refused_directories_do_not_move():
    got = extract.extract("cd nowhere; cat a", "/c", HOME, refused=["nowhere"])
    assert [u[1] for u in got.uses] == ["/c/a"]


@pytest.mark.parametrize("text", ["cat 'a", 'echo "x', "if true; then x", "( a", "cat <<E\nx", "a &&", "echo ${x", "done"])
def test_refusals(text):
    with pytest.raises(parse.Refused):
        parse.parse(text)
    assert extract.extract(text, "/c", HOME).refused


@pytest.mark.parametrize("cmd", [c for c, _ in CASES if "<<" not in c])
def test_printing_is_a_fixpoint(cmd):
    once = parse.show(parse.parse(cmd))
    assert parse.show(parse.parse(once)) == once


def test_discarded_status():
    got = parse.project(parse.parse("a && b; c"))
    assert [c.reached for c in got] == ["always", "sometimes", "always"]
    assert [c.reached for c in parse.project(parse.parse("a && b"))] == ["always", "on-success"]


def test_reach_is_a_lattice():
    r = ["always", "on-success", "sometimes"]
    for a in r:
        assert parse.both("always", a) == a == parse.both(a, "always")
    assert parse.both("on-success", "on-success") == "on-success" and parse.both("on-success", "sometimes") == "sometimes"


def test_seq():
    assert parse.seq("$(seq 3)") == ["1", "2", "3"] and parse.seq("$(seq 5 -2 1)") == ["5", "3", "1"]
    assert parse.seq("$(seq 1 1000)") is None and parse.seq("$(seq 1 0 3)") is None


@pytest.mark.parametrize("argv,kind,want", [("cargo test x", "none", "test"), ("git commit", "git", "version control"), ("sed -i s/a/b/ x", "in-place", "edit"), ("./gradlew testDebug", "none", "test"), ("kubectl apply -f x", "remote", "deploy"), ("sudo systemctl status", "none", "observe"), ("frobnicate", "none", "frobnicate")])
def test_activity(argv, kind, want):
    assert verbs.activity(argv.split(), False, kind) == want
    assert verbs.activity(argv.split(), True, kind) == "edit"


def test_embedded():
    p = embedded.read_python("from pathlib import Path\nroot = Path('d')\nroot = Path('e')\nq = 'x.txt'\nPath(q).write_text('a')\nroot.read_text()\nimport shutil\nshutil.copy('a', 'b')\nopen(f'{q}')")
    assert ("x.txt", True) in p.uses and ("a", False) in p.uses and ("b", True) in p.uses and p.computed == 1
    assert embedded.read_python("open('a'").refused and not embedded.read_python("open('a'").uses
    j = embedded.read_javascript("import x from './m.js';\nimport y from 'react';\nfs.copyFileSync('a', `b`)")
    assert j.uses == [("a", False), ("b", True), ("./m.js", False)]
    assert embedded.read_javascript("fs.readFileSync('a'").refused


def test_on_spark(spark):
    df = spark.createDataFrame([(c, "/code/app") for c, _ in CASES] * 2 + [("cat 'x", None), (None, None)], "cmd string, cwd string")
    read = extract.read_commands(df, HOME).cache()
    assert read.count() == len(CASES) + 2
    assert extract.file_uses(read).where("path = '/code/app/src/m.py'").count() == 2
    assert {r.activity for r in extract.activity_report(read).collect()} >= {"edit", "inspect", "search"}
    assert {r.reason for r in extract.report(read).collect()} >= {"read", "unclosed single quote"}


def test_reading_is_dealt_over_tasks_and_fields(spark):
    """Short texts take long to read: not one task, and only what is asked for."""
    df = spark.createDataFrame([(c, "/code/app") for c, _ in CASES] + [("cat 'x", None), (None, None)], "cmd string, cwd string")
    whole = {(r.cmd, r.cwd): r for r in extract.read_commands(df, HOME).collect()}
    assert any(r.printed for r in whole.values()) and all(r.printed == (None if r.refusal else parse.show(parse.parse(r.cmd or ""))) for r in whole.values())
    for want in (["uses"], ["steps"], ["uses", "undetermined"]):
        read = extract.read_commands(df, HOME, tuple(want))
        assert read.columns == ["cmd", "cwd", "refusal", *want] and read.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert {(r.cmd, r.cwd): [r.refusal, *[r[f] for f in want]] for r in read.collect()} == {k: [r.refusal, *[r[f] for f in want]] for k, r in whole.items()}


LAW = [c for c, _ in CASES] + [
    "! cat a", "cat a & rm b", "cat a & ", "a | b |& c", "cat 2>err.txt <in.txt >>out.txt 2>&1", "until x; do y; done", "case $x in a | b) cat a ;; *) rm b ;; esac", "cat <<E && rm b\nbody $x\nE\ncat c",
    "if cat <<E; then\nbody\nE\nx; else y & fi", "{ a; b & }", "( a; cat <<-E\n\tbody\nE\n)", "f() { cat a; }; f", "x=$(cat b) y=`cat c`", "diff <(sort a) <(sort b)", "select x in a b; do y; done", "cat <<< 'x y' 3<&0", "while read l; do echo $l; done < in.txt &",
    "function g { a; }", "for f; do cat $f; done", "a && b || c; d", "echo $((1 + (2)))",
]


@pytest.mark.parametrize("cmd", LAW)
def test_printed_text_reads_as_the_same(cmd):
    tree = parse.parse(cmd)
    once = parse.show(tree)
    again = parse.parse(once)
    assert parse.show(again) == once
    assert parse.project(again) == parse.project(tree)


def test_printing_keeps_what_decides():
    assert parse.show(parse.parse("! cat a")) == "! cat a" and parse.show(parse.parse("cat a & rm b")) == "cat a & rm b"
    assert parse.show(parse.parse("cat 2>>e <i")) == "cat 2>> e < i" and parse.show(parse.parse("until a; do b; done")).startswith("until ")


def test_scripts_inside_words():
    use = lambda cmd: sorted(extract.extract(cmd, "/code", HOME).uses)
    assert use("diff <(sort a) <(sort b)") == [(None, "/code/a", False, "always"), (None, "/code/b", False, "always")]
    assert use("x=$(cat b)") == use("echo `cat b`") == use("echo \"$(cat b)\"") == use("while read l; do :; done < <(cat b)") == [(None, "/code/b", False, "always")]
    assert use("a && x=$(cd sub; cat b); cat c") == [(None, "/code/c", False, "always"), (None, "/code/sub/b", False, "sometimes")]
    assert use("for f in $(cat list); do :; done") == [(None, "/code/list", False, "always")]
    assert use("tee >(cat > log.txt)") == [(None, "/code/log.txt", True, "always")]


def test_any_text_is_read_or_refused():
    import random

    rng = random.Random(3)
    for end in ("cat <<", "cat <<-", "..<<", "a <<<", "x=$(", "<(", "`", "case", "case x", "for", "function", "! "):
        assert extract.extract(end, "/c", HOME).refused
    parts = ["cat", " ", "<<", "<<-", "E", "\n", "$(", ")", "`", "'", '"', "<(", "&&", "||", "|", ";", "&", "case x in", "esac", "if", "then", "fi", "{", "}", "\\", "$x", "(", "!", "for f in", "do", "done", "#", "2>", "a"]
    for _ in range(30_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        got = extract.extract(text, "/c", HOME)
        if got.refused is None:
            try:
                parse.show(parse.parse(text))
            except parse.Refused:
                pass
