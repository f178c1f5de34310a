"""Commands to the files that they use: directories and variables by scope, nested shells, remote hosts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import BARE_FILES
from . import embedded, verbs
from .parse import Refused, Simple, both, parse, project, show

DEPTH = 4
_PATHLIKE = re.compile(r"^.+\.[A-Za-z0-9]{1,8}$")
_BARE = set(BARE_FILES)


@dataclass
class Extract:
    """Uses (host, path, write, reached), steps (argv, kind, activity, reached), and what stays undetermined."""

    uses: list[tuple[str | None, str, bool, str]] = field(default_factory=list)
    steps: list[tuple[str, str, str, str]] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    unnamed: int = 0
    computed: int = 0
    refused: str | None = None

    def undetermined(self) -> int:
        return self.unnamed + self.computed + len(self.patterns) + (self.refused is not None)


def looks_like_path(word: str) -> bool:
    return word.startswith("~") or "/" in word or word in _BARE or bool(_PATHLIKE.match(word))


def normalise(path: str) -> str:
    out: list[str] = []
    for p in path.split("/"):
        if p == "..":
            out[-1:] = []
        elif p not in ("", "."):
            out.append(p)
    return "/" + "/".join(out)


def resolve(word: str, cwd: str | None, home: str) -> str | None:
    """An absolute path, or none for what names no local file for certain."""
    if not word or word == "-" or re.search(r"[<>]\(", word) or "://" in word or word.startswith("/dev/") or "$" in word or "`" in word or re.match(r"^[A-Za-z0-9_.@-]+:", word):
        return None
    if word == "~" or word.startswith("~/"):
        return normalise(home + word[1:])
    if word.startswith("/"):
        return normalise(word)
    return None if cwd is None or word.startswith("~") else normalise(f"{cwd}/{word}")


def expand(word: str, env: dict[str, str | None]) -> str:
    """``$x`` and ``${x}`` from what is bound; the rest stays as written."""
    def put(m):
        v = env.get(m[1] or m[2])
        return m[0] if v is None else v

    return re.sub(r"\$(?:\{([A-Za-z_]\w*)\}|([A-Za-z_]\w*))", put, word)


class _Reader:
    def __init__(self, cwd: str | None, home: str, refused: list[str], host: str | None, depth: int):
        self.out, self.home, self.refused, self.host, self.depth = Extract(), home, refused, host, depth
        self.dirs: dict[tuple, str | None] = {(): cwd}
        self.vars: dict[tuple, dict[str, str | None]] = {(): {}}

    def near(self, table: dict, scope: tuple):
        while scope not in table:
            scope = scope[:-1]
        return table[scope]

    def env(self, scope: tuple) -> dict[str, str | None]:
        out: dict[str, str | None] = {}
        for k in range(len(scope) + 1):
            out |= self.vars.get(scope[:k], {})
        return out

    def bind(self, scope: tuple, name: str, value: str | None) -> None:
        """A second, different value poisons the name."""
        v = self.vars.setdefault(scope, {})
        v[name] = value if name not in v or v[name] == value else None

    def use(self, word: str, write: bool, reached: str, cwd: str | None) -> None:
        if re.search(r"[*?\[]|\{.*,.*\}", word):
            self.out.patterns.append(word)
            return
        path = resolve(word, cwd, self.home)
        if path is not None:
            self.out.uses.append((self.host, path, write, reached))
        elif "$" in word or "`" in word or cwd is None and word and "://" not in word and not word.startswith("/dev/"):
            self.out.unnamed += 1

    def nested(self, text: str, reached: str, cwd: str | None, host: str | None = None) -> None:
        if self.depth >= DEPTH:
            self.out.unnamed += 1
            return
        self.absorb(extract(text, cwd, self.home, self.refused, host or self.host, self.depth + 1), reached)

    def absorb(self, inner: Extract, reached: str) -> None:
        o = self.out
        o.uses += [(h, p, w, both(reached, r)) for h, p, w, r in inner.uses]
        o.steps += [(a, k, x, both(reached, r)) for a, k, x, r in inner.steps]
        o.patterns += inner.patterns
        o.unnamed += inner.unnamed + (inner.refused is not None)
        o.computed += inner.computed

    def program(self, p: embedded.Program, reached: str, cwd: str | None) -> None:
        for path, write in p.uses:
            self.use(path, write, reached, cwd)
        self.out.computed += p.computed
        self.out.unnamed += p.refused is not None
        for argv in p.commands:
            if argv[:2] == ["sh", "-c"]:
                self.nested(argv[2], reached, cwd)
            else:
                self.command(Simple(argv, reached, ()), cwd)

    def read(self, cmds: list[Simple]) -> Extract:
        for c in cmds:
            env = self.env(c.scope)
            for name, value in c.bound:
                if value.startswith("\0"):
                    env[name] = None
                    pattern = value[1:]
                    if pattern and any(f"${name}" in w or f"${{{name}}}" in w for w in c.argv) and pattern not in self.out.patterns:
                        self.out.patterns.append(pattern)
                else:
                    env[name] = value
            open_names = {n for n, v in c.bound if v.startswith("\0")}
            argv = [expand(w, env) for w in c.argv]
            argv = [w for w in argv if not any(w in (f"${n}", f"${{{n}}}") for n in open_names)]
            cwd = self.near(self.dirs, c.scope)
            while argv and verbs.is_assignment(argv[0]) and len([w for w in argv if not verbs.is_assignment(w)]) == 0:
                name, value = argv[0].split("=", 1)
                self.bind(c.scope, name.rstrip("+"), None if "$" in value or "`" in value else value)
                argv = argv[1:]
            for word, write in c.redirects:
                self.use(expand(word, env), write, c.reached, cwd)
            if argv:
                self.command(Simple(argv, c.reached, c.scope, c.redirects, c.heredocs), cwd)
        return self.out

    def command(self, c: Simple, cwd: str | None) -> None:
        argv = verbs.unwrap(c.argv)
        if not argv:
            return
        name = argv[0].rsplit("/", 1)[-1]
        words, flags = verbs.operands(argv, name)
        kind = "none"
        use = lambda w, write: self.use(w, write, c.reached, cwd)
        if name == "cd":
            kind = "cd"
            to = words[0] if words else "~"
            said_no = to in self.refused or (cwd is not None and "/" not in to and cwd.endswith("/" + to) and to != "..")
            if not said_no:
                self.dirs[c.scope] = None if to == "-" else resolve(to, cwd, self.home)
        elif name in verbs.READ:
            kind = "read"
            for w in words:
                use(w, False)
            for w in flags.get("-o", []) if name == "sort" else []:
                use(w, True)
        elif name in verbs.SEARCH:
            kind = "search"
            given = any(f in flags for f in ("-e", "--regexp", "-f", "--file"))
            for w in words if given else words[1:]:
                use(w, False)
        elif name in verbs.STREAM:
            given = {"sed": ("-e", "--expression", "-f", "--file"), "perl": ("-e", "-E")}.get(name, ("-f", "--file", "--from-file"))
            script = any(f in flags for f in given) or name == "perl" and any(re.fullmatch(r"-[a-zA-Z]*[eE]", f) for f in flags)
            files = words if script and not (name == "perl" and not any(f in flags for f in given)) else words[1:]
            in_place = name in ("sed", "perl") and any(re.match(r"-[a-zA-Z]*i|--in-place", f) for f in flags)
            kind = "in-place" if in_place else "stream"
            for w in flags.get("-f", []) + flags.get("--file", []) + flags.get("--from-file", []):
                use(w, False)
            for w in files:
                use(w, in_place)
        elif name in verbs.REMOVE or name in verbs.WRITE:
            kind = "remove" if name in verbs.REMOVE else "write"
            for w in words[1:] if name in ("chmod", "chown", "chgrp") else words:
                use(w, True)
        elif name in verbs.COPY or name == "mv":
            kind = "move" if name == "mv" else "copy"
            for w in words[:-1]:
                use(w, False)
            if len(words) > 1:
                use(words[-1], True)
        elif name in verbs.CHECK:
            kind = "check"
            fixes = any(f in flags for f in verbs.FIXES) or name in ("black", "isort") and "--check" not in flags
            for w in words:
                if looks_like_path(w):
                    use(w, fixes)
        elif name in verbs.FETCH:
            kind = "fetch"
            for f in verbs.FETCH[name]:
                for w in flags.get(f, []):
                    use(w, True)
        elif name in ("find", "fd"):
            kind = "walk"
            for w in words if name == "find" else words[1:]:
                if looks_like_path(w) or w in (".", ".."):
                    use(w, False)
        elif re.fullmatch(r"python(\d(\.\d+)?)?", name):
            kind = "run"
            if "-c" in argv:
                self.program(embedded.read_python(argv[argv.index("-c") + 1] if argv.index("-c") + 1 < len(argv) else ""), c.reached, cwd)
            elif c.heredocs and (not words or words[0] == "-"):
                self.program(embedded.read_python(c.heredocs[-1]), c.reached, cwd)
            elif words and "-m" not in flags:
                use(words[0], False)
        elif name in ("node", "tsx", "ts-node", "deno", "bun"):
            kind = "run"
            code = next((argv[argv.index(f) + 1] for f in ("-e", "-p", "--eval") if f in argv[:-1]), None)
            if code is not None:
                self.program(embedded.read_javascript(code), c.reached, cwd)
            elif c.heredocs and not words:
                self.program(embedded.read_javascript(c.heredocs[-1]), c.reached, cwd)
            elif words and looks_like_path(words[0]):
                use(words[0], False)
        elif name in verbs.SHELLS:
            kind = "run"
            if "-c" in argv[:-1]:
                self.nested(argv[argv.index("-c") + 1], c.reached, cwd)
            elif c.heredocs and not words:
                self.nested(c.heredocs[-1], c.reached, cwd)
            elif words:
                use(words[0], False)
        elif name in ("source", ".", "sqlite3", "ruby", "lean"):
            kind = "run"
            if words:
                use(words[0], False)
        elif name == "eval":
            self.nested(" ".join(words), c.reached, cwd)
        elif name in ("nix", "nix-shell"):
            kind = "run"
            for f in ("-c", "--command", "--run"):
                if f in argv[:-1]:
                    rest = argv[argv.index(f) + 1 :]
                    self.nested(rest[0] if f == "--run" else " ".join(rest), c.reached, cwd)
                    break
        elif name in verbs.CONVERT:
            kind = "convert"
            into, outof = verbs.CONVERT[name]
            for i, w in enumerate(argv[:-1]):
                if w in into:
                    use(argv[i + 1], False)
                elif w in outof:
                    use(argv[i + 1], True)
            if name == "ffmpeg" and len(argv) > 1 and not argv[-1].startswith("-"):
                use(argv[-1], True)
        elif name == "git":
            kind = "git"
            rest, at = argv[1:], cwd
            while rest and rest[0].startswith("-"):
                if rest[0] == "-C" and len(rest) > 1:
                    at = resolve(rest[1], cwd, self.home)
                    rest = rest[1:]
                rest = rest[1:]
            sub, after = (rest[0] if rest else ""), rest[1:]
            paths = after[after.index("--") + 1 :] if "--" in after else [w for w in after if not w.startswith("-")] if sub in ("mv", "rm", "restore") else []
            alters = sub in ("mv", "rm", "restore") or sub == "checkout" and "--" in after
            kind = "git-alter" if alters else "git"
            if sub not in ("add", "stage"):
                for w in paths:
                    self.use(w, alters, c.reached, at)
        elif name in ("ssh", "kubectl", "docker"):
            kind = "remote"
            host, text = None, None
            if name == "ssh" and words:
                target = words[0].rsplit("@", 1)[-1]
                host = target if re.fullmatch(r"\d+(\.\d+){3}", target) else target.split(".", 1)[0]
                tail = argv[argv.index(words[0]) + 1 :]
                text = " ".join(tail) if tail else (c.heredocs[-1] if c.heredocs else None)
            elif words and words[0] == "exec":
                rest = argv[argv.index("exec") + 1 :]
                rest = [w for w in rest if w not in ("-it", "-i", "-t", "-ti")]
                host = rest[0] if rest else None
                text = " ".join(f"'{w}'" if " " in w else w for w in (rest[rest.index("--") + 1 :] if "--" in rest else rest[1:]))
            if text:
                self.nested(text, c.reached, None, host or "?")
        self.out.steps.append((" ".join(c.argv), kind, verbs.activity(c.argv, any(w for _, w in c.redirects), kind), c.reached))


def extract(text: str, cwd: str | None, home: str, refused: list[str] | None = None, host: str | None = None, depth: int = 0) -> Extract:
    return _extracted(text, cwd, home, refused, host, depth)[0]


def _extracted(text: str, cwd: str | None, home: str, refused: list[str] | None, host: str | None = None, depth: int = 0, printed: bool = False) -> tuple[Extract, str | None]:
    """What a text uses and, if it is to be ``printed``, its printed form, by one parse."""
    shown = None
    try:
        tree = parse(text)
        if printed:
            try:
                shown = show(tree)
            except (Refused, RecursionError):
                pass
        cmds = project(tree)
    except (Refused, RecursionError) as e:
        return Extract(refused=str(e) or "too deep"), shown
    return _Reader(cwd, home, refused or [], host, depth).read(cmds), shown


_HEAD = "cmd string, cwd string, refusal string"
#: What can be asked for beside these.
FIELDS = {
    "uses": "array<struct<host:string,path:string,write:boolean,reached:string>>",
    "steps": "array<struct<argv:string,kind:string,activity:string,reached:string>>",
    "undetermined": "long",
    "printed": "string",
}


def read_commands(commands: DataFrame, home: str, want: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """One row for each distinct (cmd, cwd, refused) of ``commands``: cmd, cwd, refusal and the FIELDS that ``want`` names.

    Programs are read in Python, in Arrow batches, and each distinct text once only; join the result
    back on cmd and cwd. Reading takes much longer than its bytes let Spark expect, so the texts are dealt
    over all of ``spark.sql.shuffle.partitions``.
    """
    from ..ship import ship

    spark = commands.sparkSession
    ship(spark)
    cols = [F.col("cmd").cast("string").alias("cmd"), F.col("cwd").cast("string").alias("cwd")]
    cols.append(F.col("refused") if "refused" in commands.columns else F.array().cast("array<string>").alias("refused"))
    use = pa.list_(pa.struct([("host", pa.string()), ("path", pa.string()), ("write", pa.bool_()), ("reached", pa.string())]))
    step = pa.list_(pa.struct([("argv", pa.string()), ("kind", pa.string()), ("activity", pa.string()), ("reached", pa.string())]))
    made = {
        "uses": lambda got: pa.array([[dict(zip(("host", "path", "write", "reached"), u, strict=True)) for u in g.uses] for g, _ in got], use),
        "steps": lambda got: pa.array([[dict(zip(("argv", "kind", "activity", "reached"), s, strict=True)) for s in g.steps] for g, _ in got], step),
        "undetermined": lambda got: pa.array([g.undetermined() for g, _ in got], pa.int64()),
        "printed": lambda got: pa.array([p for _, p in got], pa.string()),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cmds, cwds, no = (b.column(i).to_pylist() for i in range(3))
            got = [_extracted(c or "", w, home, r, printed="printed" in want) for c, w, r in zip(cmds, cwds, no, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g.refused for g, _ in got], pa.string()), *[made[f](got) for f in want]], names=["cmd", "cwd", "refusal", *want])

    dealt = commands.select(*cols).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cmd", "cwd")
    return dealt.mapInArrow(run, ", ".join([_HEAD, *[f"{f} {FIELDS[f]}" for f in want]]))


def file_uses(read: DataFrame) -> DataFrame:
    """A row for each use: cmd, cwd, host, path, write, reached."""
    return read.select("cmd", "cwd", F.explode("uses").alias("u")).select("cmd", "cwd", "u.*")


def steps(read: DataFrame) -> DataFrame:
    return read.select("cmd", "cwd", F.posexplode("steps").alias("pos", "s")).select("cmd", "cwd", "pos", "s.*")


def report(read: DataFrame) -> DataFrame:
    """Commands read and refused, by reason; uses and undetermined subjects."""
    reason = F.coalesce("refusal", F.lit("read"))
    return read.groupBy(reason.alias("reason")).agg(F.count("*").alias("commands"), F.sum(F.size("uses")).alias("uses"), F.sum("undetermined").alias("undetermined"), F.sum(F.octet_length("cmd")).alias("bytes"))


def activity_report(read: DataFrame) -> DataFrame:
    s = steps(read)
    return s.groupBy("activity").agg(F.count("*").alias("commands"))
