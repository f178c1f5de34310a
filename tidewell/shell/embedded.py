"""File uses of Python and JavaScript programs given as text; broken programs are tolerated."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_STRING = re.compile(r"""[rbuRBU]{0,2}("{3}.*?"{3}|'{3}.*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')""", re.S)
# Methods and functions by what they do with the path that they are given.
PY_READ = "read_text read_bytes iterdir glob rglob exists is_file is_dir stat".split()
PY_WRITE = "write_text write_bytes touch unlink mkdir rename replace".split()
PY_CALL_READ = ["os.listdir", "os.walk", "os.scandir", "json.load", "csv.reader", "sqlite3.connect", "glob.glob", "runpy.run_path"]
PY_CALL_WRITE = ["os.remove", "os.unlink", "os.makedirs", "os.mkdir", "shutil.rmtree"]
PY_MOVE = ["shutil.copy", "shutil.copy2", "shutil.copyfile", "shutil.move", "os.rename", "os.replace"]
JS_READ = "readFileSync readFile createReadStream openSync".split()
JS_WRITE = "writeFileSync writeFile appendFileSync appendFile createWriteStream rmSync unlinkSync".split()
JS_MOVE = "copyFileSync copyFile renameSync rename".split()


@dataclass
class Program:
    """Uses (path, write), commands that it runs, and how many subjects it computes."""

    uses: list[tuple[str, bool]] = field(default_factory=list)
    commands: list[list[str]] = field(default_factory=list)
    computed: int = 0
    refused: str | None = None


def _literal(text: str, names: dict[str, str]) -> str | None:
    """A literal, a name bound once to one, ``Path(x)``, or those joined by /."""
    text = text.strip()
    m = re.fullmatch(r"(?:pathlib\.)?Path\((.*)\)", text, re.S)
    if m:
        return _literal(m[1], names)
    if _STRING.fullmatch(text):
        body = text.lstrip("rbuRBU")
        return body[3:-3] if body[:3] in ('"""', "'''") else body[1:-1]
    if re.fullmatch(r"[A-Za-z_]\w*", text):
        return names.get(text)
    parts = re.split(r"\s/\s", text)
    if len(parts) > 1:
        got = [_literal(p, names) for p in parts]
        return "/".join(got) if all(g is not None for g in got) else None
    return None


def _arguments(text: str, at: int) -> list[str] | None:
    """Arguments of the call whose bracket opens just before ``at``; none if it never closes."""
    depth, out, start, i = 1, [], at, at
    while i < len(text):
        m = _STRING.match(text, i)
        if m and m.end() > i:
            i = m.end()
            continue
        c = text[i]
        depth += (c in "([{") - (c in ")]}")
        if depth == 0:
            return [*out, text[start:i]] if text[start:i].strip() or out else []
        if c == "," and depth == 1:
            out.append(text[start:i])
            start = i + 1
        i += 1
    return None


def _balanced(text: str, comment: str) -> bool:
    """Whether strings and brackets close."""
    stack, i = [], 0
    pairs = {")": "(", "]": "[", "}": "{"}
    while i < len(text):
        if text.startswith(comment, i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
            continue
        m = _STRING.match(text, i)
        if m and m[1]:
            i = m.end()
            continue
        c = text[i]
        if c in "'\"" or (c == "`" and comment == "//"):
            end = text.find("`", i + 1) if c == "`" else -1
            if end < 0:
                return False
            i = end
        elif c in "([{":
            stack.append(c)
        elif c in pairs and (not stack or stack.pop() != pairs[c]):
            return False
        i += 1
    return not stack


def read_python(source: str) -> Program:
    """A name counts only if bound exactly once, to a literal; an unclosed string or bracket refuses all."""
    out = Program()
    if not _balanced(source, "#"):
        out.refused = "unclosed string or bracket"
        return out
    code = re.sub(r"(?m)^\s*#.*$", "", source)
    bound: dict[str, list[str]] = {}
    for m in re.finditer(r"(?m)^\s*([A-Za-z_]\w*)\s*(?::[^=\n]+)?=(?!=)\s*(.+)$", code):
        bound.setdefault(m[1], []).append(m[2])
    for m in re.finditer(r"\bfor\s+([A-Za-z_]\w*)\s+in|\bas\s+([A-Za-z_]\w*)", code):
        bound.setdefault(m[1] or m[2], []).append("")
    names: dict[str, str] = {}
    for n, vs in bound.items():
        if len(vs) == 1 and (v := _literal(vs[0], {})) is not None:
            names[n] = v

    def put(expr: str, write: bool) -> None:
        got = _literal(expr, names)
        if got is None:
            out.computed += 1
        else:
            out.uses.append((got, write))

    for m in re.finditer(r"(?<![\w.])open\(", code):
        args = _arguments(code, m.end()) or []
        if args:
            mode = next((a.split("=", 1)[-1].strip().strip("'\"") for a in args[1:] if re.match(r"\s*(mode\s*=\s*)?['\"]", a)), "r")
            put(args[0], bool(set(mode) & set("wax+")))
    for m in re.finditer(r"((?:pathlib\.)?Path\([^()]*\)|[A-Za-z_]\w*)\.(\w+)\(", code):
        if m[2] in PY_READ + PY_WRITE and (m[1].startswith(("Path", "pathlib")) or m[1] in names):
            put(m[1], m[2] in PY_WRITE)
    for names_, kinds in ((PY_CALL_READ, [False]), (PY_CALL_WRITE, [True]), (PY_MOVE, [False, True])):
        for n in names_:
            for m in re.finditer(re.escape(n) + r"\(", code):
                for expr, write in zip(_arguments(code, m.end()) or [], kinds):
                    if n not in ("json.load", "csv.reader"):
                        put(expr, write)
    for m in re.finditer(r"(?:subprocess\.(?:run|call|check_call|check_output|Popen)|os\.system)\(", code):
        args = _arguments(code, m.end()) or []
        if args:
            first = args[0].strip()
            if first.startswith("["):
                words = [_literal(a, names) for a in _arguments(first, 1) or []]
                if words and all(w is not None for w in words):
                    out.commands.append(words)
                    continue
            elif (text := _literal(first, names)) is not None:
                out.commands.append(["sh", "-c", text])
                continue
            out.computed += 1
    return out


def read_javascript(source: str) -> Program:
    """File system calls and path-like module specifiers; an unclosed string, template or bracket means it never ran."""
    out = Program()
    code = re.sub(r"/\*.*?\*/", "", source, flags=re.S)
    if "/*" in code or not _balanced(code, "//"):
        out.refused = "unclosed string, template, comment or bracket"
        return out
    bound: dict[str, list[str]] = {}
    for m in re.finditer(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*([^;\n]+)", code):
        bound.setdefault(m[1], []).append(m[2])
    names = {n: v for n, vs in bound.items() if len(vs) == 1 and (v := _literal(vs[0], {})) is not None}

    def put(expr: str, write: bool) -> None:
        expr = expr.strip()
        got = expr[1:-1] if re.fullmatch(r"`[^`$]*`", expr) else _literal(expr, names)
        if got is None:
            out.computed += 1
        else:
            out.uses.append((got, write))

    for m in re.finditer(r"\b(?:fs|fsp|promises|fs\.promises)\.(\w+)\(", code):
        kinds = [False] if m[1] in JS_READ else [True] if m[1] in JS_WRITE else [False, True] if m[1] in JS_MOVE else []
        for expr, write in zip(_arguments(code, m.end()) or [], kinds):
            put(expr, write)
    for m in re.finditer(r"\b(?:require|import)\(\s*|\bfrom\s+|\bimport\s+(?=['\"])", code):
        s = _STRING.match(code, m.end())
        if s and re.match(r"\.{0,2}/", s[1][1:-1]):
            out.uses.append((s[1][1:-1], False))
    for m in re.finditer(r"\b(?:execSync|exec)\(", code):
        args = _arguments(code, m.end()) or []
        if args and (text := _literal(args[0], names)) is not None:
            out.commands.append(["sh", "-c", text])
    return out
