"""A shell reader: text to a tree, and the tree to flat commands with reach and scope.

Nodes are tuples: ("cmd", words, redirects, inner), ("pipe", [..], joints), ("list", [(joint, node), ..])
with joint in ";", "&&", "||", ("group"|"sub"|"not"|"bg", node), ("if", [(test, body), ..], other),
("loop", test, body, word), ("for", name, words, body, word), ("case", subject, [(patterns, body), ..]),
("def", name, body). A text that can't be read raises ``Refused`` with a named reason.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MOST_UNROLLED = 256
_OPERATORS = ("&&", "||", ";;", "<<<", "<<-", "<<", ">>", ">&", "<&", "&>", ">|", "<>", ";", "|&", "|", "&", "(", ")", "<", ">", "\n")
_OPERATOR, _DESCRIPTOR = re.compile("|".join(map(re.escape, _OPERATORS))), re.compile(r"[0-9]+(?=[<>])")
_STARTS = tuple({o[0] for o in _OPERATORS})
_OPENERS = {"if", "while", "until", "for", "case", "{", "function", "select"}
_RESERVED = _OPENERS | {"then", "elif", "else", "fi", "do", "done", "esac", "in", "}", "!"}


class Refused(ValueError):
    """Why a text can't be read."""


@dataclass
class Word:
    """A word: its text with quotes removed, and whether expansions, globs or quotes are in it."""

    text: str
    raw: str
    computed: bool = False
    glob: bool = False
    quoted: bool = False
    inner: list[str] = field(default_factory=list)
    """Scripts of the command and process substitutions in it."""


@dataclass
class Redirect:
    target: Word
    write: bool
    heredoc: str | None = None
    op: str = ""
    """How it is written: the operator with its descriptor."""


@dataclass
class Simple:
    argv: list[str]
    reached: str
    scope: tuple[int, ...]
    redirects: list[tuple[str, bool]] = field(default_factory=list)
    heredocs: list[str] = field(default_factory=list)
    computed: list[bool] = field(default_factory=list)
    bound: tuple[tuple[str, str], ...] = ()


class _Op(str):
    """An operator, which also knows the descriptor written before it."""

    def __new__(cls, text: str, fd: str = ""):
        out = super().__new__(cls, text)
        out.fd = fd
        return out


class _Lexer:
    def __init__(self, text: str):
        self.s, self.i, self.n = text, 0, len(text)
        self.pending: list[tuple[Redirect, str, bool, bool]] = []
        self.tokens: list = []
        self.inner: list[str] = []
        self._run()

    def _run(self) -> None:
        while True:
            while self.i < self.n and (self.s[self.i] in " \t" or self.s.startswith("\\\n", self.i)):
                self.i += 2 if self.s[self.i] == "\\" else 1
            if self.i >= self.n:
                break
            if self.s[self.i] == "#":
                self.i = self.s.find("\n", self.i) if "\n" in self.s[self.i :] else self.n
                continue
            m = _DESCRIPTOR.match(self.s, self.i)
            if m:
                self.i = m.end()
            fd = m[0] if m else ""
            m = _OPERATOR.match(self.s, self.i) if self.s.startswith(_STARTS, self.i) else None
            op = m[0] if m else None
            if op in ("<", ">") and self.s.startswith("(", self.i + 1):
                op = None  # process substitution is a word
            if op:
                self.i += len(op)
                self.tokens.append(_Op(op, fd))
                if op == "\n":
                    self._bodies()
                elif op in ("<<", "<<-"):
                    while self.i < self.n and self.s[self.i] in " \t":
                        self.i += 1
                    w = self._word()
                    r = Redirect(w, False, "", fd + op)
                    self.pending.append((r, w.text, op == "<<-", w.quoted))
                    self.tokens[-1] = r
                continue
            self.tokens.append(self._word())
        if self.pending:
            self._bodies()

    def _bodies(self) -> None:
        for r, mark, tabs, _ in self.pending:
            lines = []
            while True:
                if self.i >= self.n:
                    raise Refused("unterminated heredoc")
                end = self.s.find("\n", self.i)
                end = self.n if end < 0 else end
                line, self.i = self.s[self.i : end], end + 1
                line = line.lstrip("\t") if tabs else line
                if line == mark:
                    break
                lines.append(line)
            r.heredoc = "\n".join(lines) + ("\n" if lines else "")
        self.pending = []

    def _substituted(self) -> None:
        """Past a bracketed script, which is noted."""
        start = self.i
        self._balanced("(", ")")
        self.inner.append(self.s[start : self.i - 1])

    def _balanced(self, open_: str, close: str) -> None:
        depth = 1
        while depth:
            if self.i >= self.n:
                raise Refused(f"unclosed {open_}")
            c = self.s[self.i]
            if c == "\\":
                self.i += 2
                continue
            if c == "'" and open_ != "{":
                end = self.s.find("'", self.i + 1)
                if end < 0:
                    raise Refused("unclosed single quote")
                self.i = end + 1
                continue
            if c == '"':
                self.i += 1
                self._double()
                continue
            depth += (c == open_) - (c == close)
            self.i += 1

    def _double(self) -> tuple[str, bool]:
        out, computed = [], False
        while True:
            if self.i >= self.n:
                raise Refused("unclosed double quote")
            c = self.s[self.i]
            if c == '"':
                self.i += 1
                return "".join(out), computed
            if c == "\\":
                nxt = self.s[self.i + 1 : self.i + 2]
                out.append("" if nxt == "\n" else nxt if nxt in '$`"\\' else "\\" + nxt)
                self.i += 2
            elif c in "$`":
                text, comp = self._expansion()
                out.append(text)
                computed |= comp
            else:
                out.append(c)
                self.i += 1

    def _expansion(self) -> tuple[str, bool]:
        start = self.i
        if self.s[self.i] == "`":
            end = self.i + 1
            while end < self.n and self.s[end] != "`":
                end += 2 if self.s[end] == "\\" else 1
            if end >= self.n:
                raise Refused("unclosed backtick")
            self.i = end + 1
            self.inner.append(re.sub(r"\\([$`\\])", r"\1", self.s[start + 1 : end]))
            return self.s[start : self.i], True
        self.i += 1
        if self.s.startswith("((", self.i):
            self.i += 1
            self._balanced("(", ")")
            return self.s[start : self.i], True
        if self.s.startswith("(", self.i):
            self.i += 1
            self._substituted()
            return self.s[start : self.i], True
        if self.s.startswith("{", self.i):
            self.i += 1
            self._balanced("{", "}")
            return self.s[start : self.i], True
        m = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9@*#?$!-]").match(self.s, self.i)
        if not m:
            return "$", False
        self.i = m.end()
        return self.s[start : self.i], True

    def _word(self) -> Word:
        start, out, w = self.i, [], Word("", "")
        self.inner = w.inner
        while self.i < self.n:
            c = self.s[self.i]
            if c in " \t\n;|&()<>" and not (c in "<>" and self.s.startswith("(", self.i + 1)):
                break
            if c == "\\":
                if self.s.startswith("\n", self.i + 1):
                    self.i += 2
                    continue
                out.append(self.s[self.i + 1 : self.i + 2])
                self.i, w.quoted = self.i + 2, True
            elif c == "'":
                end = self.s.find("'", self.i + 1)
                if end < 0:
                    raise Refused("unclosed single quote")
                out.append(self.s[self.i + 1 : end])
                self.i, w.quoted = end + 1, True
            elif c == '"':
                self.i += 1
                text, comp = self._double()
                out.append(text)
                w.computed, w.quoted = w.computed or comp, True
            elif self.s.startswith("$'", self.i):
                end = self.i + 2
                while end < self.n and self.s[end] != "'":
                    end += 2 if self.s[end] == "\\" else 1
                if end >= self.n:
                    raise Refused("unclosed single quote")
                out.append(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), self.s[self.i + 2 : end]))
                self.i, w.quoted = end + 1, True
            elif c in "$`":
                text, comp = self._expansion()
                out.append(text)
                w.computed |= comp
            elif c in "<>":
                a = self.i
                self.i += 2
                self._substituted()
                out.append(self.s[a : self.i])
                w.computed = True
            else:
                if c in "*?[":
                    w.glob = True
                out.append(c)
                self.i += 1
                if c == "(":
                    break
        if self.i == start:
            raise Refused(f"unexpected {self.s[self.i]!r}" if self.i < self.n else "end of text")
        w.text, w.raw = "".join(out), self.s[start : self.i]
        return w


class _Parser:
    def __init__(self, text: str):
        self.t, self.i = _Lexer(text).tokens, 0

    def peek(self, k: int = 0):
        return self.t[self.i + k] if self.i + k < len(self.t) else None

    def is_word(self, *texts: str) -> bool:
        w = self.peek()
        return isinstance(w, Word) and not w.quoted and not w.computed and w.text in texts

    def take(self, *texts: str) -> None:
        if not self.is_word(*texts):
            raise Refused(f"expected {' or '.join(texts)}")
        self.i += 1

    def skip(self, *ops: str) -> None:
        while isinstance(self.peek(), str) and self.peek() in ops:
            self.i += 1

    def list(self, *ends: str):
        items, joint = [], ";"
        self.skip("\n", ";")
        while self.peek() is not None and self.peek() not in (")", ";;") and not (ends and self.is_word(*ends)):
            items.append((joint, self.pipeline()))
            op = self.peek()
            if op in ("&&", "||"):
                self.i += 1
                self.skip("\n")
                joint = op
                if self.peek() is None:
                    raise Refused("nothing after a joint")
            elif op in (";", "\n", "&"):
                if op == "&":
                    items[-1] = (items[-1][0], ("bg", items[-1][1]))
                    self.i += 1
                self.skip(";", "\n")
                joint = ";"
            elif op is not None and op not in (")", ";;") and not (ends and self.is_word(*ends)):
                raise Refused(f"unexpected {op if isinstance(op, str) else op.text!r}")
        return ("list", items)

    def pipeline(self):
        no = False
        while self.is_word("!"):
            self.i, no = self.i + 1, not no
        parts, joints = [self.command()], []
        while self.peek() in ("|", "|&"):
            joints.append(self.peek())
            self.i += 1
            self.skip("\n")
            parts.append(self.command())
        node = parts[0] if len(parts) == 1 else ("pipe", parts, joints)
        return ("not", node) if no else node

    def command(self):
        if self.peek() == "(":
            self.i += 1
            body = self.list()
            if self.peek() != ")":
                raise Refused("unclosed (")
            self.i += 1
            return self.redirected(("sub", body))
        if self.is_word("{"):
            self.i += 1
            body = self.list("}")
            self.take("}")
            return self.redirected(("group", body))
        if self.is_word("if"):
            self.i += 1
            arms, other = [], None
            while True:
                test = self.list("then")
                self.take("then")
                arms.append((test, self.list("elif", "else", "fi")))
                if self.is_word("elif"):
                    self.i += 1
                    continue
                if self.is_word("else"):
                    self.i += 1
                    other = self.list("fi")
                self.take("fi")
                return self.redirected(("if", arms, other))
        if self.is_word("while", "until"):
            kind = self.peek().text
            self.i += 1
            test = self.list("do")
            self.take("do")
            body = self.list("done")
            self.take("done")
            return self.redirected(("loop", test, body, kind))
        if self.is_word("for", "select"):
            kind = self.peek().text
            self.i += 1
            name, words = self.peek(), None
            if not isinstance(name, Word):
                raise Refused("arithmetic for")
            self.i += 1
            self.skip("\n")
            if self.is_word("in"):
                self.i += 1
                words = []
                while isinstance(self.peek(), Word):
                    words.append(self.peek())
                    self.i += 1
            self.skip(";", "\n")
            self.take("do")
            body = self.list("done")
            self.take("done")
            return self.redirected(("for", name.text, words, body, kind))
        if self.is_word("case"):
            subject = self.peek(1)
            if not isinstance(subject, Word):
                raise Refused("case without a subject")
            self.i += 2
            self.skip("\n")
            self.take("in")
            arms = []
            self.skip("\n")
            while not self.is_word("esac"):
                patterns = []
                while self.peek() is not None and self.peek() != ")":
                    patterns.append(self.peek())
                    self.i += 1
                if self.peek() is None:
                    raise Refused("unclosed case")
                self.i += 1
                arms.append(([w for w in patterns if isinstance(w, Word)], self.list("esac")))
                self.skip(";;", "\n")
            self.take("esac")
            return self.redirected(("case", subject, arms))
        if self.is_word("function"):
            self.i += 1
            name = self.peek().text if isinstance(self.peek(), Word) else ""
            self.i += 1
            if self.peek() == "(" and self.peek(1) == ")":
                self.i += 2
            self.skip("\n")
            return ("def", name, self.command())
        if isinstance(self.peek(), Word) and self.peek(1) == "(" and self.peek(2) == ")":
            name = self.peek().text
            self.i += 3
            self.skip("\n")
            return ("def", name, self.command())
        return self.simple()

    def redirect(self) -> Redirect | None:
        op = self.peek()
        if isinstance(op, Redirect):
            self.i += 1
            return op
        if op in ("<", ">", ">>", ">&", "<&", "&>", ">|", "<>", "<<<"):
            w = self.peek(1)
            if not isinstance(w, Word):
                raise Refused("redirect without a target")
            self.i += 2
            how = op.fd + op
            if op == "<<<":
                return Redirect(w, False, w.text + "\n", how)
            if op in (">&", "<&") and re.fullmatch("[0-9]+|-", w.text):
                return Redirect(Word("", ""), False, None, how + w.raw)
            return Redirect(w, op not in ("<", "<&"), None, how)
        return None

    def redirected(self, node):
        found = []
        while (r := self.redirect()) is not None:
            found.append(r)
        return ("cmd", [], found, node) if found else node

    def simple(self):
        words, found = [], []
        while True:
            if (r := self.redirect()) is not None:
                found.append(r)
                continue
            w = self.peek()
            if not isinstance(w, Word):
                break
            if not words and not w.quoted and w.text in _RESERVED - {"in", "!"}:
                raise Refused(f"stray {w.text}")
            words.append(w)
            self.i += 1
        if not words and not found:
            x = self.peek()
            raise Refused("end of text" if x is None else f"unexpected {x!r}")
        return ("cmd", words, found, None)


def parse(text: str):
    p = _Parser(text)
    tree = p.list()
    if p.peek() is not None:
        raise Refused(f"unexpected {p.peek()!r}")
    return tree


def seq(word: str) -> list[str] | None:
    """Values of ``$(seq a [s] b)``; none beyond 256 or for a step of 0."""
    m = re.fullmatch(r"(?:\$\(|`)seq (-?\d+)(?: (-?\d+))?(?: (-?\d+))?(?:\)|`)", word.strip())
    if not m:
        return None
    v = [int(x) for x in m.groups() if x is not None]
    a, s, b = (1, 1, v[0]) if len(v) == 1 else (v[0], 1, v[1]) if len(v) == 2 else v
    if s == 0:
        return None
    out = list(range(a, b + (1 if s > 0 else -1), s))
    return [str(x) for x in out] if len(out) <= MOST_UNROLLED else None


def both(outer: str, inner: str) -> str:
    """Reach of a command within another."""
    if outer == "always":
        return inner
    if inner == "always":
        return outer
    return "on-success" if outer == inner == "on-success" else "sometimes"


def _size(node) -> int:
    return sum(1 for _ in _walk(node))


def _walk(node):
    kind = node[0]
    if kind == "cmd":
        yield node
        if node[3]:
            yield from _walk(node[3])
        return
    for x in {"list": lambda: [n for _, n in node[1]], "pipe": lambda: node[1], "sub": lambda: [node[1]], "group": lambda: [node[1]], "not": lambda: [node[1]], "bg": lambda: [node[1]], "loop": lambda: [node[1], node[2]], "for": lambda: [node[3]], "case": lambda: [b for _, b in node[2]], "def": lambda: [node[2]], "if": lambda: [y for a in node[1] for y in a] + ([node[2]] if node[2] else [])}[kind]():
        yield from _walk(x)


def project(tree) -> list[Simple]:
    """Flat commands in the order in which they may run."""
    out: list[Simple] = []
    scopes = [0]

    def enter(scope):
        scopes[0] += 1
        return (*scope, scopes[0])

    def inside(words, reach, scope, bound):
        """Substituted scripts run as wholes, each in a scope of its own, before the words are used."""
        for w in words:
            for text in w.inner:
                run(parse(text), reach, enter(scope), bound)

    def run(node, reach, scope, bound):
        kind = node[0]
        if kind == "list":
            sure = reach
            for joint, x in node[1]:
                if joint == ";":
                    sure = reach
                elif joint == "&&":
                    sure = both(sure, "on-success")
                else:
                    sure = "sometimes"
                run(x, sure, scope, bound)
        elif kind == "pipe":
            for x in node[1]:
                run(x, reach, enter(scope), bound)
        elif kind in ("sub", "bg"):
            run(node[1], reach, enter(scope), bound)
        elif kind in ("group", "not"):
            run(node[1], reach, scope, bound)
        elif kind == "if":
            for i, (test, body) in enumerate(node[1]):
                run(test, reach if i == 0 else "sometimes", scope, bound)
                run(body, "sometimes", scope, bound)
            if node[2]:
                run(node[2], "sometimes", scope, bound)
        elif kind == "loop":
            run(node[1], reach, scope, bound)
            run(node[2], "sometimes", scope, bound)
        elif kind == "case":
            inside([node[1]], reach, scope, bound)
            for _, x in node[2]:
                run(x, "sometimes", scope, bound)
        elif kind == "def":
            run(node[2], "sometimes", enter(scope), bound)
        elif kind == "for":
            _, name, words, body, _ = node
            inside([w for w in words or [] if seq(w.raw) is None], reach, scope, bound)
            values = None
            if words is not None:
                values = []
                for w in words:
                    v = seq(w.raw) if w.computed else None if w.glob else [w.text]
                    values = None if v is None or values is None else values + v
            if values is not None and len(values) * max(1, _size(body)) <= MOST_UNROLLED:
                for v in values:
                    run(body, reach, scope, (*bound, (name, v)))
            else:
                literal = words is not None and words and not any(w.computed for w in words)
                pattern = words[0].text if words and len(words) == 1 and words[0].glob else ""
                run(body, reach if literal else "sometimes", scope, (*bound, (name, "\0" + pattern)))
        else:
            _, words, redirects, inner = node
            put = Simple([w.text for w in words], reach, scope, [(r.target.text, r.write) for r in redirects if r.heredoc is None and r.target.raw], [r.heredoc for r in redirects if r.heredoc is not None], [w.computed for w in words], bound)
            inside([*words, *(r.target for r in redirects)], reach, scope, bound)
            if inner:
                run(inner, reach, scope, bound)
            if words or put.redirects:
                out.append(put)

    run(tree, "always", (), ())
    # the status that the caller sees is that of the last unconditional command: what stands
    # before it on success alone may have failed unseen
    last = max((i for i, c in enumerate(out) if c.reached == "always" and not c.scope), default=-1)
    for c in out[:last]:
        if c.reached == "on-success":
            c.reached = "sometimes"
    return out


def show(node) -> str:
    """The tree as normalised text, which reads as the same tree; comments are left out."""
    bodies: list[str] = []

    def end(sep: str) -> str:
        """A separator; here documents that were begun before it follow at once, on lines of their own."""
        out = "\n" + "".join(bodies) if bodies else sep
        bodies.clear()
        return out

    def redirect(r: Redirect) -> str:
        if r.heredoc is not None and not r.op.endswith("<<<"):
            bodies.append(r.heredoc + r.target.text + "\n")
        return f" {r.op}{' ' if r.target.raw else ''}{r.target.raw}"

    def put(node) -> str:
        kind = node[0]
        if kind == "list":
            out = ""
            for i, (j, x) in enumerate(node[1]):
                if i:
                    out += f" {j} " if j != ";" else end(" " if node[1][i - 1][1][0] == "bg" else "; ")
                out += put(x)
            return out
        if kind == "bg":
            return f"{put(node[1])} &"
        if kind == "not":
            return f"! {put(node[1])}"
        if kind == "pipe":
            return "".join((f" {node[2][i - 1]} " if i else "") + put(x) for i, x in enumerate(node[1]))
        stop = lambda x: put(x) + end(" " if x[0] == "list" and x[1] and x[1][-1][1][0] == "bg" else "; ")
        if kind == "sub":
            return f"( {put(node[1])}{end(' ')})"
        if kind == "group":
            return f"{{ {stop(node[1])}}}"
        if kind == "loop":
            return f"{node[3]} {stop(node[1])}do {stop(node[2])}done"
        if kind == "for":
            return f"{node[4]} {node[1]}{'' if node[2] is None else ''.join([' in', *(' ' + w.raw for w in node[2])])}; do {stop(node[3])}done"
        if kind == "if":
            arms = "el".join(f"if {stop(t)}then {stop(b)}" for t, b in node[1])
            return f"{arms}{'else ' + stop(node[2]) if node[2] else ''}fi"
        if kind == "case":
            arms = "".join(f"{' | '.join(w.raw for w in p)}) {put(b)}{end(' ')};; " for p, b in node[2])
            return f"case {node[1].raw} in {arms}esac"
        if kind == "def":
            return f"{node[1]}() {put(node[2])}"
        return (put(node[3]) if node[3] else " ".join(w.raw for w in node[1])) + "".join(map(redirect, node[2]))

    return (put(node) + end("")).strip(" ")
