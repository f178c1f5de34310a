"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions.

The base finds emails, IPs, cards and phones by linear scans. The model is trained in numpy from
labelled spans; it reads overlapping windows around digits, @ and + (a span of any kind must hold one
of them, so other windows can't add any), and the spans decoded from all windows of a text are
reconciled at once by the best set of non-overlapping ones. Added spans must pass their kind's check
and touch no base span.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_texts, text_batches

KINDS = ("email", "ip", "card", "phone")
#: The longest span that the model may add; windows overlap by it, and reach so far on either side of
#: an anchor, so every such span lies whole in a window.
LONGEST = 64
WINDOW, STEP, AROUND = 2 * LONGEST, LONGEST, LONGEST
HIDDEN, EMBED = 20, 12
#: Documents whose text carries the training spans, at most; windows trained on.
CARRIERS, WINDOWS = 300, 5600
#: Rounds over the windows, and windows held out to pick the round that counts.
ROUNDS, HELD_OUT = 6, 320
#: Characters of a carrier that go to the driver, at most.
CARRIED = 20_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@+]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base, by start and then kind; each kind leftmost and non-overlapping.

    Written so that no input makes it slow: runs are taken whole and never retried.
    """
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    for m in _DOTTED.finditer(text):
        if "." not in m[0]:
            continue
        part, begin = m[0].split("."), m.start()
        for k in range(0, len(part) - 3, 4):  # a chain of numbers gives one match for each four
            end = begin + sum(map(len, part[k : k + 4])) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in part[k : k + 4]):
                out.append((begin, 1, end))
            begin = end + 1
    for m in _NUMBER.finditer(text):
        if len(m[0]) >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_LONGER = (
    re.compile(r"\w[\w.%+-]*@\w[\w-]*(?:\.\w[\w-]*)+"),
    re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    re.compile(r"[0-9]+(?:[ .-][0-9]+)*"),
    re.compile(r"\+?\(?[0-9](?:[ ().-]*[0-9])*"),
)


# numbers that are written like phones and are none: of books, and large ones in groups of three
_BOOK, _THOUSANDS = re.compile(r"97[89](?:[ -][0-9]+){4}"), re.compile(r"[1-9][0-9]{0,2}(?:([ .])[0-9]{3})(?:\1[0-9]{3})+")


def valid(kind: int, s: str) -> bool:
    """Whether an added span can be of its kind at all: the base's forms, freer in letters and signs."""
    if len(s) > LONGEST or not _LONGER[kind].fullmatch(s):
        return False
    d = _digits(s)
    if kind == 1:
        return all(x.isascii() and len(x) <= 3 and int(x) <= 255 for x in s.split("."))
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1
    if kind == 3:
        most = 15 if s[0] == "+" or d[:2] == "00" else 13
        if _BOOK.fullmatch(s) or _THOUSANDS.fullmatch(s):
            return False
        return 10 <= len(d) <= most and len(d) < len(s) and s.count("(") == s.count(")") and len(set(d)) > 1
    return True


# characters fall into classes: some signs for themselves, digits, hex and other letters by case
_SIGNS = " \n@.+-_%()=\"':/,|#"


def classes(text: str) -> np.ndarray:
    return np.array([_CLASS.get(c, 0) if c < "\x80" else (_LETTER_OTHER if c.isalpha() else 0) for c in text], np.int64)


_CLASS = {c: i + 1 for i, c in enumerate(_SIGNS)}
_CLASS |= {c: len(_SIGNS) + 1 for c in "0123456789"} | {c: len(_SIGNS) + 2 for c in "abcdef"} | {c: len(_SIGNS) + 3 for c in "ghijklmnopqrstuvwxyz"}
_CLASS |= {c: len(_SIGNS) + 4 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_LETTER_OTHER = len(_SIGNS) + 5
_PAD = len(_SIGNS) + 6
_N_CLASS = len(_SIGNS) + 7
_N_LABEL = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


@dataclass
class Tagger:
    """Parameters of the BiLSTM-CRF; windows are rows of character classes."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.normal(size=s) * 0.2).astype(np.float32)
        p = {"E": r(_N_CLASS, EMBED), "O": r(2 * HIDDEN, _N_LABEL), "ob": np.zeros(_N_LABEL, np.float32), "T": r(_N_LABEL, _N_LABEL), "S": r(_N_LABEL)}
        for d in "fb":
            p |= {"W" + d: r(EMBED, 4 * HIDDEN), "U" + d: r(HIDDEN, 4 * HIDDEN), "c" + d: np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}
        return Tagger(p)

    def _lstm(self, e: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States of both directions, (2, n, t, HIDDEN), the second in reversed time; and what the gradients need."""
        n, t, _ = e.shape
        both = np.stack((e, e[:, ::-1]))
        z = np.stack([both[d] @ self.p["W" + k] + self.p["c" + k] for d, k in enumerate("fb")]).transpose(2, 0, 1, 3)
        u = np.stack((self.p["Uf"], self.p["Ub"]))
        # the first three gates are logistic curves, by way of tanh, so that all four are one call
        half = np.repeat(np.array([0.5, 0.5, 0.5, 1], e.dtype), HIDDEN)
        gates, cells, hs = (np.zeros((t, 2, n, w), e.dtype) for w in (4 * HIDDEN, HIDDEN, HIDDEN))
        h, c = np.zeros((2, n, HIDDEN), e.dtype), np.zeros((2, n, HIDDEN), e.dtype)
        for k in range(t):
            g = np.tanh((z[k] + h @ u) * half)
            g[:, :, : 3 * HIDDEN] += 1
            g[:, :, : 3 * HIDDEN] *= 0.5
            c = g[:, :, HIDDEN : 2 * HIDDEN] * c + g[:, :, :HIDDEN] * g[:, :, 3 * HIDDEN :]
            h = g[:, :, 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c)
            gates[k], cells[k], hs[k] = g, c, h
        return hs.transpose(1, 2, 0, 3), (gates, cells, hs, u)

    def _lstm_back(self, dh: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of what goes into the gates, (t, 2, n, 4 * HIDDEN), and of the recurrent weights."""
        gates, cells, hs, u = kept
        i, f, o, a = (gates[..., j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
        s, zero = np.tanh(cells), np.zeros_like(cells[:1])
        c0, h0 = np.concatenate((zero, cells[:-1])), np.concatenate((zero, hs[:-1]))
        to_c, into = o * (1 - s * s), np.concatenate((a * i * (1 - i), c0 * f * (1 - f), s * o * (1 - o), i * (1 - a * a)), axis=-1)
        dz, ut = np.zeros_like(gates), u.transpose(0, 2, 1)
        carry_h, carry_c = np.zeros_like(zero[0]), np.zeros_like(zero[0])
        for k in range(len(gates) - 1, -1, -1):
            dhk = dh[k] + carry_h
            dc = dhk * to_c[k] + carry_c
            dz[k] = np.concatenate((dc, dc, dhk, dc), axis=-1) * into[k]
            carry_h, carry_c = dz[k] @ ut, dc * f[k]
        flat = lambda x: x.transpose(1, 0, 2, 3).reshape(2, -1, x.shape[-1])
        return dz, flat(h0).transpose(0, 2, 1) @ flat(dz)

    def emissions(self, x: np.ndarray) -> tuple:
        e = self.p["E"][x]
        hs, kept = self._lstm(e)
        h = np.concatenate((hs[0], hs[1][:, ::-1]), axis=2)
        return h @ self.p["O"] + self.p["ob"], (e, h, kept)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the labels and its gradients."""
        em, (e, h, kept) = self.emissions(x)
        n, t, k = em.shape
        trans = self.p["T"]
        # forward and backward in probabilities, brought to a sum of 1 at each place; the factors give log z
        top = em.max(2, keepdims=True)
        e_em, e_t = np.exp(em - top), np.exp(trans)
        fwd, bwd, scale = np.zeros_like(em), np.ones_like(em), np.zeros((n, t), em.dtype)
        now = e_em[:, 0] * np.exp(self.p["S"])
        for i in range(t):
            now = now if i == 0 else (fwd[:, i - 1] @ e_t) * e_em[:, i]
            scale[:, i] = now.sum(1)
            fwd[:, i] = now / scale[:, i : i + 1]
        for i in range(t - 2, -1, -1):
            bwd[:, i] = ((e_em[:, i + 1] * bwd[:, i + 1]) @ e_t.T) / scale[:, i + 1 : i + 2]
        z = np.log(scale).sum(1) + top[:, :, 0].sum(1)
        mass = fwd * bwd
        rows, cols = np.arange(n)[:, None], np.arange(t)[None, :]
        gold = em[rows, cols, y].sum(1) + self.p["S"][y[:, 0]] + trans[y[:, :-1], y[:, 1:]].sum(1)
        de = mass.copy()
        de[rows, cols, y] -= 1
        de /= n
        ahead = (e_em[:, 1:] * bwd[:, 1:] / scale[:, 1:, None]).reshape(-1, k)
        pair = (fwd[:, :-1].reshape(-1, k).T @ ahead) * e_t
        np.add.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        first = mass[:, 0].sum(0)
        np.add.at(first, y[:, 0], -1)
        g = {"T": pair / n, "S": first / n, "O": h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, k), "ob": de.sum((0, 1))}
        dh = de @ self.p["O"].T
        dz, du = self._lstm_back(np.stack((dh[:, :, :HIDDEN], dh[:, ::-1, HIDDEN:])).transpose(2, 0, 1, 3), kept)
        dx = np.zeros_like(e)
        for d, key in enumerate("fb"):
            mine = dz[:, d].transpose(1, 0, 2)
            mine = mine if d == 0 else mine[:, ::-1]
            g |= {"U" + key: du[d], "W" + key: e.reshape(-1, EMBED).T @ mine.reshape(-1, 4 * HIDDEN), "c" + key: mine.sum((0, 1))}
            dx += mine @ self.p["W" + key].T
        g["E"] = np.eye(_N_CLASS, dtype=e.dtype)[x.ravel()].T @ dx.reshape(-1, EMBED)
        return float((z - gold).mean()), g

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi labels of windows, and how far each character's label leads by emissions."""
        em, _ = self.emissions(x)
        n, t, k = em.shape
        back = np.zeros((n, t, k), np.int64)
        s = em[:, 0] + self.p["S"]
        for i in range(1, t):
            a = s[:, :, None] + self.p["T"]
            back[:, i] = a.argmax(1)
            s = a.max(1) + em[:, i]
        y = np.zeros((n, t), np.int64)
        y[:, -1] = s.argmax(1)
        for i in range(t - 1, 0, -1):
            y[:, i - 1] = back[np.arange(n), i, y[:, i]]
        lead = np.take_along_axis(em, y[:, :, None], 2)[:, :, 0] - em[:, :, 0]
        return y, lead


def labels_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for a, k, b in spans:
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def _forms(rng: np.random.Generator) -> tuple[list[tuple[int, str]], list[str]]:
    """One made-up span of every form with its kind, and one look-alike of every form that is of none."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    some = lambda a, b: int(rng.integers(a, b))
    pick = lambda *of: of[some(0, len(of))]
    plain = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n, letters=plain: "".join(letters[i] for i in rng.integers(0, len(letters), n))

    def mail(letters: str) -> str:
        word = lambda n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
        local = word(some(2, 9)) + pick(".", "_", "+", "-", "") + word(some(0, 7)) + num(some(0, 3))
        return f"{local.strip('.-_+')}@{word(some(2, 12))}{pick('', '-' + word(4), '.' + word(3))}.{pick('com', 'org', 'net', 'example.com', 'de', 'co.uk', 'fr', 'info')}"

    def card(sep: str) -> str:
        d = num(some(13, 19))
        d = next(d + str(c) for c in range(10) if luhn(d + str(c)))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    a, b, c, e = num(3), num(3), num(4), num(2)
    phones = [
        f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{e} {a} {b} {c}", f"+{e}-{a}-{b}-{c}",
        f"0{e} {c} {num(4)} {e}", f"0{a} {num(4)}{a}", f"0{e[0]} {e} {num(2)} {num(2)} {num(2)}", f"(0{e}) {c} {num(4)}", f"00{e} {a} {num(7)}", f"+{e} (0){e} {c} {num(4)}", f"1-{a}-{b}-{c}",
    ]
    mails = [mail(x) for x in (plain, plain + plain.upper(), *[plain + "äöüéèñçß"] * 3)]
    made = [*[(0, x) for x in mails], (1, ".".join(str(x) for x in rng.integers(0, 256, 4))), *[(2, card(x)) for x in ("", " ", "-", ".", ".")], *[(3, x) for x in phones]]
    few = str(some(1, 10))
    alike = [
        f'token = "{hashlib.sha1(num(9).encode()).hexdigest()}"', f"20{num(2)}-0{num(1)}-1{num(1)}", f"v{num(1)}.{num(1)}.{num(1)}", f"{num(5)} items", f"Version {num(1)}.0", f"{num(2)}:{num(2)}:{num(2)}",
        f"= {num(3)}.{num(2)} +", f"20{num(2)}-0{num(1)}-1{num(1)} 1{num(1)}:{num(2)}", f"{num(3)} {num(3)} {num(3)} {num(3)} {num(3)}", f"{num(2)}, {num(2)}, {num(2)}, {num(3)}", f"{num(10)}", f"{num(16)}",
        f"({num(1)}) {word(5)} ({num(2)})", f"{num(4)}-{num(4)}", f"@{word(6)}", f"{word(4)} @ {word(5)}", f"1{num(3)}/{num(2)}/{num(2)}", f"{num(2)} + {num(3)} = {num(3)}", f"{num(1)}.{num(2)} {num(1)}.{num(2)} {num(1)}.{num(2)} {num(1)}.{num(3)}",
        *[pick("ISBN ", "") + sep.join(x) for sep in "- " for x in ((pick("978", "979"), num(1), *pick((num(2), num(6)), (num(3), num(5)), (num(4), num(4)), (num(5), num(3))), num(1)),)],
        f"{few} {num(3)} {num(3)} {num(3)}", f"{few}{num(1)} {num(3)} {num(3)} {num(3)}", f"{few}{pick('.', ',')}" + pick(".", ",").join((num(3), num(3), num(3))), f"{num(4)} {num(4)}", f"{num(3)} {num(4)} {num(2)}",
    ]
    return made, alike


def _made_span(rng: np.random.Generator) -> tuple[int | None, str]:
    """A made-up span of any form and its kind, or a look-alike that is of none."""
    made, alike = _forms(rng)
    return made[int(rng.integers(len(made)))] if rng.random() < 0.6 else (None, alike[int(rng.integers(len(alike)))])


def _own_window(own: list, rng: np.random.Generator) -> tuple[str, list]:
    """A piece of a carrier around one of its own spans (or anchors), with the labels that lie whole in it."""
    c, spans = own[int(rng.integers(len(own)))]
    hit = spans[int(rng.integers(len(spans)))][0] if spans else _ANCHOR.search(c).start()
    a = max(0, hit - int(rng.integers(0, WINDOW // 2)))
    b = min(len(c), a + WINDOW)
    return c[a:b], [(s - a, k, e - a) for s, k, e in spans if a <= s and e <= b]


def training_windows(carriers: list[str], n: int = WINDOWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and labels: labelled spans of the carriers, and made-up spans set into their text.

    Every form of span and of look-alike has the same share of the windows whatever the carriers are.
    """
    rng = np.random.default_rng(seed)
    carriers = [c for c in carriers if len(c) > WINDOW] or ["lorem ipsum dolor sit amet, consetetur sadipscing elitr " * 4]
    own = [(c, s) for c in carriers if _ANCHOR.search(c) for s in [base_spans(c)]]
    x, y = np.full((n, WINDOW), _PAD, np.int64), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        if own and i % 8 == 0:
            text, spans = _own_window(own, rng)
        else:
            c = carriers[int(rng.integers(len(carriers)))]
            a = int(rng.integers(0, len(c) - WINDOW + 1))
            text, spans = c[a : a + int(rng.integers(0, 70))], []
            made, alike = _forms(rng)
            put = [made[i % len(made)] if i % 5 < 3 else (None, alike[i % len(alike)])]
            put += [_made_span(rng) for _ in range(int(rng.integers(0, 3)))]
            for kind, span in put:
                text += str(rng.choice([" ", " ", "\n", ", ", ": ", " ("]))
                if kind is not None and len(text) + len(span) <= WINDOW:
                    spans.append((len(text), kind, len(text) + len(span)))
                text += span + str(rng.choice(["", "", ".", ",", " " + c[a + 70 : a + 70 + int(rng.integers(1, 30))]]))
            text = (text + " " + c[a:])[:WINDOW]
        x[i, : len(text)] = classes(text)
        y[i] = labels_of(WINDOW, spans)
    return x, y


def train(carriers: list[str], windows: int = WINDOWS, rounds: int = ROUNDS, batch: int = 64, rate: float = 0.02) -> Tagger:
    """Trains by Adam with falling steps; of all rounds the one of the least loss on windows held out counts."""
    x, y = training_windows(carriers, windows)
    held = training_windows(carriers, HELD_OUT, seed=12)
    model, rng = Tagger.fresh(), np.random.default_rng(5)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(a) for k, a in model.p.items()}
    t, steps = 0, rounds * (len(x) // batch)
    best, kept = float("inf"), model.p
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x) - batch + 1, batch):
            t += 1
            _, g = model.step(x[order[at : at + batch]], y[order[at : at + batch]])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            now = rate * (1 - 0.95 * t / steps)
            for k, a in g.items():
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                model.p[k] = (model.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        loss = model.step(*held)[0]
        if loss < best:
            best, kept = loss, dict(model.p)
    return Tagger(kept)


def windows_of(text: str) -> list[tuple[int, int, bool, bool]]:
    """(start, end, begins, ends) of the overlapping windows around anchors; the flags tell the stretch's own ends."""
    out, stretch = [], None
    found = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if stretch and a <= stretch[1]:
            stretch[1] = b
        else:
            stretch = [a, b]
            found.append(stretch)
    for a, b in found:
        at = a
        while True:
            end = min(b, at + WINDOW)
            out.append((at, end, at == a, end == b))
            if end == b:
                break
            at += STEP
    return out


def best_spans(found: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """The set of non-overlapping (start, kind, end) of greatest total score."""
    spans = sorted((b, a, k) for a, k, b in found)
    ends = [s[0] for s in spans]
    best = [0.0]
    take = []
    for i, (b, a, k) in enumerate(spans):
        before = bisect.bisect_right(ends, a, 0, i)
        with_it = best[before] + found[a, k, b]
        take.append((with_it > best[i], before))
        best.append(max(best[i], with_it))
    out, i = [], len(spans)
    while i:
        if take[i - 1][0]:
            b, a, k = spans[i - 1]
            out.append((a, k, b))
            i = take[i - 1][1]
        else:
            i -= 1
    return sorted(out)


def find(texts: list[str | None], model: Tagger | None, batch: int = 256) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) if t and _ANCHOR.search(t) else [] for t in texts]
    scored: list[dict] = [{} for _ in texts]
    work = [(i, *w) for i, t in enumerate(texts) if t and model for w in windows_of(t)]
    for at in range(0, len(work), batch):
        part = work[at : at + batch]
        x = np.full((len(part), WINDOW), _PAD, np.int64)
        for r, (i, a, b, _, _) in enumerate(part):
            x[r, : b - a] = classes(texts[i][a:b])
        y, lead = model.decode(x)
        for r, (i, a, b, begins, ends) in enumerate(part):
            lab, n, pos = y[r], b - a, 0
            if not lab[:n].any():
                continue
            while pos < n:
                if lab[pos] == 0:
                    pos += 1
                    continue
                kind, start = (int(lab[pos]) - 1) // 2, pos
                pos += 1
                while pos < n and lab[pos] == 2 + 2 * kind:
                    pos += 1
                if (start == 0 and not begins) or (pos == n and not ends):
                    continue  # cut by the window's edge; a neighbour holds it whole
                s = (a + start, kind, a + pos)
                score = float(lead[r, start:pos].mean())
                if score > 0 and valid(kind, texts[i][s[0] : s[2]]):
                    # a longer span of the same certainty explains more
                    scored[i][s] = max(scored[i].get(s, 0.0), score * (pos - start))
    out = []
    for t, b, found in zip(texts, base, scored, strict=True):
        apart = {s: v for s, v in found.items() if not any(s[0] < e and a < s[2] for a, _, e in b)} if found else {}
        # not a piece of a longer number or name
        apart = {s: v for s, v in apart.items() if not (s[0] and t[s[0] - 1].isalnum() or s[2] < len(t) and t[s[2]].isalnum())}
        out.append((b, best_spans(apart) if apart else []))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def train_on(docs: DataFrame, bound: int = CARRIERS) -> Tagger:
    """Trains on at most ``bound`` texts (picked by hash of the id) as carriers of labelled spans.

    Of a text of more than CARRIED characters so many go to the driver, from a place anywhere in it
    that the hash of id and text gives. Without any text a made-up one carries the spans.
    """
    text = F.col("text").cast("string")
    begin = F.pmod(F.xxhash64("doc_id", text), F.greatest(F.length(text) - CARRIED, F.lit(0)) + 1) + 1
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring(text, begin.cast("int"), F.lit(CARRIED)).alias("text"))
    return train([r["text"] for r in sample_texts(plain, None, bound)])


def personal_data(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and ``spans`` are of base and added spans; offsets are code points, ends exclusive. Null
    and empty texts have none. Whole texts are read; repeated rows each have their row, a null doc_id stays
    null, further columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = find(b.column("text").to_pylist(), sent.value)
            every = [sorted([*x, *y]) for x, y in found]
            counts = [pa.array([sum(s[1] == k for s in e) for e in every], pa.int64()) for k in range(len(KINDS))]
            sha = [hashlib.sha256(written(x).encode()).hexdigest() for x, _ in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(sha), pa.array([written(e) for e in every])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    plain = docs.selectExpr("cast(doc_id AS long) doc_id", "cast(text AS string) text")
    return plain.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (or run of overlapping spans) replaced by its kind's name."""
    out, at = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; ``n_chars``, if there, is counted anew.

    Null and empty texts stay as they are, repeated rows are masked alike, further columns are kept,
    and an empty table stays empty.
    """
    spark = docs.sparkSession
    text_batches(spark)
    sent, schema, at = spark.sparkContext.broadcast(model), docs.schema, docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [t if not (x or y) else mask(t, [*x, *y]) for t, (x, y) in zip(texts, find(texts, sent.value), strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
