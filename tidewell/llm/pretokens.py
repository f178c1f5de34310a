"""Pre-tokens of the lower-casing word BPE, found with numpy, and pieces once per distinct pre-token.

``WordPieces`` gives exactly the ids of the tokenizers library for a vocabulary file whose
pre-tokenizer splits into contractions, letter runs, single numerals and runs of other signs.
Texts of ASCII and Latin-1 letters take the vectorised way; any other text is split by the
library's own normalizer and pre-tokenizer. Either way a distinct pre-token meets the BPE model
once (for as long as it stays in the bounded memo).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from . import words

_SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")  # fixed values: the vocabulary's special tokens

_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[0x80:] = _LETTER  # parts of Latin-1 letters, in the texts that come this way

#: Distinct pre-tokens that the memo holds before it starts anew.
MEMO = 750_000
#: The same where only names are held, which nothing is saved by keeping for long.
NAMES = 100_000
#: Bits of the direct-mapped table in front of the memo.
DIRECT = 20


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-in for each byte: printable bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_STAND_IN = _byte_letters()


#: Bytes of the texts that are split here: white space, printable ASCII, and Latin-1 letters (0xC3 and one more).
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x09, 0x0E), *range(0x20, 0x7F), 0xC3]] = True


def other_bytes(buf: np.ndarray) -> np.ndarray:
    """Where a buffer holds anything else: such texts go by the library's own splitting."""
    odd = np.flatnonzero(~_PLAIN[buf])
    if len(odd):
        after = (buf[odd - 1] == 0xC3) & (buf[odd] >= 0x80) & (buf[odd] != 0x97) & (buf[odd] != 0xB7)
        odd = odd[~after | (odd == 0)]
    return odd


def split_runs(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens in a buffer of lower-case bytes (texts end in white space)."""
    kind = _KIND[buf]
    first = np.empty(len(buf), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == _DIGIT
    # an apostrophe that begins a run of signs takes a following s, t, m, d, re, ve or ll with it
    quote = np.flatnonzero((buf == 0x27) & first)
    if len(quote):
        quote = quote[quote + 1 < len(buf)]
        quote = quote[kind[quote + 1] == _LETTER]
        one = buf[quote + 1]
        two = buf[np.minimum(quote + 2, len(buf) - 1)]
        n = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
        n[((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))] = 2
        n[(one == ord("l")) & (two == ord("l"))] = 2
        quote, n = quote[n > 0], n[n > 0]
        first[quote + 1] = False
        first[quote + 1 + n] = True  # what follows begins anew; the buffer ends in white space
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(buf))
    ok = kind[starts] != _SPACE
    return starts[ok], ends[ok]


class Memo:
    """Ids of distinct strings: learned once, kept in flat arrays, bounded.

    Strings are looked up by 64-bit digest and then compared byte by byte with what the slot was
    learned from; one that meets another's digest gets a slot of its own.
    """

    def __init__(self, bound: int = MEMO):
        self.bound = bound
        self.reset()

    def reset(self) -> None:
        self.direct, self.direct_slot = np.zeros(1 << DIRECT, np.uint64), np.zeros(1 << DIRECT, np.int32)
        self.keys = np.zeros(0, np.uint64)  # sorted digests of known strings
        self.slot = np.zeros(0, np.int64)
        self.at, self.size, self.pool, self.used, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0, 0
        self.text_at, self.text_size, self.blocks, self.text_used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint64), 0
        self.clash: dict[bytes, int] = {}

    def _append(self, runs: words.Runs, new: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Slots for the strings at places ``new``, with their ids and bytes."""
        n, m = self.n, len(size)
        long = -(-runs.size[new] // 8)
        if n + m > len(self.at):
            for name in ("at", "size", "text_at", "text_size"):
                setattr(self, name, np.resize(getattr(self, name), max(2 * len(self.at), n + m) if name == "at" else len(self.at)))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, max(2 * len(self.pool), self.used + len(flat)))
        if self.text_used + int(long.sum()) > len(self.blocks):
            self.blocks = np.resize(self.blocks, max(2 * len(self.blocks), self.text_used + int(long.sum())))
        self.pool[self.used : self.used + len(flat)] = flat
        self.size[n : n + m] = size
        self.at[n : n + m] = self.used + np.cumsum(size) - size
        self.text_size[n : n + m] = runs.size[new]
        self.text_at[n : n + m] = self.text_used + np.cumsum(long) - long
        for k, live in runs.levels(new):
            self.blocks[self.text_at[n + live] + k] = runs.block(new[live], k)
        for i in np.flatnonzero(runs.size[new] > words.SHORT).tolist():
            at = self.text_at[n + i]
            self.blocks[at : at + long[i]] = np.frombuffer(runs.bytes(new[i]).ljust(8 * int(long[i]), b"\0"), np.uint64)
        self.n, self.used, self.text_used = n + m, self.used + len(flat), self.text_used + int(long.sum())
        return np.arange(n, n + m)

    def _same(self, runs: words.Runs, slot: np.ndarray) -> np.ndarray:
        """Whether each string has the bytes that its slot was learned from."""
        ok = self.text_size[slot] == runs.size
        for k, live in runs.levels(np.arange(len(slot))):
            ok[live] &= self.blocks[np.minimum(self.text_at[slot[live]] + k, len(self.blocks) - 1)] == runs.block(live, k)
        for i in np.flatnonzero(ok & (runs.size > words.SHORT)).tolist():
            at, size = self.text_at[slot[i]], runs.size[i]
            ok[i] = self.blocks[at : at - (-size // 8)].tobytes()[:size] == runs.bytes(i)
        return ok

    def slots(self, runs: words.Runs, learn, digest: np.ndarray | None = None) -> np.ndarray:
        """The slot of each string; ``learn(i)`` gives sizes and flat ids of the new ones, at places i of ``runs``."""
        hashed = runs.digests()[0] if digest is None else digest
        place = (hashed >> np.uint64(64 - DIRECT)).astype(np.int64)
        slot = self.direct_slot[place].astype(np.int64)
        missed = np.flatnonzero(self.direct[place] != hashed)
        if len(missed):  # not in the direct-mapped table: one look-up for each distinct string
            keys, where, inverse = np.unique(hashed[missed], return_index=True, return_inverse=True)
            spot = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            fresh = self.keys[spot] != keys if len(self.keys) else np.ones(len(keys), bool)
            if fresh.any():
                new = missed[where[fresh]]
                made = self._append(runs, new, *learn(new))
                at = np.searchsorted(self.keys, keys[fresh])
                self.keys, self.slot = np.insert(self.keys, at, keys[fresh]), np.insert(self.slot, at, made)
            found = self.slot[np.searchsorted(self.keys, keys)]
            slot[missed] = found[inverse]
            place = (keys >> np.uint64(64 - DIRECT)).astype(np.int64)
            free = self.direct[place] == 0
            self.direct[place[free]], self.direct_slot[place[free]] = keys[free], found[free]
        for i in np.flatnonzero(~self._same(runs, slot)).tolist():  # another string has its digest
            word = runs.bytes(i)
            if word not in self.clash:
                one = np.array([i])
                self.clash[word] = int(self._append(runs, one, *learn(one))[0])
            slot[i] = self.clash[word]
        return slot

    def flat(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each string's ids begin (and, last, end) in them."""
        size = self.size[slots]
        total = np.concatenate(([0], np.cumsum(size)))
        return self.pool[np.arange(total[-1]) - np.repeat(total[:-1] - self.at[slots], size)], total


class WordPieces:
    """Pre-tokens of texts, numbered in a memo, with their ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = {t: self.tokenizer.token_to_id(t) for t in ("<|startoftext|>", "<|endoftext|>")}
        self.memo = Memo()

    def _pieces(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and flat ids of pre-tokens, spelled in the model's alphabet."""
        ids = [[t.id for t in self.model.tokenize(w)] if w not in self.special else [self.special[w]] for w in spelled]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return size, np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))

    def _library_split(self, text: str) -> list[str]:
        out = []
        for k, part in enumerate(_SPECIAL.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]
        return out

    def occurrences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per pre-token of all texts its slot in the memo; per text their number.

        The third is the texts' order in the first two: the plain texts, then the others.
        """
        plain = [i for i, t in enumerate(texts) if t and "<|" not in t]
        lowered = [texts[i].lower().encode() for i in plain]
        buf, at = words.join_texts(lowered) if plain else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
        odd = set((np.searchsorted(at, other_bytes(buf), side="right") - 1).tolist())
        if odd:
            lowered = [t for i, t in enumerate(lowered) if i not in odd]
            plain = [t for i, t in enumerate(plain) if i not in odd]
            buf, at = words.join_texts(lowered)
        rest = set(plain)
        other = [i for i, t in enumerate(texts) if t and i not in rest]
        if self.memo.n > self.memo.bound:
            self.memo.reset()
        slots, counts = [], []
        if plain:
            starts, ends = split_runs(buf)

            def learn(new: np.ndarray):
                raw = buf.tobytes()
                return self._pieces([raw[a:b].decode("latin-1").translate(_STAND_IN) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])

            slots.append(self.memo.slots(words.Runs(buf, starts, ends), learn))
            counts.append(np.diff(np.append(np.searchsorted(starts, at), len(starts))))
        if other:
            split = [self._library_split(texts[i]) for i in other]
            distinct = sorted({w for x in split for w in x})
            # they are spelled in the model's alphabet, so a byte that no text has keeps them apart from those above
            raw, at = words.join_texts([b"\xff" + w.encode() for w in distinct]) if distinct else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
            runs = words.Runs(raw, at, np.append(at[1:], len(raw))[: len(at)] - 1)
            found = self.memo.slots(runs, lambda new: self._pieces([distinct[i] for i in new.tolist()]))
            of = dict(zip(distinct, found.tolist(), strict=True))
            slots.append(np.fromiter((of[w] for x in split for w in x), np.int64))
            counts.append(np.array([len(x) for x in split], np.int64))
        if not slots:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(slots), np.concatenate(counts), np.array(plain + other, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids (int32) of each text."""
        out = [np.zeros(0, np.int32)] * len(texts)
        slots, counts, order = self.occurrences(texts)
        if not len(order):
            return out
        flat, total = self.memo.flat(slots)
        ends = np.cumsum(counts)
        for i, a, b in zip(order.tolist(), total[ends - counts].tolist(), total[ends].tolist(), strict=True):
            out[i] = flat[a:b]
        return out


class PreTokens(WordPieces):
    """Pre-tokens by name only: the BPE model is asked for their number of pieces alone, and apart from the texts."""

    def __init__(self, path: str):
        super().__init__(path)
        self.memo = Memo(NAMES)
        self.names: list[str] = []

    def _pieces(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.memo.n:  # the memo is new, or began anew
            self.names = []
        self.names += spelled
        return np.zeros(len(spelled), np.int64), np.zeros(0, np.int32)

    def frequencies(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Distinct (text, pre-token) and how often the text has it; pre-tokens are places in a list of names."""
        slots, counts, order = self.occurrences(texts)
        pair, n = np.unique(np.repeat(order, counts) << 32 | slots, return_counts=True)
        distinct, name = np.unique(pair & 0xFFFFFFFF, return_inverse=True)
        return pair >> 32, [self.names[i] for i in distinct.tolist()], name, n

    def sizes(self, names: list[str]) -> list[int]:
        """Number of pieces of each pre-token."""
        return [1 if w in self.special else len(self.model.tokenize(w)) for w in names]


@lru_cache(maxsize=2)
def word_pieces(path: str) -> WordPieces:
    """One memo in each Python worker."""
    return WordPieces(path)


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    """One memo of names in each Python worker."""
    return PreTokens(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies; asked on the machine that needs it."""
    import public_tokenizers

    return public_tokenizers.path(name)
