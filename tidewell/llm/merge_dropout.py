"""SentencePiece BPE with seeded merge-dropout, and its lossless decoding.

Candidate merges are taken from the agenda best first; each is skipped when a keyed hash of (seed,
document, place of the word, word, place of the merge) falls below the dropout rate, so a seed always
gives the same segmentation and every occurrence of a word has its own draws. Without dropout the ids
are the library's.

Words (with their leading blanks) are segmented without dropout once for each distinct word, and the
merges made are kept with the ids. An occurrence that skips none of these takes the ids (skipping a
merge that isn't made changes nothing); any other occurrence is segmented on its own. Short words are
segmented all at once with numpy, long ones by an agenda (heap) each.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words
from .common import text_batches
from .pretokens import Memo, vocabulary

BLANK = "▁"
#: Words of more characters go by an agenda of their own.
LONG = 48
_NONE = np.int64(1) << 40


def _place(start, mid, end) -> np.ndarray:
    """One number for a merge's place in its word."""
    return start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mid.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + end.astype(np.uint64) * np.uint64(0x165667B19E3779F9)


class Merges:
    """Places of the merges made in each slot of a memo, in flat arrays."""

    def __init__(self):
        self.n = self.used = 0
        self.at, self.size, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint64)

    def add(self, size: np.ndarray, flat: np.ndarray) -> None:
        n, m = self.n, len(size)
        if n + m > len(self.at):
            grown = max(2 * len(self.at), n + m)
            self.at, self.size = np.resize(self.at, grown), np.resize(self.size, grown)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, max(2 * len(self.pool), self.used + len(flat)))
        self.pool[self.used : self.used + len(flat)] = flat
        self.size[n : n + m] = size
        self.at[n : n + m] = self.used + np.cumsum(size) - size
        self.n, self.used = n + m, self.used + len(flat)

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each merge of each slot: which of the slots, and its place."""
        size = self.size[slots]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - self.at[slots], size)
        return np.repeat(np.arange(len(slots)), size), self.pool[at]


class MergeDropout:
    def __init__(self, path: str, dropout: float = 0.1, seed: int = 1):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.of = {pieces[i]: i for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in self.of):
            raise ValueError("pieces that span words are not supported")
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(pieces[i][1:-1], 16)] = i
        self.bytes = [b""] * n
        for i in plain:
            self.bytes[i] = pieces[i].replace(BLANK, " ").encode()
        for b in range(256):
            self.bytes[self.byte_id[b]] = bytes([b])
        self.byte_len = np.array([len(x) for x in self.bytes], np.int64)
        self.byte_at = np.concatenate(([0], np.cumsum(self.byte_len)[:-1]))
        self.byte_pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in self.of.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.char_id[ord(" ")] = self.of.get(BLANK, -1)
        self.char_id[ord(BLANK)] = -1  # the sign itself goes by bytes, or decoding would give a blank
        # rank of each piece: higher score first, as the agenda takes them
        rank = np.full(n, n, np.int64)
        rank[sorted(plain, key=lambda i: (-sp.get_score(i), i))] = np.arange(len(plain))
        self.rank = rank
        pairs = {(self.of[p[:k]] << 32) | self.of[p[k:]]: i for p, i in self.of.items() for k in range(1, len(p)) if p[:k] in self.of and p[k:] in self.of}
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.skip_below = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        self._salt = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        self.memo, self.merges = Memo(), Merges()

    def _skipped(self, key, place):
        return words.mix(key + place) < self.skip_below

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        k = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pair, k), len(self.pair) - 1)
        return np.where((self.pair[at] == k) & (left >= 0) & (right >= 0), self.merged[at], -1)

    def _agenda(self, ids: np.ndarray, key: np.uint64 | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """One word by its agenda: (piece or -1, first character) of each symbol, and the places of the merges made."""
        n = len(ids)
        sym, nxt, prv = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i: np.ndarray) -> None:
            i = np.asarray(i, np.int64)
            j = np.array([nxt[x] for x in i.tolist()], np.int64)
            i, j = i[j < n], j[j < n]
            if not len(i):
                return
            e = np.array([nxt[x] for x in j.tolist()], np.int64)
            m = self._join(np.array([sym[x] for x in i.tolist()], np.int64), np.array([sym[x] for x in j.tolist()], np.int64))
            ok = m >= 0
            if key is not None:
                ok &= ~self._skipped(key, _place(i, j, e))
            for a, b, c, d in zip(i[ok].tolist(), j[ok].tolist(), e[ok].tolist(), m[ok].tolist(), strict=True):
                heapq.heappush(heap, (int(self.rank[d]), a, b, c, d))

        offer(np.arange(n))
        alive, made = [True] * n, []
        while heap:
            _, i, j, e, m = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and nxt[i] == j and nxt[j] == e):
                continue
            sym[i], nxt[i], alive[j] = m, e, False
            made.append((i, j, e))
            if e < n:
                prv[e] = i
            offer([x for x in (prv[i], i) if x >= 0])
        return [(sym[i], i) for i in range(n) if alive[i]], _place(*np.array(made, np.int64).reshape(-1, 3).T)

    def _segment(self, texts: list[str], keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids in order; the same of the merges made. Without keys none is skipped."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate(([0], np.cumsum(size)))
        ids = self.char_id[chars].astype(np.int64)
        keep = np.ones(len(ids), bool)
        made_of, made = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for w in np.flatnonzero(size > LONG).tolist():
            a, b = first[w], first[w + 1]
            found, places = self._agenda(ids[a:b], None if keys is None else keys[w])
            made_of.append(np.full(len(places), w))
            made.append(places)
            keep[a:b] = False
            for s, i in found:
                keep[a + i], ids[a + i] = True, s
        # short words together: in each round every word makes its best merge
        word = np.repeat(np.arange(len(texts)), size)
        live = np.flatnonzero(size[word] <= LONG)
        while len(live):
            w, s = word[live], ids[live]
            start = live - first[w]
            same = np.flatnonzero(w[1:] == w[:-1])
            m = self._join(s[same], s[same + 1])
            after = np.append(start[1:], 0)
            end = np.where(np.append(w[1:] == w[:-1], False), after, size[w])
            ok = m >= 0
            same, m = same[ok], m[ok]
            place = _place(start[same], start[same + 1], end[same + 1])
            if keys is not None:
                ok = ~self._skipped(keys[w[same]], place)
                same, m, place = same[ok], m[ok], place[ok]
            if not len(same):
                break
            ww = w[same]
            # the least (rank, place) of each word; rows are in order of words
            value = (self.rank[m] << 6) | start[same]
            group = np.flatnonzero(np.concatenate(([True], ww[1:] != ww[:-1])))
            least = np.minimum.reduceat(value, group)
            best = np.flatnonzero(value == np.repeat(least, np.diff(np.append(group, len(ww)))))
            left, right = live[same[best]], live[same[best] + 1]
            ids[left], keep[right] = m[best], False
            made_of.append(ww[best])
            made.append(place[best])
            busy = np.zeros(len(texts), bool)
            busy[ww[best]] = True
            live = live[busy[w] & keep[live]]
        of = np.concatenate(made_of)
        merges = np.bincount(of, minlength=len(texts)), np.concatenate(made)[np.argsort(of, kind="stable")]
        at = np.flatnonzero(keep)
        got, w = ids[at], word[at]
        miss = np.flatnonzero(got < 0)
        n = np.ones(len(at), np.int64)
        if not len(miss):
            return np.bincount(w, minlength=len(texts)), got.astype(np.int32), *merges
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars[at[miss]].tolist()]
        n[miss] = [len(r) for r in raw]
        flat = np.zeros(int(n.sum()), np.int32)
        begin = np.cumsum(n) - n
        flat[begin[got >= 0]] = got[got >= 0]
        for b, r in zip(begin[miss].tolist(), raw, strict=True):
            flat[b : b + len(r)] = self.byte_id[list(r)]
        return np.bincount(w, weights=n, minlength=len(texts)).astype(np.int64), flat, *merges

    def encode(self, texts: list[str | None], keys: list[int] | None = None) -> list[np.ndarray]:
        """Ids (int32) of each text; ``keys`` (of documents, say) and places choose the merges to skip."""
        out = [np.zeros(0, np.int32)] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        if self.memo.n > self.memo.bound:
            self.memo.reset()
            self.merges = Merges()
        raw = [b" " + texts[i].encode("utf-8", "surrogatepass") for i in full]
        buf, at = words.join_texts(raw, sep=b"")
        gap = buf == 0x20
        begins = gap & np.concatenate(([True], ~gap[:-1]))
        begins[at] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(buf))
        n = np.diff(np.append(np.searchsorted(starts, at), len(starts)))
        doc = np.array([(keys[i] if keys and keys[i] is not None else 0) & (2**64 - 1) for i in full], np.uint64)
        place = np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
        runs = words.Runs(buf, starts, ends)
        hashed = runs.digests()[0]
        data = buf.tobytes()

        def spelled(new: np.ndarray) -> list[str]:
            return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]

        def learn(new: np.ndarray):
            size, ids, *merges = self._segment(spelled(new), None)
            self.merges.add(*merges)
            return size, ids

        slots = self.memo.slots(runs, learn, hashed)
        key = words.mix(words.mix(words.mix(np.repeat(doc, n) ^ self._salt) + place.astype(np.uint64)) ^ hashed)
        of, made = self.merges.of(slots)
        own = np.zeros(len(slots), bool)
        own[of[self._skipped(key[of], made)]] = True
        own = np.flatnonzero(own)
        size = self.memo.size[slots]
        if len(own):
            size[own], ids, *_ = self._segment(spelled(own), key[own])
        total = np.concatenate(([0], np.cumsum(size)))
        flat = np.zeros(total[-1], np.int32)
        shared = np.ones(len(slots), bool)
        shared[own] = False
        fill = np.repeat(shared, size)
        flat[fill] = self.memo.flat(slots[shared])[0]
        if len(own):
            flat[~fill] = ids
        stop = np.cumsum(n)
        for i, a, b in zip(full, total[stop - n].tolist(), total[stop].tolist(), strict=True):
            out[i] = flat[a:b]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text again, whichever merges were skipped."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        size = self.byte_len[ids]
        total = np.cumsum(size)
        raw = self.byte_pool[np.arange(total[-1]) - np.repeat(total - size - self.byte_at[ids], size)]
        return raw.tobytes()[1:].decode("utf-8", "surrogatepass")  # without the blank that encoding put first


@lru_cache(maxsize=4)
def segmenter(path: str, dropout: float, seed: int) -> MergeDropout:
    """One in each Python worker."""
    return MergeDropout(path, dropout, seed)


def encode_pieces(docs: DataFrame, vocab: str | None = None, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, decoded (whether decoding the ids gave the text again).

    Null and empty texts have no ids and decode to the empty text. The whole text is segmented; rows
    that repeat a doc_id and its text get the same ids; a null doc_id draws as 0 does; further
    columns are ignored; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)

    def run(batches):
        bpe = segmenter(vocab or vocabulary("piece_bpe_32k.model"), dropout, seed)
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = bpe.encode(texts, b.column("doc_id").to_pylist())
            same = [bpe.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id AS long) doc_id", "cast(text AS string) text").mapInArrow(run, "doc_id long, ids array<int>, decoded boolean")


def digests(encoded: DataFrame) -> DataFrame:
    """Per row its number of pieces and the crc32 of its ids (little-endian unsigned 32-bit)."""

    def run(batches):
        for b in batches:
            col = b.column("ids")
            flat, offs = col.values.to_numpy(zero_copy_only=False).astype("<u4"), col.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offs), pa.int64()), pa.array(crc, pa.int64()), b.column("decoded")], names=["doc_id", "n_pieces", "ids_crc32", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded boolean")
