"""Token counts, packing and merge-dropout against the libraries."""

import random
import zlib

import numpy as np
import pytest

from tidewell.llm import merge_dropout, packing
from tidewell.llm.common import Scratch
from tidewell.llm import token_counts as token_counts_module
from tidewell.llm.pretokens import PreTokens, WordPieces, vocabulary
from tidewell.llm.token_counts import token_counts

ODD = [None, "", " ", "don't i'll 're 'summer !'s 's's 'tis '' 'LL", "a<|endoftext|>b <|startoftext|>", "-" * 5000, "x" * 3000, "ΣΑΣ İstanbul ﬁ ½²³ 漢字 K", "ab\x00\x1c c", "▁a ▁ b", "é" * 200]


def fuzz(n=3000, seed=1):
    rng = random.Random(seed)
    plain, wild = "ab'slrevmdtLZ 09.,!?-\n\téßÄ'_", "ab'slrevmdtLZ 09.,!?-\n\té<|>ßÄx²½ªµ İ漢字'''_\x1c\x00▁\U0001f600"
    return ODD + ["".join(rng.choice(rng.choice([plain, wild])) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def docs(spark, texts):
    return spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, start int")


def test_word_pieces_are_the_librarys():
    w = WordPieces(vocabulary())
    texts = fuzz()
    want = [e.ids for e in w.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time from the memo
        assert [x.tolist() for x in w.encode(texts)] == want
    w.memo.bound = 10
    assert [x.tolist() for x in w.encode(texts[:50])] == want[:50]


def test_frequencies_and_sizes():
    w, whole = PreTokens(vocabulary()), WordPieces(vocabulary())
    texts = ["the cat the dog the", None, "the", "ΣΑΣ the ΣΑΣ"]
    text, names, name, n = w.frequencies(texts)
    got = {(t, names[k]): c for t, k, c in zip(text.tolist(), name.tolist(), n.tolist(), strict=True)}
    assert len(got) == len(n) and sorted(c for (t, _), c in got.items() if t == 0) == [1, 1, 3] and [c for (t, _), c in got.items() if t == 2] == [1]
    for bound in (10, 10**6):  # the memo begins anew, or doesn't
        w.memo.bound = bound
        for part in (fuzz(500)[:250], fuzz(500)[250:], fuzz(500)):
            text, names, name, n = w.frequencies(part)
            total = np.zeros(len(part), np.int64)
            np.add.at(total, text, np.array(w.sizes(names), np.int64)[name] * n)
            assert total.tolist() == [len(x) for x in whole.encode(part)]
    assert not w.memo.used  # no ids are kept


@pytest.mark.parametrize("hot", [200_000, 40, 0])
def test_counts(spark, monkeypatch, hot):
    monkeypatch.setattr(token_counts_module, "HOT", hot)  # with fewer some or all pre-tokens meet by a shuffle
    w = WordPieces(vocabulary()).tokenizer
    texts = fuzz(300) + ["-" * 200 + " the"] * 300
    rows = docs(spark, texts).unionByName(docs(spark, ["", "the same", "the same"]))
    got = token_counts(rows.unionByName(rows.where("doc_id = 40")), Scratch(spark, "t"), limit=20).collect()
    want = [(i or None, t or "") for i, t in enumerate([*texts])] + [(None, ""), (1, "the same"), (2, "the same")]
    want.append(want[40])
    sizes = [len(w.encode(t, add_special_tokens=False).ids) for _, t in want]
    assert sorted([(i, len(t.encode()), n, n > 20) for (i, t), n in zip(want, sizes, strict=True)], key=repr) == sorted(map(tuple, got), key=repr)
    assert token_counts(docs(spark, []).limit(0), Scratch(spark, "t")).count() == 0


def test_packing(spark):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choices(["the", "of", "x9"], k=rng.choice([1, 10, 700, 3000]))) for _ in range(120)]
    d = docs(spark, texts).repartition(5)
    got = packing.pack(d, Scratch(spark, "t")).collect()
    w = WordPieces(vocabulary()).tokenizer
    ids = {i or None: np.array([*w.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    by_doc, by_window = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[i]))
            at += r.length
            assert zlib.crc32(ids[i][r.start : at].tobytes()) == r.ids_crc32
        assert at == len(ids[i])
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE
    total = sum(map(len, ids.values()))
    assert len(by_window) <= total / packing.SIZE * 1.02 + 5
    assert packing.pack(d.limit(0), Scratch(spark, "t")).count() == 0


def test_packer_keeps_a_fixed_number_of_windows():
    out, rng = [], np.random.default_rng(0)
    p = packing.Packer(lambda used, pieces: out.append(used), size=100, open_windows=4, slack=3)
    total = 0
    for i in range(500):
        n = int(rng.integers(1, 250))
        total += n
        p.add(i, np.arange(n, dtype="<u4"))
        assert len(p.open) <= 4
    left = p.finish()
    assert sum(out) + (left[0] if left else 0) == total
    assert np.mean(out) > 97


def test_leftovers_of_all_groups_are_merged(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    d = spark.createDataFrame([(i, "the " * 20) for i in range(45)], "doc_id long, text string").repartition(9)
    got = packing.pack(d, Scratch(spark, "t")).collect()
    assert len({r.sequence_id for r in got}) == 1 and {r.doc_id for r in got} == set(range(45))
    at = 0
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == at
        at += r.length


@pytest.fixture(scope="module")
def bpe():
    path = vocabulary("piece_bpe_32k.model")
    return merge_dropout.MergeDropout(path, 0.0), merge_dropout.MergeDropout(path, 0.2, seed=9)


def test_without_dropout_the_librarys(bpe):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    texts = [t for t in fuzz(1500) if t is not None and "▁" not in t and "\x00" not in t] + ["the" * 400, "abcabc" * 60, "  a  "]
    assert [x.tolist() for x in bpe[0].encode(texts)] == sp.encode(texts)


def test_dropout_decodes_and_varies(bpe):
    texts = [t or "" for t in fuzz(1500)]
    keys = list(range(len(texts)))
    got = bpe[1].encode(texts, keys)
    assert [bpe[1].decode(x) for x in got] == texts
    again = merge_dropout.MergeDropout(vocabulary("piece_bpe_32k.model"), 0.2, seed=9)
    assert all((a == b).all() for a, b in zip(got, again.encode(texts, keys), strict=True))
    kinds = {tuple(bpe[1].encode(["international understanding"], [k])[0].tolist()) for k in range(40)}
    assert len(kinds) > 3


def test_each_occurrence_has_its_own_draws():
    """A word of one merge is cut in a tenth of its occurrences, and a longer one has more than a few forms."""
    path = vocabulary("piece_bpe_32k.model")
    bpe = merge_dropout.MergeDropout(path, 0.1, seed=3)
    for word in ("a", "i", "s"):  # with its blank one possible merge
        whole = len(merge_dropout.MergeDropout(path, 0.0).encode([word])[0])
        assert whole == 1
        got = bpe.encode([" ".join([word] * 5000)] * 4, [1, 2, 3, 4])
        assert all(0.085 < (len(x) - 5000) / 5000 < 0.115 for x in got)
    forms = {tuple(bpe.encode(["understanding"], [k])[0].tolist()) for k in range(3000)}
    assert len(forms) > 20


def test_shared_ids_are_those_of_the_occurrence(bpe):
    """Taking the kept ids gives what the segmentation of every occurrence on its own gives."""
    alone = merge_dropout.MergeDropout(vocabulary("piece_bpe_32k.model"), 0.2, seed=9)
    alone.merges.of = lambda slots: (np.arange(len(slots)), np.zeros(len(slots), np.uint64))
    alone._skipped = lambda key, place: np.ones(len(place), bool) if not place.any() else bpe[1]._skipped(key, place)
    texts = [t or "" for t in fuzz(500)] + ["the international understanding of the whole " * 40]
    keys = list(range(len(texts)))
    assert [x.tolist() for x in bpe[1].encode(texts, keys)] == [x.tolist() for x in alone.encode(texts, keys)]


def test_vectorised_and_agenda_agree(bpe, monkeypatch):
    texts = ["internationalisation understanding thereafter " * 3, "ab" * 20, "élèves aïeux"]
    short = bpe[1].encode(texts, [1, 2, 3])
    monkeypatch.setattr(merge_dropout, "LONG", 0)
    agenda = merge_dropout.MergeDropout(vocabulary("piece_bpe_32k.model"), 0.2, seed=9).encode(texts, [1, 2, 3])
    assert [x.tolist() for x in short] == [x.tolist() for x in agenda]


def test_encode_pieces(spark):
    got = merge_dropout.digests(merge_dropout.encode_pieces(docs(spark, fuzz(200)))).collect()
    assert len(got) == len(fuzz(200)) and all(r.decoded for r in got)
    assert merge_dropout.encode_pieces(docs(spark, ["a"]).limit(0)).count() == 0


def thue_morse(n=10):
    """Two words of 2**n letters over {a, b} that agree in every sum of powers: each is the other with its letters changed."""
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_words_that_power_sums_confuse(spark, bpe):
    a, b = thue_morse()
    w = WordPieces(vocabulary())
    for pair in ([a, b], ["é " + a, "漢 " + b]):
        assert [x.tolist() for x in w.encode(pair)] == [e.ids for e in w.tokenizer.encode_batch(pair, add_special_tokens=False)]
        assert [bpe[1].decode(x) for x in bpe[1].encode(pair, [1, 2])] == pair
    got = {r.doc_id: r for r in packing.pack(docs(spark, ["", a, b]), Scratch(spark, "t")).collect()}
    for i, t in ((1, a), (2, b)):
        assert got[i].ids_crc32 == zlib.crc32(np.array([*w.tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())


def test_equal_digests_are_told_apart(monkeypatch):
    """With digests of three values every look-up meets strangers, and ids are still the library's."""
    from tidewell.llm import words

    plain = words.Runs.digests
    monkeypatch.setattr(words.Runs, "digests", lambda self, halves=1: [x % np.uint64(3) for x in plain(self, halves)])
    w = WordPieces(vocabulary())
    texts = fuzz(200) + ["x" * 300, "y" * 300, "漢" * 200]
    want = [e.ids for e in w.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in w.encode(texts)] == want
