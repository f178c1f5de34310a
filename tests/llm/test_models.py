"""Language, toxicity, quality and personal data: held-out accuracy, plain rules, odd cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import language, ngrams, pii, quality, toxicity

SYLLABLES = {"en": ["th", "ing", "er", "wh", "of"], "fr": ["eau", "oi", "é", "que", "ai"], "de": ["sch", "ung", "ö", "ich", "pf"], "es": ["ción", "ñ", "ado", "os", "el"]}
ODD = [None, "", " ", "123 %%% ...", "a", "w " * 30_000, "½", "²³ 12", "①②", "Ⅷ", "½ é", "漢"]


def say(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(1)
    return [(i, say(rng, lang), lang) for i, lang in enumerate(sorted(SYLLABLES) * 60)]


def test_codewords_are_apart():
    for k in (2, 4, 9):
        c = language.codewords(k)
        assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= 4
        assert not (np.abs(c.sum(axis=0)) == k).any()


def test_language(spark, talk):
    rows = [*talk, *[(1000 + i, t, "en") for i, t in enumerate(ODD)], (None, "th ing", None), talk[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    held = [(i, lang) for i, _, lang in talk if by_id[i].held_out]
    assert len(held) > 20 and np.mean([by_id[i].lang_pred == lang for i, lang in held]) > 0.98
    for i, t in enumerate(ODD):
        r = by_id[1000 + i]
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (t in (None, "", " ", "123 %%% ...", "½", "²³ 12", "①②", "Ⅷ"))
    kept = {r.doc_id for r in language.keep_known(docs, model).collect()}
    assert {i for i, _, _ in talk} <= kept and not {1000, 1001, 1002, 1003, 1006, 1007, 1008, 1009} & kept
    assert language.identify(docs.limit(0), language.train(docs.limit(0))).count() == 0


def test_near_ties_of_two_languages_go(spark, talk):
    model = language.fit([t for _, t, _ in talk], [lang for _, _, lang in talk])
    rng = random.Random(8)
    one, two = say(rng, "en", 2000).split(), say(rng, "fr", 2000).split()
    texts = [" ".join(one[:k] + two[k:]) for k in (0, *range(850, 1200), 2000)]
    names, score, flag = model.decode(texts)
    assert names[0] == "fr" and names[-1] == "en" and not flag[[0, -1]].any()
    assert flag.any() and score[flag].min() > 0.3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in language.keep_known(docs, model).collect()} == set(np.flatnonzero(~flag).tolist())


def test_a_bit_error_is_corrected(talk):
    model = language.fit([t for _, t, _ in talk], [x for _, _, x in talk])
    broken = model.shift.copy()
    model.shift = broken + np.where(np.arange(len(broken)) == 3, 50.0, 0.0)  # one classifier says yes to all
    names, _, _ = model.decode([t for _, t, _ in talk])
    assert np.mean([a == x for a, (_, _, x) in zip(names, talk, strict=True)]) > 0.95


def test_toxicity(spark, talk):
    rng = random.Random(2)
    rows, labels = [], []
    for i, t, _ in talk * 3:
        bad = rng.random() < 0.25
        j = len(rows)
        rows.append((j, t + (" you worthless idiot" if bad else ""), 0))
        labels.append((j, int(bad), None))
    rows += [(10_000 + i, t, 1) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame([*labels, (None, 1, None), (5, None, None)], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, toxicity.train(docs, lab)).collect()}
    assert len(got) == len(rows)
    held = [(j, y) for j, y, _ in labels if got[j].held_out]
    assert len(held) > 50 and np.mean([got[j].predicted == y for j, y in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    none = toxicity.train(docs, lab.limit(0))
    assert toxicity.toxicity(docs, none).count() == len(rows)


def test_quality(spark, talk):
    rng = random.Random(3)
    rows, ratings = [], []
    for i, (_, t, _) in enumerate(talk):
        grade = rng.randrange(3)
        w = t.split()
        for k in range(len(w)):
            if rng.random() < (0.6, 0.2, 0.0)[grade]:
                w[k] = "%%%###"
        rows.append((i, " ".join(w)))
        ratings.append((i, grade))
    docs = spark.createDataFrame([*rows, *[(5000 + i, t) for i, t in enumerate(ODD)]], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([*ratings, (3, None), (4, 99)], "doc_id long, grade int"))
    assert (np.diff(model.cuts) > 0).all()
    got = {r.doc_id: r for r in quality.quality(docs, model).collect()}
    assert len(got) == len(rows) + len(ODD)
    assert all(r.tails[0] >= r.tails[1] and abs(sum(r.tails) - r.expected_grade) < 1e-9 and r.selected == (r.tails[0] >= 0.5) for r in got.values())
    blank = [got[5000 + i] for i, t in enumerate(ODD) if not (t and t.strip())]
    assert len(blank) > 1 and not any(r.selected or r.expected_grade for r in blank)
    means = [np.mean([got[i].expected_grade for i, g in ratings if g == k]) for k in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]


def test_the_learning_sample_is_bounded(spark):
    from tidewell.llm.common import sample_texts

    rows = [(i, "x" * (i % 7 + 1)) for i in range(200)] + [(3, "longer than the other"), (500, "z" * 5000), (None, "n"), (501, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(0, 600)], "doc_id long, y int")
    got = [tuple(r) for r in sample_texts(docs, known, 1000)]
    assert [g[0] for g in got] == [*range(200), 500, 501] and got[3] == (3, "xxxx", 1) and got[-1] == (501, "", 1)
    few = sample_texts(docs, known, 1000, most=100)
    assert 20 < len(few) and 90 < sum(len(r["text"]) for r in few) <= 100
    assert len(sample_texts(docs, known, 10)) == 10 and sample_texts(docs.limit(0), None, 10) == []


def test_naive_bayes_scores_by_hand():
    """Scores are those of weights times log-count ratios, worked out per text from the model's own parts."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["worthless", "idiot", "kind", "plain", "word"], k=6)) for _ in range(80)]
    labels = [int("idiot" in t) for t in texts]
    model = toxicity.fit(texts, labels)
    for t in [*texts[:10], "", None]:
        grams = {g for n in toxicity.SIZES for g in ngrams.hashed_ngrams(ngrams.lowered(t), (n,), toxicity.BITS).tolist()}
        z = sum(float(model.weight[g]) for g in grams) + model.bias
        assert abs(model.score([t])[0] - 1 / (1 + np.exp(-z))) < 1e-6
    # the ratios are those of the counts: an n-gram of one class only has its sign
    only = [g for g in ngrams.distinct(b"idiot", toxicity.SIZES, toxicity.BITS).tolist() if model.weight[g]]
    assert only and all(model.weight[g] > 0 for g in only)


def test_decoding_against_all_codewords(talk):
    """The language is that of the least weighted loss over all codewords, summed bit by bit."""
    model = language.fit([t for _, t, _ in talk], [x for _, _, x in talk])
    texts = [t for _, t, _ in talk[:20]]
    f = model.bits(ngrams.count_matrix(texts, language.SIZES, language.BITS))
    names, _, _ = model.decode(texts)
    for row, name in zip(f, names, strict=True):
        loss = {n: sum(w * np.log1p(np.exp(-c * x)) for w, c, x in zip(model.weight, code, row, strict=True)) for n, code in zip(model.names, model.codes, strict=True)}
        assert min(loss, key=loss.get) == name


def test_ordinal_fit_is_a_minimum(talk):
    """Weights and cuts are near a minimum of the penalised likelihood, written out rating by rating."""
    rng = random.Random(3)
    texts, grades = [], []
    for _, t, _ in talk[:120]:
        g = rng.randrange(3)
        texts.append(" ".join("%%%" if rng.random() < (0.6, 0.3, 0.0)[g] else w for w in t.split()))
        grades.append(g)
    model = quality.fit(texts, grades, penalty=1e-2, rounds=600)
    x = quality.features(texts).astype(float)

    def cost(w, cuts):
        total = 0.5 * 1e-2 * float(w @ w)
        for row, g in zip(x, grades, strict=True):
            tail = [1.0, *(1 / (1 + np.exp(-(row @ w - c))) for c in cuts), 0.0]
            total -= np.log(tail[g] - tail[g + 1]) / len(grades)
        return total

    w, best = model.weight.astype(float), cost(model.weight.astype(float), model.cuts)
    for step in (0.1, -0.1):
        assert cost(w * (1 + step), model.cuts) > best - 1e-4
        for j in range(2):
            moved = model.cuts.copy()
            moved[j] += step
            assert cost(w, moved) > best - 1e-3
    tails = model.tails(texts)
    assert np.allclose(tails, 1 / (1 + np.exp(-((x @ w)[:, None] - model.cuts))), atol=1e-4)


def test_models_and_odd_rows(spark, talk):
    """Repeated rows, null ids and clashing columns each have their row."""
    docs = spark.createDataFrame([(1, "th ing", 0, "x"), (1, "th ing", 0, "x"), (None, "th ing", 1, None), (None, None, 1, None)], "doc_id long, text string, score int, tails string")
    model = quality.fit([t for _, t, _ in talk[:40]], [i % 3 for i in range(40)])
    got = quality.quality(docs, model).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 1] and len({r.expected_grade for r in got if r.doc_id == 1}) == 1
    tox = toxicity.toxicity(docs, toxicity.fit(["a"], [0])).collect()
    assert sorted((r.doc_id or 0) for r in tox) == [0, 0, 1, 1]
    assert quality.quality(docs.limit(0), model).count() == 0
    empty = quality.train(docs.limit(0), spark.createDataFrame([], "doc_id long, grade int"))
    assert quality.quality(docs, empty).count() == 4


def test_ngrams_of_the_whole_text():
    head = "x" * 50_000
    assert len(ngrams.hashed_ngrams(ngrams.lowered(head), (3,), 20)) == 50_000
    assert len(set(ngrams.distinct(ngrams.lowered(head + "zq"), (3,), 20)) - set(ngrams.distinct(ngrams.lowered(head), (3,), 20))) >= 2


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_base(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = [lambda: True, lambda: all(int(x) <= 255 for x in m[0].split(".")), lambda: 14 <= len(d) <= 19 and pii.luhn(d), lambda: 10 <= len(d) <= 15][k]  # noqa: B023
            if ok():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("019a.@+- (-)..b@0123456789 é") for _ in range(rng.randint(0, 70)))
        assert pii.base_spans(t) == plain_base(t)
    for t in ("1" * 100_000, "1." * 50_000, "a" * 100_000 + "@", "+1" * 50_000, "0" * 9000 + ".1.1.1"):  # none of these may take long
        pii.base_spans(t)


@pytest.fixture(scope="module")
def tagger(talk):
    return pii.train([t for _, t, _ in talk])


def test_gradients():
    m = pii.Tagger.fresh()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii._N_CLASS, (2, 6)), rng.integers(0, 9, (2, 6))
    g = m.step(x, y)[1]
    for k, v in m.p.items():
        i = (int(x[0, 0]), 3) if k == "E" else tuple(int(rng.integers(0, s)) for s in v.shape)
        old = v[i]
        v[i] = old + 1e-4
        up = m.step(x, y)[0]
        v[i] = old - 1e-4
        down = m.step(x, y)[0]
        v[i] = old
        assert abs((up - down) / 2e-4 - g[k][i]) < 2e-3 * (1 + abs(g[k][i]))


def test_tagger_and_masking(spark, tagger):
    x, y = pii.training_windows(["of the and whing er " * 20], 200, seed=77)
    p, _ = tagger.decode(x)
    assert (p == y)[y > 0].mean() > 0.9
    texts = ["mail joe@mail.com or +1 (974) 555-3436 to 10.0.0.1", "nothing here", None, "", "call (974) 555-3436 now", "token = \"ae93e105146691ae697923a219be4df655c4f1c7\"", "w " * 30_000 + "joe@mail.com"]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars int, spans string")
    got = {r.doc_id: r for r in pii.personal_data(docs, tagger).collect()}
    assert got[0].n_email == 1 and got[0].n_ip == 1 and got[0].n_phone >= 1
    assert got[1].spans == got[2].spans == got[3].spans == got[5].spans == ""
    assert got[6].spans == "email:60000:60012"
    import hashlib

    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(pii.written(plain_base(t or "")).encode()).hexdigest()
    out = {r.doc_id: r for r in pii.masked(docs, tagger).collect()}
    assert out[0].text == "mail <EMAIL> or <PHONE> to <IP>" and out[0].n_chars == len(out[0].text)
    assert out[1].text == texts[1] and out[2].text is None
    assert pii.personal_data(docs.limit(0), tagger).count() == 0 and pii.masked(docs.limit(0), tagger).count() == 0
    twice = pii.masked(docs.where("doc_id = 0").unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long"))), tagger).collect()
    assert len({r.text for r in twice}) == 1 and twice[0].spans == "x"


def test_added_spans_are_found_in_held_out_texts(tagger):
    """Recall of spans that the base doesn't hold, whole and of the right kind, and few additions to look-alikes."""
    rng, words = np.random.default_rng(99), random.Random(7)
    found, of, wrong, none = {0: 0, 2: 0, 3: 0}, {0: 0, 2: 0, 3: 0}, 0, 0
    for _ in range(900):
        kind, made = pii._made_span(rng)
        before, after = say(words, words.choice(sorted(SYLLABLES)), 12) + " ", " " + say(words, "en", 12)
        base, added = pii.find([before + made + after], tagger)[0]
        span = (len(before), kind, len(before) + len(made))
        if kind is None:
            none, wrong = none + 1, wrong + bool(added)
        elif not any(a < span[2] and span[0] < b for a, _, b in base) and pii.valid(kind, made):
            of[kind] += 1
            found[kind] += span in added
    assert min(of.values()) > 20 and all(found[k] >= 0.9 * of[k] for k in of), (found, of)
    assert wrong <= 0.03 * none


def made_forms(rng):
    """Each form that only the model can find, and each look-alike of phones, made apart from the training's."""
    num = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    a, b, c, e = num(3), num(3), num(4), num(2)
    d = num(15)
    d = next(d + str(x) for x in range(10) if pii.luhn(d + str(x)))
    found = {
        "(a) b-c": f"({a}) {b}-{c}", "(a) b c": f"({a}) {b} {c}", "a-b-c": f"{a}-{b}-{c}", "a.b.c": f"{a}.{b}.{c}", "a b c": f"{a} {b} {c}", "0ee": f"0{e} {c} {num(4)} {e}", "0aaa": f"0{a} {num(4)}{a}",
        "0e ee": f"0{e[0]} {e} {num(2)} {num(2)} {num(2)}", "(0ee)": f"(0{e}) {c} {num(4)}", "00ee": f"00{e} {a} {num(7)}", "1-": f"1-{a}-{b}-{c}", "dotted card": ".".join(d[i : i + 4] for i in range(0, 16, 4)),
        "accented mail": f"zoé.müller{num(2)}@boîte-{rng.choice(['a', 'bc', 'xyz'])}.{rng.choice(['de', 'fr', 'com'])}",
    }
    alike = {
        "isbn": f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", "isbn blanks": f"978 {num(1)} {num(3)} {num(5)} {num(1)}", "thousands": f"{rng.randint(1, 9)} {num(3)} {num(3)} {num(3)}", "dotted thousands": f"{rng.randint(1, 9)}.{num(3)}.{num(3)}.{num(3)}",
        "stamp": f"20{num(2)}-0{rng.randint(1, 9)}-1{num(1)} 1{num(1)}:{num(2)}:{num(2)}", "list": f"{num(2)}, {num(3)}, {num(2)}, {num(3)}", "figures": f"{num(1)}.{num(2)} {num(1)}.{num(2)} {num(1)}.{num(2)} {num(1)}.{num(3)}", "order": f"No {num(10)}", "range": f"{num(4)}-{num(4)}",
    }
    return found, alike


@pytest.mark.parametrize("share", [0, 1])
def test_forms_with_the_model_of_the_table(spark, share):
    """With the model that ``train_on`` gives on half of the driver's table: every form is found whole, look-alikes are left."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train_on(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == share))
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text and not re.search("[0-9@+]", r.text)]
    rng, hits, wrong = random.Random(share), {}, {}
    for size in (40, 4000):
        long = [t for t in texts if len(t) > size]
        for _ in range(40):
            for put, kind in zip(made_forms(rng), (True, False), strict=True):
                for name, span in put.items():
                    c = rng.choice(long)
                    at = rng.randrange(len(c) - size + 1)
                    before = c[at : at + size // 2] + " "
                    base, added = pii.find([before + span + rng.choice([" ", ". ", "\n"]) + c[at + size // 2 : at + size]], model)[0]
                    if kind:
                        hits[name] = hits.get(name, 0) + ((len(before), len(before) + len(span)) in [(x, z) for x, _, z in base + added])
                    else:
                        wrong[name] = wrong.get(name, 0) + any(x < len(before) + len(span) and len(before) < z for x, _, z in added)
    assert min(hits.values()) >= 0.9 * 80, hits
    assert max(wrong.values()) <= 0.05 * 80, wrong


def test_longest_span_lies_whole_in_a_window():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, pii.LONGEST)
        anchor = rng.randrange(n)
        text = "a" * rng.randint(0, 300) + "7 " * rng.randint(0, 90)
        a, text = len(text), text + "b" * anchor + "@" + "b" * (n - anchor - 1) + "c" * rng.randint(0, 300)
        assert any(x <= a and a + n <= y and (x < a or first) and (a + n < y or last) for x, y, first, last in pii.windows_of(text))


def test_forms_that_the_base_leaves(tagger):
    for text, span in (("call (974) 555-3436 now", (5, 3, 19)), ("mail jörg@müller.de please", (5, 0, 19)), ("ring 030 1234 5678 90 today", (5, 3, 21))):
        assert pii.find([text], tagger)[0] == ([], [span])


def test_carriers_come_from_anywhere_in_long_texts(spark, monkeypatch):
    texts = ["".join(f"{k:08d}" for k in range(12_500))] * 40 + ["short", "y" * 20_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(pii, "train", lambda carriers: carriers)
    got = pii.train_on(docs)
    assert len(got) == len(texts) and got[40:] == ["short", "y" * 20_000, ""]
    begins = [texts[0].index(c) for c in got[:40]]
    assert all(len(c) == 20_000 for c in got[:40]) and min(begins) < 20_000 and max(begins) > 60_000 and len(set(begins)) > 30


def test_windows_cover_all_anchors_and_reconcile():
    t = "x" * 500 + "12345 " * 60 + "y" * 500 + "@"
    spans = pii.windows_of(t)
    assert all(any(a <= m.start() < b for a, b, _, _ in spans) for m in re.finditer("[0-9@+]", t))
    assert all(b - a <= pii.WINDOW for a, b, _, _ in spans)
    assert pii.best_spans({(0, 0, 10): 3.0, (5, 1, 12): 4.0, (12, 2, 20): 1.0, (0, 3, 30): 4.5}) == [(5, 1, 12), (12, 2, 20)]
