"""Exact, near and vector deduplication against brute force, with the odd cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup, near_dedup, vector_dedup
from tidewell.llm.common import Scratch
from tidewell.llm.components import components

DOCS = "doc_id long, text string, lang string, digest string, rep long, kept string"


def odd_docs(spark, seed=3):
    """Copies, near copies, nulls, blanks, repeats and one very long text, with clashing columns."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 60))) for _ in range(25)]
    texts = []
    for b in base:
        texts.append(b)
        w = b.split(" ")
        for _ in range(rng.randint(0, 4)):
            v = list(w)
            if rng.random() < 0.7:
                v[rng.randrange(len(v))] = "X"
            texts.append(rng.choice([" ", "\n", "\t "]).join(v))
    texts += [None, None, "", " ", "\t\n", "one", "ONE", "one two three", "one  two\nthree", "w " * 30_000, "w " * 30_000 + "end"]
    rows = [(i * 3, t, None, "d", 1, "k") for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], (rows[2][0], rows[7][1], None, "d", 1, "k"), (-4, rows[9][1], None, "d", 1, "k"), (-4, rows[11][1], None, "d", 1, "k"), (None, texts[0], "en", None, None, None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("digest", [None, lambda c: (F.crc32(c.cast("binary")) % 7).cast("string")])
def test_exact(spark, digest):
    docs = odd_docs(spark)
    args = {} if digest is None else {"digest": digest}
    got = exact_dedup.exact_groups(docs, Scratch(spark, "t"), **args).collect()
    rows = [(r.doc_id, re.sub("[\x20\x09-\x0d]+", " ", r.text or "")) for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    least = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    want = collections.Counter((i, least(groups[t]), len(groups[t])) for i, t in rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    if digest is None:
        assert {r.digest for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def test_exact_goes_on_with_kept_state(spark, tmp_path):
    """New files only are read; the state of earlier ones is retained."""
    schema = "doc_id long, digest string, locator long"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: {r.digest: (r.group_size, r.first.id) for r in exact_dedup.stream_groups(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, f"{tmp_path}/state", f"{tmp_path}/out").collect()}
    put([(5, "a", 0), (6, "b", 1)])
    assert run() == {"a": (1, 5), "b": (1, 6)}
    put([(2, "a", 0), (9, "c", 1)])
    assert run() == {"a": (2, 2), "b": (1, 6), "c": (1, 9)}


def test_drop_copies(spark):
    docs = odd_docs(spark)
    out = exact_dedup.drop_copies(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns
    texts = [re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in docs.collect()})


def test_drop_copies_of_one_id(spark, tmp_path):
    rows = [(1, "a b", 0), (1, "a  b", 1), (None, "c d", 2), (None, "c  d", 3), (2, "e", 4), (2, "e", 4), (2, "f", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _file int")
    docs.repartition(3).write.parquet(f"{tmp_path}/t")
    for d, stored in ((docs, False), (spark.read.parquet(f"{tmp_path}/t"), True)):
        out = exact_dedup.drop_copies(d, Scratch(spark, "t"), stored=stored)
        assert out.columns == docs.columns
        out = out.collect()
        assert sorted((r.doc_id or 0, re.sub(" +", " ", r.text)) for r in out) == [(0, "c d"), (1, "a b"), (2, "e"), (2, "f")]


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("width", [4, 5])
def test_near(spark, width):
    docs = odd_docs(spark)
    got = near_dedup.near_groups(docs, Scratch(spark, "t"), width=width).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((i, len(shingles(t, width))) for i, t in rows)
    texts = collections.defaultdict(list)  # a doc_id may have several
    for i, t in rows:
        if i is not None:
            texts[i].append(shingles(t, width))
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x & y and 100 * len(x & y) >= 80 * len(x | y) for x in texts[a] for y in texts[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert all(r.component_id == (None if r.doc_id is None else top(r.doc_id)) for r in got)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("percent", [50, 65, 95])
def test_near_of_other_percents(spark, percent):
    """Links are those of the percent asked for, however far it is from 80."""
    rng = random.Random(percent)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(30):
        base = rng.choices(vocab, k=rng.randint(30, 90) if percent < 90 else rng.randint(300, 900))
        rows.append(" ".join(base))
        for _ in range(4):
            v = list(base)
            for _ in range(rng.randint(1, 9)):
                v[rng.randrange(len(v))] = "X"
            rows.append(" ".join(v))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, Scratch(spark, "t"), width=4, percent=percent).collect()}
    sets, up = [shingles(t, 4) for t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    near_the_limit = 0
    for a in range(len(rows)):
        for b in range(a):
            both, all_of = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            near_the_limit += percent <= 100 * both / all_of < percent + 10
            if 100 * both >= percent * all_of:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i in range(len(rows))} and near_the_limit > 5


def test_bands_follow_the_percent():
    for percent in (1, 10, 50, 65, 80, 90, 99, 100):
        b = near_dedup.Banding.of(percent)
        assert (1 - (percent / 100) ** b.rows) ** b.bands <= near_dedup.MISS and b.least_agree <= percent / 100
        assert b.minima <= near_dedup.MOST_MINIMA or b.rows == 1
    for percent in (0, 101):
        with pytest.raises(ValueError):
            near_dedup.Banding.of(percent)


def test_near_large_mixed_bucket(spark):
    """A family whose members are alike only through others: the star alone doesn't find its links."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(100)]
    rows, now = [], list(words)
    for i in range(60):  # each differs a little from the one before, so the ends are unlike
        rows.append((i, " ".join(now), None, None, None, None))
        now[rng.randrange(100)] = f"n{i}"
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, Scratch(spark, "t"), width=4).collect()}
    assert set(got.values()) == {0}


def test_near_words_that_power_sums_confuse(spark):
    from .test_tokens import thue_morse

    a, b = thue_morse()
    docs = spark.createDataFrame([(1, a), (2, b), (3, a + " z z z"), (4, b + " z z z")], "doc_id long, text string")
    got = near_dedup.near_groups(docs, Scratch(spark, "t"), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_shingles_that_share_half_a_digest(monkeypatch):
    from tidewell.llm import words

    x = np.array([[1, 1, 5], [7, 8, 9]], np.uint64)
    y = words.distinct_pairs(np.array([5, 1, 1, 1], np.uint64), np.array([9, 8, 7, 8], np.uint64))
    assert y.tolist() == x.tolist()
    assert near_dedup.similar(x, y, 100) and not near_dedup.similar(x, np.array([[1, 1, 5], [6, 8, 9]], np.uint64), 80)


def test_near_blocks_of_any_size(spark, monkeypatch):
    """Small blocks find what one block finds."""
    rng = random.Random(6)
    word = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(word)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(60)] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, Scratch(spark, "t"), width=2).collect()}
    whole = run()
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 50_000)
    assert run() == whole
    sets = {i: shingles(t, 2) for i, t in rows}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                assert whole[i] == whole[j]


@pytest.mark.parametrize("empty", [True, False])
def test_empty_tables(spark, empty):
    docs = spark.createDataFrame([] if empty else [(1, None, None, None, None, None)], DOCS)
    assert exact_dedup.exact_groups(docs, Scratch(spark, "t")).count() == (not empty)
    assert near_dedup.near_groups(docs, Scratch(spark, "t")).count() == (not empty)
    v = spark.createDataFrame([] if empty else [(1, None)], "vec_id long, embedding array<float>")
    assert vector_dedup.near_vectors(v, Scratch(spark, "t")).count() == (not empty)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (None, 8), (9, 10), (10, 11), (11, 12), (12, 13), (5, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, 10: 9, 11: 9, 12: 9, 13: 9}


def brute_vectors(rows, least=0.9):
    """(vec_id, n_links, component_id) of each row, by all pairs of distinct (id, vector)."""
    able = lambda i, x: i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x) and any(x)
    node = sorted({(i, tuple(x)) for i, x in rows if able(i, x)})
    x = [np.array(v) / max(abs(y) for y in v) for _, v in node]
    x = [v / np.linalg.norm(v) for v in x]
    near = [[b for b in range(len(node)) if a != b and len(x[a]) == len(x[b]) and x[a] @ x[b] >= least] for a in range(len(node))]
    label = {i: i for i, _ in node}
    for _ in range(len(node)):
        for a, bs in enumerate(near):
            label[node[a][0]] = min([label[node[a][0]], *(label[node[b][0]] for b in bs)])
    at = {n: k for k, n in enumerate(node)}
    return sorted(((i, len(near[at[i, tuple(v)]]), label[i]) if able(i, v) else (i, 0, i) for i, v in rows), key=repr)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    d = 12
    v = [rng.normal(size=d).tolist() for _ in range(80)]
    v += [(np.array(v[i % 5]) * rng.uniform(0.1, 9) + rng.normal(size=d) * 0.12).tolist() for i in range(60)]
    v += [v[3]] * 20 + [[0.0] * d, None, [], [float("nan")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [float("inf")] * d, [1e300] * d, [1e-300] * d]
    v += [(np.eye(d)[0] * np.cos(t / 3) + np.eye(d)[1] * np.sin(t / 3)).tolist() for t in range(9)]
    v += [[1.0, 2.0], [1.0, 2.01], [2.0, -1.0], [5.0], [7.0], [1.0, 2.0, 3.0]]  # other lengths are joined among themselves
    rows = list(zip((int(i) for i in rng.permutation(len(v))), v, strict=True))
    rows += [rows[0], rows[3], rows[3], (None, v[0]), (None, None)]
    rng.shuffle(rows := [list(r) for r in rows])
    docs = spark.createDataFrame([(i, x, 5) for i, x in rows], "vec_id long, embedding array<double>, rep long")
    got = vector_dedup.near_vectors(docs, Scratch(spark, "t")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_near_intervals_lose_nothing(spark):
    rng = np.random.default_rng(2)
    low = np.sort(rng.normal(size=(40, 3)) * 3, axis=0)
    high = low + rng.uniform(0, 0.5, low.shape)
    names = [f"{s}{i}" for s in "lh" for i in range(3)]
    boxes = spark.createDataFrame([(k, *map(float, low[k]), *map(float, high[k])) for k in range(40)], ["at", *names])
    found = {(r.i, r.j) for r in vector_dedup.near_intervals(boxes, 40, 3, 1.0, Scratch(spark, "t")).collect()}
    gap = np.maximum(0, np.maximum(low[:, None] - high[None], low[None] - high[:, None]))
    near = (gap**2).sum(-1) <= 1.0
    assert found == {(i, j) for i in range(40) for j in range(i, 40) if near[i, j]}
    assert len(found) < 40 * 41 / 2
