"""The pipeline's stages against brute force, and the queries' contracts."""

import re

import pytest

import corpus_pipeline
from tidewell.llm import queries
from tidewell.llm.common import Scratch
from tidewell.llm.pii import base_spans

from .test_dedup import shingles

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    scratch, docs, out = Scratch(spark, "t"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["in"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, sf), name)
        out[name] = docs
    return out


def test_columns(stages):
    assert [n for n in stages if stages[n].columns != DOCUMENTS] == ["packing"]


def test_language_keeps_clean_documents(stages):
    clean = {r.doc_id for r in stages["in"].collect() if r.text and re.search(r"[^\W\d_]", r.text)}
    assert {r.doc_id for r in stages["language_id"].collect()} == clean


def test_exact(stages):
    first = {}
    for r in sorted(stages["language_id"].collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in stages["exact_dedup"].collect()} == set(first.values())


def test_near(stages):
    rows = sorted(stages["exact_dedup"].collect(), key=lambda r: r.doc_id)
    sets = {r.doc_id: shingles(r.text, 5) for r in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert {r.doc_id for r in stages["minhash_near_dedup"].collect()} == {i for i in ids if top(i) == i}


def test_personal_data(stages):
    before = {r.doc_id: r.text for r in stages["minhash_near_dedup"].collect()}
    after = {r.doc_id: r for r in stages["pii"].collect()}
    assert set(before) == set(after)
    for i, t in before.items():
        assert not base_spans(after[i].text or "")
        assert after[i].n_chars == len(after[i].text or "")
        if not base_spans(t or ""):
            assert len(after[i].text or "") <= len(t or "")


def test_packing(stages):
    docs, length = {r.doc_id for r in stages["pii"].collect()}, {}
    total = {}
    for r in stages["packing"].collect():
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
        total[r.doc_id] = r.doc_tokens
    assert length == total and set(length) == docs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_spelling_variants"}))  # that one has a row per word
def test_query_covers_its_table(name, spark, sf):
    t = "embeddings" if name.startswith("op2_") else "documents"
    n = spark.read.parquet(f"{sf}/{t}.parquet").count()
    got = queries.QUERIES[name](spark, sf)
    assert got.count() >= n if name.startswith("op7_") else got.count() == n


def test_exact_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = c.execute(queries.ORACLE_SQL["op5_exact_dedup"])
    cols = [d[0] for d in rel.description]
    want = {tuple(sorted(zip(cols, r, strict=True))) for r in rel.fetchall()}
    got = {tuple(sorted(r.asDict().items())) for r in queries.QUERIES["op5_exact_dedup"](spark, sf).collect()}
    assert got == want
