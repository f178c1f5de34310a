"""Texts longer than an Arrow batch may be, and repeated rows, through the operators that read whole texts."""

import zlib

import numpy as np
import pytest

from tidewell.llm import language, merge_dropout, near_dedup, packing, pii, toxicity
from tidewell.llm.common import Scratch
from tidewell.llm.pretokens import WordPieces, vocabulary
from tidewell.llm.token_counts import token_counts

LONG = "the whole of it, 12 times; " * 700_000  # 18.9 million bytes, more than a batch of 16 MB


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG), (2, "the end"), (2, "the end"), (None, "the end"), (3, LONG[:-1] + "joe@mail.com")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(1)


def test_counts_and_packing(spark, docs):
    ids = WordPieces(vocabulary()).encode(["the whole of it, 12 times; "])[0]
    got = sorted(tuple(r)[:3] for r in token_counts(docs, Scratch(spark, "t")).where("doc_id IN (1, 2)").collect())
    assert got == [(1, len(LONG), 700_000 * len(ids)), (2, 7, 2), (2, 7, 2)]
    pieces = sorted(packing.pack(docs.where("doc_id = 1 OR doc_id = 2 OR doc_id IS NULL"), Scratch(spark, "t")).where("doc_id = 1").collect(), key=lambda r: r.start)
    assert sum(r.length for r in pieces) == 700_000 * len(ids) + 1
    first = np.tile(ids.astype("<u4"), 500)[: pieces[0].length]
    assert pieces[0].ids_crc32 == zlib.crc32(first.tobytes())


def test_models(spark, docs):
    found = {r.doc_id: r.spans for r in pii.personal_data(docs, None).collect() if r.doc_id}
    assert found == {1: "", 2: "", 3: f"email:{len(LONG) - 1}:{len(LONG) + 11}"}
    assert language.identify(docs, language.fit(["the end"], ["en"])).where("lang_pred = 'en'").count() == 5
    assert toxicity.toxicity(docs, toxicity.fit(["a", "b"], [0, 1])).count() == 5


def test_dropout_and_near(spark, docs):
    rows = merge_dropout.digests(merge_dropout.encode_pieces(docs)).collect()
    assert all(r.decoded for r in rows) and len({tuple(r) for r in rows if r.doc_id == 2}) == 1
    got = {r.doc_id: r.n_shingles for r in near_dedup.near_groups(docs, Scratch(spark, "t"), width=4).collect()}
    assert got == {1: 6, 2: 1, None: 1, 3: 7}
