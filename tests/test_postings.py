"""The stored index gives the scores of the search over texts, also after changes, and reads only the folders of its terms."""

import pathlib
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidewell.functions.text import tokenize
from tidewell.operators import postings, search
from tidewell.operators.postings import Index
from tidewell.sources.scratch import Scratch

NOTE = "name string, description string, body string, sessions int"


def made(rng, names):
    vocab = ["alpha", "beta-max", "gamma", "al", "straße", "x1", "alphabet", "re-use", "reuse", "Delta", "İstanbul"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ",", ".\n", "-"]) for _ in range(rng.randint(0, n)))
    return [(n, rng.choice([None, text(5)]), rng.choice([None, "", text(40)]), rng.choice([None, 0, 3, 40])) for n in names]


@pytest.mark.parametrize("query", ["alpha", "beta", "reuse gamma", "re-use", "alpha alpha x1", "straße", "lph", "al", "nothing", "  ", "Delta, alpha"])
@pytest.mark.parametrize("every", [True, False])
def test_same_scores(spark, index, query, every):
    made_of, notes = index
    want = {r.name: round(r.score, 9) for r in search.rank(notes, query, every).collect()}
    assert {r.name: round(r.score, 9) for r in made_of.rank(query, every).collect()} == want
    if query in ("alpha", "reuse gamma"):
        assert want


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(4)
    old = made(rng, [f"note-{i}" for i in range(60)] + ["gone-alpha"])
    new = made(rng, [f"note-{i}" for i in range(0, 60, 4)] + ["late-alpha"])
    frame = lambda rows: spark.createDataFrame(rows, NOTE)
    it = Index(spark, f"{Scratch(spark, 't').path}/index", buckets=8)
    it.write(frame(old))
    it.write(frame(new), gone=spark.createDataFrame([("gone-alpha",)], "name string"), seg=1)
    replaced = {r[0] for r in new} | {"gone-alpha"}
    return it, frame([r for r in old if r[0] not in replaced] + new).cache()


def test_only_folders_of_the_terms_are_read(spark):
    """A query gives the same when the postings of all other runs are away."""
    it = Index(spark, f"{Scratch(spark, 't').path}/index", buckets=16)
    it.write(spark.createDataFrame(made(random.Random(9), [f"n{i}" for i in range(40)]), NOTE))
    want = sorted(map(tuple, it.rank("x1").collect()))
    words = it._get("words", "run string, seg int, bucket int")
    needed = {r.bucket for r in words.where("run LIKE '%x1%'").collect()}
    folders = [p for p in pathlib.Path(it.path.removeprefix("file:")).glob("postings/seg=0/bucket=*")]
    others = [p for p in folders if int(p.name.split("=")[1]) not in needed]
    assert others
    for p in others:
        shutil.rmtree(p)
    assert want and sorted(map(tuple, Index(spark, it.path, buckets=16).rank("x1").collect())) == want


def test_no_folder_is_one_task(spark, monkeypatch):
    """Lists and texts are written by the tasks that read the notes, in blocks of any size, and say the same."""
    monkeypatch.setattr(postings, "BLOCK", 100, raising=False)
    notes = spark.createDataFrame(made(random.Random(5), [f"n-{i}" for i in range(60)]), NOTE).repartition(3).cache()
    it = Index(spark, f"{Scratch(spark, 't').path}/index", buckets=1)
    it.write(notes)
    for what in ("texts", "postings"):
        assert len(list(pathlib.Path(it.path.removeprefix("file:")).glob(f"{what}/seg=0/bucket=0/*.parquet"))) == 3
    want = {r.name: r.size for r in notes.select("name", sum((F.size(tokenize(F.coalesce(c, F.lit("")))) for c in ("name", "description", "body")), F.lit(0)).alias("size")).collect()}
    assert {r.name: r["size"] for r in it.notes().collect()} == want
    score = lambda df: {r.name: round(r.score, 9) for r in df.collect()}
    for query in ("alpha", "re-use gamma"):
        assert score(it.rank(query, False)) == score(search.rank(notes, query, False)) != {}
