"""A stored inverted index over notes, so that a query reads what its terms lead to and not the corpus.

The index is a folder of segments. A segment holds, for some notes: the posting lists, in folders by the
run's hash; the dictionary of its runs; the notes with their length and sessions; and their lowered texts, in
folders by the name's hash. A list says of a run and a field (name, description, body) in which notes of a
block it stands there, and how often: places in the block and numbers, each as one text. Blocks are notes that
one task read, bounded in bytes, so lists and texts are written where the notes are read, without a shuffle,
and none grows with the corpus. A run is a
lower-case stretch of letters, digits and hyphens, from which the search terms come; so a term's weighted
frequency, and whether a note holds it anywhere, follow from the runs that contain it. A note that
changed is written anew into a new segment, and its newest segment counts; one that is gone has a row
without length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..ship import ship
from . import search

NOTE = "name string, sessions long, size long, block long, at int, seg int"
#: A run's list; or, with a name and no run, a note's place and length.
LIST = "run string, name string, field int, block long, at string, ns string"
POSTING = LIST + ", seg int, bucket int"
WORD = "run string, seg int, bucket int"
TEXT = "name string, t0 string, t1 string, t2 string, seg int, bucket int"
_FIELDS = ("name", "description", "body")
_BOOSTS = (search.NAME_BOOST, search.DESC_BOOST, 1.0)
#: Bytes of text in a block of posting lists, but for a single note's.
BLOCK = 16 << 20
#: The folder of rows without a run.
_LENGTHS = -1


def _runs(text: Column) -> Column:
    """The runs of a text with single blanks between them, and perhaps around them."""
    return F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}-]+", " ")


def _once(**columns: Column) -> Column:
    """A generator of one row, so that what follows reads the columns and doesn't make them again."""
    return F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))


def _blocks(limit: int):
    """Kernel: notes (name, and the runs of each field) to posting lists, block by block."""

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = lambda x: x.to_numpy(zero_copy_only=False)
        numbers = lambda x: pc.cast(pa.array(x), pa.string())

        def rows_of(run, name, field, at, ns):
            n = len(at)
            columns = [pa.nulls(n, pa.string()) if run is None else run, pa.nulls(n, pa.string()) if name is None else name, pa.array(np.full(n, field), pa.int32()), pa.array(np.full(n, block_id[0]), pa.int64()), at, ns]
            return pa.RecordBatch.from_arrays(columns, ["run", "name", "field", "block", "at", "ns"])

        block_id = [0]

        def block(notes):
            block_id[0] = uuid.uuid4().int >> 65
            rows = notes.num_rows
            length = np.zeros(rows)
            for field in range(len(_FIELDS)):
                cut = pc.split_pattern(notes.column(field + 1).combine_chunks(), " ")
                each = cut.flatten().dictionary_encode()
                words = each.dictionary
                key = plain(each.indices).astype(np.int64) * rows + np.repeat(np.arange(rows), plain(pc.list_value_length(cut)))
                key, n = np.unique(key, return_counts=True)
                word, note = np.divmod(key, rows)
                filled = plain(pc.binary_length(words)) > 0
                # as many terms as ``tokenize`` makes of a run
                terms = filled.astype(np.int64)
                for i in np.flatnonzero(plain(pc.match_substring(words, "-"))).tolist():
                    parts = sum(x != "" for x in words[i].as_py().split("-"))
                    terms[i] = parts + (parts > 1)
                length += np.bincount(note, weights=terms[word] * n, minlength=rows)
                some = filled[word]
                word, note, n = word[some], note[some], n[some]
                if len(word):
                    start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                    to = pa.array(np.append(start, len(word)), pa.int32())
                    joined = lambda x: pc.binary_join(pa.ListArray.from_arrays(to, numbers(x)), " ")  # noqa: E731, B023
                    yield rows_of(words.take(pa.array(word[start])), None, field, joined(note), joined(n))
            yield rows_of(None, notes.column(0).combine_chunks(), 0, numbers(np.arange(rows)), numbers(length.astype(np.int64)))

        held, size = [], 0
        for batch in batches:
            each = sum(plain(pc.binary_length(c)).astype(np.int64) for c in batch.columns[1:])
            at = 0
            for i, b in enumerate(each.tolist()):
                if size and size + b > limit:
                    held.append(batch.slice(at, i - at))
                    yield from block(pa.Table.from_batches(held))
                    held, size, at = [], 0, i
                size += b
            held.append(batch.slice(at))
        if sum(h.num_rows for h in held):
            yield from block(pa.Table.from_batches(held))

    return run


def _bucket(c: str, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


class Index:
    """The index in folder ``path``. ``buckets`` is the number of folders by hash, the same for all its segments."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _put(self, df: DataFrame, what: str, seg: int, by_bucket: bool) -> None:
        out = df.write.mode("overwrite")
        (out.partitionBy("bucket") if by_bucket else out).parquet(f"{self.path}/{what}/seg={seg}")

    def _get(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}")

    def write(self, notes: DataFrame, gone: DataFrame | None = None, seg: int = 0) -> None:
        """Adds a segment of new or changed ``notes`` (name, description, body, sessions), each name once, and of names that are ``gone``.

        The notes come last: a segment that failed before isn't seen, and writing it again replaces it.
        """
        text = {c: F.coalesce(F.col(c), F.lit("")) for c in _FIELDS}
        sessions = F.coalesce("sessions", F.lit(0)).cast("long") if "sessions" in notes.columns else F.lit(0).cast("long")
        lowered = notes.select("name", *[F.lower(text[c]).alias(f"t{i}") for i, c in enumerate(_FIELDS)])
        self._put(lowered.withColumn("bucket", _bucket("name", self.buckets)), "texts", seg, True)
        ship(self.spark)
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
        lists = notes.select("name", *[_runs(text[c]).alias(c[0]) for c in _FIELDS]).mapInArrow(_blocks(BLOCK), LIST)
        self._put(lists.withColumn("bucket", F.when(F.col("run").isNull(), _LENGTHS).otherwise(_bucket("run", self.buckets))), "postings", seg, True)
        mine = self._get("postings", POSTING).where(F.col("seg") == seg)
        self._put(mine.where(F.col("bucket") != _LENGTHS).select("run").distinct().withColumn("bucket", _bucket("run", self.buckets)), "words", seg, False)
        size = mine.where(F.col("bucket") == _LENGTHS).select("name", F.col("ns").cast("long").alias("size"), "block", F.col("at").cast("int").alias("at"))
        rows = notes.select("name", sessions.alias("sessions")).join(size, "name")
        if gone is not None:
            rows = rows.unionByName(gone.select("name", F.lit(0).cast("long").alias("sessions")), allowMissingColumns=True)
        self._put(rows, "notes", seg, False)

    def notes(self) -> DataFrame:
        """(name, seg, sessions, size, block, at) of every note that is there, by its newest segment."""
        newest = self._get("notes", NOTE).groupBy("name").agg(F.max(F.struct("seg", "sessions", "size", "block", "at")).alias("x"))
        return newest.select("name", "x.*").where("size IS NOT NULL")

    def numbers(self, terms: list[str], phrase: str, save) -> DataFrame:
        """Of notes that hold any of ``terms``: name, sessions, near (the phrase), h, size and tf, as ``search`` makes them from texts.

        The dictionary tells which folders have runs that hold the terms, and only those are read; texts are
        read for the phrase alone, from the folders of the notes found. Of either only names and numbers move.
        """
        inside = lambda c, t: c.contains(t) | (c.contains("-") & F.replace(c, F.lit("-"), F.lit("")).contains(t))
        run = F.col("run")
        some = inside(run, terms[0])
        for t in terms[1:]:
            some = some | inside(run, t)
        where = [r["bucket"] for r in self._get("words", WORD).where(some).select("bucket").distinct().collect()]  # at most ``buckets``
        tokens = F.col("tokens")
        exact = lambda t: F.size(F.filter(tokens, lambda x: x == t))
        weight = lambda t: exact(t) + F.lit(search.PREFIX) * (F.size(F.filter(tokens, lambda x: x.startswith(t))) - exact(t))
        lists = self._get("postings", POSTING).where(F.col("bucket").isin(where) & some).select("*", _once(tokens=tokenize(run)))
        often = F.element_at(F.array(*map(F.lit, _BOOSTS)), F.col("field") + 1)
        each = F.arrays_zip(F.split("at", " ").alias("at"), F.split("ns", " ").alias("n"))
        known = lists.select("seg", "block", _once(h=F.array(*[inside(run, t) for t in terms]), w=F.array(*[often * weight(t) for t in terms]), each=each))
        hits = known.select("seg", "block", "h", "w", F.inline("each").alias("at", "n"))
        n = F.col("n").cast("int")
        sums = hits.groupBy("seg", "block", F.col("at").cast("int").alias("at")).agg(
            F.array(*[F.bool_or(F.col("h")[i]) for i in range(len(terms))]).alias("h"), F.array(*[F.sum(n * F.col("w")[i]) for i in range(len(terms))]).alias("tf"),
        )
        sums = save(sums.join(self.notes(), ["seg", "block", "at"]))
        if len(terms) == 1 and " " not in phrase:
            return sums.withColumn("near", F.lit(True))
        folders = [r["bucket"] for r in sums.select(_bucket("name", self.buckets).alias("bucket")).distinct().collect()]
        holds = F.col("t0").contains(phrase) | F.col("t1").contains(phrase) | F.col("t2").contains(phrase)
        near = self._get("texts", TEXT).where(F.col("bucket").isin(folders) & holds).select("name", "seg", F.lit(True).alias("near"))
        return sums.join(near, ["name", "seg"], "left").withColumn("near", F.coalesce("near", F.lit(False)))

    def rank(self, query: str, require_all: bool = True, save=None) -> DataFrame:
        """(name, score), best first, as ``search.rank`` gives them for the notes that are there."""
        from ..sources.scratch import Scratch

        save = save or Scratch(self.spark, "search").table
        terms = search.terms_of(self.spark, query)
        if not terms:
            return self.notes().select("name", F.lit(0.0).alias("score")).where("false")
        times = {t: terms.count(t) for t in terms}
        numbers = save(self.numbers(list(times), query.strip().lower(), save))
        return search.scored(numbers, terms, times, require_all, n=self.notes().count())
