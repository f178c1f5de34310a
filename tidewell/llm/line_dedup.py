"""Lines that repeat across documents, by levelled sorted runs of line hashes (DataFrame operations only).

A run is a table of line hashes, bucketed and sorted by hash, with the number of documents that
hold each line and the greatest id among them. A new batch is merge-anti-joined with all runs: hashes
that none of them has become its own run, the others a short list of increments. When a level holds
``fan`` runs they are merged into one of the next level; so every hash lies in exactly one run, and a
batch meets few of them. Runs are read by bucket and in order: no shuffle of what is there already.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_counted, located

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lets a plan use that each bucket of a run is one sorted file.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def lower_ascii(text: Column) -> Column:
    """Lowers A-Z alone; pure ASCII goes by the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(text: Column, least_chars: int) -> Column:
    """For each line of ``text`` the 128-bit hash of its key, null where the key is too short."""
    keys = F.transform(F.split(text, "\n"), lambda x: lower_ascii(F.trim(x, F.lit(WHITE))))
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= least_chars, F.unhex(F.md5(k))))


class LineRuns:
    """The runs in folder ``path`` of the shared storage. A later object with the same folder goes on with them.

    ``add`` takes tables (digest, n, top) with each digest once. The list of runs is written anew,
    under a higher number, after every step; a run that failed before is not in it.
    """

    SCHEMA = "name string, level int, buckets int"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fan: int = 2):
        self.spark, self.path, self.fan = spark, path, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, int]] = []
        self.hits: list[str] = []
        self._v = 0
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            self._open()

    def _open(self) -> None:
        lists = self.spark.read.schema(f"{self.SCHEMA}, v int").parquet(f"{self.path}/manifest")
        newest = lists.where(F.col("v") == lists.agg(F.max("v")).first()[0]).orderBy("level", "name").collect()
        self._v = newest[0]["v"]
        for r in newest:
            if r["level"] < 0:
                self.hits.append(r["name"])
                continue
            self.buckets = r["buckets"]
            self.runs.append((r["name"], r["level"]))
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {r['name']} (digest BINARY, n BIGINT, top BIGINT) USING parquet LOCATION '{self.path}/{r['name']}' "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            )

    def _note(self) -> None:
        self._v += 1
        rows = [(name, level, self.buckets) for name, level in self.runs] + [(name, -1, self.buckets) for name in self.hits]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.parquet(f"{self.path}/manifest/v={self._v}")

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex[:16]}"
        laid = df.select("digest", "n", "top").repartition(self.buckets, "digest")
        laid.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _read_hits(self) -> DataFrame:
        schema = "digest binary, n bigint, top bigint"
        if not self.hits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{h}" for h in self.hits])

    def _sums(self, df: DataFrame) -> DataFrame:
        return df.groupBy("digest").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def _save_hits(self, df: DataFrame) -> str:
        name = f"hits_{uuid.uuid4().hex[:16]}"
        df.select("digest", "n", "top").write.parquet(f"{self.path}/{name}")
        return name

    def add(self, batch: DataFrame) -> None:
        """Anti-joins a batch with the runs, adds what is new as a run of level 0, and compacts."""
        self.spark.conf.set(ORDERED, "true")
        own = self._write(batch)
        if self.runs:
            mine = self.spark.table(own)
            new = reduce(lambda d, run: d.join(self.spark.table(run[0]).select("digest"), "digest", "left_anti"), self.runs, mine)
            name = self._write(new)
            self.hits.append(self._save_hits(mine.join(self.spark.table(name).select("digest"), "digest", "left_anti")))
            self._forget(own)
            own = name
        self.runs.append((own, 0))
        self._note()
        self._compact()

    def _compact(self) -> None:
        level, old = 0, []
        while sum(at == level for _, at in self.runs) >= self.fan:
            full = [name for name, at in self.runs if at == level]
            merged = reduce(DataFrame.unionByName, [self.spark.table(x) for x in full])  # no hash is in two runs
            self.runs = [r for r in self.runs if r[1] != level] + [(self._write(merged), level + 1)]
            old += full
            level += 1
        if not old:
            return
        if len(self.hits) > 1:
            old += self.hits
            self.hits = [self._save_hits(self._sums(self._read_hits()))]
        self._note()
        for name in old:
            self._forget(name)

    def common(self, least_docs: int) -> DataFrame:
        """(digest, n, top) of the lines held by at least ``least_docs`` documents of all batches."""
        hits = self._sums(self._read_hits()).select("digest", F.col("n").alias("more"), F.col("top").alias("higher"))
        parts = []
        for name, _ in self.runs:
            both = self.spark.table(name).join(hits, "digest", "left")
            total = both.select("digest", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("top", "higher").alias("top"))
            parts.append(total.where(F.col("n") >= least_docs))
        return reduce(DataFrame.unionByName, parts)

    def close(self) -> None:
        """Takes the runs out of the session's catalogue; their files stay."""
        for name, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def batch_of(lines: DataFrame) -> DataFrame:
    """(digest, n, top): each line's hash once, with the rows that hold it and their greatest doc_id."""
    each = lines.select("doc_id", F.explode(F.array_distinct(F.filter("digests", lambda x: x.isNotNull()))).alias("digest"))
    return each.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))


def without_common_lines(docs: DataFrame, scratch: Scratch, text: str = "text", least_chars: int = 40, least_docs: int = 5, batches: int = 4, fan: int = 2, stored: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text.

    A line's key is the line without white space at its ends, A-Z lowered. Lines whose key has at
    least ``least_chars`` code points and is found in at least ``least_docs`` rows go everywhere but in
    the greatest doc_id that holds it (there all of them stay, however often they repeat). Null text
    is one empty line. Every row counts as a document, also where ids repeat (all rows of the greatest
    id keep the line); a null doc_id is less than any other, and if no holder has an id all keep it.
    An empty table gives an empty result, further columns are ignored, and texts are read whole.

    The rows are dealt into ``batches`` by their place, which go through the runs one after the other.
    """
    spark = docs.sparkSession
    plain = located(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), scratch, stored)
    lines = plain.select("doc_id", "_file", "_row", line_hashes(F.col("text"), least_chars).alias("digests"), F.pmod(F.xxhash64("_file", "_row"), F.lit(batches)).cast("int").alias("part"))
    lines = scratch.table(lines.where(F.exists("digests", lambda x: x.isNotNull())), "lines", by="part")
    runs, was = LineRuns(spark, f"{scratch.path}/runs", fan=fan), spark.conf.get(ORDERED, None)
    try:
        for k in range(batches):
            runs.add(batch_of(lines.where(F.col("part") == k)))
        common = scratch.table(runs.common(least_docs), "common")
    finally:
        runs.close()
        spark.conf.unset(ORDERED) if was is None else spark.conf.set(ORDERED, was)
    # where the common lines are: the few very common ones are broadcast, the rest meets by a shuffle
    each = lines.select("doc_id", "_file", "_row", F.posexplode("digests").alias("pos", "digest")).where("digest IS NOT NULL")
    found = join_counted(each, common, "digest").where(~F.col("doc_id").eqNullSafe(F.col("top")))
    gone = found.groupBy("_file", "_row").agg(F.collect_list("pos").alias("gone"))
    split = plain.select("doc_id", F.split("text", "\n").alias("lines"), "_file", "_row").join(gone, ["_file", "_row"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return split.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
