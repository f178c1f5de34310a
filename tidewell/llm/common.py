"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..ship import ship

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of whole texts holds in a Python worker, and sends the package there.

    The plan reads these settings when it runs, so they stay set in the session; they are the same
    for all operators, so none changes what another's plan finds.
    """
    ship(spark)
    spark.conf.set(ARROW_ROWS, "256")
    spark.conf.set(ARROW_BYTES, "16m")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, one of its own in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """A folder for the tables of one run, in the shared folder; the file system drops it at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        self._where = where
        self._fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(where)
        self._fs.deleteOnExit(where)
        self._n = 0

    def table(self, df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
        """Writes ``df`` (in folders by column ``by``) and reads it back: cuts the lineage, and a lost executor loses nothing."""
        self._n += 1
        path = f"{self.path}/{self._n}-{name}"
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(path)
        return self.read(path, df.schema)

    def read(self, path: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that ``table`` made, once nothing reads it any more."""
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            self._fs.delete(where, True)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).collect()


def join_counted(big: DataFrame, small: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Inner join on ``key`` with a table that holds each key once and in ``n`` the rows that ``big`` has for it.

    Keys with more than a thousandth of all rows (and more than 256) can be at most a thousand; they
    are broadcast, so their rows stay where they are. All others meet by a shuffle.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(small.where(F.col(n) > max(256, total // 1000)))
    cold = small.where(F.col(n) <= max(256, total // 1000))
    rest = big.join(hot.select(key), key, "left_anti").join(cold, key)
    return big.join(hot, key).unionByName(rest)


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A saved table of short keys as one side of a join: broadcast up to ``most`` rows, else shuffled."""
    return F.broadcast(df) if df.count() <= most else df.hint("shuffle_merge")


def located(docs: DataFrame, scratch: Scratch, stored: bool) -> DataFrame:
    """``docs`` with ``_file`` and ``_row``: where each row's content lies.

    ``stored`` says that ``docs`` is a plain read of Parquet files, whose places are taken; otherwise
    it is saved first. The places stay the same however often the table is read.
    """
    docs = docs if stored else scratch.table(docs, "located")
    at = docs.metadataColumn("_metadata")
    return docs.select("*", at["file_path"].alias("_file"), at["row_index"].alias("_row"))


def split_rest(col: Column, mod: int) -> Column:
    """crc32 of an id written as text, modulo ``mod``: the fixed split of learning and held-out rows."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


#: Bytes of text that a model learns from at most, whatever the number of rows.
LEARN_BYTES = 96 << 20


def sample_texts(docs: DataFrame, known: DataFrame | None, bound: int, most: int = LEARN_BYTES, seed: int = 7) -> list:
    """A bounded, documented sample to fit models on: rows (doc_id, text, and the columns of ``known``).

    ``known`` has at most one row for each doc_id; without it all ids may be picked. At most
    ``bound`` ids of ``docs`` are, by the order of their hash, as long as their texts hold at most
    ``most`` bytes in all (a text that no longer fits is passed over). Of rows that repeat an id the
    least text is taken; null text is empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    able = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("size")).where("doc_id IS NOT NULL")
    sizes = able.select("doc_id", "size") if known is None else able.select("doc_id", "size").join(known.select("doc_id"), "doc_id", "left_semi")
    order = sizes.groupBy("doc_id").agg(F.min("size").alias("size")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    picked, left = [], most
    for r in order.limit(bound).collect():
        if r["size"] <= left:
            picked.append((r["doc_id"],))
            left -= r["size"]
    if not picked:
        return []
    keys = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long"))
    least = able.join(keys, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("size", "text")).alias("t")).select("doc_id", F.col("t.text").alias("text"))
    return sorted((least if known is None else least.join(known.join(keys, "doc_id", "left_semi"), "doc_id")).collect())
