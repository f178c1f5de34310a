"""Exact deduplication with keyed streaming state (DataFrame operations only).

A table of digests is read as a stream; the state store (RocksDB, on disk, without expiry) keeps
for each digest the number of rows, the identifier of the row that stays and its content locator (file
and row). Hits, digests that several rows share, are then checked on their full bytes, fetched by locator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, is_empty, join_counted, located, small_side

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _first() -> Column:
    """The row that stays: least id (nulls last), then least content locator."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("locator").alias("locator")))


def stream_groups(spark: SparkSession, source: str, schema, state_dir: str, sink: str, files_per_batch: int | None = None) -> DataFrame:
    """Runs the keyed state over everything new in ``source`` and returns the newest state of each digest.

    A later call with the same ``state_dir`` and ``sink`` reads only files that arrived since and
    goes on with the retained state.
    """
    settings = {
        "spark.sql.streaming.stateStore.providerClass": PROVIDER,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        # else each small store reserves megabytes of disk for its log and manifest
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        state = reader.parquet(source).groupBy("digest").agg(F.count("*").alias("group_size"), _first().alias("first"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", state_dir)
            .trigger(availableNow=True)
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{sink}/batch={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    newest = spark.read.schema(state.schema).parquet(sink).select("digest", "group_size", "first")
    # a digest's count only grows, so its greatest row is its newest
    return newest.groupBy("digest").agg(F.max(F.struct("group_size", "first")).alias("s")).select("digest", "s.group_size", "s.first")


def exact_groups(
    docs: DataFrame,
    scratch: Scratch,
    text: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    files_per_batch: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    Equal texts (after ``normalised``) form a group; the row with the least doc_id stays, and of
    rows that repeat that id the first by content locator (file and row). A null doc_id counts as
    greater than any other; null text is empty; an empty table gives an empty result; further
    columns are ignored. ``digest`` may be weak: texts that share a digest but differ in bytes are
    told apart. ``stored`` tells that ``docs`` is a plain read of Parquet files (see ``located``).
    """
    plain = docs.select("doc_id", F.col(text).alias("text"))
    return _groups(located(plain, scratch, stored), scratch, digest, files_per_batch).drop("_file", "_row")


def _groups(placed: DataFrame, scratch: Scratch, digest: Callable[[Column], Column] = sha256_hex, files_per_batch: int | None = None) -> DataFrame:
    """The groups of rows with ``_file`` and ``_row``, which the result has too."""
    spark = placed.sparkSession
    plain = placed.select("doc_id", normalised(F.col("text")).alias("norm"), "_file", "_row")
    where = F.struct(F.col("_file").alias("file"), F.col("_row").alias("row")).alias("locator")
    rows = scratch.table(plain.select("doc_id", digest(F.col("norm")).alias("digest"), where), "digests")
    at = scratch.path
    path = next(iter({f.rsplit("/", 1)[0] for f in rows.inputFiles()}), None)
    groups = stream_groups(spark, path, rows.schema, f"{at}/state", f"{at}/groups", files_per_batch)
    groups = scratch.table(groups, "newest")
    out = ["doc_id", "digest", "keep_id", "group_size", "kept", "_file", "_row"]
    found = join_counted(rows, groups, "digest", n="group_size").select(
        "doc_id", "digest", F.col("first.id").alias("keep_id"), "group_size", (F.col("locator") == F.col("first.locator")).alias("kept"),
        F.col("locator.file").alias("_file"), F.col("locator.row").alias("_row"),
    )
    found = scratch.table(found, "found")

    # Hits: of equal digests the full bytes, fetched by locator, must be equal. Equal texts combine before the shuffle.
    hits = scratch.table(found.where("group_size > 1").select("_file", "_row"), "hits")
    texts = plain.join(small_side(hits), ["_file", "_row"], "left_semi").groupBy("norm").agg(F.count("*").alias("n")).select(digest(F.col("norm")).alias("digest"))
    clash = scratch.table(texts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "clash")
    if is_empty(clash):
        return found.select(*out)
    # a digest that stands for several texts: group those rows by the texts themselves
    again = plain.withColumn("digest", digest(F.col("norm"))).withColumn("locator", where)
    again = scratch.table(again.join(clash, "digest", "left_semi"), "again")
    true = scratch.table(again.groupBy("norm").agg(F.count("*").alias("group_size"), _first().alias("first")), "true")
    redone = join_counted(again, true, "norm", n="group_size")
    redone = redone.withColumn("keep_id", F.col("first.id")).withColumn("kept", F.col("locator") == F.col("first.locator")).select(*out)
    return found.join(clash, "digest", "left_anti").select(*out).unionByName(redone)


def drop_copies(docs: DataFrame, scratch: Scratch, text: str = "text", stored: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the row that the state kept.

    One row stays of each text, that of the least doc_id (null last) and, where ids repeat, the first by
    file and row; null text is empty; ``stored`` as in ``exact_groups``. An empty table stays empty.
    """
    names = docs.columns
    placed = located(docs, scratch, stored).toDF(*[f"c{i}" for i in range(len(names))], "_file", "_row")  # whatever the names are
    id_at, text_at = (F.col(f"c{names.index(c)}") for c in ("doc_id", text))
    groups = _groups(placed.select(id_at.alias("doc_id"), text_at.alias("text"), "_file", "_row"), scratch)
    gone = scratch.table(groups.where("NOT kept").select("_file", "_row"), "gone")
    return placed.join(small_side(gone), ["_file", "_row"], "left_anti").drop("_file", "_row").toDF(*names)
