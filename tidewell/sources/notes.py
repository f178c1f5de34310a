"""Note corpora, git history dumps, and artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T


def corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Notes (every ``*.md`` but the index) and index links (name, pos). A directory that can't be read is an error."""
    files = spark.read.option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1).alias("name"), F.col("value").alias("raw"))
    value = lambda k: T.frontmatter_value(F.col("raw"), k)
    prefix = F.substring_index("name", "_", 1)
    kind = F.when(value("type").isin(T.NOTE_TYPES), value("type")).when(prefix.isin(T.NOTE_TYPES), prefix).otherwise("project")
    notes = files.where("name <> 'MEMORY'").select("name", "raw", F.coalesce(value("description"), F.lit("")).alias("description"), kind.alias("mtype"), T.body(F.col("raw")).alias("body"), value("modified").alias("modified"), value("originSessionId").alias("origin_session"))
    index = files.where("name = 'MEMORY'").select(F.posexplode(T.index_links(F.col("raw"))).alias("pos", "name"))
    return notes, index


def index_sections(spark: SparkSession, root: str) -> DataFrame:
    """Each indexed note's first enclosing level-2 heading."""
    raw = spark.read.option("pathGlobFilter", "MEMORY.md").text(root, wholetext=True)
    line = raw.select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one index file
    heading = F.when(F.col("line").startswith("## "), F.trim(F.substr("line", F.lit(4))))
    carried = line.withColumn("section", F.last(heading, ignorenulls=True).over(w))
    each = carried.select("pos", "section", F.explode(T.index_links(F.col("line"))).alias("name")).where("section IS NOT NULL")
    return each.groupBy("name").agg(F.min_by("section", "pos").alias("section"))


def history(dump: DataFrame) -> DataFrame:
    """Commits with their file deltas from a ``git log --numstat --format='commit %H %cI'`` dump.

    ``dump`` holds repo, at (the line's place) and value. Binary rows are dropped; paths are prefixed
    by the repository, and renames keep the old name in ``was``.
    """
    w = Window.partitionBy("repo").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("value").startswith("commit "), F.struct(F.split("value", " ")[1].alias("sha"), F.split("value", " ")[2].alias("when")))
    rows = dump.withColumn("c", F.last(head, ignorenulls=True).over(w)).where(F.col("value").rlike(r"^[0-9]+\t[0-9]+\t"))
    cell = F.split("value", "\t", 3)
    at = lambda p: F.concat_ws("/", "repo", p)
    old = P.renamed_from(cell[2])
    return rows.select(F.col("c.sha").alias("sha"), F.col("c.when").alias("when"), at(P.renamed_to(cell[2])).alias("path"), F.when(old.isNotNull(), at(old)).alias("was"), cell[0].cast("long").alias("added"), cell[1].cast("long").alias("deleted"))


def save(df: DataFrame, path: str) -> None:
    """Writes an artefact; the output committer makes it appear whole or not at all."""
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An artefact, or no rows where there is none."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
