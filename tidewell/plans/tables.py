"""The driver tables seen as the engine's own inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timeline rows: agent, project, kind, t (minute), day, n, verdict, seq, k."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.unix_date(F.to_date("ts"))
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("agent"), F.concat(F.lit("p"), k % 7).alias("project"), F.col("event_type").alias("kind"),
        (day.cast("long") * 1440 + F.hour("ts") * 60 + F.minute("ts")).alias("t"), day.alias("day"), F.lit(1).cast("long").alias("n"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("verdict"), F.col("event_id").alias("seq"), k.alias("k"), "user_id", "value", "ts",
    )


#: The same in DuckDB's SQL.
WORK = """(SELECT 'u' || user_id AS agent, 'p' || (CAST(json_extract_string(props, '$.k') AS INT) % 7) AS project, event_type AS kind,
 CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) * 1440 + hour(ts) * 60 + minute(ts) AS t,
 CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS day, CAST(1 AS BIGINT) AS n,
 CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS verdict, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id, value, ts FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript lines: file, line_no, is_prompt, is_work, n_events, is_compaction, context."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), (F.col("role") == "user").alias("is_prompt"), (F.col("role") == "assistant").alias("is_work"),
        (F.char_length("text") % 5 + 1).cast("long").alias("n_events"), (F.col("role") == "system").alias("is_compaction"), F.when(F.col("role") == "assistant", F.char_length("text").cast("long")).alias("context"), "text",
    )


LINES = """(SELECT conv_id AS file, turn AS line_no, role = 'user' AS is_prompt, role = 'assistant' AS is_work, CAST(length(text) % 5 + 1 AS BIGINT) AS n_events,
 role = 'system' AS is_compaction, CASE WHEN role = 'assistant' THEN CAST(length(text) AS BIGINT) END AS context, text FROM conversations)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: name, description, body, sessions."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("note-"), "doc_id").alias("name"), F.concat_ws(" ", "lang", "source").alias("description"), F.col("text").alias("body"), (F.col("doc_id") % 12).alias("sessions"))


def page_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as nodes, and links between them: a page links to pages 3p+1, 5p+2 and p/2 of the same table.

    The raw pages' own addresses lead nowhere in the table; these give a graph with cycles and hubs.
    """
    p = table(spark, sf_dir, "pages").select("page_id")
    n = p.count()
    nodes = p.select(F.concat(F.lit("p"), "page_id").alias("name"))
    to = F.array(F.col("page_id") * 3 + 1, F.col("page_id") * 5 + 2, F.floor(F.col("page_id") / 2))
    each = p.select("page_id", F.posexplode(to).alias("pos", "to"))
    relation = F.when(F.col("pos") == 0, "part-of").when((F.col("pos") == 1) & (F.col("page_id") % 2 == 0), "governs")
    return nodes, each.select(F.concat(F.lit("p"), "page_id").alias("src"), F.concat(F.lit("p"), F.when(F.col("page_id") % 9 == 0, F.col("to")).otherwise(F.col("to") % n)).alias("dst"), relation.alias("relation"), "pos")


NODES = "(SELECT 'p' || page_id AS name FROM pages)"
LINKS = """(SELECT 'p' || page_id AS src, 'p' || CASE WHEN page_id % 9 = 0 THEN target ELSE target % (SELECT count(*) FROM pages) END AS dst,
 CASE WHEN pos = 0 THEN 'part-of' WHEN pos = 1 AND page_id % 2 = 0 THEN 'governs' END AS relation, pos
 FROM (SELECT page_id, unnest([0, 1, 2]) AS pos, unnest([page_id * 3 + 1, page_id * 5 + 2, page_id // 2]) AS target FROM pages))"""
EDGES = f"(SELECT src, dst, arg_min(relation, pos) FILTER (relation IS NOT NULL) AS relation, min(pos) AS pos FROM {LINKS} WHERE src <> dst AND dst IN (SELECT name FROM {NODES}) GROUP BY ALL)"
EDGES = EDGES.replace("GROUP BY ALL", "GROUP BY src, dst")
