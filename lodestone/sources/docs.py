"""The chunk table and the logs, derived from stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import table

DOCS_SCHEMA = "path string, source string, space string, title string, updated string, url string, chunk int, text string, vector array<float>"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: path, source, space, title, updated, text, doc_id."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("doc_id") * 37) % 900).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "source", F.col("lang").alias("space"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("doc_id") % 17 == 0, "").otherwise(day).alias("updated"), "text", "doc_id",
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table of the whole texts, without vectors."""
    head = ["path", "source", "space", "title", "updated", "doc_id"]
    return documents(spark, sf_dir).select(*head, F.posexplode(T.chunks(F.col("text"))).alias("chunk", "text"))


#: The same rows in DuckDB.
DOCS_SQL = """
docs_whole AS (
  SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, source, lang AS space, 'doc ' || doc_id AS title,
         CASE WHEN doc_id % 17 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(doc_id * 37 % 900 AS INTEGER), '%Y-%m-%d') END AS updated,
         text, doc_id,
         CASE WHEN length(text) <= 4000 THEN 1 ELSE 1 + CAST(ceil((length(text) - 4000) / 3800.0) AS INTEGER) END AS n
  FROM documents
),
docs_cut AS (
  SELECT path, source, space, title, updated, doc_id, i, substr(text, CAST(i * 3800 + 1 AS BIGINT), 4000) AS text
  FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM docs_whole)
),
docs AS (
  SELECT path, source, space, title, updated, doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk, text
  FROM docs_cut WHERE regexp_matches(text, '[^\\s]')
)"""


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch receipts derived from events: one batch a day; errors are owner decisions (by is set)."""
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyyMMdd-000000").alias("batch"), F.col("event_id").alias("line"),
        F.concat(F.lit("file"), F.col("user_id").cast("string"), F.lit(".txt")).alias("name"),
        F.when(F.col("event_type") == "view", "accept").when(F.col("event_type") == "click", "review").when(F.col("event_type") == "purchase", "duplicate")
        .when(F.col("event_type") == "signup", "quarantine").otherwise("reject").alias("decision"),
        F.when(F.col("event_type") == "error", "owner").alias("by"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
    )


RECEIPTS_SQL = """
receipts AS (
  SELECT strftime(ts, '%Y%m%d-000000') AS batch, event_id AS line, 'file' || user_id || '.txt' AS name,
         CASE event_type WHEN 'view' THEN 'accept' WHEN 'click' THEN 'review' WHEN 'purchase' THEN 'duplicate' WHEN 'signup' THEN 'quarantine'
              ELSE 'reject' END AS decision,
         CASE WHEN event_type = 'error' THEN 'owner' END AS "by", strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time
  FROM events
)"""


def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identity base derived from documents: path, size, mtime, sha, mid, fp, date."""
    d = documents(spark, sf_dir)
    return d.select(
        "path", F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") * 1000).alias("mtime"), F.sha2("text", 256).alias("sha"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("m"), (F.col("doc_id") % 50).cast("string"))).alias("mid"),
        F.substring(F.sha2(F.substring(F.lower("text"), 1, 200), 256), 1, 32).alias("fp"), F.nullif("updated", F.lit("")).alias("date"),
    )


KNOWN_SQL = """
known AS (
  SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id * 1000 AS mtime, sha256(text) AS sha,
         CASE WHEN doc_id % 3 = 0 THEN 'm' || (doc_id % 50) END AS mid, substr(sha256(substr(lower(text), 1, 200)), 1, 32) AS fp,
         nullif(updated, '') AS date
  FROM docs_whole
)"""
