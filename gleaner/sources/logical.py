"""Logical tables over the driver's Parquet tables, each with the same derivation in SQL (``CTES``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import content_hash, initial_summary
from gleaner.sources.shared_folder import find_package

#: Every query's "now".
AS_OF = "2024-03-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "text").when(F.col("doc_id") % 3 == 1, "command").otherwise("screenshot")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("source_app"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int))").alias("created_at"),
        kind.alias("type"), F.concat(F.lit("/w/"), (F.col("doc_id") % 7).cast("string")).alias("working_directory"),
        initial_summary(F.col("text")).alias("summary"), content_hash(F.col("text")).alias("content_hash"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("snippet_id"), "embedding")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"))
    middle = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"))
    leaf = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).cast("long").alias("id"), F.col("s_name").alias("name"), (F.col("s_nationkey") + 100).cast("long").alias("parent_id"))
    return root.unionByName(middle).unionByName(leaf)


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == 0)
    return rows.select(
        F.col("vec_id").alias("snippet_id"), (F.col("label") + 100).cast("long").alias("category_id"), (F.lit(0.5) + F.col("label") / 20.0).alias("confidence"), (F.col("vec_id") % 4 == 0).alias("is_manual"),
        F.expr("timestamp_ntz '2024-01-02 00:00:00' + make_dt_interval(0, cast(vec_id as int))").alias("assigned_at"),
        F.when(F.col("vec_id") % 4 == 0, "manual").otherwise("embedding").alias("categorization_method"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("llm_reasoning"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("snippet_id"), (F.col("turn") + 1).alias("version_number"), F.col("text").alias("content"))


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("query"), F.col("ts").alias("timestamp"), F.col("value").alias("latency_ms"),
        (k % 11).alias("keyword_results"), (k % 7).alias("semantic_results"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "purchase", "running").when(F.col("event_type") == "view", "completed").otherwise(F.concat(F.lit("failed:"), F.col("event_type")))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("snippet_id"), (F.col("event_id") % 3).cast("int").alias("priority"), status.alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))


def terminal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    return rows.select(F.col("user_id").alias("session"), F.col("ts").alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "CMD_START").otherwise("CMD_END").alias("event"), F.col("props").alias("data"))


#: The same tables for DuckDB.
CTES = r"""
snippets AS (
  SELECT doc_id AS id, text AS content, source AS source_app, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS created_at,
         CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'command' ELSE 'screenshot' END AS type, '/w/' || (doc_id % 7) AS working_directory,
         substring(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '  ', ' '), 1, 50) AS summary,
         sha256(regexp_replace(regexp_replace(text, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')) AS content_hash
  FROM documents),
vectors AS (SELECT vec_id AS snippet_id, embedding FROM embeddings),
categories AS (
  SELECT (r_regionkey + 1)::BIGINT AS id, r_name AS name, NULL::BIGINT AS parent_id FROM region
  UNION ALL SELECT (n_nationkey + 100)::BIGINT, n_name, (n_regionkey + 1)::BIGINT FROM nation
  UNION ALL SELECT (s_suppkey + 1000)::BIGINT, s_name, (s_nationkey + 100)::BIGINT FROM supplier),
snippet_categories AS (
  SELECT vec_id AS snippet_id, (label + 100)::BIGINT AS category_id, 0.5::DOUBLE + label / 20.0::DOUBLE AS confidence, vec_id % 4 = 0 AS is_manual,
         TIMESTAMP '2024-01-02 00:00:00' + to_hours(vec_id) AS assigned_at,
         CASE WHEN vec_id % 4 = 0 THEN 'manual' ELSE 'embedding' END AS categorization_method, 'label ' || label AS llm_reasoning
  FROM embeddings WHERE vec_id % 2 = 0),
snippet_versions AS (SELECT conv_id AS snippet_id, turn + 1 AS version_number, text AS content FROM conversations),
search_analytics AS (
  SELECT event_id AS id, event_type AS query, ts AS timestamp, value AS latency_ms,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 11 AS keyword_results, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS semantic_results
  FROM events),
job_queue AS (
  SELECT event_id AS id, user_id AS snippet_id, (event_id % 3)::INT AS priority,
         CASE event_type WHEN 'click' THEN 'pending' WHEN 'purchase' THEN 'running' WHEN 'view' THEN 'completed' ELSE 'failed:' || event_type END AS status, ts AS created_at, ts AS updated_at
  FROM events),
terminal AS (
  SELECT user_id AS session, ts, event_id AS seq, CASE event_type WHEN 'click' THEN 'CMD_START' ELSE 'CMD_END' END AS event, props AS data
  FROM events WHERE event_type IN ('click', 'purchase'))
"""
