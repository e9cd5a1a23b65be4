"""Nested JSON and Markdown export, and import of what was exported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0.0"
#: A snippet of the export file; categories are files of their own rows.
SNIPPET = "id long, content string, summary string, created_at string, source_app string, category_id long, versions array<struct<version_number: long, content: string>>"
CATEGORY = "id long, name string, parent_id long"


def nested(snippets: DataFrame, versions: DataFrame, assignments: DataFrame, categories: DataFrame, include_versions: bool = True) -> DataFrame:
    """One row a snippet: its columns, category and versions in order."""
    rows = snippets.select("id", "content", "summary", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "source_app")
    known = assignments.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_semi")
    rows = rows.join(known.select(F.col("snippet_id").alias("id"), "category_id"), "id", "left")
    if not include_versions:
        return rows.withColumn("versions", F.array().cast("array<struct<version_number: long, content: string>>"))
    lists = versions.groupBy(F.col("snippet_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("version_number", "content"))).alias("versions"))
    return rows.join(lists, "id", "left").withColumn("versions", F.coalesce("versions", F.array().cast("array<struct<version_number: long, content: string>>")))


def write_json(rows: DataFrame, categories: DataFrame, path: str) -> None:
    """A folder with a manifest, snippets and categories, as JSON lines that any number of tasks write."""
    spark = rows.sparkSession
    rows.write.json(f"{path}/snippets")
    categories.select("id", "name", "parent_id").write.json(f"{path}/categories")
    spark.createDataFrame([(VERSION,)], "version string").write.json(f"{path}/manifest")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(SNIPPET).json(f"{path}/snippets"), spark.read.schema(CATEGORY).json(f"{path}/categories")


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same from one pretty-printed document."""
    whole = spark.read.schema(f"version string, snippets array<struct<{SNIPPET.replace(' long', ': long').replace(' string', ': string').replace(' array', ': array').replace('version_number::', 'version_number:').replace('content::', 'content:')}>>, categories array<struct<id: long, name: string, parent_id: long>>").option("multiLine", True).json(path)
    return whole.select(F.inline("snippets")), whole.select(F.inline("categories"))


def merge(existing: DataFrame, imported: DataFrame, versions: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snippets, versions and assignments after an import: known ids are skipped, the imported assignments are manual and never replace one."""
    new = imported.join(existing.select("id"), "id", "left_anti")
    shared = [c for c in existing.columns if c in new.columns]
    added = new.select(*shared).withColumn("created_at", F.to_timestamp_ntz("created_at")) if "created_at" in shared else new.select(*shared)
    history = new.select(F.col("id").alias("snippet_id"), F.inline("versions"))
    given = imported.where(F.col("category_id").isNotNull()).select(F.col("id").alias("snippet_id"), "category_id", F.lit(1.0).alias("confidence"), F.lit(True).alias("is_manual"), F.lit("manual").alias("categorization_method"))
    given = given.join(assignments.select("snippet_id"), "snippet_id", "left_anti")
    return existing.unionByName(added, allowMissingColumns=True), versions.unionByName(history), assignments.unionByName(given, allowMissingColumns=True)


def markdown(snippets: DataFrame, assignments: DataFrame, categories: DataFrame) -> DataFrame:
    """id, markdown: a section a snippet."""
    named = assignments.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id").select(F.col("snippet_id").alias("id"), "name")
    text = F.concat(
        F.lit("## "), "summary", F.lit("\n\n- App: "), "source_app", F.lit("\n- Category: "), F.coalesce("name", F.lit("Uncategorized")), F.lit("\n\n"), "content", F.lit("\n\n---\n"),
    )
    return snippets.join(named, "id", "left").select("id", text.alias("markdown"))
