"""Incremental ingestion with Structured Streaming: command pairing, deduplicated appends, enrichment in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.functions import text as T
from gleaner.operators import tables, vectors

PAIR = "session string, start_ts timestamp, end_ts timestamp, cwd string, command string, exit_code int"
SLOT = "ts timestamp, cwd string, command string"


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A session has one open start: a new start replaces it, an end takes it, an end without one is dropped."""
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
    slot = state.get if state.exists else None
    found = []
    for r in rows.itertuples(index=False):
        if r.event == "CMD_START":
            slot = (r.ts.to_pydatetime(), r.cwd, r.data)
        elif r.event == "CMD_END" and slot is not None:
            code = int(r.data) if str(r.data).lstrip("+-").isdigit() else -1
            found.append((key[0], slot[0], r.ts.to_pydatetime(), slot[1], slot[2], code))
            slot = None
    if slot is not None:
        state.update(slot)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(found, columns=[c.split()[0] for c in PAIR.split(", ")])


def pair_commands(events: DataFrame) -> DataFrame:
    """Pairs of starts and ends (session, ts, seq, event, cwd, data) in a stream, keyed by session."""
    return events.groupBy("session").applyInPandasWithState(_pair, PAIR, SLOT, "append", GroupStateTimeout.NoTimeout)


def pair_commands_batch(events: DataFrame) -> DataFrame:
    """The same over a whole table, as window functions."""
    from pyspark.sql import Window

    before = F.lag(F.struct("event", "ts", "cwd", "data")).over(Window.partitionBy("session").orderBy("ts", "seq"))
    rows = events.where(F.col("event").isin("CMD_START", "CMD_END")).withColumn("b", before)
    rows = rows.where((F.col("event") == "CMD_END") & (F.col("b.event") == "CMD_START"))
    return rows.select("session", F.col("b.ts").alias("start_ts"), F.col("ts").alias("end_ts"), F.col("b.cwd").alias("cwd"), F.col("b.data").alias("command"), F.coalesce(F.col("data").try_cast("int"), F.lit(-1)).alias("exit_code"))


def recent_only(events: DataFrame, ts: str = "ts", window: str = "5 minutes") -> DataFrame:
    """Drops events whose hash came within the window before."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark(["content_hash"])


def command_rows(pairs: DataFrame, min_length: int = 30) -> DataFrame:
    """Snippets of the commands worth saving."""
    kept = pairs.where(T.worth_saving(F.col("command"), min_length))
    return kept.select(
        F.xxhash64("session", "start_ts", "command").alias("id"), F.col("command").alias("content"), F.lit("command").alias("type"), F.col("cwd").alias("working_directory"), "exit_code",
        F.col("end_ts").alias("created_at"), T.rule_summary(F.col("command")).alias("summary"), T.content_hash(F.concat("command", F.lit(":"), "cwd")).alias("content_hash"),
    )


def append_new(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends rows whose hash the table at path lacks.

    A batch goes to a folder of its own that a replay overwrites and its own lookup
    skips, so a batch that runs again after a failure leaves the same rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = read_batches(spark, path, batch.schema).where(F.col("batch") != number)
        new = tables.insert_if_absent(stored, batch)
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """What append_new has written; an empty table before its first batch."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(-1))
    return spark.read.schema(schema).option("basePath", path).parquet(path).withColumn("batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("int"))


def enrich(jobs: DataFrame, known: DataFrame, assignments: DataFrame, categories: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """New vectors and new assignments of a micro-batch of jobs (snippet_id, content, summary, type).

    Snippets with a vector are skipped. Commands of a known tool family take its
    category (pattern_match, 0.95), others the nearest centroid's (embedding, its
    cosine), the rest their keyword category (keyword, 0.9).
    """
    new = jobs.join(known.select("snippet_id"), "snippet_id", "left_anti").dropDuplicates(["snippet_id"])
    text = new.withColumn("input", vectors.embedding_input(F.col("summary"), F.col("content")))
    fresh = embed(text) if embed else known.limit(0)
    family = T.command_family(F.col("content")).getField("name")
    commands = new.where(F.col("type") == "command").select("snippet_id", F.coalesce(family, F.lit("Commands")).alias("name"), F.lit(0.95).alias("confidence"), F.lit("pattern_match").alias("categorization_method"))
    rest = new.where(F.col("type") != "command")
    floor = F.when(F.col("type") == "screenshot", 0.65).otherwise(0.75)
    near = vectors.classify(fresh, vectors.centroids(known, assignments), categories, floor=0.65)
    near = near.join(rest.select("snippet_id", "type"), "snippet_id").where(F.col("confidence") >= floor).join(categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    near = near.select("snippet_id", "name", "confidence", F.lit("embedding").alias("categorization_method"))
    words = rest.join(near.select("snippet_id"), "snippet_id", "left_anti").select("snippet_id", T.keyword_category(F.col("content")).alias("name"), F.lit(0.9).alias("confidence"), F.lit("keyword").alias("categorization_method"))
    return fresh, commands.unionByName(near).unionByName(words)
