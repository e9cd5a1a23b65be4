"""Centroids kept up to date: sums and counts that assignments add to and take from, in place of a rebuild.

A state has a row for each category: ``assigned`` (its assignments), ``n`` (those with a
vector) and ``sums`` (of their vectors). A change touches the categories it names only, and
reads the vectors of its own snippets only. Where ``members`` is given, only that many of a
category's newest assignments count; then a category with more before or after a change,
whose newest members differ, is summed up anew from its assignments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.vectors import newest, unit


def _summed(rows: DataFrame, sign: Column) -> DataFrame:
    """category_id, n, sums of rows of category_id and embedding; a component is summed up by a task's own partial sums first."""
    each = rows.select("category_id", sign.alias("sign"), F.posexplode("embedding").alias("at", "x"))
    parts = each.groupBy("category_id", "at").agg(F.sum(F.col("sign") * F.col("x").cast("double")).alias("x"), F.sum("sign").alias("n"))
    sums = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p.x)
    return parts.groupBy("category_id").agg(F.max(F.when(F.col("at") == 0, F.col("n"))).alias("n"), sums.alias("sums"))


def centroid_sums(vectors: DataFrame, assignments: DataFrame, members: int | None = None) -> DataFrame:
    """category_id, assigned, n, sums."""
    kept = newest(assignments, members)
    counted = assignments.groupBy("category_id").agg(F.count("*").alias("assigned"))
    return counted.join(_summed(kept.join(vectors, "snippet_id"), F.lit(1)), "category_id", "left").select("category_id", "assigned", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("sums", F.array().cast("array<double>")).alias("sums"))


def changed_sums(state: DataFrame, changes: DataFrame, vectors: DataFrame, assignments: DataFrame, members: int | None = None) -> DataFrame:
    """The state after changes (snippet_id, old_category, new_category; null where there is none: assigned anew, or deleted). assignments are those after them."""
    moves = changes.where(~F.col("old_category").eqNullSafe(F.col("new_category")))
    ends = moves.select("snippet_id", F.explode(F.array(F.struct(F.col("old_category").alias("category_id"), F.lit(-1).alias("sign")), F.struct(F.col("new_category").alias("category_id"), F.lit(1).alias("sign")))).alias("e"))
    ends = ends.select("snippet_id", "e.category_id", "e.sign").where(F.col("category_id").isNotNull())
    delta = _summed(ends.join(vectors, "snippet_id"), F.col("sign")).withColumnsRenamed({"n": "dn", "sums": "dsums"})
    counts = ends.groupBy("category_id").agg(F.sum("sign").alias("dassigned"))
    touched = counts.join(state, "category_id", "left").join(delta, "category_id", "left")
    before = F.coalesce("assigned", F.lit(0))
    after = before + F.col("dassigned")
    touched = touched.withColumns({"before": before, "after": after})
    added = F.when(F.size(F.coalesce("sums", F.array())) == 0, F.col("dsums")).when(F.col("dsums").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "dsums", lambda a, b: a + b))
    small = F.lit(True) if members is None else (F.col("before") <= members) & (F.col("after") <= members)
    easy = touched.where(small).select("category_id", F.col("after").alias("assigned"), (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"), F.coalesce(added, F.array().cast("array<double>")).alias("sums"))
    followed = state.join(counts, "category_id", "left_anti").unionByName(easy.where(F.col("assigned") > 0))
    if members is None:
        return followed
    anew = centroid_sums(vectors, assignments.join(touched.where(~small).select("category_id"), "category_id", "left_semi"), members)
    return followed.unionByName(anew)


def centroids_of(state: DataFrame) -> DataFrame:
    """category_id, n, centroid: as vectors.centroids."""
    return state.where(F.col("n") > 0).select("category_id", "n", unit(F.transform("sums", lambda x: x / F.col("n"))).alias("centroid"))
