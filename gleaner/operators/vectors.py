"""Vectors: cosine, top-k, related rows, centroids, nearest-centroid classification, rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def unit(a: Column) -> Column:
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def top_k(vectors: DataFrame, query: list[float], limit: int = fixed.SEARCH_LIMIT, floor: float = fixed.COSINE_FLOOR) -> DataFrame:
    """snippet_id, similarity of the nearest vectors at or above the floor; only a heap of limit rows leaves a task."""
    scored = vectors.select("snippet_id", cosine(F.col("embedding"), F.array(*map(F.lit, map(float, query)))).alias("similarity"))
    return scored.where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), "snippet_id").limit(limit)


def _block(key: str, n: int) -> Column:
    """A row's block of n, an int like the numbers of explode(sequence): equal numbers of two types would be dealt to different tasks of a cogroup."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def nearest_to_each(vectors: DataFrame, queries: DataFrame, limit: int, floor: float = fixed.COSINE_FLOOR, block: int = 512) -> DataFrame:
    """query_id, snippet_id, similarity, position: the nearest of each query vector (query_id, embedding), itself left out.

    A stated set of queries goes against all vectors in blocks: a block of vectors is
    one matrix, and each task keeps the best of each query, so what is shuffled is
    queries x blocks x limit at most.
    """
    import numpy as np
    import pyarrow as pa

    n = max(1, -(-vectors.count() // block))
    m = max(1, -(-queries.count() // block))
    rows = vectors.select("snippet_id", "embedding", _block("snippet_id", n).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("q"))
    asked = queries.select("query_id", F.col("embedding").alias("vector"), _block("query_id", m).alias("qq"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bb"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, keys = left.column("snippet_id").to_numpy(), right.column("query_id").to_numpy()
        out = {"query_id": [], "snippet_id": [], "similarity": []}
        if len(ids) and len(keys):
            x, y = (np.array(t.column(c).to_pylist(), np.float64) for t, c in ((left, "embedding"), (right, "vector")))
            x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y))
            for key, sims in zip(keys, y @ x.T, strict=True):
                good = np.flatnonzero((sims >= floor) & (ids != key))
                for i in good[np.lexsort((ids[good], -np.round(sims[good], 9)))][:limit]:
                    out["query_id"].append(int(key))
                    out["snippet_id"].append(int(ids[i]))
                    out["similarity"].append(float(sims[i]))
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "snippet_id": pa.array(out["snippet_id"], pa.int64()), "similarity": pa.array(out["similarity"], pa.float64())})

    found = rows.groupBy("b", "q").cogroup(asked.groupBy("bb", "qq")).applyInArrow(best, "query_id long, snippet_id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "snippet_id"))
    return found.withColumn("position", place).where(F.col("position") <= limit)


def newest(assignments: DataFrame, members: int | None) -> DataFrame:
    """category_id, snippet_id of all assignments, or of each category's newest ``members``."""
    if members is not None:
        place = F.row_number().over(Window.partitionBy("category_id").orderBy(F.desc("assigned_at"), "snippet_id"))
        assignments = assignments.withColumn("__n", place).where(F.col("__n") <= members)
    return assignments.select("category_id", "snippet_id")


def centroids(vectors: DataFrame, assignments: DataFrame, members: int | None = None) -> DataFrame:
    """category_id, n, centroid: the unit mean of all members' vectors of a category, or of its newest ``members``.

    Each task sums up a category's components first, so what is shuffled after the join
    is categories x components x tasks at most, however many members a category has.
    """
    each = newest(assignments, members).join(vectors, "snippet_id").select("category_id", F.posexplode("embedding").alias("at", "x"))
    parts = each.groupBy("category_id", "at").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p.x)
    return parts.groupBy("category_id").agg(F.max("n").alias("n"), mean.alias("mean")).select("category_id", "n", unit(F.col("mean")).alias("centroid"))


def classify(vectors: DataFrame, centres: DataFrame, categories: DataFrame, floor: float = fixed.CLASSIFY_FLOOR, least: int = fixed.CENTROID_LEAST, block: int = 8192) -> DataFrame:
    """snippet_id, category_id, confidence of the nearest centroid of a category with enough members, at or above the floor; ties by name.

    Vectors are dealt to blocks by hash and each block meets all centroids as one
    matrix, so what is shuffled is the vectors, once, and centroids x blocks.
    """
    import numpy as np
    import pyarrow as pa

    n = max(1, -(-vectors.count() // block))
    named = centres.where(F.col("n") >= least).join(categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    right = named.select("category_id", "name", "centroid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    left = vectors.select("snippet_id", "embedding", _block("snippet_id", n).alias("v"))

    def nearest(rows: pa.Table, centroids: pa.Table) -> pa.Table:
        ids = rows.column("snippet_id").to_numpy()
        out = {"snippet_id": ids[:0], "category_id": ids[:0], "confidence": np.zeros(0)}
        if len(ids) and centroids.num_rows:
            ranked = centroids.sort_by("name")
            x = np.array(rows.column("embedding").to_pylist(), np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            sims = x @ np.array(ranked.column("centroid").to_pylist(), np.float64).T
            best = np.round(sims, 9).argmax(axis=1)  # the first of equals
            top = sims[np.arange(len(ids)), best]
            good = top >= floor
            out = {"snippet_id": ids[good], "category_id": ranked.column("category_id").to_numpy()[best][good], "confidence": top[good]}
        return pa.table({"snippet_id": pa.array(out["snippet_id"], pa.int64()), "category_id": pa.array(out["category_id"], pa.int64()), "confidence": pa.array(out["confidence"], pa.float64())})

    return left.groupBy("v").cogroup(right.groupBy("b")).applyInArrow(nearest, "snippet_id long, category_id long, confidence double")


def classify_new(vectors: DataFrame, assignments: DataFrame, categories: DataFrame, limit: int, **floors: float) -> DataFrame:
    """Vectors without an assignment, the first by id, classified by centroids as they are at the start."""
    new = vectors.join(assignments.select("snippet_id"), "snippet_id", "left_anti").orderBy("snippet_id").limit(limit)
    return classify(new, centroids(vectors, assignments), categories, **floors)


def fuse(keyword: DataFrame, semantic: DataFrame, k: int = fixed.RRF_K) -> DataFrame:
    """id, score, in_keyword, in_semantic from two lists of (id, position from 1), best first."""
    part = lambda d, name: d.select("id", (1.0 / (k + F.col("position"))).alias(name))
    both = part(keyword, "a").join(part(semantic, "b"), "id", "full")
    score = F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
    return both.select("id", score.alias("score"), F.col("a").isNotNull().alias("in_keyword"), F.col("b").isNotNull().alias("in_semantic")).orderBy(F.desc("score"), "id")


def search_type(keyword_hits: Column, semantic_hits: Column) -> Column:
    return F.when((keyword_hits == 0) & (semantic_hits > 0), "semantic").when((keyword_hits > 0) & (semantic_hits == 0), "keyword").otherwise("hybrid")


def embedding_input(summary: Column, content: Column) -> Column:
    return F.concat(F.coalesce(summary, F.lit("")), F.lit("\n\n"), content)
