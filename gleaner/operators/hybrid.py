"""Hybrid search: keyword and vector lists fused by reciprocal ranks, with filters and match types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.operators import search, tables, vectors


def ranked_lists(snippets: DataFrame, embeddings: DataFrame, text: str, probe: list[float] | None, as_of: Column, index=None, limit: int = fixed.SEARCH_LIMIT, floor: float = fixed.COSINE_FLOOR, semantic_rank: str = "similarity", **options: bool) -> tuple[DataFrame, DataFrame]:
    """id, position (from 1) of the keyword and of the semantic list.

    semantic_rank orders the nearest vectors: by similarity, or by recency (the newest
    snippet first; vectors without a snippet are left out), as a list that is fetched
    again by date would have it. Without a probe the semantic list is empty.
    """
    keyword = search.keyword_search(snippets, text, as_of, limit, index=index, **options).select("id", "position")
    if probe is None:
        return keyword, keyword.limit(0)
    near = vectors.top_k(embeddings, probe, limit, floor).withColumnRenamed("snippet_id", "id")
    if semantic_rank == "recency":
        near = near.join(snippets.select("id", "created_at"), "id")
    order = {"similarity": [F.desc("similarity"), "id"], "recency": [F.desc("created_at"), "id"]}[semantic_rank]
    return keyword, near.select("id", F.row_number().over(Window.orderBy(*order)).alias("position"))  # limit rows at most


def hybrid_search(snippets: DataFrame, embeddings: DataFrame, text: str, probe: list[float] | None, as_of: Column, index=None, limit: int = fixed.SEARCH_LIMIT, floor: float = fixed.COSINE_FLOOR, semantic_rank: str = "similarity", since: Column | None = None, until: Column | None = None, app: str | None = None, **options: bool) -> DataFrame:
    """Snippets of either list that pass the filters, with score (reciprocal rank fusion) and match_type (semantic if the vector found them), best first."""
    fused = vectors.fuse(*ranked_lists(snippets, embeddings, text, probe, as_of, index, limit, floor, semantic_rank, **options))
    found = tables.search_filters(snippets.join(F.broadcast(fused), "id"), since, until, app)  # 2 limit rows at most
    kind = F.when(F.col("in_semantic"), "semantic").otherwise("keyword").alias("match_type")
    return found.select(*snippets.columns, "score", kind).orderBy(F.desc("score"), "id")
