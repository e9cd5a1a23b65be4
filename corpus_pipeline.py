"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again before the next.

Null texts and texts of under 20 words go in the first stage, so a table of nothing
else, or an empty one, gives an empty result. Repeated rows pass the first three
stages and stay once in the fourth; null doc_ids stay. Columns besides those of
``documents`` are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import jaccard_join, language_id, line_templates, packing, quality_rules
from gleaner.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough of their lines."""
    return quality_rules.keep(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a centroid of some language; the classifier is fitted on this stage's input."""
    return language_id.accepted(docs, language_id.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates."""
    return line_templates.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", pack)]

#: SQL expresses neither the classifier nor the genetic packing. A test holds the packing of run() against brute force over what the stages keep; the stages are held against brute force one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
