"""The queries of this folder and their SQL twins, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import byte_bpe, context_tree, digests, dual_tree, jaccard_join, language_id, line_templates, packing, prefix_trie, quality_rules, token_counts, toxicity, url_filters
from gleaner.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op2_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprints(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.report(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_url_filters, op2_digests, op3_quality_rules, op4_context_tree, op5_jaccard_join, op6_token_counts, op7_line_templates, op8_byte_bpe, op9_packing, op10_language_id, op11_toxicity, op12_dual_tree, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": url_filters.sql(), "op3_quality_rules": quality_rules.SQL, "op7_line_templates": line_templates.sql(), "op12_dual_tree": dual_tree.sql(), "op13_prefix_trie": prefix_trie.SQL}
