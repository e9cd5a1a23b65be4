"""All queries of the library over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions import text as T
from gleaner.operators import centroids, hybrid, names, postings, query_language, search, tables, vectors
from gleaner.plans import oracles as O
from gleaner.sources import exchange
from gleaner.sources import logical as L
from gleaner.sources.shared_folder import snapshot, temporary
from gleaner.streaming import cache

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def as_of() -> Column:
    return F.lit(L.AS_OF).cast("timestamp_ntz")


def when(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


W = O.with_tables
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


# keyword retrieval


_INDEXES: dict[tuple, postings.Index] = {}


def indexed(spark, sf_dir, tokenizer=search.tokens, stems=False) -> postings.Index:
    """The index of the snippets in sf_dir, built by the first search of an application and anew once the table's files have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, tokenizer.__name__, stems, snapshot(spark, f"{sf_dir}/documents.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = postings.Index.build(L.snippets(spark, sf_dir), temporary(spark), tokenizer, stems)
    return _INDEXES[key]


def _searched(text: str, **options: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search.keyword_search(L.snippets(spark, sf_dir), text, as_of(), index=indexed(spark, sf_dir), **options)
        return found.select("id", F.round("score", 6).alias("score"), F.round("rank", 6).alias("rank"), F.col("position").cast("long").alias("position"))

    return run


def _search(name: str, text: str, sql: str, **options: bool) -> None:
    _QUERIES[name], _SQL[name] = _searched(text, **options), sql


_search("search_keyword_and", "with thing", O.searching([(("with",), True), (("thing",), False)], "t0 > 0 AND t1 > 0"))
_search("search_keyword_prefix", "tion", O.searching([(("tion",), True)], "t0 > 0"))
_search("search_keyword_boolean_and", "lying AND beer", O.searching([(("lying",), True), (("beer",), True)], "t0 > 0 AND t1 > 0"))
_search("search_keyword_or", "lying OR beer", O.searching([(("lying",), True), (("beer",), True)], "t0 > 0 OR t1 > 0"))
_search("search_keyword_not", "thing NOT with", O.searching([(("thing",), False), (("with",), False)], "t0 > 0 AND NOT t1 > 0", scored=[0]))
_search("search_phrase", '"of the"', O.searching([(("of", "the"), False)], "t0 > 0", tail="WHERE contains(lower(content), 'of the')"))
_search("search_nested", "(lying OR beer) AND thing", O.searching([(("lying",), True), (("beer",), True), (("thing",), True)], "(t0 > 0 OR t1 > 0) AND t2 > 0"))
_NEAR = "len(list_filter(list_filter(range(1, len({0}) + 1), lambda i: {0}[i] = 'with'), lambda a: len(list_filter(range(1, len({0}) + 1), lambda b: {0}[b] = 'thing' AND abs(a - b) - 1 <= 5)) > 0)) > 0"
_search("search_proximity", "with NEAR/5 thing", O.searching([(("with",), False), (("thing",), False)], f"({_NEAR.format('c')} OR {_NEAR.format('s')})"), near=True)
_search(
    "search_synonyms", "os la",
    O.searching([(("os",), False), (("operating", "system"), False), (("la",), False)], "(t0 > 0 OR t1 > 0) AND t2 > 0"), synonyms=True,
)


@query(W("SELECT id, round(score, 6) AS score FROM scored", O.search([(("thing",), False)], "t0 > 0")[0]))
def bm25_scores(spark, sf_dir):
    tree = query_language.Words(("thing",))
    return indexed(spark, sf_dir).bm25(tree).select("id", F.round("score", 6).alias("score"))


@query(W(f"SELECT id, round(greatest(1.0, 0) * 0.8 + exp(-floor((epoch(TIMESTAMP '{L.AS_OF}') - epoch(created_at)) / 86400) / 30) * 0.2, 6)::DOUBLE AS rank FROM snippets"))
def recency_blend(spark, sf_dir):
    return L.snippets(spark, sf_dir).select("id", F.round(search.recency(F.lit(1.0), F.col("created_at"), as_of()), 6).alias("rank"))


_FUZZY = "list_filter(list_transform(regexp_split_to_array(lower(content), '\\s+'), lambda t: regexp_replace(regexp_replace(t, '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', '')), lambda t: t <> '')"
_FUZZY_FITS = "(levenshtein(t, 'thing') <= 2 AND levenshtein(t, 'thing') < 5) OR ((starts_with(t, 'thing') OR starts_with('thing', t)) AND abs(strlen(t) - 5) <= 2)"


@query(W(f"SELECT id FROM snippets WHERE len(list_filter({_FUZZY.format()}, lambda t: {_FUZZY_FITS})) > 0"))
def search_fuzzy(spark, sf_dir):
    return L.snippets(spark, sf_dir).where(search.fuzzy_match(F.col("content"), "thing")).select("id")


_MANY = """
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
post AS (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+') || regexp_extract_all(lower(summary), '[a-z0-9]+')) AS term FROM snippets),
dl AS (SELECT id, count(*) AS dl FROM post GROUP BY 1), corpus AS (SELECT count(*) AS n, avg(dl) AS average FROM dl),
tf AS (SELECT term, id, count(*) AS t FROM post SEMI JOIN q USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
part AS (SELECT term, id, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * (t * 2.2::DOUBLE / (t + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / average))) AS p FROM tf JOIN df USING (term) JOIN dl USING (id), corpus),
hit AS (SELECT query_id, id, sum(p) AS score, count(*) AS have FROM q JOIN part USING (term) GROUP BY ALL),
fit AS (SELECT hit.*, have = terms AS whole, max(have) OVER (PARTITION BY query_id) = terms AS found FROM hit JOIN (SELECT query_id, count(*) AS terms FROM q GROUP BY 1) USING (query_id)),
full_hit AS (SELECT * FROM fit WHERE whole OR NOT found)
"""


_MANY_BEST = W("SELECT query_id, id, round(score, 6) AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS position FROM full_hit) WHERE position <= 10", _MANY)


def _batch(spark, sf_dir, **options) -> DataFrame:
    asked = L.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("term"))
    return indexed(spark, sf_dir).search_many(asked, any_term=True, **options).select("query_id", "id", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"))


@query(_MANY_BEST)
def search_batched(spark, sf_dir):
    return _batch(spark, sf_dir)


@query(_MANY_BEST)
def search_batched_pruned(spark, sf_dir):
    """As search_batched on any number of rows: only rows that can be among the best are scored in full."""
    return _batch(spark, sf_dir, direct=0)


_STEMS = O.stem_search(["thing", "beer", "et"], "t0 > 0 OR t1 > 0 OR t2 > 0")


@query(W("SELECT id, round(score, 6) AS score FROM scored", _STEMS[0]))
def search_stemmed(spark, sf_dir):
    """Every row with a word of one of three stems, accents aside, by the stored index and its dictionary."""
    tree = query_language.parse("Things OR beers OR été", False)
    tree = query_language.Or(tuple(query_language.Words(p.tokens) for p in tree.parts))
    return indexed(spark, sf_dir, search.unicode_tokens, True).bm25(tree, stemmed=True).select("id", F.round("score", 6).alias("score"))


_CHANGED = r"""
base AS (SELECT * FROM snippets WHERE type <> 'command'),
fresh AS (SELECT * FROM snippets WHERE id IN (SELECT min(id) FROM snippets WHERE type = 'command' AND content_hash NOT IN (SELECT content_hash FROM base) GROUP BY content_hash)),
stored AS (SELECT * FROM base UNION ALL SELECT * FROM fresh),
newest AS (SELECT snippet_id, arg_max(content, version_number) AS new FROM snippet_versions GROUP BY 1),
final AS (
  SELECT s.id, s.created_at, coalesce(new, s.content) AS content,
         CASE WHEN new IS NULL THEN s.summary ELSE substring(replace(replace(replace(new, chr(10), ' '), chr(13), ' '), '  ', ' '), 1, 50) END AS summary
  FROM stored s LEFT JOIN newest ON snippet_id = s.id
  WHERE s.id IN (SELECT min(id) FROM stored GROUP BY content_hash))
"""
_AFTER = O.search([(("thing",), False), (("beer",), True)], "t0 > 0 OR t1 > 0")[0].replace("FROM snippets", "FROM final")


@query(W("SELECT id, round(score, 6) AS score FROM scored", _CHANGED + "," + _AFTER))
def search_after_changes(spark, sf_dir):
    """An index of all snippets but commands; then commands come in, every snippet with versions becomes its newest one, repeats go, and segments are merged in between."""
    rows = L.snippets(spark, sf_dir)
    index = postings.Index.build(rows.where("type <> 'command'"), temporary(spark))
    stored = postings.insert(index, rows.where("type <> 'command'"), rows.where("type = 'command'"))
    newest = L.versions(spark, sf_dir).groupBy("snippet_id").agg(F.max_by("content", "version_number").alias("new"))
    edited = stored.join(newest, stored["id"] == newest["snippet_id"]).select("id", F.col("new").alias("content"), T.initial_summary(F.col("new")).alias("summary"))
    index.change(edited)
    index.compact()
    postings.delete(index, stored, tables.repeats(stored))
    found = index.bm25(query_language.Or((query_language.Words(("thing",)), query_language.Words(("beer",), True))))
    return found.select("id", F.round("score", 6).alias("score"))


@query()
def index_stemmed(spark, sf_dir):
    index = search.build_index(L.snippets(spark, sf_dir))
    return index.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("df"))


@query()
def highlight(spark, sf_dir):
    return L.snippets(spark, sf_dir).select("id", search.highlight(F.col("content"), 'thing "of the"').alias("html"))


# vectors and fusion


def _probe(spark, sf_dir) -> list[float]:
    return [float(x) for x in L.embeddings(spark, sf_dir).where(F.col("snippet_id") == 7).first()["embedding"]]


_TOP = "probe AS (SELECT embedding AS e FROM vectors WHERE snippet_id = 7), top AS (SELECT snippet_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS similarity FROM vectors, probe WHERE list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) >= 0.3 ORDER BY similarity DESC, snippet_id LIMIT 10)"


@query(W("SELECT snippet_id, round(similarity, 6) AS similarity FROM top", _TOP))
def vector_topk(spark, sf_dir):
    return vectors.top_k(L.embeddings(spark, sf_dir), _probe(spark, sf_dir)).select("snippet_id", F.round("similarity", 6).alias("similarity"))


@query(
    W(
        "SELECT query_id, snippet_id, round(similarity, 6) AS similarity, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, snippet_id) AS position FROM sims) WHERE position <= 5",
        "sims AS (SELECT q.snippet_id AS query_id, v.snippet_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM vectors q, vectors v WHERE q.snippet_id % 50 = 0 AND v.snippet_id <> q.snippet_id AND list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.3)",
    )
)
def related_snippets(spark, sf_dir):
    rows = L.embeddings(spark, sf_dir)
    asked = rows.where(F.col("snippet_id") % 50 == 0).select(F.col("snippet_id").alias("query_id"), "embedding")
    return vectors.nearest_to_each(rows, asked, 5).select("query_id", "snippet_id", F.round("similarity", 6).alias("similarity"), F.col("position").cast("long").alias("position"))


@query(W("SELECT category_id, n, i AS pos, round(c[i], 6) AS x FROM centroid, unnest(range(1, len(c) + 1)) AS u(i)", O.CENTROIDS))
def category_centroids(spark, sf_dir):
    found = vectors.centroids(L.embeddings(spark, sf_dir), L.assignments(spark, sf_dir))
    return found.select("category_id", "n", F.posexplode("centroid").alias("pos", "x")).select("category_id", "n", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


_FINAL = """
final AS (
  SELECT snippet_id, CASE WHEN is_manual OR confidence <= 0.8 THEN category_id ELSE 100 + (category_id - 99) % 10 END AS category_id, assigned_at
  FROM snippet_categories WHERE is_manual OR confidence > 0.5)
"""


@query(W("SELECT category_id, n, i AS pos, round(c[i], 6) AS x FROM centroid, unnest(range(1, len(c) + 1)) AS u(i)", _FINAL + "," + O.CENTROIDS.replace("snippet_categories", "final")))
def centroids_after_changes(spark, sf_dir):
    """Sums of the assignments that aren't manual; then manual ones come in, the surest others move on to the next category, and the least sure ones go."""
    rows, all_of_them = L.embeddings(spark, sf_dir), L.assignments(spark, sf_dir)
    manual, sure = F.col("is_manual"), F.col("confidence") > 0.8
    following = (F.lit(100) + (F.col("category_id") - 99) % 10).cast("long")
    changes = all_of_them.select(
        "snippet_id", F.when(~manual, F.col("category_id")).alias("old_category"), F.when(manual | ~sure & (F.col("confidence") > 0.5), F.col("category_id")).when(sure, following).alias("new_category")
    )
    final = all_of_them.join(changes.select("snippet_id", "new_category"), "snippet_id").where("new_category is not null").select("snippet_id", F.col("new_category").alias("category_id"), "assigned_at")
    state = centroids.changed_sums(centroids.centroid_sums(rows, all_of_them.where(~manual)), changes, rows, final)
    return centroids.centroids_of(state).select("category_id", "n", F.posexplode("centroid").alias("pos", "x")).select("category_id", "n", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(O.nearest(""))
def nearest_centroid(spark, sf_dir):
    rows = L.embeddings(spark, sf_dir)
    found = vectors.classify(rows, vectors.centroids(rows, L.assignments(spark, sf_dir)), L.categories(spark, sf_dir), floor=0.3)
    return found.select("snippet_id", "category_id", F.round("confidence", 6).alias("confidence"))


@query(O.nearest("WHERE snippet_id NOT IN (SELECT snippet_id FROM snippet_categories) ORDER BY snippet_id LIMIT 50"))
def classify_uncategorized(spark, sf_dir):
    found = vectors.classify_new(L.embeddings(spark, sf_dir), L.assignments(spark, sf_dir), L.categories(spark, sf_dir), 50, floor=0.3)
    return found.select("snippet_id", "category_id", F.round("confidence", 6).alias("confidence"))


def _lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return hybrid.ranked_lists(L.snippets(spark, sf_dir), L.embeddings(spark, sf_dir), "thing", _probe(spark, sf_dir), as_of(), indexed(spark, sf_dir))


_KW = O.search([(("thing",), True)], "t0 > 0")[0]
_FUSE = f"{_KW}, {_TOP}, sem AS (SELECT snippet_id AS id, row_number() OVER (ORDER BY similarity DESC, snippet_id) AS p FROM top), fused AS (SELECT coalesce(r.id, s.id) AS id, coalesce(1.0::DOUBLE / (60 + r.position), 0) + coalesce(1.0::DOUBLE / (60 + s.p), 0) AS score, r.id IS NOT NULL AS in_keyword, s.id IS NOT NULL AS in_semantic FROM ranked r FULL JOIN sem s ON r.id = s.id)"


@query(W("SELECT id, round(score, 6) AS score, in_keyword, in_semantic FROM fused", _FUSE))
def rrf_fusion(spark, sf_dir):
    return vectors.fuse(*_lists(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(W("SELECT id, round(score, 6) AS score, CASE WHEN in_semantic THEN 'semantic' ELSE 'keyword' END AS match_type, source_app FROM fused JOIN (SELECT id, source_app FROM snippets WHERE contains(lower(source_app), 'src1') AND created_at >= TIMESTAMP '2024-01-03 00:00:00') USING (id)", _FUSE))
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir, "similarity")


def _hybrid(spark, sf_dir, semantic_rank: str) -> DataFrame:
    found = hybrid.hybrid_search(L.snippets(spark, sf_dir), L.embeddings(spark, sf_dir), "thing", _probe(spark, sf_dir), as_of(), indexed(spark, sf_dir), semantic_rank=semantic_rank, since=when("2024-01-03 00:00:00"), app="SRC1")
    return found.select("id", F.round("score", 6).alias("score"), "match_type", "source_app")


@query(W("SELECT id, round(score, 6) AS score, CASE WHEN in_semantic THEN 'semantic' ELSE 'keyword' END AS match_type, source_app FROM fused JOIN (SELECT id, source_app FROM snippets WHERE contains(lower(source_app), 'src1') AND created_at >= TIMESTAMP '2024-01-03 00:00:00') USING (id)", _FUSE.replace("ORDER BY similarity DESC, snippet_id) AS p FROM top", "ORDER BY created_at DESC, snippet_id) AS p FROM top JOIN snippets ON snippets.id = snippet_id")))
def hybrid_search_recency(spark, sf_dir):
    """The semantic list in order of dates."""
    return _hybrid(spark, sf_dir, "recency")


@query(W("SELECT content_hash, n, id, position FROM (SELECT content_hash, id, count(*) OVER (PARTITION BY content_hash) AS n, row_number() OVER (PARTITION BY content_hash ORDER BY created_at, id) AS position FROM snippets WHERE content_hash IS NOT NULL) WHERE n > 1"))
def duplicate_members(spark, sf_dir):
    return tables.duplicate_members(L.snippets(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@query(W("SELECT max_id + row_number() OVER (ORDER BY app) AS id, app AS app_name FROM (SELECT DISTINCT trim(source_app) AS app FROM snippets WHERE trim(source_app) <> ''), (SELECT max(id) AS max_id FROM categories)"))
def app_folders(spark, sf_dir):
    """Folders of all snippets' apps, made where there is none."""
    rows = L.snippets(spark, sf_dir)
    made = tables.app_folders(L.categories(spark, sf_dir), rows.select("source_app"), as_of())
    return made.where("is_app_folder").select("id", "app_name")


@query(W("SELECT id FROM snippets WHERE created_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AND contains(lower(source_app), 'src1') AND id IN (SELECT snippet_id FROM vectors)"))
def search_filters(spark, sf_dir):
    return tables.search_filters(L.snippets(spark, sf_dir), when("2024-01-05 00:00:00"), when("2024-01-20 00:00:00"), "Src1", True, L.embeddings(spark, sf_dir)).select("id")


@query(W("SELECT id, CASE WHEN keyword_results = 0 AND semantic_results > 0 THEN 'semantic' WHEN keyword_results > 0 AND semantic_results = 0 THEN 'keyword' ELSE 'hybrid' END AS search_type FROM search_analytics"))
def search_type(spark, sf_dir):
    return L.search_events(spark, sf_dir).select("id", vectors.search_type(F.col("keyword_results"), F.col("semantic_results")).alias("search_type"))


@query(W("SELECT snippet_id FROM vectors SEMI JOIN snippets ON snippets.id = vectors.snippet_id"))
def orphan_vectors(spark, sf_dir):
    return tables.drop_orphans(L.embeddings(spark, sf_dir), L.snippets(spark, sf_dir)).select("snippet_id")


@query(W("SELECT snippet_id, len(embedding)::BIGINT AS n FROM vectors WHERE snippet_id IN (SELECT snippet_id FROM job_queue WHERE status = 'completed')"))
def vector_multi_get(spark, sf_dir):
    done = L.jobs(spark, sf_dir).where("status = 'completed'").select("snippet_id")
    return tables.vectors_of(L.embeddings(spark, sf_dir), done).select("snippet_id", F.size("embedding").cast("long").alias("n"))


# analytics


@query(W("SELECT count(*) AS total_searches, round(coalesce(avg(latency_ms), 0), 6) AS avg_latency_ms, coalesce(sum(keyword_results), 0)::BIGINT AS keyword_results, coalesce(sum(semantic_results), 0)::BIGINT AS semantic_results, round(sum(keyword_results) / count(*), 6) AS keyword_hit_rate, round(sum(semantic_results) / count(*), 6) AS semantic_hit_rate FROM search_analytics WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00'"))
def search_stats(spark, sf_dir):
    found = tables.search_stats(L.search_events(spark, sf_dir), when("2024-01-10 00:00:00"))
    return found.withColumns({c: F.round(c, 6) for c in ("avg_latency_ms", "keyword_hit_rate", "semantic_hit_rate")})


@query(W("SELECT query, count(*) AS n FROM search_analytics WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY query ORDER BY n DESC, query LIMIT 10"))
def popular_queries(spark, sf_dir):
    return tables.popular_queries(L.search_events(spark, sf_dir), when("2024-01-10 00:00:00"))


@query(W("SELECT id FROM search_analytics WHERE timestamp >= TIMESTAMP '2024-01-15 00:00:00'"))
def analytics_retention(spark, sf_dir):
    return tables.retained(L.search_events(spark, sf_dir), when("2024-01-15 00:00:00")).select("id")


@query(W("SELECT DISTINCT source_app FROM snippets WHERE source_app IS NOT NULL AND source_app <> '' ORDER BY 1"))
def source_apps(spark, sf_dir):
    return tables.source_apps(L.snippets(spark, sf_dir))


@query(W("SELECT 'snippets' AS name, count(*) AS n FROM snippets UNION ALL SELECT 'categories', count(*) FROM categories UNION ALL SELECT 'vectors', count(*) FROM vectors"))
def storage_stats(spark, sf_dir):
    return tables.storage_stats(snippets=L.snippets(spark, sf_dir), categories=L.categories(spark, sf_dir), vectors=L.embeddings(spark, sf_dir))


@query(W("SELECT type, count(*) AS n FROM snippets GROUP BY type"))
def type_counts(spark, sf_dir):
    return tables.type_counts(L.snippets(spark, sf_dir))


# scans


@query(W("SELECT id FROM snippets"))
def all_ids(spark, sf_dir):
    return L.snippets(spark, sf_dir).select("id")


@query(W(f"SELECT id, content, {STAMP.format('created_at')} FROM snippets WHERE id = 42"))
def snippet_by_id(spark, sf_dir):
    return L.snippets(spark, sf_dir).where("id = 42").select("id", "content", stamp("created_at"))


@query(W("SELECT id, type FROM snippets WHERE id IN (3, 5, 8, 13)"))
def snippets_by_ids(spark, sf_dir):
    return tables.by_ids(L.snippets(spark, sf_dir), [3, 5, 8, 13]).select("id", "type")


@query(W("SELECT snippet_id, version_number, content FROM snippet_versions WHERE snippet_id = 3"))
def version_history(spark, sf_dir):
    return tables.newest_versions(L.versions(spark, sf_dir), 3)


@query(W("SELECT snippet_id, category_id, round(confidence, 6) AS confidence, is_manual FROM snippet_categories WHERE snippet_id = 4"))
def snippet_category(spark, sf_dir):
    return L.assignments(spark, sf_dir).where("snippet_id = 4").select("snippet_id", "category_id", F.round("confidence", 6).alias("confidence"), "is_manual")


# categories


@query(O.closed("SELECT ancestor, descendant FROM closure"))
def category_closure(spark, sf_dir):
    return tables.closure(L.categories(spark, sf_dir))


@query(O.closed("SELECT id, name FROM categories WHERE id IN (SELECT ancestor FROM closure JOIN snippet_categories ON category_id = descendant JOIN snippets ON snippets.id = snippet_id WHERE type = 'screenshot')"))
def categories_by_type(spark, sf_dir):
    return tables.with_content(L.categories(spark, sf_dir), L.assignments(spark, sf_dir), L.snippets(spark, sf_dir), "screenshot").select("id", "name")


@query(W("SELECT c.id, c.name, count(DISTINCT s.id) AS n FROM categories c LEFT JOIN snippet_categories sc ON sc.category_id = c.id LEFT JOIN snippets s ON s.id = sc.snippet_id GROUP BY ALL"))
def category_counts(spark, sf_dir):
    return tables.category_counts(L.categories(spark, sf_dir), L.assignments(spark, sf_dir), L.snippets(spark, sf_dir))


@query(W(f"SELECT DISTINCT s.id, s.type, {STAMP.format('assigned_at')} FROM snippets s JOIN snippet_categories sc ON sc.snippet_id = s.id WHERE sc.category_id = 103 ORDER BY assigned_at DESC, s.id LIMIT 10 OFFSET 5"))
def snippets_by_category(spark, sf_dir):
    return tables.in_category(L.snippets(spark, sf_dir), L.assignments(spark, sf_dir), 103, 10, 5).select("id", "type", stamp("assigned_at"))


@query(W("SELECT snippet_id, category_id, name, round(confidence, 6) AS confidence, categorization_method, llm_reasoning FROM snippet_categories JOIN categories ON categories.id = category_id"))
def categorization_reasoning(spark, sf_dir):
    return tables.reasoning(L.assignments(spark, sf_dir), L.categories(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(W("SELECT r.id, r.name, coalesce(string_agg(k.name, ', ' ORDER BY k.name), '') AS children FROM categories r LEFT JOIN categories k ON k.parent_id = r.id WHERE r.parent_id IS NULL GROUP BY ALL"))
def category_tree(spark, sf_dir):
    return tables.tree(L.categories(spark, sf_dir))


@query(W("SELECT id FROM snippets WHERE type = 'screenshot' AND id NOT IN (SELECT snippet_id FROM snippet_categories) ORDER BY created_at DESC, id LIMIT 20 OFFSET 10"))
def uncategorized(spark, sf_dir):
    rows = tables.without_category(L.snippets(spark, sf_dir).where("type = 'screenshot'"), L.assignments(spark, sf_dir))
    return tables.page(rows, [F.desc("created_at"), "id"], 20, 10).select("id")


@query(W("SELECT id, name, parent_id FROM categories UNION ALL SELECT (SELECT max(id) FROM categories) + row_number() OVER (ORDER BY key), name, NULL FROM (SELECT DISTINCT ON (key) key, name FROM (SELECT p_brand AS name, lower(replace(p_brand, '_', ' ')) AS key FROM part)) WHERE replace(key, '-', ' ') NOT IN (SELECT lower(name) FROM categories)"))
def create_categories(spark, sf_dir):
    new = L.read(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct().withColumn("parent_id", F.lit(None).cast("long"))
    return tables.create_categories(L.categories(spark, sf_dir), new)


@query(O.closed("SELECT id FROM categories WHERE id NOT IN (SELECT descendant FROM closure WHERE ancestor = 1)"))
def delete_subtree(spark, sf_dir):
    return tables.delete_subtree(1, L.categories(spark, sf_dir), L.assignments(spark, sf_dir), L.snippets(spark, sf_dir), L.embeddings(spark, sf_dir))[0].select("id")


@query(W("SELECT s.id, k.name AS category, k.name IS NOT NULL AS is_categorized FROM snippets s LEFT JOIN snippet_categories sc ON sc.snippet_id = s.id LEFT JOIN categories k ON k.id = sc.category_id WHERE s.type = 'screenshot' AND s.content ILIKE '%thing%' ORDER BY s.id LIMIT 20"))
def screenshot_status(spark, sf_dir):
    return tables.screenshot_status(L.snippets(spark, sf_dir), L.assignments(spark, sf_dir), L.categories(spark, sf_dir), "thing")


# duplicates, versions, assignments


@query(W("SELECT content_hash, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY created_at, id) AS ids FROM snippets GROUP BY 1 HAVING count(*) > 1"))
def duplicate_groups(spark, sf_dir):
    return tables.duplicate_groups(L.snippets(spark, sf_dir)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(W("SELECT count(*) AS total, count(DISTINCT content_hash) AS unique_hashes, (SELECT count(*) FROM (SELECT content_hash FROM snippets GROUP BY 1 HAVING count(*) > 1)) AS groups, count(*) - count(DISTINCT content_hash) AS duplicates, round((count(*) - count(DISTINCT content_hash)) / count(*), 6) AS rate FROM snippets"))
def duplicate_stats(spark, sf_dir):
    return tables.duplicate_stats(L.snippets(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(W("SELECT id FROM snippets QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY created_at, id) = 1"))
def merge_keep_oldest(spark, sf_dir):
    return tables.keep_oldest(L.snippets(spark, sf_dir)).select("id")


_TYPED = "typed AS (SELECT *, CASE type WHEN 'command' THEN sha256(" + O.TRIMMED.format("(content || ':' || working_directory)") + ") WHEN 'screenshot' THEN NULL ELSE content_hash END AS h FROM snippets)"


@query(W("SELECT id, h AS content_hash FROM typed WHERE type <> 'command' UNION ALL SELECT id, h FROM typed WHERE type = 'command' QUALIFY row_number() OVER (PARTITION BY h ORDER BY created_at, id) = 1", _TYPED))
def command_dedup(spark, sf_dir):
    rows = tables.with_hash(L.snippets(spark, sf_dir))
    return rows.where("type <> 'command'").unionByName(tables.keep_oldest(rows.where("type = 'command'"))).select("id", "content_hash")


@query(W("SELECT id FROM (SELECT * FROM snippets WHERE id % 2 = 1) n WHERE content_hash NOT IN (SELECT content_hash FROM snippets WHERE id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY id) = 1"))
def insert_if_absent(spark, sf_dir):
    rows = L.snippets(spark, sf_dir)
    return tables.insert_if_absent(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")).select("id")


@query(W("SELECT id FROM snippets WHERE id % 2 = 1 AND content_hash IN (SELECT content_hash FROM snippets WHERE id % 2 = 0 AND type = 'text')"))
def find_duplicates(spark, sf_dir):
    rows = L.snippets(spark, sf_dir)
    return tables.find_duplicates(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "text").select("id")


_ASSIGNED = "every AS (SELECT * FROM snippet_categories UNION ALL SELECT snippet_id, category_id + 1, 1.0, true, assigned_at + INTERVAL 1 HOUR, 'manual', NULL FROM snippet_categories WHERE snippet_id % 6 = 0)"


@query(W(f"SELECT snippet_id, category_id, round(confidence, 6) AS confidence, is_manual, {STAMP.format('assigned_at')}, categorization_method, llm_reasoning FROM every QUALIFY row_number() OVER (PARTITION BY snippet_id ORDER BY assigned_at DESC, category_id DESC) = 1", _ASSIGNED))
def latest_assignment(spark, sf_dir):
    rows = L.assignments(spark, sf_dir)
    later = rows.where("snippet_id % 6 = 0").select("snippet_id", (F.col("category_id") + 1).alias("category_id"), F.lit(1.0).alias("confidence"), F.lit(True).alias("is_manual"), F.expr("assigned_at + INTERVAL 1 HOUR").alias("assigned_at"), F.lit("manual").alias("categorization_method"), F.lit(None).cast("string").alias("llm_reasoning"))
    return tables.latest_assignment(rows.unionByName(later)).withColumn("assigned_at", stamp("assigned_at")).withColumn("confidence", F.round("confidence", 6))


@query(W("SELECT snippet_id, content, row_number() OVER (PARTITION BY snippet_id ORDER BY version_number) AS version_number FROM snippet_versions"))
def version_numbering(spark, sf_dir):
    return tables.numbered_versions(L.versions(spark, sf_dir), "version_number").select("snippet_id", "content", F.col("version_number").cast("long").alias("version_number"))


@query(W("SELECT snippet_id, version_number, content FROM snippet_versions UNION ALL SELECT 3, (SELECT count(*) FROM snippet_versions WHERE snippet_id = 3) + 1, content FROM snippets WHERE id = 3"))
def edit_history(spark, sf_dir):
    return tables.edit(L.snippets(spark, sf_dir), L.versions(spark, sf_dir), 3, "new text", as_of())[1]


# filters, jobs, suggestions


@query(W("SELECT id FROM snippets WHERE type = 'command' AND (content ILIKE '%thing%' OR summary ILIKE '%thing%') AND working_directory = '/w/3' ORDER BY created_at DESC, id LIMIT 100"))
def saved_commands(spark, sf_dir):
    return tables.saved_commands(L.snippets(spark, sf_dir), "thing", "/w/3").select("id")


@query(W("(SELECT id, 'summary' AS field, false AS in_caption FROM snippets WHERE summary ILIKE '%the%' ORDER BY id LIMIT 10) UNION ALL (SELECT id, 'content', content ILIKE '%[Caption: the%' FROM snippets WHERE content ILIKE '%the%' ORDER BY id LIMIT 10)"))
def text_search_fields(spark, sf_dir):
    return tables.text_search(L.snippets(spark, sf_dir), "the")


@query(W("SELECT j.id, j.snippet_id, j.priority, s.summary FROM job_queue j LEFT JOIN snippets s ON s.id = j.snippet_id WHERE status IN ('pending', 'running')"))
def pending_jobs(spark, sf_dir):
    return tables.pending_jobs(L.jobs(spark, sf_dir), L.snippets(spark, sf_dir)).select("id", "snippet_id", "priority", "summary")


@query(W("SELECT id FROM job_queue WHERE NOT ((status = 'completed' OR status LIKE 'failed:%') AND updated_at < TIMESTAMP '2024-01-20 00:00:00')"))
def job_cleanup(spark, sf_dir):
    return tables.finished_jobs_dropped(L.jobs(spark, sf_dir), when("2024-01-20 00:00:00")).select("id")


@query(W("SELECT id, CASE WHEN status = 'running' THEN 'pending' ELSE status END AS status FROM job_queue"))
def job_recovery(spark, sf_dir):
    return tables.recovered_jobs(L.jobs(spark, sf_dir)).select("id", "status")


@query(W("SELECT id, CASE WHEN status = 'pending' AND id % 3 = 0 THEN 'running' WHEN status = 'running' AND id % 3 = 1 THEN 'completed' WHEN status = 'running' AND id % 3 = 2 THEN 'failed:timeout' ELSE status END AS status FROM job_queue"))
def job_transitions(spark, sf_dir):
    rows = L.jobs(spark, sf_dir)
    events = rows.select("id", F.element_at(F.array(*map(F.lit, ("start", "complete", "fail"))), (F.col("id") % 3 + 1).cast("int")).alias("event"), F.lit("timeout").alias("error"))
    return tables.moved_jobs(rows, events, as_of()).select("id", "status")


@query(W("SELECT id AS snippet_id FROM snippets WHERE id NOT IN (SELECT snippet_id FROM vectors) AND id NOT IN (SELECT snippet_id FROM job_queue WHERE status IN ('pending', 'running'))"))
def job_enqueue(spark, sf_dir):
    return tables.enqueue(L.jobs(spark, sf_dir), L.snippets(spark, sf_dir).select(F.col("id").alias("snippet_id")), L.embeddings(spark, sf_dir))


_ARCHIVE = "SELECT id FROM snippets WHERE created_at < TIMESTAMP '2024-01-10 00:00:00' AND id NOT IN (SELECT snippet_id FROM snippet_categories WHERE is_manual) ORDER BY created_at, id LIMIT 10"


@query(W(_ARCHIVE))
def archive_candidates(spark, sf_dir):
    return tables.archive_candidates(L.snippets(spark, sf_dir), L.assignments(spark, sf_dir), when("2024-01-10 00:00:00")).select("id")


_TAG_RULES = "list_filter([CASE WHEN contains(l, 'function') OR contains(l, 'def ') OR contains(l, 'const ') THEN 'code' END, CASE WHEN contains(l, 'import react') OR contains(l, 'usestate') OR contains(l, 'jsx') THEN 'react' END, CASE WHEN contains(l, 'fn ') OR contains(l, 'impl ') OR contains(l, 'struct ') THEN 'rust' END, CASE WHEN contains(l, 'def ') OR (contains(l, 'import ') AND contains(l, 'python')) THEN 'python' END, CASE WHEN contains(l, 'async') OR contains(l, 'await') THEN 'async' END, CASE WHEN contains(l, 'todo') OR contains(l, 'note:') THEN 'note' END], lambda x: x IS NOT NULL)[1:2]"


@query(W(f"SELECT id, array_to_string({_TAG_RULES}, ',') AS tags FROM (SELECT id, lower(content) AS l FROM snippets)"))
def auto_tags(spark, sf_dir):
    return L.snippets(spark, sf_dir).select("id", F.array_join(T.tags(F.col("content")), ",").alias("tags"))


@query(
    W(
        "SELECT * FROM dup UNION ALL SELECT 'archive-old', 'archive', n || ' old snippets unused for 90+ days', 1, NULL FROM (SELECT count(*) AS n FROM arch) WHERE n > 0 UNION ALL SELECT 'tag-' || id || '-' || tag, 'auto_tag', 'Add #' || tag || ' tag', 2, 0.8::DOUBLE FROM tag",
        f"g AS (SELECT content_hash, count(*) AS n FROM snippets GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, content_hash LIMIT 5), dup AS (SELECT 'dup-hash-' || content_hash AS suggestion_id, 'duplicate' AS kind, n || ' exact duplicates found' AS title, CASE WHEN n > 5 THEN 3 ELSE 2 END AS priority, NULL::DOUBLE AS confidence FROM g), arch AS ({_ARCHIVE}), tag AS (SELECT id, unnest({_TAG_RULES}) AS tag FROM (SELECT id, lower(content) AS l FROM snippets WHERE id NOT IN (SELECT snippet_id FROM snippet_categories) ORDER BY id LIMIT 5))",
    )
)
def suggestions_union(spark, sf_dir):
    return tables.suggestions(L.snippets(spark, sf_dir), L.assignments(spark, sf_dir), when("2024-01-10 00:00:00"))


def _ranked(spark, sf_dir) -> DataFrame:
    """All rows that a search finds, with their scores."""
    return L.snippets(spark, sf_dir).join(indexed(spark, sf_dir).bm25(query_language.Words(("thing",))), "id")


def _rank() -> list[Column]:
    return [-F.round("score", 9), F.col("id")]


_RUN = f"{O.search([(('thing',), False)], 't0 > 0')[0]}, run AS (SELECT *, used - need AS earlier FROM (SELECT *, strlen(content) // 4 AS need, sum(strlen(content) // 4) OVER (ORDER BY round(score, 9) DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM scored))"


@query(W("SELECT id, used::BIGINT AS used FROM run WHERE used <= 5000", _RUN))
def rag_packing(spark, sf_dir):
    return tables.greedy_context(_ranked(spark, sf_dir), 5000, _rank()).select("id", "used")


@query(
    W(
        "SELECT id, CASE WHEN used <= 749 THEN '[' || source_app || '] ' || content || chr(10) || '---' || chr(10) ELSE short || chr(10) || '---' || chr(10) END AS part FROM (SELECT *, CASE WHEN length(content) <= (749 - earlier) * 4 THEN content WHEN len(string_split(content, '. ')) <= 2 THEN substring(content, 1, ((749 - earlier) * 4)::INT) ELSE string_split(content, '. ')[1] || ' ... ' || string_split(content, '. ')[-1] END AS short FROM run WHERE earlier <= 749) WHERE used <= 749 OR 749 - earlier > 50",
        _RUN,
    )
)
def rag_context(spark, sf_dir):
    return tables.rag_context(_ranked(spark, sf_dir), "thing", _rank(), window=900).select("id", "part")


@query(W("SELECT session, start_seq, end_seq, command FROM (SELECT session, event, seq AS end_seq, lag(event) OVER w AS e, lag(seq) OVER w AS start_seq, lag(data) OVER w AS command FROM terminal WINDOW w AS (PARTITION BY session ORDER BY ts, seq)) WHERE event = 'CMD_END' AND e = 'CMD_START'"))
def command_pairing(spark, sf_dir):
    return tables.command_pairs(L.terminal_events(spark, sf_dir))


@query("SELECT event_id FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NULL OR gap > 60000000")
def debounce_save(spark, sf_dir):
    return tables.debounce(L.read(spark, sf_dir, "events"), ["event_type"], "ts", 60_000, "event_id").select("event_id")


# text functions


@query(W("SELECT id, summary FROM snippets"))
def summary_sql(spark, sf_dir):
    return L.snippets(spark, sf_dir).select("id", "summary")


@query(
    W(
        r"SELECT id, CASE WHEN x = '' THEN 'Empty snippet' ELSE 'Note: ' || CASE WHEN length(n) > 45 THEN substring(n, 1, 42) || '...' ELSE n END END AS note FROM (SELECT id, x, array_to_string(" + O.words(r"regexp_replace(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))[1], '\*+|_+|~~|`|#', '', 'g')") + ", ' ') AS n FROM (SELECT id, " + O.TRIMMED.format("content") + " AS x FROM snippets))"
    )
)
def summary_note(spark, sf_dir):
    x = T.trim_all(F.col("content"))
    return L.snippets(spark, sf_dir).select("id", F.when(x == "", "Empty snippet").otherwise(T.note_summary(x)).alias("note"))


@query()
def summary_rules(spark, sf_dir):
    from gleaner.functions.topics import topic

    rows = L.snippets(spark, sf_dir).select("id", "content", topic(T.trim_all(F.col("content"))).alias("topic"))
    return rows.select("id", T.rule_summary(F.col("content"), F.col("topic")).alias("summary"))


@query(W(r"SELECT page_id, CASE WHEN path = '' THEN 'Link: ' || host WHEN length(host || path) > 43 THEN substring('Link: ' || host || '/' || path, 1, 47) || '...' ELSE 'Link: ' || host || '/' || path END AS summary FROM (SELECT page_id, string_split(regexp_extract(url, '^[^:]*://(.*)$', 1), '/')[1] AS host, coalesce(string_split(regexp_extract(url, '^[^:]*://(.*)$', 1), '/')[2], '') AS path FROM pages)"))
def url_summary(spark, sf_dir):
    return L.read(spark, sf_dir, "pages").select("page_id", T.url_summary(F.col("url")).alias("summary"))


@query(
    W(
        "SELECT s.id, coalesce(first(b.category ORDER BY b.score DESC, b.category), CASE WHEN any_value(k) > 8 AND any_value(n) / any_value(k) > 30 AND any_value(n) / any_value(w) > 4 AND any_value(n) / any_value(w) < 12 THEN 'Notes' WHEN any_value(n) < 100 OR any_value(w) < 10 THEN 'Quick Notes' ELSE 'Uncategorized' END) AS category FROM lead_words s LEFT JOIN b USING (id) GROUP BY s.id",
        f"{O.KEYWORDS}, lead_words AS (SELECT id, strlen(content) AS n, len({O.LINES.format('content')}) AS k, len({O.words('content')}) AS w, array_to_string({O.words('lower(content)')}[1:50], ' ') AS t FROM snippets), b AS (SELECT id, category, sum(weight) AS score FROM lead_words, keywords WHERE contains(t, keyword) GROUP BY ALL)",
    )
)
def keyword_category(spark, sf_dir):
    return L.snippets(spark, sf_dir).select("id", T.keyword_category(F.col("content")).alias("category"))


_FAMILY = "CASE lower(string_split(" + O.words("string_split(p_name, chr(10))[1]") + "[1], '-')[1]) " + " ".join(f"WHEN '{t}' THEN '{n}'" for tools, n, _ in fixed.COMMAND_FAMILIES for t in tools) + " END"


@query(f"SELECT p_partkey, {_FAMILY} AS family FROM (SELECT p_partkey, (CASE p_partkey % 5 WHEN 0 THEN 'docker-compose up' WHEN 1 THEN 'git push ' WHEN 2 THEN 'Kubectl get ' WHEN 3 THEN 'pip install ' ELSE '' END) || p_name AS p_name FROM part)")
def canonical_command(spark, sf_dir):
    name = F.concat(F.when(F.col("p_partkey") % 5 == 0, "docker-compose up").when(F.col("p_partkey") % 5 == 1, "git push ").when(F.col("p_partkey") % 5 == 2, "Kubectl get ").when(F.col("p_partkey") % 5 == 3, "pip install ").otherwise(""), "p_name")
    return L.read(spark, sf_dir, "part").select("p_partkey", T.command_family(name).getField("name").alias("family"))


_STRUCTURE = (
    "CASE WHEN len(ls) = 0 THEN 'Plain' WHEN " + O._line_count("regexp_matches(x, '^[$>]\\s+.+$')") + " >= 2 AND " + O._line_count("regexp_matches(x, '^[$>]\\s+.+$')") + " / len(ls) >= 0.3 THEN 'Terminal' WHEN ("
    + O._line_count(O._any("x", fixed.CODE_KEYWORDS)) + " >= 2 OR " + O._line_count(O._any("x", fixed.CODE_SYMBOLS)) + " >= 2) AND (" + O._line_count(O._any("x", fixed.CODE_KEYWORDS)) + " + " + O._line_count(O._any("x", fixed.CODE_SYMBOLS)) + ") / len(ls) >= 0.2 THEN 'Code' WHEN "
    + O._line_count("length(x) - length(replace(x, '|', '')) >= 2") + " >= 3 AND " + O._line_count("length(x) - length(replace(x, '|', '')) >= 2") + " / len(ls) >= 0.5 THEN 'Table' WHEN "
    + O._line_count("regexp_matches(x, '^\\s*[-*+]\\s')") + " >= 3 OR " + O._line_count("regexp_matches(x, '^\\s*\\d+\\.\\s')") + " >= 3 THEN 'List' ELSE 'Plain' END"
)


@query(W(f"SELECT id, {_STRUCTURE} AS structure FROM (SELECT id, {O.LINES.format('content')} AS ls FROM snippets)"))
def structure_detect(spark, sf_dir):
    return L.snippets(spark, sf_dir).select("id", T.structure(F.col("content")).alias("structure"))


@query(W("SELECT id, array_to_string(regexp_extract_all(content, '(?i)\\b(?:https?://|www\\.)[a-z0-9][-a-z0-9+&@#/%?=~_|!:,.;]*[a-z0-9]'), ' ') AS urls, array_to_string(regexp_extract_all(content, '\\b[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}\\b'), ' ') AS emails, array_to_string(list_filter(regexp_extract_all(content, '" + fixed.PATH_PATTERN + "'), lambda x: length(x) > 3), ' ') AS paths FROM snippets"))
def entities(spark, sf_dir):
    found = T.entities(F.col("content"))
    return L.snippets(spark, sf_dir).select("id", F.array_join(found.urls, " ").alias("urls"), F.array_join(found.emails, " ").alias("emails"), F.array_join(found.file_paths, " ").alias("paths"))


@query(W(r"SELECT id, array_to_string(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')), chr(10)) AS cleaned FROM snippets"))
def clean_minimal(spark, sf_dir):
    return L.snippets(spark, sf_dir).select("id", T.clean_minimal(F.col("content")).alias("cleaned"))


@query()
def clean_balanced(spark, sf_dir):
    from gleaner.functions.stem import nfc

    return L.snippets(spark, sf_dir).select("id", nfc(F.col("content")).alias("content")).select("id", T.clean_balanced(F.col("content")).alias("cleaned"))


@query()
def clean_screenshot(spark, sf_dir):
    from gleaner.functions.stem import nfc

    return L.snippets(spark, sf_dir).select("id", nfc(F.col("content")).alias("content")).select("id", T.clean_screenshot(F.col("content")).alias("cleaned"))


_LETTERS = "list_distinct(string_split(lower({}), ''))"


@query(
    f"SELECT a.r_name AS left_name, b.n_name AS right_name, round(CASE WHEN lower(a.r_name) = lower(b.n_name) THEN 1.0 WHEN contains(lower(a.r_name), lower(b.n_name)) OR contains(lower(b.n_name), lower(a.r_name)) THEN least(length(a.r_name), length(b.n_name)) / greatest(length(a.r_name), length(b.n_name)) ELSE len(list_intersect({_LETTERS.format('a.r_name')}, {_LETTERS.format('b.n_name')})) / len(list_distinct({_LETTERS.format('a.r_name')} || {_LETTERS.format('b.n_name')})) END, 6)::DOUBLE AS score FROM region a JOIN nation b ON a.r_regionkey = b.n_regionkey"
)
def string_similarity(spark, sf_dir):
    pairs = L.read(spark, sf_dir, "region").join(L.read(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return pairs.select(F.col("r_name").alias("left_name"), F.col("n_name").alias("right_name"), F.round(T.similarity(F.col("r_name"), F.col("n_name")), 6).alias("score"))


_ALIKE = f"""
asked AS (SELECT reverse(s_name) AS name FROM supplier UNION SELECT s_name || '1' FROM supplier UNION SELECT upper(s_name) FROM supplier UNION SELECT n_name || 'S' FROM nation UNION SELECT substring(r_name, 2) FROM region),
pair AS (SELECT a.name, c.name AS category, lower(a.name) AS a, lower(c.name) AS b FROM asked a, categories c),
scored AS (SELECT name, category, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) ELSE len(list_intersect({_LETTERS.format('a')}, {_LETTERS.format('b')})) / len(list_distinct({_LETTERS.format('a')} || {_LETTERS.format('b')})) END AS score FROM pair)
"""


@query(W("SELECT name, category, round(score, 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, category) AS r FROM scored WHERE score > 0.85) WHERE r = 1", _ALIKE))
def similar_names(spark, sf_dir):
    """The category most like each supplier's name backwards, with a figure more and in capitals, and each changed name of a nation or region."""
    one = lambda table, x: L.read(spark, sf_dir, table).select(F.expr(x).alias("name"))
    asked = one("supplier", "reverse(s_name)").union(one("supplier", "s_name || '1'")).union(one("supplier", "upper(s_name)")).union(one("nation", "n_name || 'S'")).union(one("region", "substring(r_name, 2)"))
    return names.similar_names(L.categories(spark, sf_dir), asked).withColumn("score", F.round("score", 6))


@query("SELECT conv_id, turn, '[' || role || '] of [[' || turn || ']]' AS caption, CASE WHEN regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') = '' THEN NULL ELSE " + O.TRIMMED.format("translate(text, '[]', '()')") + " END AS text FROM conversations")
def split_screenshot(spark, sf_dir):
    """Captions with nested brackets and texts (theirs made round, as they need not be balanced) are combined and taken apart again."""
    both = T.combine_screenshot(F.concat(F.lit("["), "role", F.lit("] of [["), F.col("turn").cast("string"), F.lit("]]")), F.translate("text", "[]", "()"))
    return L.read(spark, sf_dir, "conversations").select("conv_id", "turn", T.split_screenshot(both).alias("s")).select("conv_id", "turn", "s.caption", "s.text")


@query()
def query_cache(spark, sf_dir):
    """Lookups of users' caches of three queries: an event's type and its property are the query."""
    lookups = L.read(spark, sf_dir, "events").select("user_id", F.concat("event_type", F.get_json_object("props", "$.k")).alias("query"), "ts", F.col("event_id").alias("seq"))
    return cache.cached_lookups(lookups, "user_id", capacity=3, seconds=12 * 3600)


@query("SELECT p_partkey, array_to_string(" + O.words("replace(replace(lower(p_brand || '_' || p_name), '_', ' '), '-', ' ')") + ", ' ') AS name FROM part")
def normalize_category(spark, sf_dir):
    return L.read(spark, sf_dir, "part").select("p_partkey", T.normalize_category(F.concat("p_brand", F.lit("_"), "p_name")).alias("name"))


_SAVE = "CASE WHEN x = '' THEN false WHEN p[1] IN {} THEN false WHEN p[1] IN {} THEN true ELSE length(x) > 30 OR contains(x, '|') OR contains(x, '&&') OR contains(x, '>') OR contains(x, '--') OR starts_with(x, 'sudo') OR len(p) >= 3 OR (contains(x, '-') AND len(p) >= 2) END".format(O._in(fixed.COMMAND_BLOCKLIST), O._in(fixed.COMMAND_ALLOWLIST))


@query(f"SELECT p_partkey, {_SAVE} AS saved FROM (SELECT p_partkey, x, {O.words('x')} AS p FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ls -la' WHEN 1 THEN 'git status' WHEN 2 THEN p_name WHEN 3 THEN 'a | b' WHEN 4 THEN 'echo' ELSE p_brand END AS x FROM part))")
def command_filter(spark, sf_dir):
    k = F.col("p_partkey") % 6
    x = F.when(k == 0, "ls -la").when(k == 1, "git status").when(k == 2, F.col("p_name")).when(k == 3, "a | b").when(k == 4, "echo").otherwise(F.col("p_brand"))
    return L.read(spark, sf_dir, "part").select("p_partkey", T.worth_saving(x).alias("saved"))


@query("SELECT conv_id, turn, CASE WHEN c = '' AND t = '' THEN '[Screenshot]' WHEN c = '' THEN '[Text: ' || t || ']' WHEN t = '' THEN '[Caption: ' || c || ']' ELSE '[Caption: ' || c || '] [Text: ' || t || ']' END AS combined FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS c, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS t FROM conversations)")
def combine_screenshot(spark, sf_dir):
    return L.read(spark, sf_dir, "conversations").select("conv_id", "turn", T.combine_screenshot(F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(""), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text"))).alias("combined"))


def _contains_case(pairs) -> str:
    return "CASE " + " ".join(f"WHEN {O._any('low', keys)} THEN '{name}'" for keys, name in pairs) + " END"


_FALLBACK = (
    "coalesce(CASE WHEN b IS NOT NULL THEN coalesce(" + _contains_case(fixed.FALLBACK_INDUSTRY) + ", b) END, CASE WHEN " + O._any("low", fixed.FALLBACK_PRODUCT) + " THEN CASE WHEN " + O._any("low", fixed.FALLBACK_PROPOSAL[0])
    + f" THEN '{fixed.FALLBACK_PROPOSAL[1]}' ELSE '{fixed.FALLBACK_PROPOSAL[2]}' END END, CASE WHEN type = 'command' THEN 'Commands' END, " + _contains_case(fixed.FALLBACK_TOPICS)
    + ", CASE WHEN len(f) >= 2 THEN array_to_string(list_transform(f, lambda w: replace(upper(w[1:1]), 'ẞ', 'SS') || w[2:]), ' ') || ' Content' END, CASE type " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in fixed.FALLBACK_TYPES) + f" ELSE '{fixed.FALLBACK_LAST}' END)"
)


@query(W(f"SELECT id, {_FALLBACK} AS name FROM (SELECT id, type, lower(p) AS low, list_filter({O.words("regexp_extract(p, '^([^.!?]*)', 1)")}, lambda w: strlen(w) > 3 AND regexp_matches(w, '^\\p{{L}}+$'))[1:3] AS f, {_contains_case([((k,), n) for k, n in fixed.FALLBACK_BUSINESS]).replace('low', 'lower(p)')} AS b FROM (SELECT id, type, substring(content, 1, 200) AS p FROM snippets))"))
def fallback_category(spark, sf_dir):
    return L.snippets(spark, sf_dir).select("id", T.fallback_category(F.col("content"), F.col("type")).alias("name"))


def _caption_case() -> str:
    prefixes = " ".join(f"WHEN {' OR '.join(f"starts_with(c, '{k}')" for k in keys)} THEN '{name}'" for name, keys in fixed.CAPTION_PREFIXES)
    return f"CASE {prefixes} " + " ".join(f"WHEN {O._any('c', keys)} THEN '{name}'" for name, keys in fixed.CAPTION_KEYWORDS) + " ELSE 'General' END"


@query(W(f"SELECT id, {_caption_case()} AS kind FROM (SELECT id, lower(CASE id % 4 WHEN 0 THEN 'Code: ' WHEN 1 THEN 'pdf: ' ELSE '' END || content) AS c FROM snippets)"))
def caption_type(spark, sf_dir):
    caption = F.concat(F.when(F.col("id") % 4 == 0, "Code: ").when(F.col("id") % 4 == 1, "pdf: ").otherwise(""), "content")
    return L.snippets(spark, sf_dir).select("id", T.caption_type(caption).alias("kind"))


@query(W("SELECT id, CASE WHEN c = '' THEN 'Screenshot content' WHEN length(c) > 100 THEN substring(c, 1, 97) || '...' ELSE c END AS summary FROM (SELECT id, CASE WHEN id % 3 = 0 THEN summary ELSE content END AS c FROM snippets)"))
def screenshot_summary(spark, sf_dir):
    caption = F.when(F.col("id") % 3 == 0, F.col("summary")).otherwise(F.lit("Screenshot at noon"))
    return L.snippets(spark, sf_dir).select("id", T.screenshot_summary(caption, F.col("content")).alias("summary"))


@query(W("SELECT id, strlen(content) // 4 AS tokens FROM snippets"))
def token_estimate(spark, sf_dir):
    return L.snippets(spark, sf_dir).select("id", T.estimate_tokens(F.col("content")).alias("tokens"))


@query(W("SELECT id FROM (SELECT * FROM snippets WHERE date_diff('day', created_at::DATE, DATE '2024-03-01') <= 50) ORDER BY created_at DESC, id LIMIT 100"))
def storage_policy(spark, sf_dir):
    return tables.within_policy(L.snippets(spark, sf_dir), as_of(), 100, 50).select("id")


def _commands(spark, sf_dir):
    return L.read(spark, sf_dir, "part").select(F.col("p_name").alias("label"), F.col("p_brand").alias("description"), F.col("p_type").alias("category"), F.array(F.col("p_size").cast("string"), "p_brand").alias("keywords"), "p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), '#1') OR contains(lower(p_brand), '#1') OR contains(lower(p_type), '#1') OR contains(p_size::VARCHAR, '#1')")
def palette_filter(spark, sf_dir):
    return tables.palette(_commands(spark, sf_dir), " #1 ").select("p_partkey")


@query(W("SELECT suggestion_id FROM (SELECT 'dup-hash-' || content_hash AS suggestion_id, count(*) AS n FROM snippets GROUP BY content_hash HAVING count(*) > 1) WHERE n <= 2"))
def undismissed(spark, sf_dir):
    groups = tables.duplicate_groups(L.snippets(spark, sf_dir)).select(F.concat(F.lit("dup-hash-"), "content_hash").alias("suggestion_id"), "n")
    return tables.undismissed(groups, groups.where("n > 2").select("suggestion_id")).select("suggestion_id")


@query(W("SELECT id, embedding_input FROM (SELECT id, coalesce(summary, '') || chr(10) || chr(10) || content AS embedding_input FROM snippets)"))
def embedding_input(spark, sf_dir):
    return L.snippets(spark, sf_dir).select("id", vectors.embedding_input(F.col("summary"), F.col("content")).alias("embedding_input"))


@query("SELECT conv_id, turn, array_to_string(" + O.words("lower(text)") + ", ' ') AS cache_key FROM conversations")
def cache_key(spark, sf_dir):
    return L.read(spark, sf_dir, "conversations").select("conv_id", "turn", T.cache_key(F.col("text")).alias("cache_key"))


@query(W("SELECT id, coalesce(id > min(id) OVER (PARTITION BY content_hash), false) AS known FROM snippets"))
def check_duplicate(spark, sf_dir):
    rows = L.snippets(spark, sf_dir).select("id", "content_hash")
    known = tables.repeats(rows).select("id", F.lit(True).alias("known"))
    return rows.select("id").join(known, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


# export and import


@query()
def export_nested(spark, sf_dir):
    return exchange.nested(L.snippets(spark, sf_dir), L.versions(spark, sf_dir), L.assignments(spark, sf_dir), L.categories(spark, sf_dir))


@query(W("SELECT s.id, '## ' || s.summary || chr(10) || chr(10) || '- App: ' || s.source_app || chr(10) || '- Category: ' || coalesce(k.name, 'Uncategorized') || chr(10) || chr(10) || s.content || chr(10) || chr(10) || '---' || chr(10) AS markdown FROM snippets s LEFT JOIN snippet_categories sc ON sc.snippet_id = s.id LEFT JOIN categories k ON k.id = sc.category_id"))
def export_markdown(spark, sf_dir):
    return exchange.markdown(L.snippets(spark, sf_dir), L.assignments(spark, sf_dir), L.categories(spark, sf_dir))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
