"""Relational operators over the logical tables: scans, filters, joins, aggregates, writes as new tables."""

from __future__ import annotations

from itertools import count as numbers

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.names import similar_names  # noqa: F401
from gleaner.sources.shared_folder import shared_folder


# scans


def by_ids(snippets: DataFrame, ids: list[int]) -> DataFrame:
    """Newest first; no ids, no rows."""
    return (snippets.where(F.col("id").isin(ids)) if ids else snippets.limit(0)).orderBy(F.desc("created_at"), "id")


def newest_versions(versions: DataFrame, snippet_id: int) -> DataFrame:
    return versions.where(F.col("snippet_id") == snippet_id).orderBy(F.desc("version_number"))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


# filters


def like(x: Column, part: str) -> Column:
    """SQL LIKE %part% without regard to case; wildcards in part count."""
    return x.ilike(f"%{part}%")


def saved_commands(snippets: DataFrame, part: str | None = None, directory: str | None = None, limit: int = 100) -> DataFrame:
    found = snippets.where(F.col("type") == "command")
    if part:
        found = found.where(like(F.col("content"), part) | like(F.col("summary"), part))
    if directory:
        found = found.where(F.col("working_directory") == directory)
    return found.orderBy(F.desc("created_at"), "id").limit(limit)


def search_filters(snippets: DataFrame, since: Column | None = None, until: Column | None = None, app: str | None = None, has_embedding: bool | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Bounds are inclusive; a null bound doesn't filter."""
    for bound, keep in ((since, lambda b: F.col("created_at") >= b), (until, lambda b: F.col("created_at") <= b)):
        if bound is not None:
            snippets = snippets.where(bound.isNull() | keep(bound))
    if app:
        snippets = snippets.where(F.lower("source_app").contains(app.lower()))
    if has_embedding is not None:
        snippets = snippets.join(vectors.select(F.col("snippet_id").alias("id")), "id", "left_semi" if has_embedding else "left_anti")
    return snippets


def text_search(snippets: DataFrame, part: str, limit: int = 10) -> DataFrame:
    """id, field, in_caption: hits in summaries and hits in content, each list by id."""
    summary = snippets.where(like(F.col("summary"), part)).select("id", F.lit("summary").alias("field"), F.lit(False).alias("in_caption")).orderBy("id").limit(limit)
    caption = F.col("content").ilike(f"%[Caption: {part}%")
    content = snippets.where(like(F.col("content"), part)).select("id", F.lit("content").alias("field"), caption.alias("in_caption")).orderBy("id").limit(limit)
    return summary.unionByName(content)


def source_apps(snippets: DataFrame) -> DataFrame:
    return snippets.where(F.col("source_app").isNotNull() & (F.col("source_app") != "")).select("source_app").distinct().orderBy("source_app")


# categories


def closure(categories: DataFrame, every: int = 4) -> DataFrame:
    """ancestor, descendant of every pair, each with itself, however deep. One join a level, until a level has no new pair (so cycles end); lineage is cut at every few levels."""
    edges = categories.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("descendant"), F.col("id").alias("child"))
    level = whole = categories.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"))
    for turn in numbers(1):
        level = level.join(edges, "descendant").select("ancestor", F.col("child").alias("descendant")).distinct().join(whole, ["ancestor", "descendant"], "left_anti")
        if turn % every == 0:
            level, whole = cut(level), cut(whole)
        if level.isEmpty():
            return whole
        whole = whole.unionByName(level)


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder that the cluster names."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def with_content(categories: DataFrame, assignments: DataFrame, snippets: DataFrame, kind: str | None = None) -> DataFrame:
    """Categories with a snippet (of a kind) in them or below."""
    rows = snippets.where(F.col("type") == kind) if kind and kind != "all" else snippets
    used = assignments.join(rows.select(F.col("id").alias("snippet_id")), "snippet_id", "left_semi").select(F.col("category_id").alias("descendant")).distinct()
    above = closure(categories).join(used, "descendant", "left_semi").select(F.col("ancestor").alias("id")).distinct()
    return categories.join(above, "id", "left_semi")


def category_counts(categories: DataFrame, assignments: DataFrame, snippets: DataFrame) -> DataFrame:
    """id, name, n: distinct snippets directly in each category."""
    n = assignments.join(snippets.select(F.col("id").alias("snippet_id")), "snippet_id").groupBy(F.col("category_id").alias("id")).agg(F.countDistinct("snippet_id").alias("n"))
    return categories.join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def in_category(snippets: DataFrame, assignments: DataFrame, category_id: int, limit: int = 100, offset: int = 0) -> DataFrame:
    found = snippets.join(assignments.where(F.col("category_id") == category_id), snippets["id"] == assignments["snippet_id"])
    return page(found.select("id", "type", "assigned_at", "confidence").distinct(), [F.desc("assigned_at"), "id"], limit, offset)


def reasoning(assignments: DataFrame, categories: DataFrame) -> DataFrame:
    return assignments.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id").select("snippet_id", "category_id", "name", "confidence", "categorization_method", "llm_reasoning")


def tree(categories: DataFrame) -> DataFrame:
    """Roots by name, each with its children's names in order."""
    roots = categories.where(F.col("parent_id").isNull()).select("id", "name")
    below = categories.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("children"))
    return roots.join(below, "id", "left").select("id", "name", F.array_join(F.coalesce("children", F.array().cast("array<string>")), ", ").alias("children")).orderBy("name")


def without_category(snippets: DataFrame, assignments: DataFrame) -> DataFrame:
    return snippets.join(assignments.select(F.col("snippet_id").alias("id")), "id", "left_anti")


def screenshot_status(snippets: DataFrame, assignments: DataFrame, categories: DataFrame, part: str, limit: int = 20) -> DataFrame:
    named = assignments.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left").select(F.col("snippet_id").alias("id"), "category")
    named_so = like(F.col("content"), part)
    if "file_path" in snippets.columns:
        named_so |= F.coalesce(like(F.col("file_path"), part), F.lit(False))
    found = snippets.where((F.col("type") == "screenshot") & named_so)
    return found.join(named, "id", "left").select("id", "category", F.col("category").isNotNull().alias("is_categorized")).orderBy("id").limit(limit)


def create_categories(categories: DataFrame, new: DataFrame) -> DataFrame:
    """categories and the new (name, parent_id) whose normalised name is not there yet; ids go on from the largest."""
    key = T.normalize_category(F.col("name")).alias("key")
    missing = new.withColumn("key", key).dropDuplicates(["key"]).join(categories.select(key), "key", "left_anti")
    last = categories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    place = F.row_number().over(Window.orderBy("key"))  # rows a caller hands in at once
    return categories.select("id", "name", "parent_id").unionByName(missing.crossJoin(F.broadcast(last)).select((F.col("last") + place).alias("id"), "name", "parent_id"))


def app_folders(categories: DataFrame, apps: DataFrame, now: Column) -> DataFrame:
    """categories and a folder for each app (source_app) that has none yet, whatever its rows: name and app_name are the app's without blanks around it, with its emoji. Blank apps get none."""
    lacking = {"emoji": "string", "created_at": "timestamp_ntz", "is_app_folder": "boolean", "app_name": "string"}
    there = categories.withColumns({c: F.lit(None).cast(t) for c, t in lacking.items() if c not in categories.columns})
    asked = apps.select(F.trim("source_app").alias("app_name")).where(F.col("app_name") != "").distinct()
    missing = asked.join(there.where("is_app_folder").select("app_name"), "app_name", "left_anti")
    last = there.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    place = F.row_number().over(Window.orderBy("app_name"))  # a row an app
    new = missing.crossJoin(F.broadcast(last)).select((F.col("last") + place).alias("id"), F.col("app_name").alias("name"), T.app_emoji(F.col("app_name")).alias("emoji"), now.cast("timestamp_ntz").alias("created_at"), F.lit(True).alias("is_app_folder"), "app_name")
    return there.unionByName(new, allowMissingColumns=True)


def update_category(categories: DataFrame, category_id: int, **changes: object) -> DataFrame:
    own = F.col("id") == category_id
    return categories.withColumns({c: F.when(own, F.coalesce(F.lit(v), F.col(c))).otherwise(F.col(c)) for c, v in changes.items()})


def delete_subtree(category_id: int, categories: DataFrame, assignments: DataFrame, snippets: DataFrame, vectors: DataFrame) -> tuple[DataFrame, ...]:
    """The four tables without a category, what is below it, and the snippets in them."""
    gone = closure(categories).where(F.col("ancestor") == category_id).select(F.col("descendant").alias("id"))
    rows = assignments.join(gone, assignments["category_id"] == gone["id"], "left_semi").select("snippet_id").distinct()
    less = lambda d, key: d.join(rows.withColumnRenamed("snippet_id", key) if key != "snippet_id" else rows, key, "left_anti")
    return categories.join(gone, "id", "left_anti"), less(assignments, "snippet_id"), less(snippets, "id"), less(vectors, "snippet_id")


# assignments and versions


def latest_assignment(assignments: DataFrame) -> DataFrame:
    """One row a snippet: the newest, by an aggregate."""
    others = [c for c in assignments.columns if c != "snippet_id"]
    newest = F.max_by(F.struct(*others), F.struct("assigned_at", "category_id"))
    return assignments.groupBy("snippet_id").agg(newest.alias("r")).select("snippet_id", *(f"r.{c}" for c in others))


def numbered_versions(versions: DataFrame, order: str) -> DataFrame:
    return versions.withColumn("version_number", F.row_number().over(Window.partitionBy("snippet_id").orderBy(order)))


def edit(snippets: DataFrame, versions: DataFrame, snippet_id: int, content: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """The old row becomes version n + 1; the new content gets a new summary."""
    n = versions.where(F.col("snippet_id") == snippet_id).agg(F.count("*").alias("n"))
    old = snippets.where(F.col("id") == snippet_id).crossJoin(F.broadcast(n))  # one row
    saved = old.select(F.col("id").alias("snippet_id"), (F.col("n") + 1).alias("version_number"), "content")
    own = F.col("id") == snippet_id
    fresh = {"content": F.lit(content), "summary": T.rule_summary(F.lit(content)), "content_hash": T.content_hash(F.lit(content))} | ({"updated_at": now} if "updated_at" in snippets.columns else {})
    changed = snippets.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in fresh.items() if c in snippets.columns})
    return changed, versions.select("snippet_id", "version_number", "content").unionByName(saved)


def edit_many(snippets: DataFrame, versions: DataFrame, edits: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """edit of many rows at once; edits has id and content, one row an id. Ids that aren't there change nothing."""
    asked = edits.select("id", F.col("content").alias("__new"))
    had = versions.join(edits.select(F.col("id").alias("snippet_id")), "snippet_id", "left_semi").groupBy(F.col("snippet_id").alias("id")).agg(F.count("*").alias("n"))
    old = snippets.join(asked.select("id"), "id", "left_semi").join(had, "id", "left")
    saved = old.select(F.col("id").alias("snippet_id"), (F.coalesce("n", F.lit(0)) + 1).alias("version_number"), "content")
    own = F.col("__new").isNotNull()
    fresh = {"content": F.col("__new"), "summary": T.rule_summary(F.col("__new")), "content_hash": T.content_hash(F.col("__new"))} | ({"updated_at": now} if "updated_at" in snippets.columns else {})
    changed = snippets.join(asked, "id", "left").select(*(F.when(own, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in snippets.columns))
    return changed, versions.select("snippet_id", "version_number", "content").unionByName(saved)


def summarize_all(snippets: DataFrame) -> DataFrame:
    return snippets.withColumn("summary", T.rule_summary(F.col("content")))


# duplicates


def with_hash(snippets: DataFrame) -> DataFrame:
    return snippets.withColumn("content_hash", T.typed_hash(F.col("type"), F.col("content"), F.col("working_directory")))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str = "content_hash") -> DataFrame:
    """The new rows to append: the first by id of each hash that is not there yet. Null hashes are always new."""
    first = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("id"))
    fresh = first.join(existing.select(key), key, "left_anti").select("id")
    return new.join(fresh, "id", "left_semi").unionByName(new.where(F.col(key).isNull()))


def duplicate_groups(snippets: DataFrame) -> DataFrame:
    """content_hash, n, ids (oldest first) of hashes that several rows have. Hashes are counted before members are gathered."""
    counted = snippets.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = snippets.select("content_hash", "created_at", "id").join(counted, "content_hash")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id"))), lambda x: x.id)
    return members.groupBy("content_hash", "n").agg(ids.alias("ids"))


def duplicate_members(snippets: DataFrame) -> DataFrame:
    """content_hash, n, id, position (oldest first): a row for each member of each group, however many a hash has."""
    counted = snippets.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    place = F.row_number().over(Window.partitionBy("content_hash").orderBy("created_at", "id"))
    return snippets.select("content_hash", "created_at", "id").join(counted, "content_hash").select("content_hash", "n", "id", place.alias("position"))


def duplicate_stats(snippets: DataFrame) -> DataFrame:
    """total, unique_hashes, groups, duplicates, rate in one row; rows without a hash count as duplicates."""
    by_hash = snippets.groupBy("content_hash").agg(F.count("*").alias("n"))
    known = F.col("content_hash").isNotNull()
    one = by_hash.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.when(known, 1)).alias("unique_hashes"), F.count(F.when(known & (F.col("n") > 1), 1)).alias("groups"))
    more = F.col("total") - F.col("unique_hashes")
    return one.select("total", "unique_hashes", "groups", more.alias("duplicates"), F.when(F.col("total") > 0, more / F.col("total")).otherwise(0.0).alias("rate"))


def keep_oldest(snippets: DataFrame) -> DataFrame:
    """One row a hash, the oldest; rows without a hash stay."""
    first = snippets.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("id")).select("id")
    return snippets.join(first, "id", "left_semi").unionByName(snippets.where(F.col("content_hash").isNull()))


def find_duplicates(snippets: DataFrame, new: DataFrame, kind: str | None = None) -> DataFrame:
    """New rows whose hash some row (of a kind) has."""
    rows = snippets.where(F.col("type") == kind) if kind else snippets
    return new.join(rows.select("content_hash"), "content_hash", "left_semi")


def repeats(snippets: DataFrame) -> DataFrame:
    """Rows whose hash a row with a smaller id has: find_duplicates of every row against those before it. The first id of each hash is found by an aggregate, so a popular hash is one row of the join's other side."""
    first = snippets.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("id").alias("__first"))
    return snippets.join(first, "content_hash").where(F.col("id") > F.col("__first")).drop("__first")


# vectors


def drop_orphans(vectors: DataFrame, snippets: DataFrame) -> DataFrame:
    return vectors.join(snippets.select(F.col("id").alias("snippet_id")), "snippet_id", "left_semi")


def replace_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    return vectors.join(new.select("snippet_id"), "snippet_id", "left_anti").unionByName(new)


def vectors_of(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The vectors of many snippets at once; ids is a table of snippet_id."""
    return vectors.join(ids, "snippet_id", "left_semi")


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_anti")


def delete_everything(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without rows, their columns as they were."""
    return tuple(d.limit(0) for d in tables)


# analytics


def search_stats(events: DataFrame, since: Column) -> DataFrame:
    """One row: searches, mean latency, results, and results a search (which may exceed 1)."""
    one = events.where(F.col("timestamp") >= since).agg(
        F.count("*").alias("total_searches"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.sum("keyword_results"), F.lit(0)).alias("keyword_results"), F.coalesce(F.sum("semantic_results"), F.lit(0)).alias("semantic_results"),
    )
    rate = lambda c: F.when(F.col("total_searches") > 0, F.col(c) / F.col("total_searches")).otherwise(0.0)
    return one.withColumns({"keyword_hit_rate": rate("keyword_results"), "semantic_hit_rate": rate("semantic_results")})


def popular_queries(events: DataFrame, since: Column, limit: int = 10) -> DataFrame:
    return events.where(F.col("timestamp") >= since).groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(limit)


def retained(events: DataFrame, cutoff: Column, column: str = "timestamp") -> DataFrame:
    return events.where(F.col(column) >= cutoff)


def storage_stats(**tables: DataFrame) -> DataFrame:
    """name, n of each table."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, d in tables.items()])


def type_counts(snippets: DataFrame) -> DataFrame:
    return snippets.groupBy("type").agg(F.count("*").alias("n"))


def within_policy(snippets: DataFrame, as_of: Column, rows: int = 10_000, days: int = 90) -> DataFrame:
    """The newest rows, none older than so many days."""
    age = F.datediff(as_of, F.col("created_at"))
    return snippets.where(age <= days).orderBy(F.desc("created_at"), "id").limit(rows)


# jobs


def pending_jobs(jobs: DataFrame, snippets: DataFrame) -> DataFrame:
    """Jobs to take up again, urgent and old first, with their snippet's summary; running ones count as pending."""
    left = jobs.where(F.col("status").isin("pending", "running")).select("id", "snippet_id", "priority", "created_at")
    return left.join(snippets.select(F.col("id").alias("snippet_id"), "summary"), "snippet_id", "left").orderBy(F.desc("priority"), "created_at", "id")


def recovered_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def moved_jobs(jobs: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """jobs after events (id, event, error): start takes up a waiting job, complete and fail end a running one. Other events change nothing; a job has one event at most."""
    moved = jobs.join(events.select("id", F.col("event").alias("__event"), F.col("error").alias("__error")), "id", "left")
    step = lambda a, b: (F.col("status") == a) & F.coalesce(F.col("__event") == b, F.lit(False))
    status = F.when(step("pending", "start"), "running").when(step("running", "complete"), "completed").when(step("running", "fail"), F.concat(F.lit("failed:"), F.coalesce("__error", F.lit(""))))
    moved = moved.withColumn("__status", status)
    changed = {"status": F.coalesce("__status", "status"), "updated_at": F.when(F.col("__status").isNotNull(), now).otherwise(F.col("updated_at"))}
    return moved.withColumns(changed).select(*jobs.columns)


def finished_jobs_dropped(jobs: DataFrame, cutoff: Column) -> DataFrame:
    done = (F.col("status") == "completed") | F.col("status").startswith("failed:")
    return jobs.where(~(done & (F.col("updated_at") < cutoff)))


def enqueue(jobs: DataFrame, new: DataFrame, vectors: DataFrame) -> DataFrame:
    """New jobs whose snippet has no vector and no job waiting or running."""
    busy = jobs.where(F.col("status").isin("pending", "running")).select("snippet_id")
    return new.join(vectors.select("snippet_id"), "snippet_id", "left_anti").join(busy, "snippet_id", "left_anti")


# suggestions and context


def archive_candidates(snippets: DataFrame, assignments: DataFrame, cutoff: Column, limit: int = 10) -> DataFrame:
    manual = assignments.where("is_manual").select(F.col("snippet_id").alias("id"))
    return snippets.where(F.col("created_at") < cutoff).join(manual, "id", "left_anti").orderBy("created_at", "id").limit(limit)


def tag_suggestions(snippets: DataFrame, assignments: DataFrame, limit: int = 5) -> DataFrame:
    rows = without_category(snippets, assignments).orderBy("id").limit(limit)
    return rows.select("id", F.explode(T.tags(F.col("content"))).alias("tag"))


def suggestions(snippets: DataFrame, assignments: DataFrame, cutoff: Column) -> DataFrame:
    """suggestion_id, kind, title, priority, confidence: duplicates, archive, tags, by priority and in that order."""
    number = lambda c: c.cast("string")
    groups = duplicate_groups(snippets).orderBy(F.desc("n"), "content_hash").limit(5)
    columns = ["suggestion_id", "kind", "title", "priority", "confidence"]
    dup = groups.select(F.concat(F.lit("dup-hash-"), "content_hash"), F.lit("duplicate"), F.concat(number(F.col("n")), F.lit(" exact duplicates found")), F.when(F.col("n") > 5, 3).otherwise(2), F.lit(None).cast("double"))
    old = archive_candidates(snippets, assignments, cutoff).agg(F.count("*").alias("n")).where("n > 0")
    archive = old.select(F.lit("archive-old"), F.lit("archive"), F.concat(number(F.col("n")), F.lit(" old snippets unused for 90+ days")), F.lit(1), F.lit(None).cast("double"))
    tag = tag_suggestions(snippets, assignments).select(F.concat(F.lit("tag-"), number(F.col("id")), F.lit("-"), "tag"), F.lit("auto_tag"), F.concat(F.lit("Add #"), "tag", F.lit(" tag")), F.lit(2), F.lit(0.8))
    order = F.when(F.col("kind") == "duplicate", 0).when(F.col("kind") == "archive", 1).otherwise(2)
    return dup.toDF(*columns).unionByName(archive.toDF(*columns)).unionByName(tag.toDF(*columns)).orderBy(F.desc("priority"), order, "suggestion_id")


def _filled(ranked: DataFrame, budget: int, order: list[Column]) -> DataFrame:
    """Rows up to the first that overflows the budget, it included, with __need and used, the running sum of needs.

    A row with a need takes a token at least, so budget + 1 of them decide: no more meet
    in one task. Rows without one (texts of under four bytes, nulls) take the sum of the
    rows before them from that bounded list.
    """
    rows = ranked.withColumns({"__need": F.coalesce(T.estimate_tokens(F.col("content")), F.lit(0)).cast("long"), "__key": F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))})
    heavy = rows.where(F.col("__need") > 0).orderBy("__key").limit(max(budget, 0) + 1)
    heavy = heavy.withColumn("used", F.sum("__need").over(Window.orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)))  # budget + 1 rows at most
    steps = heavy.agg(F.collect_list(F.struct("__key", "used")).alias("__steps"))
    before = F.array_max(F.transform(F.filter("__steps", lambda s: s["__key"] < F.col("__key")), lambda s: s["used"]))
    light = rows.where(F.col("__need") == 0).crossJoin(F.broadcast(steps)).withColumn("used", F.coalesce(before, F.lit(0).cast("long"))).drop("__steps")  # one row
    return heavy.unionByName(light).where(F.col("used") - F.col("__need") <= budget)


def greedy_context(ranked: DataFrame, budget: int, order: list[Column]) -> DataFrame:
    """Rows of a ranked list (ascending by order) up to the first that overflows the token budget, with their running sum."""
    return _filled(ranked, budget, order).where(F.col("used") <= budget).drop("__need", "__key")


def rag_context(ranked: DataFrame, query: str, order: list[Column], window: int = 512, answer: int = 150, least: int = 50) -> DataFrame:
    """id, part: the packed texts and, where over least tokens are left, a shortened next one."""
    budget = window - len(query.encode()) // 4 - answer
    left = F.lit(budget) - (F.col("used") - F.col("__need"))
    pieces = F.split("content", r"\. ")
    short = F.when(F.length("content") <= left * 4, F.col("content")).when(F.size(pieces) <= 2, F.substring(F.col("content"), F.lit(1), (left * 4).cast("int"))).otherwise(F.concat(F.get(pieces, 0), F.lit(" ... "), F.element_at(pieces, -1)))
    whole = F.concat(F.lit("["), F.coalesce("source_app", F.lit("Unknown")), F.lit("] "), "content", F.lit("\n---\n"))
    part = F.when(F.col("used") <= budget, whole).when(left > least, F.concat(short, F.lit("\n---\n")))
    return _filled(ranked, budget, order).select("id", part.alias("part"), "used").where(F.col("part").isNotNull())


def rag_prompt(query: str, context: str) -> str:
    return f"Answer from the context below and from nothing else.\n\nContext:\n{context}\n\nQuestion: {query}\n\nAnswer:\n"


def command_pairs(events: DataFrame) -> DataFrame:
    """session, start_seq, end_seq, data of each end with the last start before it that no other end took. Events are (session, ts, seq, event, data)."""
    order = Window.partitionBy("session").orderBy("ts", "seq")
    before = F.lag(F.struct("event", "seq", "data")).over(order)
    return events.withColumn("b", before).where((F.col("event") == "CMD_END") & (F.col("b.event") == "CMD_START")).select("session", F.col("b.seq").alias("start_seq"), F.col("seq").alias("end_seq"), F.col("b.data").alias("command"))


def debounce(events: DataFrame, keys: list[str], ts: str, milliseconds: int = 800, tie: str | None = None) -> DataFrame:
    """Events that come more than so long after the one before with the same keys; of equal times the first by tie counts.

    Events are sorted within stretches of an hour or the pause, whichever is longer, so a
    busy key is many groups; a stretch's first event looks at the last of the stretch
    before, found by an aggregate.
    """
    width = max(milliseconds, 3_600_000)
    timed = events.withColumn("__ms", F.unix_micros(F.col(ts).cast("timestamp")) / 1000).withColumn("__part", F.floor(F.col("__ms") / width))
    ends = timed.groupBy(*keys, "__part").agg(F.max("__ms").alias("__end")).withColumn("__last", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__part"))).drop("__end")
    order = Window.partitionBy(*keys, "__part").orderBy("__ms", *([tie] if tie else []))
    own = timed.withColumn("__before", F.lag("__ms").over(order))
    same = [own[k].eqNullSafe(ends[k]) for k in [*keys, "__part"]]
    gap = F.col("__ms") - F.coalesce("__before", "__last")
    return own.join(ends, same).where(gap.isNull() | (gap > milliseconds)).select(*(own[c] for c in events.columns))


# the command palette, and rows of history


def palette(commands: DataFrame, query: str) -> DataFrame:
    """Commands (label, description, category, keywords) of which some part holds the query."""
    q = query.strip().lower()
    part = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q)
    return commands.where(part("label") | part("description") | part("category") | F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.lower(k).contains(q))) if q else commands


def recent_first(commands: DataFrame, recent: list[str], order: list[str]) -> DataFrame:
    """Recent labels first, latest first, then by the order of categories and by label."""
    place = lambda values, c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)) if values else F.array().cast("array<string>"), F.col(c)), F.lit(0)), F.lit(1 << 30))
    return commands.orderBy(place(recent, "label"), place(order, "category"), "label")


def undismissed(found: DataFrame, dismissed: DataFrame) -> DataFrame:
    return found.join(dismissed, "suggestion_id", "left_anti")


def search_event(spark: SparkSession, query: str, kind: str, keyword: int, semantic: int, total: int, latency_ms: int, at: Column) -> DataFrame:
    """One row of search analytics, to append."""
    row = [(query, kind, keyword, semantic, total, latency_ms)]
    return spark.createDataFrame(row, "query string, search_type string, keyword_results long, semantic_results long, total_results long, latency_ms long").withColumn("timestamp", at)


def export_history(events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest exports, newest first."""
    return events.orderBy(F.desc("exported_at"), "file_path").limit(limit)


def export_event(spark: SparkSession, kind: str, path: str, items: int, size: int, at: Column) -> DataFrame:
    """One row of export history, to append."""
    return spark.createDataFrame([(kind, path, items, size)], "format string, file_path string, item_count long, file_size_bytes long").withColumn("exported_at", at)
