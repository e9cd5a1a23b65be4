"""A stored inverted index in segments: read by every keyword search, kept in step with inserts, edits and deletes.

A change writes one segment and then commits it by a small manifest file; a change that
dies before has no effect, and two changes at once can't both commit. A segment has

* ``postings``: a row for each term and row, with the term's places in content and
  summary, how often it occurs and the row's length, ordered by term and id. Filters on
  terms are pushed down to the scan and skip other terms' row groups, and a common term
  spreads over files;
* ``rows``: id and length of each row;
* ``gone``: ids that no longer count in older segments. An edited row keeps its id: its
  old postings are gone, the new ones are in the segment itself;
* ``dictionary``: tokens that no older segment knows, with their stems.

The manifest has the numbers of live rows and tokens. ``compact`` merges the newest
segments while they aren't much smaller than the next older one, so that there are
about as many as the logarithm of the rows, and drops what is gone; all of it with ``whole``.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions.stem import fold_text, porter, stem
from gleaner.operators import query_language as ql
from gleaner.operators.search import best_of_each, holds, idf, saturation, scored_leaves, tokens
from gleaner.sources.shared_folder import hadoop, written

POSTINGS = "term string, id long, tf int, size int, content array<int>, summary array<int>"
#: Tombstones that are broadcast, at most (8 MB of ids); beyond, they are joined by a shuffle.
BROADCAST = 1_000_000
#: A segment is merged with newer ones once they have this share of its rows.
RATIO = 0.25
#: Terms of queries times rows up to which a batch is scored without pruning, which takes more jobs.
DIRECT = 100_000_000
#: Rounded scores may be off by less than this.
_SLACK = 1e-6


def rows_of(snippets: DataFrame, tokenizer=tokens) -> DataFrame:
    """The postings of snippets."""
    read = snippets.select("id", tokenizer(F.col("content")).alias("c"), tokenizer(F.col("summary")).alias("s")).withColumn("size", F.size("c") + F.size("s"))
    fields = F.array(*(F.struct(F.lit(name).alias("field"), F.col(name).alias("words")) for name in ("c", "s")))
    each = read.select("id", "size", F.explode(fields).alias("x")).select("id", "size", "x.field", F.posexplode("x.words").alias("place", "term"))
    places = [F.array_sort(F.collect_list(F.when(F.col("field") == name, F.col("place")))).alias(column) for name, column in (("c", "content"), ("s", "summary"))]
    return each.groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"), F.first("size").alias("size"), *places)


@dataclass(frozen=True)
class Segment:
    folder: str
    number: int  # what is gone in a segment concerns those of smaller numbers
    rows: int
    gone: int


@dataclass(frozen=True)
class State:
    version: int = 0
    next: int = 0
    rows: int = 0
    tokens: int = 0
    segments: tuple[Segment, ...] = ()


class Conflict(Exception):
    """Another change was committed meanwhile; this one had no effect."""


class Index:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, tokenizer=tokens, stems: bool = False):
        self.spark, self.path, self.tokenizer, self.stems = spark, path, tokenizer, stems

    @classmethod
    def build(cls, snippets: DataFrame, path: str, tokenizer=tokens, stems: bool = False) -> Index:
        index = cls(snippets.sparkSession, path, tokenizer, stems)
        index.change(snippets)
        return index

    # manifests

    def state(self) -> State:
        """The last whole manifest."""
        folder, system = hadoop(self.spark, f"{self.path}/manifests")
        if not system.exists(folder):
            return State()
        for name in sorted((s.getPath().getName() for s in system.listStatus(folder)), reverse=True):
            stream = system.open(hadoop(self.spark, f"{self.path}/manifests/{name}")[0])
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            with contextlib.suppress(json.JSONDecodeError):  # a writer died in it
                found = json.loads(text)
                return State(**found | {"segments": tuple(Segment(**s) for s in found["segments"])})
        return State()

    def _commit(self, state: State) -> None:
        path, system = hadoop(self.spark, f"{self.path}/manifests/{state.version:010d}")
        try:
            stream = system.create(path, False)
        except Py4JJavaError as there:
            raise Conflict(f"version {state.version} of {self.path}") from there
        stream.write(bytearray(json.dumps(asdict(state)).encode()))
        stream.close()

    # what the segments hold

    def _union(self, state: State, name: str, schema: str, where: Column | None = None) -> DataFrame:
        """A part of all segments with their numbers."""
        parts = []
        for s in state.segments:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{s.folder}/{name}")
            parts.append((part if where is None else part.where(where)).withColumn("number", F.lit(s.number)))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, number int")

    def _live(self, state: State, rows: DataFrame) -> DataFrame:
        """rows (with id and number) that no newer segment has as gone."""
        count = sum(s.gone for s in state.segments)
        if not count:
            return rows
        gone = self._union(replace(state, segments=tuple(s for s in state.segments if s.gone)), "gone", "id long").groupBy("id").agg(F.max("number").alias("__gone"))
        return rows.join(F.broadcast(gone) if count <= BROADCAST else gone, "id", "left").where(F.col("__gone").isNull() | (F.col("__gone") <= F.col("number"))).drop("__gone")

    def postings(self, terms: Column | None = None, state: State | None = None) -> DataFrame:
        state = state or self.state()
        return self._live(state, self._union(state, "postings", POSTINGS, terms))

    def rows(self, state: State | None = None) -> DataFrame:
        """id, size, number of the live rows."""
        state = state or self.state()
        return self._live(state, self._union(state, "rows", "id long, size int"))

    def dictionary(self, state: State | None = None) -> DataFrame:
        return self._union(state or self.state(), "dictionary", "stem string, term string").select("stem", "term")

    # upkeep

    def change(self, rows: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Adds rows (id, content, summary; one for each id), in place of those of the same ids, and deletes those whose ids deleted has."""
        state = self.state()
        segment = Segment(uuid.uuid4().hex, state.next, 0, 0)
        at = f"{self.path}/{segment.folder}"
        added = added_tokens = lost = lost_tokens = 0
        ids = [d.select("id") for d in (rows, deleted) if d is not None]
        if state.segments and ids:
            self.rows(state).join(reduce(DataFrame.unionByName, ids).distinct(), "id", "left_semi").select("id", "size").write.parquet(f"{at}/lost")
            dead = self.spark.read.schema("id long, size int").parquet(f"{at}/lost")
            lost, lost_tokens = dead.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            dead.select("id").write.parquet(f"{at}/gone")
        else:
            self.spark.createDataFrame([], "id long").write.parquet(f"{at}/gone")
        rows = self.spark.createDataFrame([], "id long, content string, summary string") if rows is None else rows
        rows_of(rows, self.tokenizer).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{at}/postings")
        size = F.size(self.tokenizer(F.col("content"))) + F.size(self.tokenizer(F.col("summary")))
        rows.select("id", size.alias("size")).write.parquet(f"{at}/rows")
        added, added_tokens = self.spark.read.schema("id long, size int").parquet(f"{at}/rows").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        self._write_dictionary(state, at)
        segment = replace(segment, rows=added, gone=lost)
        self._commit(State(state.version + 1, state.next + 1, state.rows + added - lost, state.tokens + added_tokens - lost_tokens, (*state.segments, segment)))

    def _write_dictionary(self, state: State, at: str) -> None:
        """New terms with their stems: each distinct term is stemmed once in the index's life."""
        if not self.stems:
            self.spark.createDataFrame([], "stem string, term string").write.parquet(f"{at}/dictionary")
            return
        terms = self.spark.read.schema(POSTINGS).parquet(f"{at}/postings").select("term").distinct().join(self.dictionary(state).select("term"), "term", "left_anti")
        terms.select(stem(F.col("term")).alias("stem"), "term").repartitionByRange("stem").sortWithinPartitions("stem").write.parquet(f"{at}/dictionary")

    def add(self, rows: DataFrame) -> None:
        self.change(rows)

    def remove(self, rows: DataFrame) -> None:
        """Deletes the rows of these ids; ids that aren't there, or no longer, change nothing."""
        self.change(deleted=rows)

    def compact(self, whole: bool = False) -> int:
        """Merges segments; how many are merged. Files of merged ones go, so no search may run over an older state."""
        state = self.state()
        first = len(state.segments) - 1
        while first > 0 and (whole or sum(s.rows + s.gone for s in state.segments[first:]) >= RATIO * state.segments[first - 1].rows):
            first -= 1
        old = state.segments[max(first, 0) :]
        if len(old) < 2 and not (whole and old and first <= 0 and any(s.gone for s in old)):
            return 0
        part = replace(state, segments=old)
        merged = Segment(uuid.uuid4().hex, old[-1].number, 0, 0)
        at = f"{self.path}/{merged.folder}"
        self.postings(state=part).drop("number").select(*[c.split()[0] for c in POSTINGS.split(", ")]).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{at}/postings")
        self.rows(part).select("id", "size").write.parquet(f"{at}/rows")
        # what is gone still matters to older segments
        gone = self._union(part, "gone", "id long").select("id").distinct()
        (gone if first > 0 else gone.limit(0)).write.parquet(f"{at}/gone")
        self.dictionary(part).repartitionByRange("stem").sortWithinPartitions("stem").write.parquet(f"{at}/dictionary")
        counts = [self.spark.read.parquet(f"{at}/{name}").count() for name in ("rows", "gone")]
        merged = replace(merged, rows=counts[0], gone=counts[1])
        self._commit(replace(state, version=state.version + 1, segments=(*state.segments[: max(first, 0)], merged)))
        for s in old:
            target, system = hadoop(self.spark, f"{self.path}/{s.folder}")
            system.delete(target, True)
        return len(old)

    # searches

    def bm25(self, tree: object, stemmed: bool = False) -> DataFrame:
        """id, score of the rows that satisfy the tree: as search.bm25, from the postings of the tree's terms only.

        With stemmed, words meet by their stems, which the dictionary has; a stem
        without its last letter begins all its words, so the scan is still filtered.
        """
        state = self.state()
        phrases, nears = ql.leaves(tree), ql.nears(tree)
        scored = scored_leaves(tree)
        known = {t: porter(fold_text(t)) if stemmed else t for p in phrases for t in p.tokens}
        wanted = sorted({(known[t], p.prefix and i == len(p.tokens) - 1) for p in phrases for i, t in enumerate(p.tokens)})
        number = {w: k for k, w in enumerate(wanted)}
        on = F.col("stem" if stemmed else "term")
        fits = {w: on.startswith(w[0]) if w[1] else on == w[0] for w in wanted}
        if stemmed:
            found = self.postings(reduce(Column.__or__, (F.col("term").startswith(w[0][: max(1, len(w[0]) - 1)]) for w in wanted)), state)
            found = found.join(self.dictionary(state).where(reduce(Column.__or__, fits.values())), "term")
        else:
            found = self.postings(reduce(Column.__or__, fits.values()), state)
        places = [F.array_sort(F.flatten(F.collect_list(F.when(fits[w], F.col(c))))).alias(f"{c[0]}{k}") for w, k in number.items() for c in ("content", "summary")]
        rows = found.groupBy("id").agg(F.first("size").alias("__dl"), *places)  # a row's postings of a few terms

        def key(p: ql.Words, i: int) -> int:
            return number[known[p.tokens[i]], p.prefix and i == len(p.tokens) - 1]

        def moved(column: str, back: int) -> Column:
            return F.transform(column, lambda x: x - back)

        def times(p: ql.Words, field: str) -> Column:
            return F.size(reduce(F.array_intersect, [moved(f"{field}{key(p, i)}", i) for i in range(len(p.tokens))]))

        def near(n: ql.Near, field: str) -> Column:
            first, second = F.col(f"{field}{key(n.first, 0)}"), F.col(f"{field}{key(n.second, 0)}")
            return F.exists(first, lambda a: F.exists(second, lambda b: F.abs(a - b) - 1 <= n.distance))

        counted = rows.select("id", "__dl", *((times(p, "c") + times(p, "s")).alias(f"__tf{i}") for i, p in enumerate(phrases)), *((near(n, "c") | near(n, "s")).alias(f"__near{i}") for i, n in enumerate(nears)))
        having = counted.agg(*(F.count(F.when(F.col(f"__tf{i}") > 0, 1)).alias(f"__df{i}") for i in range(len(phrases))))
        hits = counted.where(holds(tree, {p: F.col(f"__tf{i}") for i, p in enumerate(phrases)}, {n: F.col(f"__near{i}") for i, n in enumerate(nears)}))
        both = hits.crossJoin(F.broadcast(having))  # one row
        n, average = F.lit(state.rows), F.lit(state.tokens / max(state.rows, 1))
        parts = [idf(n, F.col(f"__df{i}")) * saturation(F.col(f"__tf{i}"), F.col("__dl"), average) for i, p in enumerate(phrases) if p in scored]
        return both.select("id", reduce(lambda a, b: a + b, parts).alias("score"))

    def search_many(self, queries: DataFrame, limit: int = fixed.SEARCH_LIMIT, any_term: bool = False, direct: int = DIRECT) -> DataFrame:
        """query_id, id, score, position: as search.search_many, from the stored postings. Where queries and rows are few, every row is scored in one job; else by search_many_counted. The result is the same."""
        state = self.state()
        wanted = queries.select("query_id", "term").distinct()
        if wanted.count() * state.rows > direct:
            return self.search_many_counted(queries, limit, any_term)[0]
        tf = self.postings(state=state).join(wanted.select("term").distinct(), "term", "left_semi").select("term", "id", "tf", F.col("size").alias("dl"))
        corpus = self.spark.range(1).select(F.lit(state.rows).alias("n"), F.lit(state.tokens / max(state.rows, 1)).alias("average"))
        return best_of_each(tf, corpus, wanted, limit, any_term)

    def search_many_counted(self, queries: DataFrame, limit: int = fixed.SEARCH_LIMIT, any_term: bool = False) -> tuple[DataFrame, DataFrame]:
        """What search_many gives, and query_id, id of the rows that were scored in full.

        First the rows of each query's rarest terms are scored: rows with all terms are
        among them, and the best ``limit`` of them give a score that the result reaches
        at least. Where no row has all terms (and any_term), terms whose largest scores
        anywhere together stay under it can't bring a row in alone: only rows with another
        term are looked at. What those terms give a row raises the floor once more, and
        only rows that could reach it with all the rest are scored in full. Nothing is cut
        that could be among the best.
        """
        state = self.state()
        n, average = F.lit(state.rows), F.lit(state.tokens / max(state.rows, 1))
        wanted = queries.select("query_id", "term").distinct()
        found = self.postings(state=state).select("term", "id", saturation(F.col("tf"), F.col("size"), average).alias("share"))
        terms = found.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.max("share").alias("most"))
        weight = idf(n, F.col("df"))
        own = Window.partitionBy("query_id")
        known = wanted.withColumn("terms", F.count("*").over(own)).join(terms, "term")
        before = F.coalesce(F.sum("df").over(own.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        asked = written(known.select("query_id", "term", "terms", weight.alias("weight"), (weight * F.col("most")).alias("bound"), (before < (4 * limit if any_term else 1)).alias("seed")))

        def rows_with(some: DataFrame) -> DataFrame:
            """query_id, id, part, by the terms that some has of each query."""
            return some.select("query_id", "term", "weight").join(found, "term").select("query_id", "id", (F.col("weight") * F.col("share")).alias("part"))

        def full(rows: DataFrame, of: DataFrame) -> DataFrame:
            """query_id, id, score, have of given query_id, id, by the terms of ``of``. Where the rows are few, Spark sends them to the postings, and only what is summed up moves."""
            each = rows_with(of).join(rows, ["query_id", "id"], "left_semi")
            return each.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.count("*").alias("have"))

        def kth(rows: DataFrame, score: str) -> DataFrame:
            """The score of the limit-th best row of each query that has so many, a little less."""
            return rows.withColumn("position", F.row_number().over(own.orderBy(F.desc(score)))).where(F.col("position") == limit).select("query_id", (F.col(score) - _SLACK).alias(f"kth_{score}"))

        seeds = written(rows_with(asked.where("seed")).select("query_id", "id").distinct())
        seeded = written(full(seeds, asked).join(asked.groupBy("query_id").agg(F.first("terms").alias("terms")), "query_id").select("query_id", "id", "score", (F.col("have") == F.col("terms")).alias("whole")))
        scored, looked = seeded.where("whole").select("query_id", "id", "score"), seeded.select("query_id", "id")
        if any_term:
            rest = asked.join(seeded.where("whole").select("query_id").distinct(), "query_id", "left_anti").join(kth(seeded, "score"), "query_id", "left")
            over = own.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
            split = written(rest.withColumn("small", F.sum("bound").over(over) < F.coalesce("kth_score", F.lit(0.0))))
            others = split.groupBy("query_id").agg(F.max("kth_score").alias("floor"), F.coalesce(F.sum(F.when(F.col("small"), F.col("bound"))), F.lit(0.0)).alias("more"))
            near = written(rows_with(split.where(~F.col("small"))).groupBy("query_id", "id").agg(F.sum("part").alias("most")))
            near = near.join(others, "query_id").join(kth(near, "most"), "query_id", "left")
            near = near.where(F.col("most") + F.col("more") >= F.coalesce(F.greatest("floor", "kth_most"), F.lit(0.0))).select("query_id", "id", "most")
            near = written(near)
            added = full(near, split.where("small")).select("query_id", "id", F.col("score").alias("less"))
            scored = scored.unionByName(near.join(added, ["query_id", "id"], "left").select("query_id", "id", (F.col("most") + F.coalesce("less", F.lit(0.0))).alias("score")))
            looked = looked.unionByName(near.select("query_id", "id"))
        best_first = F.row_number().over(own.orderBy(F.desc(F.round("score", 9)), "id"))
        return scored.withColumn("position", best_first).where(F.col("position") <= limit).select("query_id", "id", "score", "position"), looked


# operators on tables that keep an index in step


def insert(index: Index, snippets: DataFrame, new: DataFrame) -> DataFrame:
    """snippets and those new rows whose hash isn't there yet (tables.insert_if_absent), indexed."""
    from gleaner.operators.tables import insert_if_absent

    fresh = written(insert_if_absent(snippets, new))
    index.change(fresh)
    return snippets.unionByName(fresh)


def edit(index: Index, snippets: DataFrame, versions: DataFrame, edits: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """tables.edit_many, with the edited rows indexed anew under their ids."""
    from gleaner.operators.tables import edit_many

    changed, saved = edit_many(snippets, versions, edits, now)
    index.change(changed.join(edits.select("id").distinct(), "id", "left_semi"))
    return changed, saved


def delete(index: Index, snippets: DataFrame, ids: DataFrame) -> DataFrame:
    index.change(deleted=ids)
    return snippets.join(ids.select("id"), "id", "left_anti")
