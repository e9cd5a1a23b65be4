"""Operator 3: quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: words, symbols, repeated lines, words in repeated
eight-word windows. The method's rule looks across documents: lines are
normalised (lower case, single spaces) and hashed, and for each host the distinct
texts that hold a line are counted. Lines, however long, that more than
``max_docs`` texts of a host hold are removed, and a document that keeps fewer
than ``least_words`` words or less than ``least_share`` of its words is rejected.
Exact copies count as one text, so copies of a clean text stay.

``documents`` has no host; its ``source`` stands for it. Line hashes, counts and
text hashes are moved between machines. ``keep`` moves the texts of rows that a
bitmap of rejected keys marks, which are little more than those rejected; all
others stay where they are read.

Defined results: null text has no words and fails the base; null source is a host
of its own, shared with the empty name; repeated rows are judged alike; an empty
table gives an empty result; a very long text is one row of its own, judged whole;
a line that exactly ``max_docs`` texts hold stays; extra columns are ignored by
``judge`` and kept by ``keep``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import divided, fresh, written

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
LIMITS = {"max_docs": 20, "least_words": 5, "least_share": 0.2}


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more."""
    n = F.size(words)

    def widen(h: Column, by: int, left: Column) -> Column:
        return F.zip_with(F.slice(h, 1, left), F.slice(h, by + 1, left), lambda a, b: F.xxhash64(a, b))

    return F.when(n > WINDOW, widen(widen(widen(hashes, 1, n - 1), 2, n - 3), 4, n - 7)).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)
    no = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    after = F.zip_with(ordered, F.concat(F.slice(ordered, 2, n), no), lambda a, b: F.struct(a.h.alias("h"), a.i.alias("i"), (a.h == b.h).alias("same")))
    both = F.zip_with(after, F.concat(no, F.slice(ordered, 1, n - 1)), lambda a, b: F.when(F.coalesce(a.same, F.lit(False)) | F.coalesce(a.h == b.h, F.lit(False)), a.i))
    return F.array_sort(F.filter(both, lambda i: i.isNotNull()))


def _span(places: Column) -> Column:
    """How many words windows at these places cover."""
    gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)


def parse(docs: DataFrame) -> DataFrame:
    """One narrow row a document: doc_id, host, key, the base figures, and its lines as (hash, words)."""
    split = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    split = split.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    split = split.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    split = split.withColumn("windows", _repeat_words(F.col("words"), F.col("hashes")))
    split = split.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    split = split.withColumn("normal", F.transform("lines", lambda x: F.trim(F.regexp_replace(F.lower(x), SPACES, " "))))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    places = F.when(some, _covered(F.col("windows"))).otherwise(F.array().cast("array<int>"))
    split = split.withColumn("places", places)
    return split.select(
        "doc_id", "host", text_key(F.col("text")).alias("key"),
        F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _span(F.col("places")).cast("long").alias("n_repeat_words"),
        F.transform("normal", lambda x: F.struct(F.xxhash64(x).alias("line"), (F.regexp_count(x, F.lit(" ")) + 1).alias("n"))).alias("lines"),
    )


def _verdicts(docs: DataFrame, max_docs: int, least_words: int, least_share: float) -> DataFrame:
    parsed = written(parse(docs).withColumn("row", F.monotonically_increasing_id()))
    lines = parsed.select("row", "host", "key", F.explode("lines").alias("x")).select("row", "host", "key", "x.line", "x.n")
    counted = lines.select("host", "line", "key").distinct().groupBy("host", "line").count()
    frequent = written(counted.where(F.col("count") > max_docs).select("host", "line"))
    removed = written(lines.join(frequent, ["host", "line"], "left_semi").groupBy("row").agg(F.sum("n").alias("removed")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    judged = parsed.drop("lines").join(removed, "row", "left").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~failed & (left >= least_words) & (left >= least_share * F.col("n_words")))


def judge(docs: DataFrame, **limits: float) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return _verdicts(docs, **(LIMITS | limits)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of docs that judge keeps, with all their columns."""
    out = _verdicts(docs, **(LIMITS | limits)).where(~F.col("kept"))
    names = host, a, b = fresh(docs, "__host", "__a", "__b")
    out = written(out.select(F.col("host").alias(host), F.col("key.a").alias(a), F.col("key.b").alias(b)).distinct())
    key = text_key(F.coalesce("text", F.lit("")))
    clear, marked = divided(docs, key.getField("a"), out, a)
    own = (F.coalesce("source", F.lit("")), key.getField("a"), key.getField("b"))
    same = reduce(Column.__and__, (x == F.col(y) for x, y in zip(own, names, strict=True)))
    return clear.unionByName(marked.join(out.hint("merge"), same, "left_anti"))


#: The same rules over exact strings in DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 6, 1))) AS u(i)),
dup AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM win JOIN dup USING (r, g), unnest(range(0, 8)) AS v(k) GROUP BY r),
l AS (SELECT r, host, t, line FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
nl AS (SELECT r, host, t, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
f AS (SELECT host, line FROM nl GROUP BY host, line HAVING count(DISTINCT t) > 20),
rm AS (SELECT r, sum(n) AS n FROM nl SEMI JOIN f USING (host, line) GROUP BY r),
m AS (SELECT r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM w),
j AS (SELECT m.*, coalesce(dl.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_words - coalesce(rm.n, 0) AS words_left
      FROM m LEFT JOIN dl USING (r) LEFT JOIN rep USING (r) LEFT JOIN rm USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND words_left >= 5 AND words_left >= 0.2 * n_words AS kept
FROM j
"""
