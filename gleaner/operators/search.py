"""Keyword retrieval: tokens, BM25 over content and summary, recency, fuzzy match, highlighting, an index for many queries."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions.stem import fold, stem
from gleaner.operators import query_language as ql

ASCII_TOKEN = "[a-z0-9]+"


def tokens(x: Column) -> Column:
    """Lower-cased ASCII runs; what the SQL twins use."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(ASCII_TOKEN), F.lit(0))


def unicode_tokens(x: Column) -> Column:
    """Runs of letters and numbers without diacritics."""
    return F.regexp_extract_all(fold(F.lower(F.coalesce(x, F.lit("")))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def occurrences(words: Column, leaf: ql.Words) -> Column:
    """How often a phrase occurs in a token array."""
    k = len(leaf.tokens)
    fits = lambda t, j: t.startswith(leaf.tokens[j]) if leaf.prefix and j == k - 1 else t == leaf.tokens[j]
    if k == 1:
        return F.size(F.filter(words, lambda t: fits(t, 0)))
    at = lambda t, i: reduce(lambda a, b: a & b, [fits(t, 0), *(F.coalesce(fits(F.get(words, i + j), j), F.lit(False)) for j in range(1, k))])
    return F.size(F.filter(words, at))


def _near(words: Column, near: ql.Near) -> Column:
    """Whether the two words occur with at most so many tokens between them."""
    places = lambda leaf: F.filter(F.transform(words, lambda t, i: F.when(t == leaf.tokens[0], i)), lambda i: i.isNotNull())
    return F.exists(places(near.first), lambda a: F.exists(places(near.second), lambda b: F.abs(a - b) - 1 <= near.distance))


def holds(tree: object, found: dict[ql.Words, Column], near: dict[ql.Near, Column]) -> Column:
    if isinstance(tree, ql.Words):
        return found[tree] > 0
    if isinstance(tree, ql.Near):
        return near[tree]
    if isinstance(tree, ql.Not):
        return holds(tree.keep, found, near) & ~holds(tree.drop, found, near)
    parts = [holds(p, found, near) for p in tree.parts]
    return reduce((lambda a, b: a & b) if isinstance(tree, ql.And) else (lambda a, b: a | b), parts)


def idf(total: Column, having: Column) -> Column:
    raw = F.log((total - having + 0.5) / (having + 0.5))
    return F.when(raw <= 0, F.lit(fixed.IDF_FLOOR)).otherwise(raw)


def saturation(tf: Column, length: Column, average: Column) -> Column:
    return tf * (fixed.BM25_K1 + 1) / (tf + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * length / average))


def bm25(snippets: DataFrame, tree: object, tokenizer=tokens) -> DataFrame:
    """snippets that satisfy the tree, with score: one scan for the corpus figures (one row), one for the scores."""
    phrases = ql.leaves(tree)
    scored = scored_leaves(tree)
    read = snippets.withColumns({"__c": tokenizer(F.col("content")), "__s": tokenizer(F.col("summary"))})
    tf = {p: occurrences(F.col("__c"), p) + occurrences(F.col("__s"), p) for p in phrases}
    figures = read.select((F.size("__c") + F.size("__s")).alias("__dl"), *((tf[p]).alias(f"__tf{i}") for i, p in enumerate(phrases)))
    corpus = figures.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *(F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"__df{i}") for i in range(len(phrases))))
    nears = {n: _near(F.col("__c"), n) | _near(F.col("__s"), n) for n in ql.nears(tree)}
    counted = read.withColumns({"__dl": F.size("__c") + F.size("__s")} | {f"__tf{i}": tf[p] for i, p in enumerate(phrases)})
    hits = counted.where(holds(tree, {p: F.col(f"__tf{i}") for i, p in enumerate(phrases)}, nears))
    both = hits.crossJoin(F.broadcast(corpus))  # one row
    parts = [idf(F.col("__n"), F.col(f"__df{i}")) * saturation(F.col(f"__tf{i}"), F.col("__dl"), F.col("__avg")) for i, p in enumerate(phrases) if p in scored]
    return both.select(*snippets.columns, reduce(lambda a, b: a + b, parts).alias("score"))


def scored_leaves(tree: object) -> list[ql.Words]:
    """The phrases that count for the score: a Not's right side only excludes."""
    return [p for p in ql.leaves(tree) if p not in _dropped(tree)]


def _dropped(tree: object) -> set[ql.Words]:
    if isinstance(tree, ql.Not):
        return set(ql.leaves(tree.drop)) - set(ql.leaves(tree.keep)) | _dropped(tree.keep)
    return set() if isinstance(tree, ql.Words | ql.Near) else set().union(*map(_dropped, tree.parts))


def recency(score: Column, created_at: Column, as_of: Column) -> Column:
    days = F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(created_at.cast("timestamp"))) / 86400)
    return F.greatest(score, F.lit(0.0)) * fixed.RECENCY_SCORE + F.exp(-days / fixed.RECENCY_DAYS) * fixed.RECENCY_AGE


def keyword_search(snippets: DataFrame, query: str, as_of: Column, limit: int = fixed.SEARCH_LIMIT, tokenizer=tokens, index=None, **options: bool) -> DataFrame:
    """The best snippets by BM25, ties by id, with position (from 1), score and rank (blended with recency). Phrase queries keep snippets whose content holds the phrase.

    With an index (postings.Index), only the postings of the query's terms are read, and
    of snippets the rows found: their ids, ``limit`` at most, come to the driver and are
    pushed down to the scan. Without one, all texts are read.
    """
    tree = ql.parse(query, **options)
    if tree is None:
        return snippets.limit(0).withColumns({"score": F.lit(0.0), "rank": F.lit(0.0), "position": F.lit(0)})
    if index is None:
        best = bm25(snippets, tree, tokenizer).orderBy(F.desc("score"), "id").limit(limit)
    else:
        found = [(r.id, r.score) for r in index.bm25(tree).orderBy(F.desc("score"), "id").limit(limit).collect()]
        scores = F.create_map(*(F.lit(x) for pair in found for x in pair)) if found else F.create_map().cast("map<bigint,double>")
        best = snippets.where(F.col("id").isin([i for i, _ in found])).withColumn("score", scores[F.col("id")].cast("double"))
    if isinstance(tree, ql.Words) and len(tree.tokens) > 1:
        best = best.where(F.lower("content").contains(query.strip().strip('"').lower()))
    ranked = best.withColumn("rank", recency(F.col("score"), F.col("created_at"), as_of))
    return ranked.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # limit rows at most


def fuzzy_budget(word: str) -> int:
    return 0 if len(word) <= 2 else 1 if len(word) <= 4 else 2


def fuzzy_match(text: Column, word: str, budget: int | None = None) -> Column:
    """Whether some token is within the edit budget, or a prefix either way within it."""
    d = fuzzy_budget(word) if budget is None else budget
    n = len(word.encode())
    w = F.lit(word.lower())
    parts = F.transform(F.split(F.lower(text), r"\s+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    near = lambda t: (F.levenshtein(t, w) <= d) & (F.levenshtein(t, w) < n)
    prefix = lambda t: (t.startswith(w) | w.startswith(t)) & (F.abs(F.octet_length(t) - n) <= d)
    return F.exists(F.filter(parts, lambda t: t != ""), lambda t: near(t) | prefix(t))


def fuzzy_majority(text: Column, query: str) -> Column:
    """Of one or two words one must match, of more at least half; an empty query matches."""
    found = query.split()
    if not found:
        return F.lit(True)
    n = reduce(lambda a, b: a + b, [fuzzy_match(text, w).cast("int") for w in found])
    return n >= (1 if len(found) <= 2 else -(-len(found) // 2))


def build_index(snippets: DataFrame, tokenizer=unicode_tokens) -> DataFrame:
    """id, col, pos, term (stemmed), length of the row. Stems are found once for each distinct term."""
    rows = snippets.select("id", F.explode(F.array(F.struct(F.lit("content").alias("col"), tokenizer(F.col("content")).alias("words")), F.struct(F.lit("summary").alias("col"), tokenizer(F.col("summary")).alias("words")))).alias("x"))
    posted = rows.select("id", "x.col", F.posexplode("x.words").alias("pos", "token"))
    stems = posted.select("token").distinct().select("token", stem(F.col("token")).alias("term"))
    return posted.join(stems, "token").select("id", "col", "pos", "term")


def search_many(postings: DataFrame, queries: DataFrame, limit: int = fixed.SEARCH_LIMIT, any_term: bool = False) -> DataFrame:
    """query_id, id, score, position: the best of each query (query_id, term rows). All terms must occur; with any_term, a query that no row satisfies so takes rows with any of them. Terms meet postings by an equi-join; nothing is compared pairwise."""
    lengths = postings.groupBy("id").agg(F.count("*").alias("dl"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("average"))
    wanted = queries.select("query_id", "term").distinct()
    tf = postings.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term", "id").agg(F.count("*").alias("tf"))
    return best_of_each(tf.join(lengths, "id"), corpus, wanted, limit, any_term)


def best_of_each(tf: DataFrame, corpus: DataFrame, wanted: DataFrame, limit: int, any_term: bool) -> DataFrame:
    """search_many from term, id, tf, dl rows of the wanted terms and one row of n, average."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(corpus))  # one row
    weighed = weighed.select("term", "id", (idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("average"))).alias("part"))
    size = wanted.groupBy("query_id").agg(F.count("*").alias("terms"))
    hits = wanted.join(weighed, "term").groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.count("*").alias("have"))
    whole = F.col("have") == F.col("terms")
    hits = hits.join(size, "query_id").withColumn("whole", whole)
    if not any_term:
        hits = hits.where("whole")
    own = Window.partitionBy("query_id")
    place = F.row_number().over(own.orderBy(F.desc("whole"), F.desc(F.round("score", 9)), "id"))
    best = hits.withColumn("position", place).where(F.col("position") <= limit)
    best = best.withColumn("found", F.max("whole").over(own)).where(F.col("whole") | ~F.col("found"))  # limit rows a query
    return best.select("query_id", "id", "score", "position")


def query_words(query: str) -> list[str]:
    """Phrases, then words of over two characters that are no operators."""
    import re

    phrases = [p.lower() for p in re.findall(r'"([^"]+)"', query)]
    rest = re.sub(r'"[^"]+"', "", query).lower().replace("(", " ").replace(")", " ").split()
    return phrases + [w for w in rest if len(w) > 2 and w not in ("and", "or", "not")]


def window_of(content: str, found: list[str], size: int) -> str:
    """The stretch with most matches, ends moved to blanks."""
    low = content.lower()
    places = sorted(m for w in found for m in _starts(low, w))
    if not places:
        return content[:size] + ("..." if len(content) > size else "")
    counts = [sum(1 for q in places if p <= q < p + size) for p in places]
    best = places[counts.index(max(counts))]
    first, last = max(0, best - 50), min(len(content), best + size + 50)
    if first and 0 <= (blank := content.find(" ", first)) < first + 20:
        first = blank + 1
    if last < len(content) and (blank := content.rfind(" ", 0, last + 1)) > last - 20 and blank >= 0:
        last = blank
    return ("..." if first else "") + content[first:last] + ("..." if last < len(content) else "")


def _starts(text: str, word: str) -> list[int]:
    found, at = [], text.find(word)
    while at >= 0:
        found.append(at)
        at = text.find(word, at + len(word))
    return found


def marked(text: str, found: list[str]) -> str:
    """HTML with matches, merged where they overlap, in mark elements."""
    import html

    low, spans = text.lower(), []
    for a, b in sorted((m, m + len(w)) for w in found for m in _starts(low, w)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    out, at = [], 0
    for a, b in spans:
        out += [html.escape(text[at:a]), "<mark>", html.escape(text[a:b]), "</mark>"]
        at = b
    return "".join([*out, html.escape(text[at:])])


def highlight(content: Column, query: str, size: int = 300) -> Column:
    found = query_words(query)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else marked(window_of(t, found, size), found))

    return run(content)
