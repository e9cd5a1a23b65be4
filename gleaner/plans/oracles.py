"""SQL twins of the queries, for DuckDB. Each is put behind the logical tables' common table expressions."""

from __future__ import annotations

from gleaner.functions import fixed
from gleaner.functions.stem import _ACCENTED, _PLAIN, porter
from gleaner.sources.logical import AS_OF, CTES

TRIMMED = r"regexp_replace(regexp_replace({}, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def words(x: str) -> str:
    return WORDS.format(x)


def with_tables(body: str, extra: str = "") -> str:
    return f"WITH {CTES}{',' + extra if extra else ''} {body}"


def tf(tokens: tuple[str, ...], prefix: bool = False) -> str:
    """Occurrences of a phrase in both columns' token lists."""
    k = len(tokens)
    part = lambda j, v: f"starts_with({v}, '{tokens[j]}')" if prefix and j == k - 1 else f"{v} = '{tokens[j]}'"
    count = lambda c: f"len(list_filter({c}, lambda x, i: {' AND '.join([part(0, 'x'), *(f'coalesce({part(j, f"{c}[i + {j}]")}, false)' for j in range(1, k))])}))"
    return f"{count('c')} + {count('s')}"


def search(phrases: list[tuple[tuple[str, ...], bool]], where: str, scored: list[int] | None = None, tail: str = "", pick: str = "id, round(score, 6) AS score, round(rank, 6) AS rank, position") -> str:
    scored = list(range(len(phrases))) if scored is None else scored
    idf = lambda i: f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END"
    part = lambda i: f"({idf(i)}) * (t{i} * {fixed.BM25_K1 + 1}::DOUBLE / (t{i} + {fixed.BM25_K1}::DOUBLE * ({1 - fixed.BM25_B}::DOUBLE + {fixed.BM25_B}::DOUBLE * dl / average)))"
    every = ", ".join(f"{tf(*p)} AS t{i}" for i, p in enumerate(phrases))
    counts = ", ".join(f"count(*) FILTER (t{i} > 0) AS df{i}" for i in range(len(phrases)))
    return f"""
tok AS (SELECT *, regexp_extract_all(lower(content), '[a-z0-9]+') AS c, regexp_extract_all(lower(summary), '[a-z0-9]+') AS s FROM snippets),
cnt AS (SELECT *, len(c) + len(s) AS dl, {every} FROM tok),
corpus AS (SELECT count(*) AS n, avg(dl) AS average, {counts} FROM cnt),
scored AS (SELECT cnt.*, {' + '.join(map(part, scored))} AS score FROM cnt, corpus WHERE {where}),
best AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 10),
ranked AS (SELECT *, greatest(score, 0) * 0.8::DOUBLE + exp(-floor((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400) / 30) * 0.2::DOUBLE AS rank,
           row_number() OVER (ORDER BY score DESC, id) AS position FROM best {tail})
""", f"SELECT {pick} FROM ranked"


def searching(*args, **options) -> str:
    extra, body = search(*args, **options)
    return with_tables(body, extra)


def inflected(stems: list[str]) -> list[list[str]]:
    """For each stem the words that end in up to two common suffixes and have it, precomputed here as DuckDB has another stemmer."""
    ends = ["", "s", "es", "ed", "ing", "er", "ers", "ly", "ion", "ions", "al", "e", "en", "ness", "ful", "able", "ment", "ity", "ive", "ous", "ism", "ate", "ize", "ation", "y", "ies"]
    return [sorted({stem + a + b for a in ends for b in ends if porter(stem + a + b) == stem}) for stem in stems]


def stem_search(stems: list[str], where: str) -> tuple[str, str]:
    """As search, over folded tokens that have one of the stems."""
    read = "regexp_extract_all(translate(lower({}), '" + _ACCENTED + "', '" + _PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"
    extra, body = search([((s,), False) for s in stems], where, pick="id, round(score, 6) AS score")
    for stem, words in zip(stems, inflected(stems), strict=True):
        for c in "cs":
            extra = extra.replace(f"len(list_filter({c}, lambda x, i: x = '{stem}'))", f"len(list_filter({c}, lambda x, i: x IN {_in(words)}))")
    for c in ("content", "summary"):
        extra = extra.replace(f"regexp_extract_all(lower({c}), '[a-z0-9]+')", read.format(c))
    return extra, body


def _line_count(condition: str) -> str:
    return f"len(list_filter(ls, lambda x: {condition}))"


def _any(x: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


COSINE = "list_cosine_similarity({}, {})"
CLOSURE = "RECURSIVE_closure"

LINES = r"CASE WHEN {0} = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(replace({0}, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) END"

KEYWORDS = "keywords(keyword, category, emoji, weight) AS (VALUES " + ", ".join("('{}', '{}', '{}', {})".format(k.replace("'", "''"), c, e, w) for k, c, e, w in fixed.CATEGORY_KEYWORDS) + ")"

CENTROIDS = """
member AS (SELECT category_id, snippet_id FROM snippet_categories),
part AS (SELECT category_id, i AS pos, avg(embedding[i]::DOUBLE) AS x, count(*) AS n FROM member JOIN vectors USING (snippet_id), unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY ALL),
mean AS (SELECT category_id, max(n) AS n, list(x ORDER BY pos) AS m FROM part GROUP BY 1),
centroid AS (SELECT category_id, n, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM mean)
"""


def nearest(where: str) -> str:
    return with_tables(
        "SELECT snippet_id, category_id, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY snippet_id ORDER BY round(confidence, 9) DESC, name) AS r FROM sims WHERE confidence >= 0.3) WHERE r = 1",
        f"{CENTROIDS}, sims AS (SELECT v.snippet_id, centroid.category_id, name, list_cosine_similarity(v.embedding::DOUBLE[], c) AS confidence FROM (SELECT * FROM vectors {where}) v, centroid JOIN categories ON categories.id = centroid.category_id WHERE centroid.n >= 2)",
    )


TREE = """WITH RECURSIVE {}, closure AS (SELECT id AS ancestor, id AS descendant FROM categories UNION ALL SELECT c.ancestor, k.id FROM closure c JOIN categories k ON k.parent_id = c.descendant) {}"""


def closed(body: str) -> str:
    return TREE.format(CTES, body)
