"""Operator 7: line dedup by a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: its number of tokens, then its first
``LEAD`` tokens, with tokens that hold a digit generalised to ``<*>``. A leaf that
enough distinct texts share gets a template: at each place the commonest token of
the leaf's lines. A line follows a template if at least ``alike`` percent of its
tokens do; the other places are its variable fields. Lines that don't follow part by
their token at the place where the leaf's lines agree most, so that several wordings
in one leaf come apart; each branch gets a template in the same way, ``depth``
levels in all, whatever the number of templates. The lines left then are compared by their whole generalised wording. A template or wording that
the lines of ``min_docs`` distinct texts follow recurs (for lines of
``long_tokens`` tokens or more: of ``long_docs``), if ``constant`` percent of its
tokens are constant, so that lines of numbers only don't count as alike. Lines
that recur are dropped, except in the first text (smallest doc_id) that has them:
no passage is lost from all documents.

Exact copies count as one text, so they keep their lines; copies are another
operator's work. Templates are formed over distinct wordings with their numbers of
lines, so a line that half the corpus shares is one row there. Only lines of shared
leaves are taken apart. Of the texts, those move that have lines to drop, as told
by a bitmap of fixed size, and no others.

Defined results: null text has no lines and stays null; lines without a word are
kept; null doc_ids come last, and of equal doc_ids the text with the smaller hash is
first; between tokens equally common at a place the greater in byte order makes
the template; a text all of whose lines go becomes empty; repeated rows are treated
alike; a very long text or line is treated whole; an empty table gives an empty
result; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.quality_rules import SPACES, text_key
from gleaner.llm.shared import divided, fresh, quoted, written

LEAD = 3
LIMITS = {"min_docs": 5, "long_docs": 2, "long_tokens": 50, "alike": 70, "constant": 50, "depth": 3}
#: Wordings of a leaf beyond which its tokens are dealt by place and token instead of by leaf.
LARGE = 20_000
#: A generalised token.
ANY = "<*>"


def _lines(texts: DataFrame) -> DataFrame:
    """texts with a row for each line that holds a word: at, line (lower case)."""
    others = [c for c in texts.columns if c != "text"]
    lines = texts.select(*others, F.posexplode(F.split(F.lower("text"), "\n")).alias("at", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _placed(lines: DataFrame) -> DataFrame:
    """lines with single spaces, and with size (tokens) and leaf (hash of the path)."""
    line = F.col("line")
    odd = reduce(Column.__or__, map(line.contains, ("  ", "\t", "\v", "\f", "\r")), line.startswith(" ") | line.endswith(" "))
    lines = lines.withColumn("line", F.when(odd, F.trim(F.regexp_replace("line", SPACES, " "))).otherwise(line))
    size = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    path = _general(F.substring_index("line", " ", LEAD))
    return lines.withColumn("size", size).withColumn("leaf", F.xxhash64("size", path))


def _general(line: Column) -> Column:
    """A line with <*> for each token that holds a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", ANY)).otherwise(line)


def _steady(tokens: Column, constant: int) -> Column:
    """Whether enough of the tokens are constant."""
    return 100 * F.size(F.filter(tokens, lambda t: t != ANY)) >= constant * F.size(tokens)


def _met(left: DataFrame, alike: int, constant: int, large: bool) -> DataFrame:
    """left with what follows its node's template (follows), by how many lines (n), and all the node's lines (total)."""
    tokens = F.split("wording", " ")
    seen = left.select("node", "weight", F.posexplode(tokens).alias("place", "token")).groupBy("node", "place", "token").agg(F.sum("weight").alias("n"))
    common = seen.groupBy("node", "place").agg(F.max_by("token", F.struct("n", "token")).alias("token"))
    templates = common.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).getField("token").alias("template"))
    same = F.size(F.filter(F.zip_with(tokens, "template", lambda a, b: a == b), lambda x: x))
    met = left.join(templates.where(_steady(F.col("template"), constant)).hint("merge"), "node", "left")  # the same plan at every size
    met = met.select(*left.columns, F.coalesce(100 * same >= alike * F.size(tokens), F.lit(False)).alias("follows"))
    n, total = F.sum(F.when(F.col("follows"), F.col("weight")).otherwise(0)), F.sum("weight")
    if large:
        return met.join(met.groupBy("node").agg(n.alias("n"), total.alias("total")), "node")
    node = Window.partitionBy("node")
    return met.withColumns({"n": n.over(node), "total": total.over(node)})


def _branches(left: DataFrame, large: bool) -> DataFrame:
    """node, line, branch of wordings with a parting token: one that enough of the node's lines have at its place, but half of them at most.

    Of several, the one at the place where lines agree most (the sum of squared numbers
    is greatest) decides: fields vary more than the words that tell wordings apart.
    """
    seen = left.select("node", "line", "weight", "need", "rest", F.posexplode(F.split("wording", " ")).alias("place", "token")).withColumn("token", F.xxhash64("token"))
    spot, n = ["node", "place", "token"], F.col("n").cast("double")
    if large:  # a token that most lines have is one row on the right; the left side's tasks may be split
        counts = seen.groupBy(*spot).agg(F.sum("weight").alias("n"), F.first("need").alias("need"), F.first("rest").alias("rest"))
        counts = counts.join(counts.groupBy("node", "place").agg(F.sum(n * n).alias("agree")), ["node", "place"])
        seen = seen.select(*spot, "line").join(counts.hint("merge"), spot)
    else:
        seen = seen.withColumn("n", F.sum("weight").over(Window.partitionBy(*spot)))
        seen = seen.withColumn("agree", F.sum(F.col("weight") * n).over(Window.partitionBy("node", "place")))
    parting = seen.where((F.col("n") >= F.col("need")) & (2 * F.col("n") <= F.col("rest")))
    best = F.max(F.struct("agree", "n", (-F.col("place")).alias("place"), "token")).alias("best")
    return parting.groupBy("node", "line").agg(best).select("node", "line", F.xxhash64("node", "best.place", "best.token").alias("branch"))


def _groups(wordings: DataFrame, alike: int, constant: int, depth: int) -> DataFrame:
    """leaf, line, exact, group: the node whose template each of the lines follows, or their whole generalised wording. Others follow none."""

    def both(step: Callable[[DataFrame, bool], DataFrame], rows: DataFrame) -> DataFrame:
        # dealt by node, wordings move instead of their single tokens; a large leaf's tokens are counted apart, wherever they are
        return step(rows.where(~F.col("large")).repartition("node"), False).unionByName(step(rows.where("large"), True))

    found, left = [], wordings.withColumn("node", F.col("leaf"))
    for level in range(depth):
        met = written(both(lambda rows, large: _met(rows, alike, constant, large), left))
        # more lines than texts may follow a template, not fewer: one that too few follow can't recur
        often = F.col("n") >= F.col("need")
        found.append(met.where(F.col("follows") & often).select("leaf", "line", F.lit(False).alias("exact"), F.col("node").alias("group")))
        rest = F.col("total") - F.when(often, F.col("n")).otherwise(0)
        left = met.where(~(F.col("follows") & often)).withColumn("rest", rest).where(F.col("rest") >= F.col("need")).drop("follows", "n", "total")
        if level + 1 == depth or left.isEmpty():
            break
        left = left.join(both(_branches, left).hint("merge"), ["node", "line"]).withColumn("node", F.col("branch")).drop("branch", "rest")
    out = reduce(DataFrame.unionByName, found)
    whole = wordings.where((F.col("weight") >= F.col("need")) & _steady(F.split("wording", " "), constant)).join(out, ["leaf", "line"], "left_anti")
    return out.unionByName(whole.select("leaf", "line", F.lit(True).alias("exact"), F.col("line").alias("group")))


def _drops(docs: DataFrame, min_docs: int, long_docs: int, long_tokens: int, alike: int, constant: int, depth: int) -> DataFrame:
    """__a, __b (a text's key), __at: numbers of the lines to drop, from 0."""
    need = lambda n: F.when(n >= long_tokens, long_docs).otherwise(min_docs)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", text_key(F.col("text")).alias("key"))
    lines = _placed(_lines(texts))
    leaves = lines.select("key", "leaf", "size").distinct()
    shared = written(leaves.groupBy("leaf", "size").count().where(F.col("count") >= need(F.col("size"))).select("leaf"))

    # leaves, not lines, are in the bitmap: of them there are far fewer. What it lets through besides does no harm: nothing recurs in other leaves
    inside = divided(lines, F.col("leaf"), shared, "leaf")[1].withColumn("wording", _general(F.col("line")))
    inside = written(inside.select("leaf", F.xxhash64("wording").alias("line"), "size", "key", "at", "doc_id", "wording"))
    lines = inside.groupBy("leaf", "line", "size", "key", "at").agg(F.min("doc_id").alias("doc_id"))
    weights = written(lines.groupBy("leaf", "line").agg(F.count("*").alias("weight")))
    wordings = inside.select("leaf", "line", "wording", need(F.col("size")).alias("need")).distinct()
    large = weights.groupBy("leaf").agg((F.count("*") > LARGE).alias("large")).join(shared.hint("merge"), "leaf", "left_semi")
    weighed = wordings.join(weights.join(large, "leaf"), ["leaf", "line"])
    groups = written(_groups(written(weighed), alike, constant, depth))

    group = ["leaf", "exact", "group"]
    following = written(lines.join(groups, ["leaf", "line"]).drop("line"))
    # nulls last: the flag comes first
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).getField("key").alias("first")
    texts_of = following.groupBy(*group, "key").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"))
    recurring = written(texts_of.groupBy(*group).agg(F.count("*").alias("n"), F.first("size").alias("size"), first).where(F.col("n") >= need(F.col("size"))).select(*group, "first"))
    gone = following.join(recurring, group).where(F.col("key") != F.col("first")).select("key", "at")
    return gone.groupBy(F.col("key.a").alias("__a"), F.col("key.b").alias("__b")).agg(F.collect_set("at").alias("__at"))


def drop_lines(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped", **limits: int) -> DataFrame:
    """docs with shorter texts, and two more columns of these names: how many lines there were and went."""
    a, b, at, split = fresh(docs, "__a", "__b", "__at", "__split")
    drops = written(_drops(docs, **(LIMITS | limits)).toDF(a, b, at))
    key = text_key(F.col("text"))
    clear, marked = divided(docs, key.getField("a"), drops, a)
    marked = marked.join(drops.hint("merge"), (key.getField("a") == F.col(a)) & (key.getField("b") == F.col(b)), "left").withColumn(split, F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), at)
    shorter = F.array_join(F.transform(kept, lambda i: F.get(F.col(split), i)), "\n")
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(shorter).alias("text")
    many = lambda x: F.when(F.col("text").isNull(), 0).otherwise(F.size(x)).cast("long").alias(n_lines)
    marked = marked.select(*(text if c == "text" else quoted(c) for c in docs.columns), many(F.col(split)), F.coalesce(F.size(at), F.lit(0)).cast("long").alias(n_dropped))
    return clear.select(*map(quoted, docs.columns), many(F.split("text", "\n")), F.lit(0).cast("long").alias(n_dropped)).unionByName(marked)


def dedup(docs: DataFrame, **limits: int) -> DataFrame:
    """docs with recurring lines dropped from their texts; n_chars, where there is one, follows."""
    out = drop_lines(docs, *fresh(docs, "__lines", "__dropped"), **limits).select(*map(quoted, docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def report(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_chars and text_sha256 of what is left."""
    out = drop_lines(docs.select("doc_id", "text"), **limits)
    left = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(left).cast("long").alias("n_chars"), F.sha2(left.cast("binary"), 256).alias("text_sha256"))


def sql(min_docs: int = 5, long_docs: int = 2, long_tokens: int = 50, alike: int = 70, constant: int = 50, depth: int = 3) -> str:
    """The same tree over exact strings in DuckDB."""
    need = lambda n: f"(CASE WHEN {n} >= {long_tokens} THEN {long_docs} ELSE {min_docs} END)"
    steady = lambda t: f"100 * len(list_filter({t}, lambda y: y <> '{ANY}')) >= {constant} * len({t})"
    parts = [
        "t AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text)",
        "l AS (SELECT text, doc_id, string_split(text, chr(10)) AS ls FROM t)",
        r"p AS (SELECT text, doc_id, i - 1 AS ln, regexp_extract_all(lower(ls[i]), '[^\x20\x09-\x0D]+') AS tok FROM l, unnest(range(1, len(ls) + 1)) AS u(i))",
        f"g AS (SELECT text, doc_id, ln, list_transform(tok, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{ANY}' ELSE x END) AS tok FROM p WHERE len(tok) > 0)",
        "k AS (SELECT *, len(tok) || '|' || tok[1] || '|' || coalesce(tok[2], '') || '|' || coalesce(tok[3], '') AS leaf FROM g)",
        f"s AS (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT text) >= {need('any_value(len(tok))')})",
        "h AS MATERIALIZED (SELECT * FROM k SEMI JOIN s USING (leaf))",
        f"o0 AS (SELECT leaf, leaf AS node, tok, count(*) AS weight, {need('len(tok)')} AS need FROM h GROUP BY leaf, tok)",
    ]
    for i in range(depth):
        parts += [
            f"c{i} AS (SELECT node, i AS place, tok[i] AS token, sum(weight) AS n FROM o{i}, unnest(range(1, len(tok) + 1)) AS u(i) GROUP BY ALL)",
            f"b{i} AS (SELECT node, place, token FROM c{i} QUALIFY row_number() OVER (PARTITION BY node, place ORDER BY n DESC, token DESC) = 1)",
            f"m{i} AS (SELECT node, list(token ORDER BY place) AS template FROM b{i} GROUP BY node)",
            f"f{i} AS (SELECT o.*, coalesce({steady('template')} AND 100 * len(list_filter(range(1, len(tok) + 1), lambda y: tok[y] = template[y])) >= {alike} * len(tok), false) AS follows FROM o{i} AS o JOIN m{i} USING (node))",
            f"s{i} AS (SELECT node, sum(CASE WHEN follows THEN weight ELSE 0 END) AS n, sum(weight) AS total FROM f{i} GROUP BY node)",
            f"w{i} AS MATERIALIZED (SELECT f.*, follows AND n >= need AS settled, total - CASE WHEN n >= need THEN n ELSE 0 END AS rest FROM f{i} AS f JOIN s{i} USING (node))",
            f"x{i} AS MATERIALIZED (SELECT node, tok, i AS place, tok[i] AS token, weight, need, rest FROM w{i}, unnest(range(1, len(tok) + 1)) AS u(i) WHERE NOT settled AND rest >= need)",
            f"y{i} AS (SELECT *, sum(weight) OVER (PARTITION BY node, place, token) AS n FROM x{i})",
            f"g{i} AS (SELECT *, sum(weight * n) OVER (PARTITION BY node, place) AS agree FROM y{i})",
            f"z{i} AS (SELECT node, tok, place, token FROM g{i} WHERE n >= need AND 2 * n <= rest QUALIFY row_number() OVER (PARTITION BY node, tok ORDER BY agree DESC, n DESC, place) = 1)",
            f"o{i + 1} AS MATERIALIZED (SELECT w.leaf, w.node || chr(10) || z.place || ' ' || z.token AS node, w.tok, w.weight, w.need FROM w{i} AS w JOIN z{i} AS z ON w.node = z.node AND w.tok = z.tok)",
        ]
    parts.append("v AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT leaf, tok, node, NULL AS line FROM w{i} WHERE settled" for i in range(depth)) + ")")
    whole = f"SELECT * FROM v UNION ALL SELECT leaf, tok, NULL, tok FROM o0 ANTI JOIN v USING (leaf, tok) WHERE weight >= need AND {steady('tok')}"
    parts += [
        f"a AS ({whole})",
        "fo AS MATERIALIZED (SELECT h.text, h.ln, h.doc_id, leaf, tok, coalesce(node, '') AS node, coalesce(array_to_string(line, ' '), '') AS line FROM h JOIN a USING (leaf, tok))",
        f"r AS (SELECT leaf, node, line, arg_min(text, doc_id) AS first FROM fo GROUP BY leaf, node, line HAVING count(DISTINCT text) >= {need('any_value(len(tok))')})",
        "x AS (SELECT fo.text, list(DISTINCT fo.ln) AS gone FROM fo JOIN r USING (leaf, node, line) WHERE fo.text <> r.first GROUP BY fo.text)",
        "z AS (SELECT d.doc_id, string_split(d.text, chr(10)) AS ls, x.gone FROM documents d LEFT JOIN x USING (text))",
        "q AS (SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(gone), 0) AS n_dropped, coalesce(array_to_string(list_filter(ls, lambda y, i: gone IS NULL OR NOT list_contains(gone, i - 1)), chr(10)), '') AS left_text FROM z)",
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, length(left_text)::BIGINT AS n_chars, sha256(left_text) AS text_sha256 FROM q"
