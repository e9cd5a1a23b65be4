"""Operator 1: url verdicts from prefix rules and link-graph propagation.

A rule is a host and a path prefix and fits the host and its subdomains; the
longest rule that fits decides. Other urls get their host's verdict: personalised
PageRank spreads trust from hosts with allowed urls along links, and distrust from
hosts with blocked urls against links, and a host is blocked where distrust
exceeds ``ratio`` times its trust by more than a share of ``TIE``. The unrounded
scores are compared, as they shrink with the table, in the SQL twin too; the
columns shown are rounded.

Scores are propagated until no host's changes by more than a share of ``SETTLED``
in ``EVERY`` rounds, so every host that a path joins to a seed is reached, however
long the path. The SQL twin stops after ``ROUNDS``, which is the same where pages
link to their own host only.

Links come from the pages' href attributes; a link without a host stays on its
page's host. Links are summed to host edges before any join, so a hot host is as
many rows as it has neighbours. Seeds are weighted by their numbers of ruled urls,
with one total for both kinds, so that the two scores compare.

Defined results: a null url or one without ``://`` has an empty host and path, no
rule, and verdict allow; a host that neither score reaches is allowed; repeated
rows are judged alike; an empty table gives an empty result. Null html has no
links. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count as numbers

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import written

#: verdict, host and path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ROUNDS, DAMPING, RATIO = 8, 0.85, 1.0
#: Scores that differ by a smaller share are a tie: sums are added up in any order.
TIE = 1e-7
#: Rounds between written tables, and the change in them that counts as none; scores under LEAST, some 4,000 links from a seed, don't count.
EVERY, SETTLED, LEAST = 4, 1e-9, 1e-290
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?i)href\s*=\s*["']((?:https?:)?//[^/?#"'\s]+|[^"'#][^"']*)["']"""


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, share: the share of src's links that go to dst."""
    target = F.regexp_extract("href", r"^(?:[A-Za-z]+:)?//([^/?#]+)", 1)
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))).alias("href")).where(F.col("src") != "")
    edges = links.select("src", F.when(target == "", F.col("src")).otherwise(lower_ascii(target)).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return edges


def propagate(edges: DataFrame, seeds: DataFrame, source: str, target: str, rounds: int | None, damping: float) -> DataFrame:
    """host, score: personalised PageRank of seeds (host, seed) along edges from source to target, of so many rounds or settled. Mass at hosts without edges is lost."""
    totals = edges.groupBy(source).agg(F.sum("n").alias("total"))
    shares = written(edges.join(totals, source).select(F.col(source).alias("host"), F.col(target).alias("to"), (F.col("n") / F.col("total")).alias("share")))
    score = last = seeds.select("host", F.col("seed").alias("score"))
    for turn in numbers() if rounds is None else range(rounds):
        moved = score.join(shares, "host").select(F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        score = moved.unionByName(seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))).groupBy("host").agg(F.sum("score").alias("score"))
        if turn % EVERY == EVERY - 1:
            score = written(score)
            if rounds is None and _settled(last, score):
                break
            last = score
    return score


def _settled(last: DataFrame, score: DataFrame) -> bool:
    """No host is new or has another score. Hosts once reached stay."""
    before = last.select("host", F.col("score").alias("before"))
    change = F.abs(F.col("score") - F.coalesce("before", F.lit(0.0)))
    return score.where(F.col("score") > LEAST).join(before, "host", "left").where(change > SETTLED * F.col("score")).isEmpty()


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, rounds: int | None = None, damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    count = lambda v: F.sum((F.coalesce(F.col("found.verdict"), F.lit("")) == v).cast("double"))
    seeds = written(rows.where(F.col("found").isNotNull()).groupBy("host").agg(count("allow").alias("allow"), count("block").alias("block")))
    total = F.lit(float(seeds.agg(F.sum(F.col("allow") + F.col("block"))).first()[0] or 1.0))
    edges = written(host_edges(pages))
    trust = propagate(edges, seeds.where("allow > 0").select("host", (F.col("allow") / total).alias("seed")), "src", "dst", rounds, damping)
    distrust = propagate(edges, seeds.where("block > 0").select("host", (F.col("block") / total).alias("seed")), "dst", "src", rounds, damping)
    hosts = written(trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full"))
    trusted, distrusted = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrusted > ratio * trusted * (1 + TIE), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(hosts, "host", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"),
        F.round(trusted, 9).alias("trust"), F.round(distrusted, 9).alias("distrust"),
    )


def sql(rules: Iterable[tuple[str, str]] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, ratio: float = RATIO) -> str:
    """The same in DuckDB, a common table expression for each round."""
    cases = {"rule": "", "verdict": ""}
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN"
        cases["rule"] += f" {fits} '{rule}'"
        cases["verdict"] += f" {fits} '{verdict}'"
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = f"coalesce({lower.format(f"regexp_extract(url, '{pattern}', 1)")}, '')"
    href = HREF.replace("'", "''")
    parts = [
        f"h AS (SELECT page_id, html, {host} AS host, coalesce(regexp_extract(url, '{pattern}', 2), '') AS path FROM pages)",
        f"r AS (SELECT page_id, host, path, CASE{cases['rule']} END AS rule, CASE{cases['verdict']} END AS ruled FROM h)",
        "total AS (SELECT greatest(count(ruled), 1)::DOUBLE AS n FROM r)",
        f"links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)) AS href FROM h WHERE host <> '')",
        f"e AS (SELECT src, CASE WHEN regexp_extract(href, '^(?:[A-Za-z]+:)?//([^/?#]+)', 1) = '' THEN src ELSE {lower.format("regexp_extract(href, '^(?:[A-Za-z]+:)?//([^/?#]+)', 1)")} END AS dst, count(*)::DOUBLE AS n FROM links GROUP BY ALL)",
    ]
    for kind, verdict, source, target in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        parts.append(f"{kind}s AS (SELECT host, count(*) / any_value(n) AS seed FROM r, total WHERE ruled = '{verdict}' GROUP BY host)")
        parts.append(f"{kind}e AS (SELECT {source} AS host, {target} AS dest, n / sum(n) OVER (PARTITION BY {source}) AS share FROM e)")
        parts.append(f"{kind}0 AS (SELECT host, seed AS score FROM {kind}s)")
        for i in range(rounds):
            parts.append(f"{kind}{i + 1} AS (SELECT host, sum(score) AS score FROM (SELECT dest AS host, score * share * {damping} AS score FROM {kind}{i} JOIN {kind}e USING (host) UNION ALL SELECT host, seed * {1 - damping} FROM {kind}s) GROUP BY host)")
    last = f"FROM r LEFT JOIN t{rounds} AS t USING (host) LEFT JOIN d{rounds} AS d USING (host)"
    parts.append(f"j AS (SELECT r.*, coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust {last})")
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > {ratio} * trust * (1 + {TIE}) THEN 'block' ELSE 'allow' END) AS verdict, round(trust, 9) AS trust, round(distrust, 9) AS distrust FROM j"
