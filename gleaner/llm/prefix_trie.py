"""Operator 13: a trie over the first turns that conversations share.

Conversations are rebuilt first (each takes its first turns from the conversation whose
id ends in 00 below it), then every distinct sequence of first turns is a node. A turn
is 32 hex digits of the SHA-256 of role and text from the scan on, so texts never move.

1. Turns are shuffled once, by the hundred they belong to: a hundred has all that its
   rebuilt conversations need, and collapses equal ones to one row with a list of ids.
2. Equal sequences of all hundreds meet in order of ids; the hash of those ids is fed
   row by row, so a sequence that a third of all conversations share takes no memory.
3. Distinct sequences are dealt by the digest of their first turn, many first turns to
   a bucket, and applyInPandas builds each subtrie of a bucket with a dictionary of
   child pointers per node. Children are numbered after their parents, so one walk over
   the numbers backwards is the postorder.
4. A first turn with more than ``limit`` turns under it is dealt by its next turns
   instead, the shallowest prefix under which few enough remain. The sizes of all
   prefixes of such conversations are counted at once, so a deep split takes as many
   jobs as a shallow one. Nodes above the split are summed up in Spark, from their
   subtries' tops.

One conversation's digests (some 50 bytes a turn) are one row; nothing else gathers.

Defined results: rows without a conv_id are left out; null role or text counts as
empty; turns of one number (repeated rows included) are ordered by their digest and
all count; very long texts count as digests; an empty table gives an empty result;
other columns are ignored. ``%`` keeps the sign of the id, as SQL does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import prepare, written

#: Hex digits of a turn's digest.
WIDTH = 32
#: Turns of distinct sequences under one subtrie, and in a bucket of subtries on average.
LIMIT, BUCKET = 1024, 4096
NONE = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, WIDTH)


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """hundred, conv_id, turns (array of digest and chars) of each rebuilt conversation. Rows are dealt by hundred."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where(conv.isNotNull()).select(
        (conv - conv % every).alias("hundred"), conv.alias("conv_id"), F.col("turn").alias("turn"), _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("chars")
    )
    own = turns.repartition("hundred").groupBy("hundred", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("hundred"), F.slice("own", 1, most))).over(Window.partitionBy("hundred"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1)).cast("int")
    both = F.concat(F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), taken), F.slice("own", taken + 1, F.size("own")))
    return own.withColumn("head", head).select("hundred", "conv_id", F.transform(both, lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("turns"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal keys, with the hash of all its ids."""
    names = ["key", "path", "chars", "n_turns", "n", "conv_id", "ends"]
    last, found = None, []

    def flush(final: bool) -> list:
        done = found if final else found[:-1]
        for r in done:
            r["ends"] = r["ends"].hexdigest()
        if not final:
            del found[:-1]
        return done

    for batch in batches:
        for r in batch.to_pylist():
            if r["key"] == last:
                top = found[-1]
                top["n"] += r["n"]
                top["conv_id"] = min(top["conv_id"], r["conv_id"])
                top["ends"].update(b"," + r["ids"].encode())
            else:
                last = r["key"]
                found.append({k: r[k] for k in names[:-1]} | {"ends": hashlib.sha256(r["ids"].encode())})
        if done := flush(False):
            yield pa.RecordBatch.from_pylist(done, schema=_SEQUENCES)
    if found:
        yield pa.RecordBatch.from_pylist(flush(True), schema=_SEQUENCES)


_SEQUENCES = pa.schema([("key", pa.string()), ("path", pa.string()), ("chars", pa.list_(pa.int64())), ("n_turns", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])


def sequences(conversations: DataFrame) -> DataFrame:
    """key, path, chars, n_turns, n, conv_id, ends: a row for each distinct rebuilt conversation, with the number of its copies, the smallest id and the hash of all ids."""
    rows = rebuilt(conversations).select("hundred", "conv_id", F.array_join("turns.digest", "").alias("path"), F.col("turns.chars").alias("chars"))
    same = rows.groupBy("hundred", "path").agg(
        F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    keyed = same.select(_digest(F.col("path")).alias("key"), "hundred", "path", "chars", F.size("chars").cast("long").alias("n_turns"), "n", F.col("first").alias("conv_id"), "ids")
    return keyed.repartition("key").sortWithinPartitions("key", "hundred").mapInArrow(_ends, "key string, path string, chars array<long>, n_turns long, n long, conv_id long, ends string")


def _node(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:WIDTH]


def build_tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all subtries of a bucket. A top has its sequence's key as rep, its depth as cut and its parent node as above."""
    tops: dict[str, int] = {}
    below: list[dict[str, int]] = []
    conv, depth, parent, n_convs, chars, ends = [], [], [], [], [], []
    marks: dict[int, tuple[str, str | None]] = {}

    def new(c: int, d: int, p: int, length: int) -> int:
        below.append({})
        conv.append(c)
        depth.append(d)
        parent.append(p)
        n_convs.append(0)
        chars.append(length)
        ends.append(NONE)
        return len(conv) - 1

    for key, path, lengths, cut, n, c, hashed in zip(rows["key"], rows["path"], rows["chars"], rows["cut"], rows["n"], rows["conv_id"], rows["ends"], strict=True):
        at = tops.get(top := path[: WIDTH * cut])
        if at is None:
            at = tops[top] = new(c, cut, -1, int(lengths[cut - 1]))
            marks[at] = (key, _node(path[: WIDTH * (cut - 1)]) if cut > 1 else None)
        d = cut
        while True:
            n_convs[at] += n
            conv[at] = min(conv[at], c)
            if WIDTH * d == len(path):
                break
            turn = path[WIDTH * d : WIDTH * (d + 1)]
            to = below[at].get(turn)
            if to is None:
                to = below[at][turn] = new(c, d + 1, at, int(lengths[d]))
            at, d = to, d + 1
        ends[at] = hashed
    leaves = [0] * len(conv)
    saved = [(n - 1) * length for n, length in zip(n_convs, chars, strict=True)]
    for at in range(len(conv) - 1, -1, -1):  # children before their parents
        leaves[at] = leaves[at] or 1
        if (up := parent[at]) >= 0:
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    columns = {
        "conv_id": conv, "depth": depth, "parent_conv_id": pd.array([conv[p] if p >= 0 else None for p in parent], "Int64"), "n_convs": n_convs, "n_children": [len(x) for x in below], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends,
        "rep": [marks[i][0] if i in marks else None for i in range(len(conv))], "above": [marks[i][1] if i in marks else None for i in range(len(conv))],
    }
    return pd.DataFrame(columns)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix of each sequence."""
    for batch in batches:
        for r in batch.to_pylist():
            running, up, out = hashlib.sha256(), None, []
            for k in range(r["n_turns"]):
                running.update(r["path"][WIDTH * k : WIDTH * (k + 1)].encode())
                node = running.copy().hexdigest()[:WIDTH]
                last = k + 1 == r["n_turns"]
                out.append((r["key"], k + 1, node, up, r["chars"][k], r["n"], r["conv_id"], r["n_turns"] - k, r["ends"] if last else None))
                up = node
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PREFIXES, strict=True)], schema=_PREFIXES)


_PREFIXES = pa.schema([("key", pa.string()), ("depth", pa.int64()), ("node", pa.string()), ("above", pa.string()), ("chars", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("turns", pa.int64()), ("ends", pa.string())])


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """A row for each node: ``COLUMNS``."""
    spark = conversations.sparkSession
    prepare(spark)
    found = written(sequences(conversations))
    first = F.substring("path", 1, WIDTH)
    total = found.agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.sum("n_turns").alias("turns"), F.max(F.when(F.col("n_turns") == 0, F.col("ends"))).alias("ends")).first()
    if not total["n"]:
        return spark.createDataFrame([], _NODES)
    large = written(found.where("n_turns > 0").groupBy(first.alias("first")).agg(F.sum("n_turns").alias("turns")).where(F.col("turns") > limit))
    split = not large.isEmpty()
    turned = found.where("n_turns > 0").withColumn("first", first)
    dealt = turned.join(large, "first", "left_anti").withColumn("cut", F.lit(1))
    if split:
        each = written(turned.join(large, "first", "left_semi").select("key", "path", "chars", "n_turns", "n", "conv_id", "ends").mapInArrow(_prefixes, "key string, depth long, node string, above string, chars long, n long, conv_id long, turns long, ends string"))
        nodes = written(each.groupBy("node").agg(F.max("depth").alias("depth"), F.max("above").alias("above"), F.max("chars").alias("chars"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("turns").alias("turns"), F.min("key").alias("rep"), F.max("ends").alias("ends")))
        upper = nodes.where(F.col("turns") > limit)
        cuts = each.join(upper.select("node"), "node", "left_semi").groupBy("key").agg((F.count("*") + 1).cast("int").alias("cut"))
        dealt = dealt.unionByName(turned.join(cuts, "key").where(F.col("cut") <= F.col("n_turns")).select(*dealt.columns))
    buckets = -(-total["turns"] // bucket) + 1
    dealt = dealt.select("key", "path", "chars", "n", "conv_id", "ends", "cut", F.pmod(F.xxhash64(F.expr(f"left(path, {WIDTH} * cut)")), F.lit(buckets)).alias("bucket"))
    built = written(dealt.groupBy("bucket").applyInPandas(build_tries, _NODES + ", rep string, above string"))
    root = F.lit(total["conv_id"]).cast("long")
    tops = F.col("rep").isNotNull() & (F.col("depth") == 1)
    parts = [built.where(F.col("above").isNull()).select(*[F.when(tops, root).otherwise(F.col(c)).alias(c) if c == "parent_conv_id" else c for c in COLUMNS])]
    if split:
        parents = upper.select(F.col("node").alias("above"), F.col("conv_id").alias("up"))
        cut_tops = built.where(F.col("above").isNotNull())
        parts.append(cut_tops.join(parents, "above").select(*[F.col("up").alias(c) if c == "parent_conv_id" else c for c in COLUMNS]))
        # what each subtrie's top and each upper node adds to all upper nodes over it: sums from the deepest up along one sequence that goes through it
        adds = cut_tops.select("rep", (F.col("depth") - 1).alias("depth"), "n_leaves", "saved_tokens").unionByName(upper.select("rep", "depth", F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")))
        adds = written(adds.groupBy("rep", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        paths = each.select(F.col("key").alias("rep"), "depth", "node").join(adds.groupBy("rep").agg(F.max("depth").alias("deepest")), "rep").where(F.col("depth") <= F.col("deepest"))
        over = Window.partitionBy("rep").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        summed = paths.join(adds, ["rep", "depth"], "left").select("node", *[F.sum(F.coalesce(c, F.lit(0))).over(over).alias(c) for c in ("n_leaves", "saved_tokens")]).groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        children = nodes.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("node")).agg(F.count("*").alias("n_children"))
        full = upper.join(summed, "node").join(children, "node").join(parents, "above", "left")
        parts.append(full.select("conv_id", "depth", F.coalesce("up", root).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NONE)).alias("ends_sha256")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = written(rows) if split else rows
    top = rows.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    top = top.select(
        root.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"]).cast("long").alias("n_convs"), "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.lit(total["ends"] or NONE).alias("ends_sha256")
    )
    return rows.unionByName(top)


#: The same in DuckDB: crc32 from its polynomial, nodes as lists of turns, subtree sums over all ancestors of each node.
SQL = """
WITH polynomial AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS places),
own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
taken AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, places[CAST(xor(c, b) % 256 AS INT) + 1])), 4294967295) % 6 AS h
  FROM own, polynomial),
rebuilt AS (
  SELECT t.conv_id, list_concat(CASE WHEN d.turns IS NULL THEN [] ELSE d.turns[1:t.h] END, t.turns[t.h + 1:]) AS turns
  FROM taken t LEFT JOIN own d ON d.conv_id = t.conv_id - t.conv_id % 100),
node AS (
  SELECT turns[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN len(turns) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt) GROUP BY ALL),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
counted AS (SELECT node.*, coalesce(children.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS own FROM node LEFT JOIN children USING (path)),
summed AS (
  SELECT path[1:d] AS path, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT path, own, n_children, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY 1)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, CAST(c.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN summed s USING (path) LEFT JOIN node p ON c.depth > 0 AND p.path = c.path[1:c.depth - 1]
"""
