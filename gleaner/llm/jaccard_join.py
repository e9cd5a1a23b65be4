"""Operator 5: exact n-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct five-word shingles as 64-bit hashes. Two
documents link when their intersection is at least four fifths of their union.
Documents with equal sets are one class and are searched once.

Tokens are ordered rare class first, then by hash; a token is in the frequent
class if a hashed cell of its count over all data reaches ``FREQUENT``. Of a set of
n tokens at most d = n // 5 are missing from a set that it links with. Rare tokens
are indexed one by one, and d + 1 of them are prefix enough. A set with fewer
extends its prefix into the frequent tokens, which hash into as many classes as a
set of its size has tokens to miss, and indexes the two-token combinations of each
class. A class of which two sets share no combination holds one shared token at
most, so the prefix ends where its rare tokens and all but one token of each class
are d + 1: sets that link then share a rare token or a combination of both
prefixes. The number of classes goes by size levels that double; a set whose
partners may be of the level below is indexed for both.

Candidates: every set under a key is compared with the key's leader only, and
verified links make components. Sets outside the leader's component are compared
with up to ORDERS of its members, and links make components anew. Sets that are
still outside are then compared with the sets of other components under their
keys, behind a bit-parity bound on the difference; a pair that shares several keys
is met under the first of them. Nothing else can add to the components.
Verification counts the exact intersection.

Moved between machines: about a fifth of the shingles as key and class; full sets
only of pairs that the parity bound lets through; and, for ``representatives``, the
texts of rows that a bitmap of dropped ids marks. Nothing of all documents is
collected; what is broadcast are bitmaps of fixed size.

Defined results: null or blank texts have 0 shingles and link with nothing; fewer
words than five count as one shingle; a null doc_id is in its class's component
but never names one unless all are null; repeated rows link; a very long text is
one set of all its shingles; pairs at 0.8 exactly link; an empty table gives an empty
result. Extra columns are ignored by ``join`` and kept by ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import divided, fresh, prepare, quoted, text_buffer, written
from gleaner.llm.words import mix, word_hashes

SHINGLE = 5
#: Sum of a cell's counts from which its tokens are of the frequent class; a chunk of CHUNK tokens reports counts of LOCAL or more.
FREQUENT, LOCAL, CHUNK = 64, 8, 2_000_000
#: Members of a leader's component that a class outside it is compared with, for each key.
ORDERS = 16
#: First keys of a set that it is known by: a pair is met under no later key than the first that both have among these.
FIRSTS = 8
#: Bits of the bitmaps that are broadcast.
CELLS = 1 << 22
STEP = 1 << 20
_FACTORS = [pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1 for j in range(SHINGLE)]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    data, offsets = text_buffer(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP, side="right")) - 1)
        hashes, begins = word_hashes(data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first])
        grams = np.zeros(max(len(hashes) - SHINGLE + 1, 0), np.uint64)
        for j, factor in enumerate(_FACTORS):
            grams += hashes[j : j + len(grams)] * np.uint64(factor)
        grams = mix(grams)
        for b, e in zip(begins[:-1], begins[1:], strict=True):
            if e - b >= SHINGLE:
                yield np.unique(grams[b : e - SHINGLE + 1])
            elif e > b:
                yield mix(np.array([int(sum(int(h) * f for h, f in zip(hashes[b:e], _FACTORS, strict=False)) + int(e - b)) % (1 << 64)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        first = stop


def set_key(tokens: np.ndarray) -> int:
    """Stands for the whole set."""
    return int(mix(np.array([mix(tokens + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def _bitmap(keys: DataFrame, column: str) -> bytes:
    """CELLS bits, those of the column's low bits set. Built on executors in 512 parts."""
    width = CELLS // 512

    def build(part: pa.Table) -> pa.Table:
        bits = np.zeros(width, bool)
        bits[part.column("cell").to_numpy() % width] = True
        return pa.table([part.column("part")[:1], pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    cells = keys.select(F.col(column).bitwiseAND(CELLS - 1).cast("int").alias("cell")).distinct().withColumn("part", (F.col("cell") / width).cast("int"))
    whole = bytearray(CELLS // 8)
    for r in cells.groupBy("part").applyInArrow(build, "part int, bits binary").collect():  # 512 rows of 1 KB at most
        whole[r.part * width // 8 : (r.part + 1) * width // 8] = r.bits
    return bytes(whole)


@lru_cache(4)
def _bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, parity of each document, and cell, count of tokens that are common within a chunk."""
    names = ["doc_id", "key", "n", "parity", "cell", "count"]

    def common(gathered: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(gathered), return_counts=True)
        often = counts >= LOCAL
        k = int(often.sum())
        return pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int64())), pa.array((tokens[often] & np.uint64(CELLS - 1)).astype(np.int64)), pa.array(counts[often].astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        gathered: list[np.ndarray] = []
        size = 0
        for batch in batches:
            keys, sizes, marks = [], [], []
            for tokens in shingle_sets(batch.column("text")):
                key = set_key(tokens) if len(tokens) else None
                keys.append(key)
                sizes.append(len(tokens))
                marks.append(None if key is None else parity(tokens).tolist())
                if key is not None and key not in met:
                    met.add(key)
                    gathered.append(tokens)
                    size += len(tokens)
            yield pa.record_batch([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(marks, pa.list_(pa.int64())), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64())], names=names)
            if size >= CHUNK:
                yield common(gathered)
                gathered, size = [], 0
        if gathered:
            yield common(gathered)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, n int, parity array<long>, cell long, count long")


def size_levels(n: int) -> list[int]:
    """Least sizes of the levels that a set of n tokens is indexed for."""
    own = 4 << max(0, (n // 4).bit_length() - 1)
    return [own, own // 2] if own > 4 and 4 * n < 5 * own else [own]


def combinations(frequent: np.ndarray, missing: int, level: int) -> np.ndarray:
    """Keys of the pairs within classes of a prefix of the frequent tokens; it has missing tokens besides one of each class."""
    classes = (frequent >> np.uint64(20)) % np.uint64(level // 5 + 1)
    first = np.zeros(len(frequent), bool)
    first[np.unique(classes, return_index=True)[1]] = True
    end = int(np.searchsorted(np.cumsum(~first), missing)) + 1
    order = np.argsort(classes[:end], kind="stable")
    tokens, classes = frequent[order], classes[order]
    found = []
    for apart in range(1, len(tokens)):
        same = classes[apart:] == classes[:-apart]
        if not same.any():
            break
        found.append(mix(tokens[:-apart][same] * np.uint64(_FACTORS[0]) + tokens[apart:][same] * np.uint64(_FACTORS[1]) + np.uint64(level)))
    return np.concatenate(found)


def signatures(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Index entries of a set, given which of its tokens are frequent. Sets of three tokens or fewer link with equal ones only."""
    if len(tokens) < 4:
        return tokens[:0]
    need = len(tokens) // 5 + 1
    rare = tokens[~common][:need]
    if len(rare) == need:
        return rare
    return np.concatenate([rare, *(combinations(tokens[common], need - len(rare), level) for level in size_levels(len(tokens)))])


def index(docs: DataFrame, frequent: bytes) -> DataFrame:
    """token, key, n: index entries of each class, once a task at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, met = _bits(frequent), set()
        for batch in batches:
            entries, keys, sizes = [], [], []
            for tokens in shingle_sets(batch.column("text")):
                if not len(tokens) or (key := set_key(tokens)) in met:
                    continue
                met.add(key)
                own = signatures(tokens, common[(tokens & np.uint64(CELLS - 1)).astype(np.int64)])
                if len(own):
                    entries.append(own)
                    keys.append((key, len(own)))
                    sizes.append(len(tokens))
            if entries:
                repeats = [k for _, k in keys]
                yield pa.record_batch([pa.array(np.concatenate(entries).view(np.int64)), pa.array(np.repeat([k for k, _ in keys], repeats)), pa.array(np.repeat(np.array(sizes, np.int32), repeats))], names=["token", "key", "n"])

    return docs.select("text").mapInArrow(run, "token long, key long, n int")


def shared_entries(entries: DataFrame) -> DataFrame:
    """token, leader, leader_n, key, n of tokens with two classes or more; the leader is the least key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader, leader_n = None, 0, 0
        pending = False  # the leader's own row goes out with its first follower
        for batch in batches:
            token, key, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(token):
                continue
            new = np.diff(token, prepend=token[0]) != 0
            new[0] = last is None or token[0] != last
            fresh = new | (np.diff(key, prepend=key[0]) != 0)
            start = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            led = np.where(start >= 0, key[start], leader)
            led_n = np.where(start >= 0, n[start], leader_n)
            follows = ~new & (key != led) & fresh
            if not new[0] and key[0] != led[0]:
                follows[0] = True  # equal rows across batches are harmless
            heads = np.unique(start[follows & (start >= 0)])
            rows = [np.concatenate([a[heads], a[follows]]) for a in (token, led, led_n, key, n)]
            if pending and (follows & (start < 0)).any():
                rows = [np.append(a, v).astype(a.dtype) for a, v in zip(rows, (last, leader, leader_n, leader, leader_n), strict=True)]
            yield pa.record_batch([pa.array(a) for a in rows], names=["token", "leader", "leader_n", "key", "n"])
            done = bool((follows & (start == start[-1])).any()) or (start[-1] < 0 and not pending)
            last, leader, leader_n, pending = token[-1], led[-1], led_n[-1], not done

    ordered = entries.repartition("token").sortWithinPartitions("token", "key")
    return ordered.mapInArrow(run, "token long, leader long, leader_n int, key long, n int")


def parity(tokens: np.ndarray) -> np.ndarray:
    """At least as many bits as tokens, a power of two from 64 on; each tells whether an odd number of tokens fall on it. Sets differ in as many tokens at least as in bits."""
    size = max(64, 1 << (len(tokens) - 1).bit_length())
    bits = np.bincount((tokens >> np.uint64(8)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def once_each(entries: DataFrame) -> DataFrame:
    """Of tokens with the same classes under them, as those of one shared passage have, the entries of one."""
    members = entries.groupBy("token").agg(F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"), F.count("*").alias("m"))
    kept = members.groupBy("x", "y", "m").agg(F.min("token").alias("token")).select("token")
    return entries.join(written(kept), "token", "left_semi")


def full_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, tokens of the classes in pairs (a, b); a bitmap of fixed size keeps most others from leaving their task."""
    wanted = _bitmap(pairs.select(F.explode(F.array("a", "b")).alias("key")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, met = _bits(wanted), set()
        for batch in batches:
            keys, sets = [], []
            for tokens in shingle_sets(batch.column("text")):
                if len(tokens) and (key := set_key(tokens)) not in met and bits[key & (CELLS - 1)]:
                    met.add(key)
                    keys.append(key)
                    sets.append(tokens.tobytes())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "tokens"])

    return written(docs.select("text").mapInArrow(run, "key long, tokens binary").dropDuplicates(["key"]))


def apart(a: Column, b: Column) -> Column:
    """Bits in which two parity signatures differ; one of twice the size is folded first. Null where sizes are further apart, as those of sets that link never are."""
    size = F.least(F.size(a), F.size(b))
    folded = lambda x: F.when(F.size(x) == size, x).otherwise(F.zip_with(F.slice(x, 1, size), F.slice(x, size + 1, F.size(x) - size), lambda u, v: u.bitwiseXOR(v)))
    return F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                good.append(5 * both >= 4 * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a")
    return first.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """key, comp: each linked key and the least key it is reachable from. Labels spread to neighbours and then jump to their label's label."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "comp"), "b").groupBy(F.col("a").alias("key")).agg(F.min("comp").alias("near"))
        spread = written(labels.join(near, "key").select("key", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")))
        jumped = spread.join(spread.select(F.col("key").alias("comp"), F.col("comp").alias("next")), "comp").select("key", "old", F.least("comp", "next").alias("comp"))
        jumped = written(jumped)
        labels = jumped.select("key", "comp")
        if jumped.where(F.col("comp") != F.col("old")).isEmpty():
            return labels


def _near(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose signatures allow a link."""
    first = pairs.join(marks.select(F.col("key").alias("a"), F.col("parity").alias("x")), "a")
    both = first.join(marks.select(F.col("key").alias("b"), F.col("parity").alias("y")), "b")
    return both.where(9 * apart(F.col("x"), F.col("y")) <= F.col("na") + F.col("nb")).select("a", "b")


def _led(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """token, leader, key, n, comp, main: whether the class is in the component of its key's leader."""
    placed = written(entries.join(comps, "key", "left").select("token", "leader", "key", "n", F.coalesce("comp", "key").alias("comp")))
    leaders = placed.where(F.col("key") == F.col("leader")).select("token", F.col("comp").alias("lead")).distinct()
    return placed.join(leaders, "token").select("token", "leader", "key", "n", "comp", (F.col("comp") == F.col("lead")).alias("main"))


def _second_stars(entries: DataFrame, comps: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes outside their key's leader's component with ORDERS members of it, the first by as many hash orders. In a group of near copies most find a partner so; a group that shares a passage only has no such members."""
    rows = written(_led(entries, comps))
    first = lambda r: F.min_by(F.struct("key", "n"), F.xxhash64(F.lit(r), "key"))
    picks = rows.where(F.col("main") & (F.col("key") != F.col("leader"))).groupBy("token").agg(F.array(*map(first, range(ORDERS))).alias("picks"))
    pairs = rows.where(~F.col("main")).join(written(picks), "token").select("key", "n", F.explode(F.array_distinct("picks")).alias("p"))
    pairs = pairs.where((5 * F.col("n") >= 4 * F.col("p.n")) & (5 * F.col("p.n") >= 4 * F.col("n")))
    return _near(pairs.select(F.least("key", "p.key").alias("a"), F.greatest("key", "p.key").alias("b"), F.col("n").alias("na"), F.col("p.n").alias("nb")).distinct(), marks).distinct()


def _across(entries: DataFrame, comps: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) under a key that lie in different components, have fitting sizes and may differ little enough; neither is the key's leader."""
    placed = written(_led(entries, comps))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where(F.col("least") != F.col("most")).select("token")
    rows = placed.where(F.col("key") != F.col("leader")).distinct().join(written(mixed), "token", "left_semi")
    rows = written(rows.select("token", "key", "n", "comp", "main"))
    firsts = rows.groupBy("key").agg(F.slice(F.array_sort(F.collect_set("token")), 1, FIRSTS).alias("firsts")).join(marks, "key")
    rows = written(rows.join(firsts, "key").withColumn("before", F.filter("firsts", lambda t: t < F.col("token"))).drop("firsts"))
    left, right = rows.where(~F.col("main")).alias("p"), rows.alias("q")
    sizes = (5 * F.col("p.n") >= 4 * F.col("q.n")) & (5 * F.col("q.n") >= 4 * F.col("p.n"))
    once = F.col("q.main") | (F.col("p.key") < F.col("q.key"))
    earlier = F.arrays_overlap("p.before", "q.before")
    near = 9 * apart(F.col("p.parity"), F.col("q.parity")) <= F.col("p.n") + F.col("q.n")
    fits = (F.col("p.token") == F.col("q.token")) & (F.col("p.comp") != F.col("q.comp")) & once & sizes & ~earlier & near
    return left.join(right, fits).select(F.least("p.key", "q.key").alias("a"), F.greatest("p.key", "q.key").alias("b")).distinct()


def classify(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, n of each document; and key, comp of the classes that link."""
    prepare(docs.sparkSession)
    found = written(classes(docs))
    cells = found.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("count").alias("count")).where(F.col("count") >= FREQUENT)
    entries = written(once_each(written(shared_entries(index(docs, _bitmap(cells, "cell"))))))
    marks = found.where(F.col("key").isNotNull()).select("key", "parity").join(entries.select("key"), "key", "left_semi")
    marks = written(marks.dropDuplicates(["key"]))
    sizes = (5 * F.col("n") >= 4 * F.col("leader_n")) & (5 * F.col("leader_n") >= 4 * F.col("n"))
    stars = entries.where((F.col("key") != F.col("leader")) & sizes).select(F.col("leader").alias("a"), F.col("key").alias("b"), F.col("leader_n").alias("na"), F.col("n").alias("nb")).distinct()
    stars = written(_near(stars, marks))
    links = written(verified(stars, full_sets(docs, stars)))
    for candidates in (_second_stars, _across):
        pairs = written(candidates(entries, components(links), marks))
        links = written(links.unionByName(verified(pairs, full_sets(docs, pairs))))
    comps = components(links)
    return found.where(F.col("n").isNotNull()).select("doc_id", "key", "n"), comps


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    rows, comps = classify(docs)
    rows = rows.join(comps, "key", "left").select("doc_id", "n", F.coalesce("comp", "key").alias("comp"))
    rows = written(rows)
    least = written(rows.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    return rows.join(least, "comp", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of one document in each component: the first by doc_id.

    Documents without words stay, as do those with a null doc_id; rows that repeat
    doc_id and text stay once.
    """
    prepare(docs.sparkSession)
    own = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).cast("int")
    many, ident = fresh(docs, "__many", "__id")
    rows = join(docs).where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(ident)).agg(F.sum(own).alias(many))
    other = written(rows.where(F.col(many) != 1).withColumn("hash", F.xxhash64(ident)))  # ids to drop, and ids that repeat
    clear, marked = divided(docs, F.xxhash64("doc_id"), other, "hash")
    marked = marked.join(other.drop("hash").hint("merge"), F.col("doc_id") == F.col(ident), "left")
    once = marked.where(F.col(many).isNull()).select(*map(quoted, docs.columns))
    repeated = marked.where(F.col(many) > 1).select(*map(quoted, docs.columns))
    return clear.unionByName(once).unionByName(repeated.dropDuplicates(["doc_id", "text"]))
