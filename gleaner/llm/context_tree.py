"""Operator 4: context-tree weighting over bytes, and a word-unigram base beside it.

A byte is eight binary decisions, each with a context tree of its own whose levels
are the preceding bytes, nearest first, ``DEPTH`` of them. A node's estimate is
Krichevsky-Trofimov's; the weighted probability of a node is half its own plus
half the product of its children's, so all depths are mixed. The tree is learned
from n-gram counts, which any grouping of the data can add up, and then fixed: the
probability of a byte depends on itself and the bytes before it only, and a text's
score is a sum of values of its n-grams. An end byte closes each text, so scores
are those of a distribution over texts.

One pass cuts the table into chunks, keeps each chunk's texts compressed, and
lists its distinct n-grams and words with their counts in training texts, sorted,
as compressed blobs for each pair of nearest context bytes. Pairs are put into
groups of about ``GROUP`` listed n-grams; a pair with more is split by its third
context byte. Lists of more than ``FAN`` chunks are first added up by ``FAN`` at a
time, again and again, so no task sees the lists of all chunks. A group's task
solves the tree from its depth up to the third level; the second is solved by
pairs, and the levels above, at most 256 x 255 nodes, on the driver. Then values of
the n-grams go back the way the lists came. Nothing that grows with the corpus is
broadcast or collected.

Defined results: a null text counts as empty, which has one token and the end
byte; a null doc_id is not held out; with no training text every bit has
probability 1/2; repeated rows are scored row by row, and learned from row by row;
a text longer than a chunk is a chunk of its own; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import prepare, text_buffer, trim, written
from gleaner.llm.words import word_hashes

#: Context bytes. An n-gram's code has them with the nearest highest, and its byte lowest; six leave room for a text's number within a step.
DEPTH = 6
#: Bytes that UTF-8 never has: before a text's first byte, and after its last.
BEFORE, END = 0xFE, 0xFF
#: Bytes of text a chunk, and bytes and texts a step.
CHUNK, STEP, STEP_TEXTS = 32 << 20, 1 << 20, 256
#: Listed keys a group, and lists that a task adds up.
GROUP, FAN = 1_000_000, 64
#: Words have this bit, n-grams don't.
WORD = np.uint64(1 << 63)
END_WORD = np.uint64((1 << 63) | 1)
#: Parts of a list: one for each pair of nearest context bytes, and so many of words.
PAIRS, WORD_PARTS = 1 << 16, 256
_U8 = np.uint64(8)


def held_out(modulus: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of DEPTH context bytes and a byte; and the texts they belong to."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int32), lengths)
    stream = np.full(len(data) + n * (DEPTH + 1), BEFORE, np.uint8)
    stream[np.arange(len(data)) + row * (DEPTH + 1) + DEPTH] = data
    stream[offsets[1:] + np.arange(1, n + 1) * (DEPTH + 1) - 1] = END
    at = np.flatnonzero(stream != BEFORE)
    codes = stream[at].astype(np.uint64)
    for back in range(1, DEPTH + 1):
        codes |= stream[at - back].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - back))
    return codes, np.repeat(np.arange(n, dtype=np.int32), lengths + 1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and of one end a text, with the texts they belong to."""
    hashes, begins = word_hashes(data, offsets)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(begins))
    keys = np.concatenate([hashes | WORD, np.full(n, END_WORD)])
    return keys, np.concatenate([row, np.arange(n)])


def _steps(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets, of about STEP bytes and STEP_TEXTS texts at a time."""
    data, offsets = text_buffer(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        stop = min(first + STEP_TEXTS, max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP, side="right")) - 1))
        yield first, stop, data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first]
        first = stop


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists as one. A stable sort only merges what is sorted already."""
    if len(keys) == 1:
        return keys[0], counts[0]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    at = _runs(every)
    return every[at], np.add.reduceat(np.concatenate(counts)[order], at) if len(at) else np.zeros(0, np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second, and so on, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _from_planes(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(blob, np.uint64), dtype=np.uint64)


class _Chunk:
    """Texts gathered so far, and their keys as sorted lists, each at least twice as long as the next."""

    def __init__(self) -> None:
        self.batches: list[pa.RecordBatch] = []
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def _put(self, keys: np.ndarray, train: bool) -> None:
        keys.sort()
        at = _runs(keys)
        n = np.diff(np.append(at, len(keys))) if train else np.zeros(len(at))
        found = (keys[at], n.astype(np.int32))  # a chunk has fewer bytes than that holds
        while self.lists and len(self.lists[-1][0]) < 2 * len(found[0]):
            last = self.lists.pop()
            found = added([last[0], found[0]], [last[1], found[1]])
        self.lists.append(found)

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)
        self.size += batch.column("text").nbytes
        train = ~batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        for first, stop, data, offsets in _steps(batch.column("text")):
            for listed in (grams, tokens):
                keys, row = listed(data, offsets)
                own = train[first:stop][row]
                self._put(keys[own], True)
                self._put(keys[~own], False)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in self.batches:
                out.write_batch(batch)
        self.batches = []
        trim()
        yield _batch(CHUNK_ROWS, [[number], [None], [None], [None], [None], [sink.getvalue().to_pybytes()]])
        while len(self.lists) > 1:
            (a, n), (b, m) = self.lists.pop(), self.lists.pop()
            self.lists.append(added([a, b], [n, m]))
        keys, n = self.lists.pop()
        part = np.where(keys >= WORD, (keys >> np.uint64(55) & np.uint64(WORD_PARTS - 1)) + np.uint64(PAIRS), keys >> np.uint64(8 * (DEPTH - 1)))
        at = _runs(part)
        found: list[tuple] = []
        for begin, end in zip(at, np.append(at[1:], len(keys)), strict=True):
            found.append((number, int(part[begin]), int(end - begin), packed_keys(keys[begin:end]), _planes(n[begin:end].astype(np.int64)), None))
            if len(found) == 500:
                yield _batch(CHUNK_ROWS, zip(*found, strict=True))
                found = []
        if found:
            yield _batch(CHUNK_ROWS, zip(*found, strict=True))


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
CHUNK_ROWS = "chunk long, part int, n long, keys binary, counts binary, texts binary"
LISTED = "owner long, group int, n long, keys binary, counts binary"
ANSWERS = "owner long, group int, keys binary, values binary"
NODES = "pair int, node int, zeros double, ones double, children double"
GIVEN = "group int, pair int, node int, so_far double, rest double"


def _columns(schema: str, columns: Iterable) -> dict[str, pa.Array]:
    return {name: x if isinstance(x, pa.Array) else pa.array(x, _TYPES[kind]) for (name, kind), x in zip((c.split() for c in schema.split(", ")), columns, strict=True)}


def _batch(schema: str, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(_columns(schema, columns))


def _table(schema: str, columns: Iterable) -> pa.Table:
    return pa.table(_columns(schema, columns))


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, and either texts (compressed rows) or a part of its list: n sorted keys with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            if batch.num_rows:
                chunk.add(batch)
            if chunk.size >= CHUNK:
                yield from chunk.rows(number)
                number, chunk = number + 1, _Chunk()
        if chunk.batches:
            yield from chunk.rows(number)

    return docs.select("doc_id", held_out().alias("held"), "text").mapInArrow(run, CHUNK_ROWS)


#: Arguments of log_gamma whose values are kept in tables: i + 1/2 and i + 1.
_KEPT = 4096
_HALF = np.array([math.lgamma(i + 0.5) for i in range(_KEPT)])
_WHOLE = np.array([math.lgamma(i + 1.0) for i in range(_KEPT)])


def log_gamma(counts: np.ndarray, more: float) -> np.ndarray:
    """Logarithm of the gamma function of whole counts plus 1/2 or 1; by Stirling's series from _KEPT on."""
    found = (_HALF if more == 0.5 else _WHOLE)[np.minimum(counts, _KEPT - 1)]
    if len(big := np.flatnonzero(counts >= _KEPT)):
        y = counts[big] + more
        found[big] = (1 / 12 - 1 / (360 * y * y)) / y + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi)
    return found


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the KT probability of so many zeros and ones."""
    zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
    return log_gamma(zeros, 0.5) + log_gamma(ones, 0.5) - log_gamma(zeros + ones, 1.0) - np.log(np.pi)


def weigh(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the weighted probability of nodes with children, and the share of weight that stops at them."""
    estimate = log_estimate(zeros, ones)
    weighted = np.logaddexp(estimate, children) - np.log(2)
    return weighted, np.exp(estimate - np.log(2) - weighted)


class Tree:
    """The context trees under some pairs of nearest bytes, from sorted codes of n-grams and their counts; counts may be 0."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.codes = {DEPTH: codes}  # of each depth, the distinct contexts with their bytes
        self.n = {DEPTH: n.astype(np.int64)}
        self.up: dict[int, np.ndarray] = {}  # place of a code of one depth more
        for depth in range(DEPTH - 1, 1, -1):
            below = self.codes[depth + 1]
            own, places = np.unique(below >> np.uint64(16) << _U8 | below & np.uint64(255), return_inverse=True)
            self.codes[depth], self.up[depth] = own, places.astype(np.int32)
            self.n[depth] = np.bincount(places, self.n[depth + 1], len(own)).astype(np.int64)

    def _nodes(self, depth: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of decision k: where nodes begin in the codes, each code's node, the nodes' zeros and ones."""
        codes = self.codes[depth]
        starts = _runs(codes >> np.uint64(8 - k))
        node = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(codes))))
        bit = (codes >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
        if not len(codes):
            return starts, node, starts, starts
        ones = np.add.reduceat(self.n[depth] * bit, starts)
        return starts, node, np.add.reduceat(self.n[depth], starts) - ones, ones

    def _rise(self, k: int) -> tuple[dict, np.ndarray]:
        """Nodes of decision k at each depth with their stops, and what depth 3 gives each node of depth 2."""
        found, weighted, before = {}, np.zeros(0), None
        for depth in range(DEPTH, 1, -1):
            starts, node, zeros, ones = self._nodes(depth, k)
            parent = None if before is None else node[self.up[depth][before]]  # of the nodes of one depth more
            children = np.zeros(len(starts)) if parent is None else np.bincount(parent, weighted, len(starts))
            if depth == DEPTH:
                weighted, stop = log_estimate(zeros, ones), np.ones(len(starts))
            else:
                weighted, stop = weigh(zeros, ones, children)
            found[depth] = (starts, node, zeros, ones, stop, parent)
            before = starts
        return found, children

    def bottom(self) -> list[np.ndarray]:
        """pair, node, zeros, ones, children of all nodes of depth 2."""
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for k in range(8):
            found, children = self._rise(k)
            starts, _, zeros, ones, _, _ = found[2]
            for column, v in zip(out, (*decided(self.codes[2][starts], k), zeros, ones, children), strict=True):
                column.append(v)
        return [np.concatenate(v) for v in out]

    def values(self, key: np.ndarray, so_far: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of each n-gram's last byte's probability after its context. Given for nodes of depth 2, by sorted key (pair << 8 | node): the probability of a one so far, and the weight left."""
        total = np.zeros(len(self.codes[DEPTH]))
        for k in range(8):
            found, _ = self._rise(k)
            pair, node = decided(self.codes[2][found[2][0]], k)
            at = np.searchsorted(key, pair << 8 | node)
            one, left = so_far[at], rest[at]
            for depth in range(3, DEPTH + 1):
                _, _, zeros, ones, stop, _ = found[depth]
                parent = found[depth - 1][5]
                one = one[parent] + left[parent] * stop * (ones + 0.5) / (zeros + ones + 1)
                left = left[parent] * (1 - stop)
            bit = (self.codes[DEPTH] >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            own = one[found[DEPTH][1]]
            total += np.log10(np.where(bit, own, 1 - own))
        return total


def decided(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair of nearest bytes, and node of decision k: a one followed by the byte's first k bits."""
    return (codes >> _U8).astype(np.int64), (np.uint64(1 << k) | (codes & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64)


def upper(byte: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the nodes of depth 1: for each nearest byte and node, the probability of a one so far and the weight left."""
    weighted, stop = weigh(zeros, ones, children)
    zeros0, ones0, children0 = (np.bincount(node, v, 256) for v in (zeros, ones, weighted))
    _, stop0 = weigh(zeros0, ones0, children0)
    so_far, left = np.full((256, 256), 0.5), np.zeros((256, 256))
    so_far[byte, node] = (stop0 * (ones0 + 0.5) / (zeros0 + ones0 + 1))[node] + (1 - stop0)[node] * stop * (ones + 0.5) / (zeros + ones + 1)
    left[byte, node] = (1 - stop0)[node] * (1 - stop)
    return so_far, left


def second(pair: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray, so_far: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same after the nodes of depth 2."""
    _, stop = weigh(zeros, ones, children)
    rest = left[pair >> 8, node]
    return so_far[pair >> 8, node] + rest * stop * (ones + 0.5) / (zeros + ones + 1), rest * (1 - stop)


def _unpacked(listed: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a table as one."""
    keys = [unpacked_keys(k) for k in listed.column("keys").to_pylist()]
    return added(keys, [_from_planes(c, np.int64) for c in listed.column("counts").to_pylist()])


def places(sizes: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """For each part, its first group and its number of groups, from the numbers of keys listed in parts."""
    found, group, held = {}, 0, 0
    for part, n in sorted(sizes):
        if held and (held + n > GROUP or part >= PAIRS and part - 1 not in found):
            group, held = group + 1, 0
        split = min(256, -(-n // GROUP)) if part < PAIRS else 1
        found[part] = (group, split)
        if split > 1:
            group, held = group + split, 0
        else:
            held += n
    return found


def _grouped(cut: DataFrame, place: dict[int, tuple[int, int]]) -> DataFrame:
    """The lists by owner (a chunk) and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                group, split = place[r["part"]]
                if split == 1:
                    found.append((r["chunk"], group, r["n"], r["keys"], r["counts"]))
                    continue
                keys, counts = unpacked_keys(r["keys"]), _from_planes(r["counts"], np.int64)
                third = (keys >> np.uint64(8 * (DEPTH - 2)) & np.uint64(255)) * np.uint64(2654435761) % np.uint64(1 << 32) * np.uint64(split) >> np.uint64(32)
                for i in range(split):
                    if (own := third == np.uint64(i)).any():
                        found.append((r["chunk"], group + i, int(own.sum()), packed_keys(keys[own]), _planes(counts[own])))
            if found:
                yield _batch(LISTED, zip(*found, strict=True))

    return cut.where(F.col("keys").isNotNull()).select("chunk", "part", "n", "keys", "counts").mapInArrow(run, LISTED)


def _joined(owner: int, group: int, listed: pa.Table) -> tuple:
    keys, counts = _unpacked(listed)
    return owner, group, len(keys), packed_keys(keys), _planes(counts)


def _levels(listed: DataFrame, n: int) -> list[DataFrame]:
    """Lists of chunks, then of FAN chunks and so on, until there are FAN owners at most. Owners of a next level are told by owner_of."""
    found = [listed]
    while n > FAN:
        n = -(-n // FAN)

        def add(part: pa.Table) -> pa.Table:
            return _table(LISTED, zip(_joined(part.column("up")[0].as_py(), part.column("group")[0].as_py(), part), strict=True))

        found.append(written(found[-1].withColumn("up", owner_of(n)).groupBy("up", "group").applyInArrow(add, LISTED)))
    return found


def owner_of(n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(n), "owner"), F.lit(n))


def _looked_up(listed: pa.Table, keys: np.ndarray, value: np.ndarray) -> pa.Table:
    """Answers to lists whose keys are all among the sorted keys."""
    blobs = listed.column("keys").to_pylist()
    return _table(ANSWERS, [listed.column("owner").combine_chunks(), listed.column("group").combine_chunks(), blobs, [_planes(value[np.searchsorted(keys, unpacked_keys(b))]) for b in blobs]])


def _value_kind(keys: np.ndarray) -> type:
    """Words get their count, n-grams the logarithm of a probability."""
    return np.int64 if len(keys) and keys[-1] >= WORD else np.float32


def _answers(listed: DataFrame, place: dict[int, tuple[int, int]]) -> tuple[DataFrame, int, int]:
    """owner, group, keys, values for each list; and the number of training words, and of different ones."""

    def bottom(part: pa.Table) -> pa.Table:
        trim()
        keys, n = _unpacked(part)
        if keys[-1] >= WORD:
            return _table(NODES, [[-1], [0], [float(n.sum())], [float((n > 0).sum())], [0.0]])
        pair, node, *rest = Tree(keys, n).bottom()
        return _table(NODES, [pair.astype(np.int32), node.astype(np.int32), *(v.astype(np.float64) for v in rest)])

    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "children")]
    nodes = written(listed.groupBy("group").applyInArrow(bottom, NODES).groupBy("pair", "node").agg(*sums))
    known = nodes.where("pair < 0").first()

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, node, zeros, ones, children = (c.to_numpy() for c in batch.columns)
            yield _batch(NODES, [pair >> 8, node, zeros, ones, weigh(zeros, ones, children)[0]])

    pairs = nodes.where("pair >= 0")
    top = pairs.mapInArrow(weighed, NODES).groupBy("pair", "node").agg(*sums).toArrow()  # 256 x 255 rows at most
    so_far, left = upper(*(top.column(c).to_numpy() for c in ("pair", "node", "zeros", "ones", "children")))

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, node, *rest = (c.to_numpy() for c in batch.columns)
            so_far2, left2 = second(pair, node, *rest, so_far, left)
            first, split = np.array([place[int(p)] for p in pair], np.int32).reshape(-1, 2).T
            at = np.repeat(np.arange(len(pair)), split)
            group = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(split) - split, split)
            yield _batch(GIVEN, [group.astype(np.int32), pair[at], node[at], so_far2[at], left2[at]])

    def every(part: pa.Table, top: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _table(ANSWERS, [[], [], [], []])
        trim()
        keys, n = _unpacked(part)
        if _value_kind(keys) is np.int64:
            return _looked_up(part, keys, n)
        key = top.column("pair").to_numpy().astype(np.int64) << 8 | top.column("node").to_numpy()
        order = np.argsort(key)
        value = Tree(keys, n).values(key[order], *(top.column(c).to_numpy()[order] for c in ("so_far", "rest")))
        return _looked_up(part, keys, value.astype(np.float32))

    found = listed.groupBy("group").cogroup(pairs.mapInArrow(given, GIVEN).groupBy("group")).applyInArrow(every, ANSWERS)
    return found, int(known.zeros) if known else 0, int(known.ones) if known else 0


def _passed_down(answers: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """Answers to the lists of one level less."""

    def down(part: pa.Table, answered: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _table(ANSWERS, [[], [], [], []])
        keys = [unpacked_keys(b) for b in answered.column("keys").to_pylist()]
        kind = _value_kind(keys[0])
        every, order = np.concatenate(keys), slice(None)
        value = np.concatenate([_from_planes(b, kind) for b in answered.column("values").to_pylist()])
        if len(keys) > 1:
            order = np.argsort(every, kind="stable")
        return _looked_up(part, every[order], value[order])

    up = listed.withColumn("up", owner_of(n))
    return up.groupBy("up", "group").cogroup(answers.groupBy("owner", "group")).applyInArrow(down, ANSWERS)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each whole text."""
    prepare(docs.sparkSession)
    cut = written(chunks(docs))
    place = places([tuple(r) for r in cut.where(F.col("part").isNotNull()).groupBy("part").agg(F.sum("n")).collect()])  # PAIRS + WORD_PARTS rows at most
    n_chunks = cut.where(F.col("texts").isNotNull()).count()
    levels = _levels(_grouped(cut, place), n_chunks)
    answers, n_train, distinct = _answers(levels[-1], place)
    sizes = [n_chunks]
    while sizes[-1] > FAN:
        sizes.append(-(-sizes[-1] // FAN))
    for listed, n in zip(levels[-2::-1], sizes[:0:-1], strict=True):
        answers = _passed_down(written(answers), listed, n)

    def finish(texts: pa.Table, answered: pa.Table) -> pa.Table:
        trim()
        sides: dict[type, list] = {np.int64: [], np.float32: []}
        for blob, found in zip(answered.column("keys").to_pylist(), answered.column("values").to_pylist(), strict=True):
            keys = unpacked_keys(blob)
            kind = _value_kind(keys)
            sides[kind].append((keys, _from_planes(found, kind)))
        (words, counts), (codes, logs) = (added([k for k, _ in s], [v for _, v in s]) for s in sides.values())
        out: list[list] = [[] for _ in NAMES]
        for blob in texts.column("texts"):
            for batch in pa.ipc.open_stream(blob.as_buffer()):
                n = batch.num_rows
                sums = np.zeros((5, n))  # tokens, known, base, score, bytes
                for first, stop, data, offsets in _steps(batch.column("text")):
                    count = stop - first
                    own, row = grams(data, offsets)
                    own = own << _U8 | row.astype(np.uint64)
                    own.sort()  # keys in order are looked up faster
                    row = (own & np.uint64(255)).astype(np.int64)
                    sums[3, first:stop] = np.bincount(row, logs[np.searchsorted(codes, own >> _U8)], count)
                    sums[4, first:stop] = np.bincount(row, minlength=count)
                    found, row = tokens(data, offsets)
                    seen = counts[np.searchsorted(words, found)]
                    sums[0, first:stop] = np.bincount(row, minlength=count)
                    sums[1, first:stop] = np.bincount(row, seen > 0, count)
                    sums[2, first:stop] = np.bincount(row, np.log10((seen + 1) / (n_train + distinct + 1)), count)
                out[0] += batch.column("doc_id").to_pylist()
                out[1] += batch.column("held").to_pylist()
                for i, v in ((2, sums[0].astype(np.int64)), (3, sums[1].astype(np.int64)), (4, np.full(n, n_train)), (5, sums[2]), (6, sums[3]), (7, -sums[3] / np.log10(2) / sums[4])):
                    out[i] += v.tolist()
        return _table(SCHEMA, out)

    blobs = cut.where(F.col("texts").isNotNull()).select("chunk", "texts")
    return blobs.groupBy("chunk").cogroup(answers.groupBy("owner")).applyInArrow(finish, SCHEMA)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
