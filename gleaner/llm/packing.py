"""Operator 9: best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most ``capacity``; only documents longer
than that are cut, with whole pieces after a first one that may be shorter.
Whole pieces have a sequence of their own. The others are dealt by hash to
blocks of bounded size, and each block is solved on several islands: best-fit
decreasing gives the first packings, crossover puts whole well-filled bins of one
parent into another, drops the bins that hold their documents twice and best-fits
what is displaced. Between epochs each island's elite goes to the next island of
the block. Bins that a block leaves poorly filled are opened again and packed
together over all blocks.

Defined results: a null text counts as empty, which is one piece, the end token
alone; repeated rows are packed row by row; null doc_ids are kept; an empty table
gives an empty result; a very long text is encoded whole and cut into many pieces;
equal lengths are packed in order of doc_id and piece, and of packings with as many
sequences the one whose free space lies in fewer of them is taken. Strings of
special tokens in a text are what the library makes of them by default. Extra
columns are ignored.
"""

from __future__ import annotations

import os
import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.byte_bpe import byte_characters
from gleaner.llm.shared import prepare, written

CAPACITY = 2048
#: Pieces that a block aims at, islands a block, epochs, crossovers an epoch and island.
BLOCK, ISLANDS, EPOCHS, CROSSOVERS = 4096, 2, 2, 12
#: Words that a worker's cache holds before it is emptied.
CACHED = 800_000


class _Words(dict):
    """Word -> little-endian ids of the word after a space, or after the line end that it begins with.

    A text that holds a special token's string goes to the tokenizers library as it
    is. Words of others are encoded by tiktoken over the same vocabulary: its ids are
    the library's, at a quarter of the time for words that weren't met before.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are what runs in parallel
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        reverse = {c: b for b, c in byte_characters().items()}
        ranks = {bytes(reverse[c] for c in token): i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.leads = np.zeros(max(ranks.values()) + 1, bool)  # tokens that begin with a space or line end
        self.leads[[i for token, i in ranks.items() if token[:1] in (b" ", b"\n")]] = True

    def ids(self, text: str) -> bytes:
        whole = any(s in text for s in self.special)
        return np.array(self.library.encode(text, add_special_tokens=False).ids if whole else self.plain(text), "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """In few calls: words have no white space but a line end that they begin with, and a token that begins with either begins a word."""
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            whole = [w if w[0] == "\n" else f" {w}" for w in part]
            ids = np.array(self.plain("".join(whole)), "<u4")
            starts = [*(np.flatnonzero(self.leads[ids]) * 4).tolist(), 4 * len(ids)]
            if len(starts) == len(part) + 1:
                raw = ids.tobytes()
                self.update(zip(part, [raw[b:e] for b, e in zip(starts, starts[1:], strict=False)], strict=True))
            else:  # not expected
                self.update(zip(part, map(self.ids, whole), strict=True))

    def split(self, text: str) -> list[str] | None:
        """Words of a text in which a single space or line end parts any two; null for other texts."""
        words = text.replace("\n", " \n").split(" ")
        even = "" not in words and "\n" not in words and len(words) == len(text.split())
        return words if even and not any(s in text for s in self.special) else None

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        if len(self) > CACHED:
            self.clear()
        for first in range(0, len(texts), 200):
            part = texts[first : first + 200]
            split = [self.split(t) or [] for t in part]
            found = [list(map(self.get, words)) for words in split]
            missing = [[i for i, ids in enumerate(own) if ids is None] if None in own else [] for own in found]
            self.learn(list({words[i] for words, at in zip(split, missing, strict=True) for i in at if i}))
            for text, words, own, at in zip(part, split, found, missing, strict=True):
                for i in at:
                    own[i] = self.get(words[i])
                if words:
                    own[0] = self.ids(words[0])
                yield b"".join(own) if words else self.ids(text)


@lru_cache(2)
def _words(path: str) -> _Words:
    return _Words(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an end token 0, cut where they are longer than capacity."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode_all(texts), strict=True):
                ids += bytes(4)
                n = len(ids) // 4
                start, stop = 0, n - (n - 1) // capacity * capacity
                piece = 0
                while start < n:
                    for column, value in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        column.append(value)
                    piece, start, stop = piece + 1, stop, stop + capacity
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of item numbers, with their fill and a table of bins by free space."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0
        for members in bins or []:
            self._register(members, capacity - sum(sizes[i] for i in members))

    def _register(self, members: list[int], free: int) -> None:
        self.bins.append(members)
        self.free.append(free)
        self._offer(len(self.bins) - 1, free)

    def _offer(self, b: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(b)
        self.mask |= 1 << free

    def best_fit(self, items: list[int]) -> Packing:
        """Each item, largest first, into the fullest bin that has room."""
        for i in sorted(items, key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[i]
            room = self.mask >> size
            if not room:
                self._register([i], self.capacity - size)
                continue
            free = size + (room & -room).bit_length() - 1
            at = self.by_free[free]
            b = at.pop()
            if not at:
                self.mask &= ~(1 << free)
            self.bins[b].append(i)
            self.free[b] = free - size
            self._offer(b, free - size)
        return self

    def rank(self) -> tuple[int, int]:
        """Fewer bins first, then the one whose free space is in fewer bins."""
        return len(self.bins), -sum(f * f for f in self.free)

    def numbers(self) -> list[int]:
        out = [0] * len(self.sizes)
        for b, members in enumerate(self.bins):
            for i in members:
                out[i] = b
        return out


def from_numbers(sizes: list[int], capacity: int, numbers: list[int]) -> Packing:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(numbers):
        bins.setdefault(b, []).append(i)
    return Packing(sizes, capacity, list(bins.values()))


def crossover(into: Packing, donor: Packing, rng: random.Random) -> Packing:
    """Whole well-filled bins of donor put into the other parent; its bins with the same items go, what they held besides is best-fitted."""
    order = sorted(range(len(donor.bins)), key=lambda b: donor.free[b])
    well = [b for b in order[: max(1, len(order) // 2)] if rng.random() < 0.5] or order[:1]
    injected = [list(donor.bins[b]) for b in well]
    held = {i for members in injected for i in members}
    kept, displaced = [], []
    worst = max(into.free, default=0)
    for members, free in zip(into.bins, into.free, strict=True):
        if held.isdisjoint(members) and (free == 0 or free < worst or rng.random() < 0.5):
            kept.append(list(members))
        else:
            displaced += [i for i in members if i not in held]
    return Packing(into.sizes, into.capacity, injected + kept).best_fit(displaced)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[int]], crossovers: int = CROSSOVERS) -> list[int]:
    """Bin number of each item in the best packing found on one island."""
    least = -(-sum(sizes) // capacity)
    rng = random.Random(seed)
    everyone = list(range(len(sizes)))
    people = [from_numbers(sizes, capacity, e) for e in elites]
    if not people:
        people.append(Packing(sizes, capacity).best_fit(everyone))
    for _ in range(2):  # packings that begin with some items at random
        first = [i for i in everyone if rng.random() < 0.2]
        chosen = set(first)
        people.append(Packing(sizes, capacity).best_fit(first).best_fit([i for i in everyone if i not in chosen]))
    for _ in range(crossovers):
        people.sort(key=Packing.rank)
        if len(people[0].bins) <= least:
            break
        a, b = rng.sample(people[: max(2, len(people))], 2)
        child = crossover(a, b, rng)
        if child.rank() < people[-1].rank():
            people[-1] = child
    return min(people, key=Packing.rank).numbers()


def _solve(items: DataFrame, capacity: int, salt: int) -> DataFrame:
    """items with block and bin. items come from a written table: its rows have the same numbers when a lost task is run again."""
    n = items.count()
    blocks = max(1, -(-n // BLOCK))
    ids = [c for c in items.columns if c not in ("block", "bin")]
    dealt = items.select(*ids, F.pmod(F.xxhash64(F.lit(salt), F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"))
    within = Window.partitionBy("block").orderBy(F.desc("length"), *(c for c in ids if c != "length"))
    numbered = written(dealt.withColumn("item", F.row_number().over(within) - 1))
    sizes = numbered.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("item", F.col("length").cast("int").alias("length")))).getField("length").alias("sizes"))
    schema = "block int, island int, sizes array<int>, numbers array<int>"

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                for r in rows:
                    r["numbers"] = evolve(r["sizes"], capacity, hash((r["block"], r["island"], number)), [e for e in r.pop("elites") if e])
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("block", pa.int32()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())), ("numbers", pa.list_(pa.int32()))]))

        return run

    begun = sizes.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("elites", F.array().cast("array<array<int>>"))
    columns = ["block", "island", "sizes", "elites"]
    state = written(begun.select(*columns).repartition(blocks * ISLANDS, "block", "island").mapInArrow(epoch(0), schema))
    for number in range(1, EPOCHS):
        emigrants = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("numbers").alias("guest"))
        met = state.join(emigrants, ["block", "island"]).withColumn("elites", F.array("numbers", "guest"))
        state = written(met.select(*columns).mapInArrow(epoch(number), schema))
    best = state.groupBy("block").agg(F.min_by("numbers", F.struct(F.array_max("numbers"), "island")).alias("numbers"))
    bins = best.select("block", F.posexplode("numbers").alias("item", "bin"))
    return numbered.join(bins, ["block", "item"]).drop("item")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset."""
    prepare(pieces.sparkSession)
    names, pieces = pieces.columns, written(pieces)
    part = F.lit(1 << 20)  # bins of a block at most
    short = pieces.where(F.col("length") < capacity)
    once = written(_solve(short, capacity, 1))
    fill = once.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    loose = once.join(fill.where(F.col("fill") < capacity * 0.97), ["block", "bin"], "left_semi")
    firm = once.join(fill.where(F.col("fill") >= capacity * 0.97), ["block", "bin"], "left_semi")
    twice = _solve(written(loose.select(*names)), capacity, 2)
    number = lambda d, turn: d.select(*names, ((F.col("block").cast("long") * part + F.col("bin")) * 3 + turn).alias("sequence_id"))
    packed = number(firm, 0).unionByName(number(twice, 1))
    order = Window.partitionBy("sequence_id").orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = packed.withColumn("offset", F.sum("length").over(order) - F.col("length"))
    alone = pieces.where(F.col("length") == capacity).select(*names, (F.monotonically_increasing_id() * 3 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, path, capacity), capacity)
