"""Operator 11: toxicity by the nearest labelled examples.

Terms are words (runs of letters, lower-cased), their beginnings of 4 to 7 letters, and
beginnings that two or three words of a text share. Those that stand in toxic examples
``lift`` times as often as in all, and significantly so, are kept (a likelihood-ratio test,
against the number of terms tested), and a text is the vector of their TF-IDF
weights, (1 + ln tf) * idf at length one. The ``k`` examples of the
largest exact cosine vote, each with the weight 1 / (1 - cosine + ``near``), together with
one vote of the average example; a monotone table (pool-adjacent-violators over votes of
examples on one another) turns votes into probabilities. Texts without a kept term get
the share of toxic ones among such examples. The neighbours found are the evidence.

Postings are lists by term of (example, weight), cut in blocks of ``BLOCK`` examples with
the block's largest weight. A text's bounds for all blocks are summed up first; blocks
are opened from the largest bound down, until a bound is under the k-th best cosine. So
the neighbours are those of comparing with all examples.

The classifier is fitted on a bounded sample: the ``examples`` labelled doc_ids whose
hash is smallest, held-out ones aside. Equal texts of the sample are one example with
their average label. Only the examples' kept terms reach the driver, at most as
many rows as the sample has, and go to all tasks. Scoring is a single scan; texts
never move.

Defined results: null and empty texts have no kept term; with nothing to learn from,
every score is 0; a null doc_id is neither held out nor learned from; a null label is
none; labels other than 0 are toxic, repeated ones are averaged; ties between
neighbours go to the smaller doc_id; repeated rows are scored row by row; a very long
text is one vector of the whole; an empty table gives an empty result. Columns besides doc_id,
text and toxic are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.language_id import remainder
from gleaner.llm.shared import prepare, written

#: Labelled doc_ids that the classifier is fitted on, at most.
EXAMPLES = 40_000
#: Examples in a block of the index, and blocks opened at a time.
BLOCK, OPENED = 64, 4
#: Letters of a word's beginning; as often as a beginning's repetition is a term of its own.
BEGINNINGS, AGAIN = (4, 5, 6, 7), (2, 3)
#: Terms that a task sums up before it passes them on.
_HELD = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def terms(found: Counter[str]) -> Counter[str]:
    """All terms of a text with these words. A beginning ends in "-", repeated ones in a number."""
    begun: Counter[str] = Counter()
    for word, n in found.items():
        for length in BEGINNINGS:
            if len(word) > length:
                begun[f"{word[:length]}-"] += n
    again = {f"{b}{times}": 1 for b, n in begun.items() for times in AGAIN if n >= times}
    return found + begun + Counter(again)


@dataclass
class Index:
    """Postings by term: the blocks in which it stands with their largest weights, and where the block's entries begin."""

    blocks: list[np.ndarray]
    most: list[np.ndarray]
    begins: list[np.ndarray]
    examples: list[np.ndarray]
    weights: list[np.ndarray]
    size: int

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> Index:
        lengths = [len(at) for at, _ in vectors]
        at = np.concatenate([a for a, _ in vectors]) if vectors else np.zeros(0, np.int64)
        w = np.concatenate([x for _, x in vectors]) if vectors else np.zeros(0)
        who = np.repeat(np.arange(len(vectors)), lengths)
        by = np.lexsort((who, at))
        at, w, who = at[by], w[by], who[by]
        cut = np.searchsorted(at, np.arange(n_terms + 1))
        out = cls([], [], [], [], [], len(vectors))
        for t in range(n_terms):
            own, weight = who[cut[t] : cut[t + 1]], w[cut[t] : cut[t + 1]]
            begins = np.flatnonzero(np.r_[True, own[1:] // BLOCK != own[:-1] // BLOCK]) if len(own) else np.zeros(0, np.int64)
            out.blocks.append(own[begins] // BLOCK)
            out.most.append(np.maximum.reduceat(weight, begins) if len(own) else weight)
            out.begins.append(np.r_[begins, len(own)])
            out.examples.append(own)
            out.weights.append(weight)
        return out

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """The k examples of the largest cosine over 0, their cosines, and the number of blocks opened. ``but`` is left out."""
        bound = np.zeros(-(-self.size // BLOCK))
        for t, x in zip(at, w, strict=True):
            bound[self.blocks[t]] += x * self.most[t]
        order = np.argsort(-bound, kind="stable")[: int((bound > 0).sum())]
        who, cosine, opened = np.zeros(0, np.int64), np.zeros(0), 0
        for first in range(0, len(order), OPENED):
            part = order[first : first + OPENED]
            if len(cosine) >= k and bound[part[0]] * (1 + 1e-9) < cosine[k - 1]:
                break
            opened += len(part)
            sums = np.zeros((len(part), BLOCK))
            for t, x in zip(at, w, strict=True):
                places = np.searchsorted(self.blocks[t], part)
                for row, (p, b) in enumerate(zip(places, part, strict=True)):
                    if p < len(self.blocks[t]) and self.blocks[t][p] == b:
                        own = slice(self.begins[t][p], self.begins[t][p + 1])
                        sums[row, self.examples[t][own] - b * BLOCK] += x * self.weights[t][own]
            row, place = np.nonzero(sums)
            found = part[row] * BLOCK + place
            fresh = found != but
            who, cosine = np.r_[who, found[fresh]], np.r_[cosine, sums[row, place][fresh]]
            best = np.lexsort((who, -np.round(cosine, 12)))[:k]
            who, cosine = who[best], cosine[best]
        return who, np.minimum(cosine, 1.0), opened


@dataclass
class ToxicityModel:
    places: dict[str, int] = field(default_factory=dict)
    heads: set[str] = field(default_factory=set)  # what kept terms begin with
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    index: Index | None = None
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of the examples with a kept term
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    average: float = 0.0
    without: float = 0.0  # share among examples without a kept term
    table: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    k: int = 16
    near: float = 0.05

    def counts(self, text: str | None) -> tuple[list[int], list[int]]:
        """Places of the text's kept terms, and how often each stands there. Words that no kept term begins like are passed over."""
        some = Counter({w: n for w, n in words(text).items() if w[: BEGINNINGS[0]] in self.heads})
        pairs = sorted((self.places[t], n) for t, n in terms(some).items() if t in self.places)
        return [p for p, _ in pairs], [n for _, n in pairs]

    def vector(self, at: list[int], n: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(at, np.int64)
        w = (1 + np.log(np.array(n, np.float64))) * self.idf[at]
        return at, w / max(np.sqrt((w * w).sum()), 1e-300)

    def vote(self, at: np.ndarray, w: np.ndarray, but: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """The weighted share of toxic neighbours before calibration, the neighbours and their cosines."""
        who, cosine, _ = self.index.nearest(at, w, self.k, but)
        weight = 1 / (1 - cosine + self.near)
        own = 1 / (1 + self.near)  # the average example's vote, at cosine 0
        return float((weight @ self.toxic[who] + own * self.average) / (weight.sum() + own)), who, cosine

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        at, n = self.counts(text) if self.index is not None else ([], [])
        if not at:
            return self.without, np.zeros(0, np.int64), np.zeros(0)
        raw, who, cosine = self.vote(*self.vector(at, n))
        return float(np.interp(raw, *self.table)), self.ids[who], cosine


def monotone(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The nondecreasing values nearest to y by squares weighted with n, in the order of x."""
    level, weight, size = [], [], []
    for value, count in zip(y[np.argsort(x)], n[np.argsort(x)], strict=True):
        level.append(value)
        weight.append(count)
        size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            total = weight[-2] + weight[-1]
            level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / total]
            weight[-2:] = [total]
            size[-2:] = [size[-2] + size[-1]]
    return np.repeat(level, size)


def examples_of(docs: DataFrame, labels: DataFrame, modulus: int, held: int, examples: int) -> DataFrame:
    """doc_id, text, toxic: the sample, one row for equal texts. Written."""
    ids = F.col("doc_id")
    known = labels.where(ids.isNotNull() & F.col("toxic").isNotNull() & (remainder(modulus) != held)).groupBy("doc_id").agg(F.avg((F.col("toxic") != 0).cast("double")).alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)  # each task passes on so many rows at most
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id")
    same = own.groupBy(F.sha2("text", 256).alias("hash")).agg(F.first("text").alias("text"), F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic"))
    return written(same.select("doc_id", "text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, examples: int = EXAMPLES, least: int = 4, surplus: float = 5.0, lift: float = 3.0, k: int = 16) -> ToxicityModel:
    """A kept term stands in ``least`` examples at least, ``lift`` times as often in toxic ones as the average term, and its statistic is over 2 ln(terms tested) + ``surplus``: among terms without a bearing, that of the best is about 2 ln(terms tested)."""
    spark = docs.sparkSession
    prepare(spark)
    sample = examples_of(docs, labels, modulus, held, examples)
    total, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    model = ToxicityModel(k=k)
    if not total:
        return model
    model.average = model.without = toxic / total

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stood: dict[str, list[float]] = {}

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(stood), pa.string()), pa.array([n for n, _ in stood.values()], pa.int64()), pa.array([y for _, y in stood.values()], pa.float64())], names=["term", "n", "y"])
            stood.clear()
            return batch

        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                for term in terms(words(text.as_py())):
                    own = stood.setdefault(term, [0, 0.0])
                    own[0] += 1
                    own[1] += y
                if len(stood) > _HELD:
                    yield flush()
        yield flush()

    stood = written(sample.mapInArrow(summed, "term string, n long, y double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).where((F.col("n") >= least) & (F.col("n") < total)))
    n, y = F.col("n"), F.col("y")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = toxic / total
    statistic = 2 * (part(y, n * share) + part(n - y, n * (1 - share)) + part(toxic - y, (total - n) * share) + part(total - n - toxic + y, (total - n) * (1 - share)))
    tested = stood.count()
    chosen = stood.where((y / n >= lift * share) & (statistic > 2 * math.log(tested) + surplus)).orderBy("term").collect() if tested and 0 < toxic < total else []
    model.places = {r["term"]: i for i, r in enumerate(chosen)}
    model.heads = {r["term"].rstrip("-23")[: BEGINNINGS[0]] for r in chosen}
    model.idf = np.array([np.log((1 + total) / (1 + r["n"])) + 1 for r in chosen])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.counts(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int32()))], names=["doc_id", "toxic", "at", "n"])

    vectors = written(sample.mapInArrow(placed, "doc_id long, toxic double, at array<int>, n array<int>"))
    none, none_toxic = vectors.where(F.size("at") == 0).agg(F.count("*"), F.sum("toxic")).first()
    model.without = none_toxic / none if none else model.average
    rows = vectors.where(F.size("at") > 0).orderBy("doc_id").collect()  # at most the sample, kept terms only
    if rows:
        # examples with like terms side by side, so that blocks' bounds differ; ties by doc_id stay as ids rise within equal vectors
        rows.sort(key=lambda r: (r["at"], r["n"], r["doc_id"]))
        model.ids, model.toxic = np.array([r["doc_id"] for r in rows], np.int64), np.array([r["toxic"] for r in rows])
        model.index = Index.build([model.vector(r["at"], r["n"]) for r in rows], len(chosen))
        places = spark.createDataFrame([(i,) for i in range(len(rows))], "place int").repartition(min(len(rows), spark.sparkContext.defaultParallelism))
        own = [(r["at"], r["n"]) for r in rows]

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("place").to_pylist()
                yield pa.record_batch([pa.array([model.vote(*model.vector(*own[i]), but=i)[0] for i in at]), pa.array([model.toxic[i] for i in at])], names=["raw", "toxic"])

        bins = places.mapInArrow(others, "raw double, toxic double").groupBy(F.floor(F.col("raw") * 200).alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("toxic").alias("toxic"), F.count("*").alias("n")).orderBy("raw").collect()  # 201 rows at most
        x, share, size = (np.array([float(r[c]) for r in bins]) for c in ("raw", "toxic", "n"))
        model.table = (x, monotone(x, share, size))
    return model


def judge(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the neighbours' doc_ids and cosines, nearest first) of each whole text."""
    prepare(docs.sparkSession)
    names = ["doc_id", "held_out", "score", "predicted", "evidence"]
    shown = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column("text")]
            score = np.array([s for s, _, _ in found], np.float64)
            evidence = [[{"doc_id": i, "cosine": c} for i, c in zip(who.tolist(), cosine.tolist(), strict=True)] for _, who, cosine in found]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(evidence, shown)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(modulus) == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, cosine: double>>")
