"""Operator 10: language identification by nearest clustered centroid.

Byte trigrams of the text (A-Z lower-cased) are hashed to ``DIMS`` places; a
vector holds the logarithm of each count times its inverse document frequency,
with length one. Each language has up to ``clusters`` centroids from spherical
k-means. A text gets the language of the centroid with the largest cosine. It is
rejected if that cosine is under a floor taken from the training texts' own.

The classifier is fitted on a bounded sample: for each of at most ``languages``
languages (the commonest), at most ``per_language`` of its labelled training rows,
those whose hash of doc_id and text is smallest. Only their vectors reach the
driver.

Defined results: a null text, or one without a letter, gets ``und``, score 0 and
is rejected; with nothing to learn from, all texts do. A null doc_id is not held
out, and not learned from. Ties go to the language first in alphabetical order.
Repeated rows are judged row by row, and may be learned from more than once; a very
long text is one vector of the whole; an empty table gives an empty result. Extra
columns are ignored by ``identify`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import prepare, text_buffer

DIMS = 4096
UNKNOWN = "und"
#: Bytes hashed at a time.
STEP = 1 << 20
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def trigram_counts(column: pa.Array) -> np.ndarray:
    """Texts x DIMS."""
    data, offsets = text_buffer(column)
    n, lengths = len(offsets) - 1, np.diff(offsets)
    counts = np.zeros((n, DIMS), np.float32)
    first = 0
    while first < n:  # as many texts at a time as fit in STEP bytes, one at least
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP, side="right")) - 1)
        part = _LOWER[data[offsets[first] : offsets[stop]]].astype(np.uint32)
        if len(part) >= 3:
            row = np.repeat(np.arange(stop - first), lengths[first:stop])
            code = (part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)) * np.uint32(2654435761)
            inside = row[:-2] == row[2:]
            place = row[:-2] * DIMS + (code >> np.uint32(20))
            counts[first:stop] = np.bincount(place[inside], minlength=(stop - first) * DIMS).reshape(-1, DIMS)
        first = stop
    return counts


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from texts far from one another, so it gives the same every time."""
    chosen = [int(np.argmax(x @ _unit(x.mean(axis=0, keepdims=True))[0]))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.array([x[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))]))
    return centres


@dataclass
class LanguageModel:
    languages: list[str]  # one a centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: float

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        texts = column.to_pylist()
        lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosines = _unit(np.log1p(trigram_counts(column)) * self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.where(lettered, np.clip(cosines[np.arange(len(texts)), best].astype(np.float64), 0, 1), 0.0)
        return [self.languages[b] if known else UNKNOWN for b, known in zip(best, lettered, strict=True)], score, ~lettered | (score < self.floor)


def _sample(docs: DataFrame, modulus: int, held: int, per_language: int, languages: int) -> DataFrame:
    """lang, text of the rows learned from."""
    labelled = docs.select("doc_id", "text", "lang").where((remainder(modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.withColumn("place", F.xxhash64(F.lit(10), "doc_id", "text"))
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    # each task passes on its least places only, and no text moves before the bound is known
    ranked = labelled.select("lang", "place").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place")))
    bounds = ranked.where(F.col("rank") <= per_language).groupBy("lang").agg(F.max("place").alias("most")).join(common, "lang", "left_semi")
    near = labelled.join(F.broadcast(bounds), "lang").where(F.col("place") <= F.col("most"))
    exact = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place")))  # rows that repeat have the same place
    return exact.where(F.col("rank") <= per_language).select("lang", "text")


def fit(docs: DataFrame, modulus: int = 4, held: int = 2, per_language: int = 400, clusters: int = 4, languages: int = 100) -> LanguageModel:
    prepare(docs.sparkSession)
    sample = _sample(docs, modulus, held, per_language, languages)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = trigram_counts(batch.column("text"))
            at = [np.flatnonzero(c) for c in counts]
            yield pa.record_batch([batch.column("lang"), pa.array([a.tolist() for a in at], pa.list_(pa.int32())), pa.array([c[a].tolist() for a, c in zip(at, counts, strict=True)], pa.list_(pa.float32()))], names=["lang", "at", "n"])

    rows = sample.mapInArrow(vectors, "lang string, at array<int>, n array<float>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["at"], r["n"]))  # the same model however rows arrive
    if not rows:
        return LanguageModel([], np.zeros((0, DIMS)), np.ones(DIMS), 0.0)
    seen = np.bincount(np.concatenate([np.array(r["at"], np.int64) for r in rows]), minlength=DIMS)
    idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + np.float32(1)

    def of(lang: str) -> np.ndarray:
        own = [r for r in rows if r["lang"] == lang]
        x = np.zeros((len(own), DIMS), np.float32)
        for i, r in enumerate(own):
            x[i, r["at"]] = r["n"]
        return _unit(np.log1p(x) * idf)

    names = sorted({r["lang"] for r in rows})
    found = [(lang, c) for lang in names for c in _clusters(of(lang), clusters)]
    centroids = np.array([c for _, c in found], np.float32)
    own = np.concatenate([(of(lang) @ centroids.T).max(axis=1) for lang in names])
    return LanguageModel([lang for lang, _ in found], centroids, idf, float(np.quantile(own, 0.01)) / 2)


def identify(docs: DataFrame, model: LanguageModel, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, rejected = model.judge(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", F.coalesce(remainder(modulus) == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected."""
    prepare(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, rejected = model.judge(batch.column(names.index("text")))
            yield batch.filter(pa.array(~rejected, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
