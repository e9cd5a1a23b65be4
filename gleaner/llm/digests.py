"""Operator 2: quartile bucket digests of byte triplets.

Every window of four bytes gives three triplets, hashed into 128 buckets. A
digest is hex: a length byte (logarithmic), a byte of quartile ratios, a
checksum byte, then two bits a bucket that tell which quartile its count lies
in. Two digests compare by a difference score, bounded by ``WORST``; likeness is
one less its share of that bound.

``fingerprints`` also digests an edited text, whose end comes from the next
document by descending doc_id. Rows are dealt to ranges of doc_id, each of which
begins at a doc_id of the table picked by hash; the first row of a range also goes
to the range before it, so texts are shuffled once and no task sees more than a
range. Ranges hold ``RANGE_BYTES`` of text on average, or more where there would be
over ``RANGES`` of them: only so many doc_ids, 8 MB, ever reach the driver or a task.

Defined results: null text counts as empty; null doc_ids come last; rows with
equal doc_ids go by text, and repeated rows follow one another; a table of one row
is its own next document; a very long text is digested whole, in steps; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import prepare

BUCKETS = 128
#: Places of a window's bytes that make a triplet, with the multiplier that hashes it.
TRIPLETS = (((0, 1, 2), 2654435761), ((0, 1, 3), 2246822519), ((0, 2, 3), 3266489917))
#: Bound of the difference score.
WORST = 400
#: Bytes hashed at a time.
STEP = 1 << 19
#: Bytes of text that a range aims at, and the most ranges.
RANGE_BYTES, RANGES = 4 << 20, 1 << 20


def _bucket_counts(texts: list[bytes]) -> np.ndarray:
    """len(texts) x BUCKETS."""
    n = len(texts)
    data = np.frombuffer(b"".join(texts) + bytes(3), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(n, dtype=np.int32), lengths)
    for back in (1, 2, 3):  # a window must not run into the next text
        at = ends - back
        row[at[lengths >= back]] = n
    counts = np.zeros((n + 1) * BUCKETS, np.int64)
    for start in range(0, len(row), STEP):
        own = row[start : start + STEP]
        low = int(own[own < n].min(initial=n))
        high = int(own[own < n].max(initial=low - 1))
        if high < low:
            continue
        base = np.where(own < n, own - low, high - low + 1).astype(np.int64) * BUCKETS
        window = [data[start + i : start + i + len(own)].astype(np.uint32) for i in range(4)]
        for (a, b, c), k in TRIPLETS:
            code = (window[a] | window[b] << np.uint32(8) | window[c] << np.uint32(16)) * np.uint32(k)
            found = np.bincount(base + (code >> np.uint32(25)), minlength=(high - low + 2) * BUCKETS)
            counts[low * BUCKETS : (high + 1) * BUCKETS] += found[: (high - low + 1) * BUCKETS]
    return counts[: n * BUCKETS].reshape(n, BUCKETS)


def digests(texts: list[bytes]) -> list[str]:
    if not texts:
        return []
    counts = _bucket_counts(texts)
    q = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, :, None] > q[:, None, :]).sum(axis=2)
    packed = (codes.reshape(len(texts), -1, 4) << np.array([0, 2, 4, 6])).sum(axis=2).astype(np.uint8)
    sizes = np.fromiter(map(len, texts), np.float64, len(texts))
    length = np.minimum(255, np.round(np.log1p(sizes) / np.log(1.1))).astype(np.uint8)
    top = np.maximum(q[:, 2], 1)
    ratios = (np.minimum(15, q[:, 0] * 15 // top) * 16 + np.minimum(15, q[:, 1] * 15 // top)).astype(np.uint8)
    check = np.array([zlib.crc32(t) & 0xFF for t in texts], np.uint8)
    whole = np.column_stack([length, ratios, check, packed])
    return [row.tobytes().hex() for row in whole]


def _parts(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(found)), np.uint8).reshape(len(found), 3 + BUCKETS // 4).astype(np.int64)
    return raw[:, :3], (raw[:, 3:, None] >> np.array([0, 2, 4, 6]) & 3).reshape(len(found), BUCKETS)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """1 less the difference as a share of WORST: 1 for equal digests, 0 for those as far apart as it counts."""
    if not left:
        return np.zeros(0)
    (a, x), (b, y) = _parts(left), _parts(right)
    steps = np.array([0, 1, 2, 6])[np.abs(x - y)].sum(axis=1)
    length = np.abs(a[:, 0] - b[:, 0])
    length = np.where(length <= 1, length, 6 * length)
    ratio = np.abs(a[:, 1] // 16 - b[:, 1] // 16) + np.abs(a[:, 1] % 16 - b[:, 1] % 16)
    score = steps + length + 2 * ratio + (a[:, 2] != b[:, 2])
    return 1 - np.minimum(score, WORST) / WORST


def _order(row: tuple) -> tuple:
    return row[0] is None, -(row[0] or 0), row[1]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def range_heads(rows: DataFrame, range_bytes: int, most: int = RANGES) -> np.ndarray:
    """The largest doc_id and about one in as many as fill a range, descending."""
    known = rows.where(F.col("doc_id").isNotNull())
    size = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.max("doc_id").alias("last")).first()
    if not size.n:
        return np.zeros(0, np.int64)
    ranges = min(most // 2, (size.bytes or 0) // range_bytes)  # their number varies about this
    place = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 40))
    picked = known.where(place < F.lit(int((1 << 40) * ranges / size.n))).select("doc_id").distinct().limit(most)
    return np.array(sorted({size.last, *picked.toArrow().column("doc_id").to_pylist()}, reverse=True), np.int64)


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each whole text."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", "text")
    firsts = range_heads(rows, range_bytes)
    last = max(len(firsts) - 1, 0)

    @F.pandas_udf("array<int>")
    def places(doc_id: pd.Series) -> pd.Series:
        """The row's range and, for the first row of a range, the range before it as -1 - number."""
        known = doc_id.notna().to_numpy()
        value = doc_id.fillna(0).to_numpy(np.int64)
        own = np.where(known, len(firsts) - np.searchsorted(firsts[::-1], value, side="left") - 1, last)
        is_first = known & np.isin(value, firsts) & (last > 0)
        return pd.Series([[int(o), -1 - int((o - 1) % (last + 1))] if f else [int(o)] for o, f in zip(own, is_first, strict=True)])

    def whole_range(group: pa.Table) -> pa.Table:
        place = group.column("place").to_pylist()
        texts = [t or "" for t in group.column("text").to_pylist()]
        rows = sorted(zip(group.column("doc_id").to_pylist(), texts, place, strict=True), key=_order)
        own = [(i, t) for i, t, p in rows if p >= 0]
        after = next((t for _, t, p in rows if p < 0), own[0][1] if own else "")
        following = [t for _, t in own[1:]] + [after]
        changed = [edited(t, f).encode() for (_, t), f in zip(own, following, strict=False)]
        prints = digests([*(t.encode() for _, t in own), after.encode()])
        other = digests(changed)
        data = [
            pa.array([i for i, _ in own], pa.int64()), pa.array([len(t) for _, t in own], pa.int64()), [hashlib.sha256(c).hexdigest() for c in changed],
            prints[:-1], other, likeness(prints[:-1], other), likeness(prints[:-1], prints[1:]),
        ]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(data, types, strict=True)], names=NAMES)

    dealt = rows.withColumn("place", F.explode(places("doc_id")))
    key = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    return dealt.groupBy(key.alias("range")).applyInArrow(whole_range, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
