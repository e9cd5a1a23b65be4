"""Operator 8: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives each token's bytes. The library works on characters, so each
byte is mapped to one printable character (``byte_characters``) and the merges
are every split of a token into two tokens, ordered by the token's rank. Each
match of the split pattern is encoded by itself. Decoding reverses the byte
table; a character whose bytes lie in several tokens is put together again when
all bytes are joined.

Defined results: a null text counts as empty (no tokens, hash of no bytes);
repeated rows and ids are encoded row by row; an empty table gives an empty
result; other columns are ignored. Memory: one Arrow batch and a cache of
``CACHED`` pieces a worker.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.shared import prepare

#: Entries that a worker's piece cache holds; beyond it pieces are encoded anew.
CACHED = 250_000
#: Two white-space characters in a row, or one at either end: such texts take the general way.
_RUN = re.compile(r"\s\s|\A\s|\s\Z")


def byte_characters() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Pieces(dict):
    """Chunk between two spaces -> little-endian ids of the chunk with its leading space."""

    def __init__(self, codec: ByteBpe):
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join(map(self.codec.piece, self.codec.split(f" {chunk}")))
        if len(self) < CACHED and len(chunk) < 64:
            self[chunk] = ids
        return ids


class ByteBpe:
    """Encoder and decoder for one rank file and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        from tokenizers import Tokenizer, models

        characters = byte_characters()
        self._to_characters = {b: c for b, c in characters.items()}
        as_text = lambda raw: raw.decode("latin-1").translate(self._to_characters)
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            halves = [(token[:i], token[i:]) for i in range(1, len(token))]
            known = [(ranks[a], ranks[b], a, b) for a, b in halves if a in ranks and b in ranks]
            merges += [(as_text(a), as_text(b)) for _, _, a, b in sorted(known)]
        self._model = Tokenizer(models.BPE(vocab={as_text(t): r for t, r in ranks.items()}, merges=merges)).model
        reverse = {c: b for b, c in characters.items()}
        strings = {r: as_text(t) for t, r in ranks.items()}
        self._bytes = {r: bytes(reverse[c] for c in s) for r, s in strings.items()}
        self._lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for r, raw in self._bytes.items():
            self._lengths[r] = len(raw)
        self.split = regex.compile(pattern).findall
        self._pieces = _Pieces(self)

    def piece(self, match: str) -> bytes:
        found = self._model.tokenize(match.encode().decode("latin-1").translate(self._to_characters))
        return np.array([t.id for t in found], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _RUN.search(text):
            return b"".join(map(self.piece, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.piece, self.split(first)), *map(self._pieces.__getitem__, rest)])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the character it begins in and the character after its last; tokens that share a character overlap."""
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(self._lengths[ids])
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return character[ends - self._lengths[ids]], character[ends - 1] + 1


@lru_cache(4)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, and for each id the characters it covers: starts (from 0) and ends (after the last)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [np.frombuffer(bpe.encode(t), "<u4").astype(np.int64) for t in texts]
            spans = [bpe.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
            lists = [ids, [s for s, _ in spans], [e for _, e in spans]]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([x.tolist() for x in v], pa.list_(pa.int32())) for v in lists)], names=["doc_id", "ids", "starts", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, raw (the bytes) and text; bytes that are no UTF-8 become the replacement character in text. Null ids count as none."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            raw = [bpe.decode(np.array(i or [], np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(raw, pa.binary()), pa.array([r.decode(errors="replace") for r in raw], pa.string())], names=["doc_id", "raw", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and decoded again in one pass."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text or "")
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
