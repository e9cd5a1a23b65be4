"""Operator 6: greedy longest-match word-piece counts by a linear automaton.

A trie over the vocabulary gets failure links. A link's label is the number of
tokens that greedy matching has put out by the time it is taken, so a word's
count is a sum over the walk; no piece is built. Each byte of a word moves the
automaton forward once, and failure links are amortised over those moves, so
the time is linear in the word's length.

Vocabulary strings are bytes; those that end a word carry ``END``, a byte that
UTF-8 never has. Words are runs of non-white bytes, A-Z lower-cased.

Defined results: a null or blank text has 0 words and 0 tokens; a word with a
byte that no token covers counts as one unknown token; repeated rows are
counted row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.byte_bpe import byte_characters
from gleaner.llm.shared import prepare

#: Marks the end of a word in vocabulary strings and in words.
END = b"\xff"
#: Entries that a worker's cache of words holds.
CACHED = 400_000


class LongestMatch:
    """Trie, failure links and popped-token counts."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        token, depth = [False], [0]
        for entry in vocabulary:
            node = 0
            for byte in entry:
                if byte not in self.next[node]:
                    self.next[node][byte] = len(self.next)
                    self.next.append({})
                    token.append(False)
                    depth.append(depth[node] + 1)
                node = self.next[node][byte]
            token[node] = bool(entry)
        #: Where matching goes on when a node has no way on, and how many tokens it has put out then.
        self.fail: list[int | None] = [None] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, node in self.next[parent].items():
                    below.append(node)
                    if token[node]:
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    at, count = self.fail[parent], self.popped[parent]
                    while at is not None and byte not in self.next[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at is not None:
                        self.fail[node], self.popped[node] = self.next[at][byte], count
            level = below

    def count(self, word: bytes) -> int:
        """Tokens of one word; -1 if some byte can't be covered."""
        node = total = 0
        for byte in word:
            while byte not in self.next[node]:
                if self.fail[node] is None:
                    return -1
                total += self.popped[node]
                node = self.fail[node]
            node = self.next[node][byte]
        while node:
            if self.fail[node] is None:
                return -1
            total += self.popped[node]
            node = self.fail[node]
        return total


def word_vocabulary(path: str) -> list[bytes]:
    """The token strings of a tokenizer file whose word-final tokens end in ``</w>``, as bytes with END in its place."""
    reverse = {c: b for b, c in byte_characters().items()}
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    found = []
    for token in tokens:
        body, final = token.removesuffix("</w>"), token.endswith("</w>")
        if body and all(c in reverse for c in body):
            found.append(bytes(reverse[c] for c in body) + END * final)
    return found


class _Counts(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word + END)
        if len(self) < CACHED and len(word) < 64:
            self[word] = n
        return n


@lru_cache(4)
def _counts(path: str) -> _Counts:
    return _Counts(LongestMatch(word_vocabulary(path)))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_unknown (words), n_tokens (unknown words count one each) of each whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(path)
        for batch in batches:
            words, unknown, tokens = [], [], []
            for text in batch.column("text").to_pylist():
                found = (text or "").encode().lower().split()
                each = list(map(counts.__getitem__, found))
                bad = each.count(-1)
                words.append(len(found))
                unknown.append(bad)
                tokens.append(sum(each) + 2 * bad)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, unknown, tokens))], names=["doc_id", "n_words", "n_unknown", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_unknown long, n_tokens long")
