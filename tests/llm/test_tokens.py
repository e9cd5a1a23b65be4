"""Operators 6 and 8 against plain greedy matching and tiktoken."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import byte_bpe, token_counts

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip(docs, texts, reference):
    got = sorted(byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect(), key=repr)
    want = []
    for i, t in texts:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_any_text(text):
    codec = byte_bpe.codec(RANKS, P.PATTERN)
    ids = np.frombuffer(codec.encode(text), "<u4").astype(int)
    assert codec.decode(ids) == text.encode()
    starts, ends = codec.offsets(text, ids) if len(ids) else ([], [])
    assert all(a < b for a, b in zip(starts, ends, strict=True))


@given(st.lists(st.sampled_from(["the", " ", "\n", "aaaa", "é", "  ", "123", "'s", "!!", "<|endoftext|>", "漢", "\x1c", "　"]), max_size=20).map("".join))
@settings(max_examples=200, deadline=None)
def test_equals_tiktoken(text):
    codec = byte_bpe.codec(RANKS, P.PATTERN)
    enc = test_equals_tiktoken.__dict__.setdefault("enc", tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == enc.encode_ordinary(text)


def test_offsets_and_decode(docs, empty):
    coded = byte_bpe.encode(docs.where("doc_id < 80"), RANKS, P.PATTERN)
    text = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for r in byte_bpe.decode(coded, RANKS, P.PATTERN).collect():
        assert r.text == text[r.doc_id]
    for r in coded.collect():
        if r.ids:
            assert r.starts[0] == 0 and r.ends[-1] == len(text[r.doc_id])
    assert byte_bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


def greedy(word, vocabulary, longest):
    word, at, n = word + token_counts.END, 0, 0
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_counts(docs, texts, empty):
    vocabulary = set(token_counts.word_vocabulary(WORDS))
    longest = max(map(len, vocabulary))
    got = {(r.doc_id, r.n_words, r.n_tokens) for r in token_counts.token_counts(docs, WORDS).collect()}
    words = lambda t: (t or "").encode().lower().split()
    assert got == {(i, len(words(t)), sum(greedy(w, vocabulary, longest) for w in words(t))) for i, t in texts}
    assert token_counts.token_counts(empty, WORDS).count() == 0


@given(st.sets(st.text("ab", min_size=1, max_size=4).map(str.encode), max_size=8), st.text("abc", min_size=1, max_size=9).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_automaton(vocabulary, word):
    vocabulary = vocabulary | {v + token_counts.END for v in list(vocabulary)[:3]}
    got = token_counts.LongestMatch(vocabulary).count(word + token_counts.END)
    assert (1 if got < 0 else got) == greedy(word, vocabulary, 6)
