"""Operator 10 against plain Python: hashed trigrams, TF-IDF, clustering and cosines as lists and dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from gleaner.llm import language_id


def trigrams(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    return Counter(((a | b << 8 | c << 16) * 2654435761 % 2**32) >> 20 for a, b, c in zip(data, data[1:], data[2:], strict=False))


def dot(x, y):
    return sum(v * y.get(k, 0.0) for k, v in x.items())


def unit(x):
    n = math.sqrt(sum(v * v for v in x.values())) or 1.0
    return {k: v / n for k, v in x.items()}


def mean(xs):
    total = defaultdict(float)
    for x in xs:
        for k, v in x.items():
            total[k] += v / len(xs)
    return unit(total)


def first_best(values):
    return max(range(len(values)), key=lambda i: (values[i], -i))


def clusters(xs, k=4):
    middle = mean(xs)
    chosen = [first_best([dot(x, middle) for x in xs])]
    while len(chosen) < min(k, len(xs)):
        chosen.append(first_best([-max(dot(x, xs[c]) for c in chosen) for x in xs]))
    centres = [xs[c] for c in chosen]
    for _ in range(12):
        own = [first_best([dot(x, c) for c in centres]) for x in xs]
        centres = [mean([x for x, o in zip(xs, own, strict=True) if o == i]) if i in own else c for i, c in enumerate(centres)]
    return centres


def by_hand(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    learned = [(lang, trigrams(t)) for i, t, lang in rows if i is not None and not held(i) and lang is not None and t is not None]
    df = Counter(k for _, c in learned for k in c)
    idf = lambda k: math.log((1 + len(learned)) / (1 + df[k])) + 1
    vector = lambda c: unit({k: math.log1p(n) * idf(k) for k, n in c.items()})
    learned.sort(key=lambda r: (r[0], sorted(r[1]), [r[1][k] for k in sorted(r[1])]))
    own = defaultdict(list)
    for lang, c in learned:
        own[lang].append(vector(c))
    centres = [(lang, c) for lang in sorted(own) for c in clusters(own[lang])]
    out = []
    for i, t, _ in rows:
        if not t or not any(map(str.isalpha, t)):
            out.append((i, held(i), "und", 0.0))
            continue
        cosines = [dot(vector(trigrams(t)), c) for _, c in centres]
        best = first_best(cosines)
        out.append((i, held(i), centres[best][0], min(max(cosines[best], 0.0), 1.0)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_languages_by_hand(spark, seed):
    rng = random.Random(seed)
    stocks = {lang: [["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(25)] for _ in range(3)] for lang, letters in (("aa", "abcdeft"), ("bb", "bnmklo"), ("cc", "zxcvé"))}
    rows = []
    for i in range(150):
        lang = rng.choice(sorted(stocks))
        stock = rng.choice(stocks[lang])  # topics, so that a language has several clusters
        rows.append((i, " ".join(rng.choice(stock) for _ in range(rng.randrange(8, 30))).title() if i % 3 else " ".join(rng.choice(stock) for _ in range(9)), lang if i % 11 else None))
    rows += [(200, None, "aa"), (201, "", "aa"), (202, "12 34", "bb"), (None, rows[5][1], "cc"), rows[4], (203, "ab", None)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    want = by_hand(rows)
    for parts in (1, 5):  # however rows are dealt
        dealt = docs.repartition(parts)
        got = language_id.identify(dealt, language_id.fit(dealt)).select("doc_id", "held_out", "lang_pred", "score").collect()
        key = lambda r: (repr(r[0]), r[3])
        for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
            assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-4)
