"""Operators 11, 12 and 13."""

import collections
import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from gleaner.llm import dual_tree, prefix_trie, toxicity

# Operator 11


def brute_nearest(vectors, query, k, but=-1):
    cosines = [(-round(sum(q * dict(zip(*v, strict=True)).get(t, 0.0) for t, q in zip(*query, strict=True)), 12), i) for i, v in enumerate(vectors) if i != but]
    return [(i, -c) for c, i in sorted(cosines)[:k] if c < 0]


@pytest.mark.parametrize("seed,equal", [(1, False), (2, True)])
def test_nearest_against_all(seed, equal):
    rng = np.random.default_rng(seed)
    vectors = []
    for _ in range(700):
        at = np.sort(rng.choice(40, rng.integers(1, 7), replace=False))
        w = np.ones(len(at)) if equal else rng.random(len(at)) + 0.1  # equal weights give many ties
        vectors.append((at, w / np.sqrt((w * w).sum())))
    vectors.sort(key=lambda v: v[0].tolist())
    index = toxicity.Index.build(vectors, 40)
    spared = 0
    for i in range(0, 700, 7):
        who, cosine, opened = index.nearest(*vectors[i], 5, but=i)
        want = brute_nearest(vectors, vectors[i], 5, but=i)
        assert who.tolist() == [w for w, _ in want]
        assert np.allclose(cosine, [min(c, 1) for _, c in want])
        spared += index.size // toxicity.BLOCK + 1 - opened
    assert spared > 0


def test_terms():
    found = toxicity.words("Rotten, rottener rotten ROTTENEST x")
    assert found == {"rotten": 2, "rottener": 1, "rottenest": 1, "x": 1}
    assert toxicity.terms(found) == {**found, "rott-": 4, "rotte-": 4, "rotten-": 2, "rottene-": 2, "rott-2": 1, "rott-3": 1, "rotte-2": 1, "rotte-3": 1, "rotten-2": 1, "rottene-2": 1}
    model = toxicity.ToxicityModel(places={t: i for i, t in enumerate(["rott-3", "rotten", "rotten-", "x"])}, heads={"rott", "x"})
    assert model.counts("Rotten, rottener rotten ROTTENEST x xx") == ([0, 1, 2, 3], [1, 2, 2, 1])


def test_monotone():
    assert toxicity.monotone(np.array([3.0, 1, 2, 4]), np.array([0.1, 0.4, 0.2, 0.9]), np.array([2.0, 1, 1, 1])).tolist() == pytest.approx([0.2, 0.2, 0.2, 0.9])


def toxic_tables(n=400):
    rng = random.Random(3)
    stock = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    bad = ["vileness", "wretched", "gruesome"]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(stock) for _ in range(rng.randrange(20, 60))]
        if toxic := i % 5 == 0:
            for _ in range(4):
                own[rng.randrange(len(own))] = rng.choice(bad)
        docs.append((i, " ".join(own), "en", "x", 3.0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_finds_held_out(spark):
    docs, labels = toxic_tables()
    docs += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "vileness wretched vileness", None, None, None), docs[0], (1002, "wretched " * 30_000, None, None, None)]
    labels += [(1000, 1, None), (None, 1, 1), labels[5], (99_999, 0, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, term string, score double").repartition(3)
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.judge(frame, model).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is None or r.doc_id == 1002 or r.doc_id < 1000 and r.doc_id % 5 == 0:
            assert r.predicted == 1 and r.evidence and all(e.doc_id % 5 == 0 and not held(e.doc_id) for e in r.evidence)
        else:
            assert r.predicted == 0
        assert [e.cosine for e in r.evidence] == sorted((e.cosine for e in r.evidence), reverse=True)
    # plain Python over the same model: all cosines, votes, calibration
    shares = {i: y for i, y in zip(model.ids.tolist(), model.toxic.tolist(), strict=True)}
    texts = {i: t for i, t, *_ in docs if i is not None}
    vectors = [model.vector(*model.counts(texts[i])) for i in model.ids.tolist()]
    for r in [r for r in got if r.evidence][:25]:
        text = "vileness wretched vileness" if r.doc_id is None else texts[r.doc_id]
        near = brute_nearest(vectors, model.vector(*model.counts(text)), model.k)
        weights = [(1 / (1 - min(c, 1) + 0.05), shares[model.ids[i]]) for i, c in near] + [(1 / 1.05, model.average)]
        raw = sum(w * y for w, y in weights) / sum(w for w, _ in weights)
        assert r.score == pytest.approx(float(np.interp(raw, *model.table)))
        assert [e.doc_id for e in r.evidence] == [model.ids[i] for i, _ in near]


def test_toxicity_terms_kept(spark):
    """The kept terms are those of a plain count over the examples."""
    docs, labels = toxic_tables(200)
    toxic = {i: y for i, _, y in labels}
    model = toxicity.fit(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    learned = [(i, t) for i, t, *_ in docs if not held(i)]
    n, y = collections.Counter(), collections.Counter()
    for i, t in learned:
        for term in toxicity.terms(toxicity.words(t)):
            n[term] += 1
            y[term] += toxic[i]
    total, bad = len(learned), sum(toxic[i] for i, _ in learned)
    tested = [t for t in n if 4 <= n[t] < total]

    def g(t):
        cells = [(y[t], n[t] * bad / total), (n[t] - y[t], n[t] * (total - bad) / total), (bad - y[t], (total - n[t]) * bad / total), (total - n[t] - bad + y[t], (total - n[t]) * (total - bad) / total)]
        return 2 * sum(o * math.log(o / e) for o, e in cells if o)

    want = sorted(t for t in tested if y[t] / n[t] >= 3 * bad / total and g(t) > 2 * math.log(len(tested)) + 5)
    assert want and sorted(model.places) == want


def test_toxicity_with_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.judge(docs, toxicity.fit(docs, none)).collect()] == [(0.0, 0)] * 2
    all_clean = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.judge(docs, toxicity.fit(docs, all_clean)).collect()] == [0.0] * 2
    empty = docs.limit(0)
    assert toxicity.judge(empty, toxicity.fit(empty, none)).count() == 0


# Operator 12


def brute_lloyd(rows, k, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in starts[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, n in found:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found), key=repr)


def vectors(seed, n, clumps):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clumps, 64))
    rows = [(i, (centres[rng.integers(clumps)] + rng.normal(size=64) * 0.05).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # one very common vector
    rows += [(n + 40 + i, np.full(64, i % 2, np.float32).tolist()) for i in range(6)]  # ties between equal centroids
    bad = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [float("inf")] + [0.0] * 63]
    rows += [(9000 + i, v) for i, v in enumerate(bad)]
    return [*rows, rows[7], (None, rows[8][1])]


@pytest.mark.parametrize("block,ratio", [(512, 1.4), (32, 2.0)])
def test_lloyd(spark, monkeypatch, block, ratio):
    monkeypatch.setattr(dual_tree, "BLOCK", block)
    monkeypatch.setattr(dual_tree, "RATIO", ratio)
    rows = vectors(1, 300, 12)
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int").repartition(2)
    for k in (7, 40):
        assert sorted(map(tuple, dual_tree.cluster(frame, k).collect()), key=repr) == brute_lloyd(rows, k)


def test_lloyd_of_few_and_huge(spark):
    schema = "vec_id long, embedding array<double>"
    few = [(5, [0.5] * 64), (6, [-0.5] * 64), (6, [-0.25] * 64)]
    assert sorted(map(tuple, dual_tree.cluster(spark.createDataFrame(few, schema)).collect()), key=repr) == brute_lloyd(few, 40)
    assert dual_tree.cluster(spark.createDataFrame([], schema)).count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], schema)
    got = sorted(map(tuple, dual_tree.cluster(huge, 1, 0).select("vec_id", "distance").collect()))
    start = min((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i) for i in (1, 2, 3))[1]
    at = {1: 2**26, 2: -(2**26), 3: 0}
    assert got == [(i, 64 * (at[i] - at[start]) ** 2) for i in (1, 2, 3)]


def test_trees_prune():
    """Clumped vectors: equal to all comparisons, with far fewer of them."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-900, 900, (40, 64))
    points = np.unique(centres[rng.integers(40, size=512)] + rng.integers(-5, 6, (512, 64)), axis=0)
    tree, over = dual_tree.CoverTree(points), dual_tree.CoverTree(centres, 1)
    own, computed = dual_tree.assign(points, tree, centres, over)
    assert (own == dual_tree.squared(points, centres).argmin(1)).all()
    assert computed < len(points) * len(centres) / 2
    for i, children in enumerate(tree.children):
        inside = points[tree.order[tree.start[i] : tree.stop[i]]]
        assert np.sqrt(((inside - points[tree.centre[i]]) ** 2).sum(1)).max() <= tree.radius[i]
        if children:
            assert sum(tree.stop[c] - tree.start[c] for c in children) == len(inside)
            apart = np.sqrt(dual_tree.squared(points[[tree.centre[c] for c in children]], points[[tree.centre[c] for c in children]]))
            assert apart[~np.eye(len(children), dtype=bool)].min() > tree.radius[i] / dual_tree.RATIO


def test_exact_distances():
    big = np.array([[2**26] * 64, [-(2**26)] * 64, [3] * 64])
    assert dual_tree.squared(big, big)[0].tolist() == [0, 64 * 2**54, 64 * (2**26 - 3) ** 2]


# Operator 13


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + x[h:]
    members = collections.defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = collections.defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, n=260):
    """Few first turns, most of them one; short turns of few texts, so that prefixes recur at all depths."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(-130, -90), 10**12 + 7, 10**12]:
        length = rng.randrange(1, 9)
        for t in range(length):
            text = rng.choice(["yes", "no", "maybe ü😀"]) if rng.random() < 0.7 else f"text {rng.randrange(40)}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "hello" if t == 0 and rng.random() < 0.7 else text))
    rows += [(40, None, None, None), (41, 0, None, "x"), (41, 0, "user", None), (None, 0, "user", "lost"), rows[3], (100, 0, "user", "w " * 50_000)]
    rows += [(5000 + k, t, "user", f"same {t}") for k in range(60) for t in range(30)]  # copies of a long one
    return rows


@pytest.mark.parametrize("limit,bucket", [(4096, 16384), (200, 50), (7, 9), (1, 5)])
def test_trie(spark, limit, bucket):
    rows = talks(limit)
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, digest int").repartition(3)
    got = [tuple(r) for r in prefix_trie.prefix_trie(frame, limit, bucket).select(prefix_trie.COLUMNS).collect()]
    assert sorted(got, key=repr) == brute_trie(rows)


def test_trie_odd(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    turnless = [(c, 0, "user", "gone") for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6]  # their hundred is absent
    assert [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(turnless, schema)).collect()] == brute_trie(turnless)
    long = [(7, t, "user", str(t)) for t in range(300)]  # one conversation, longer than a subtrie
    assert sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(long, schema), 100, 50).collect()), key=repr) == brute_trie(long)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are absent")
@pytest.mark.parametrize("name,table,query,sql", [("op12", "embeddings", dual_tree.cluster, dual_tree.sql()), ("op13", "conversations", prefix_trie.prefix_trie, prefix_trie.SQL)])
def test_twins(spark, name, table, query, sql):
    path = f"/root/testdata/sf0.001/{table}.parquet"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    got = query(spark.read.parquet(path))
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
