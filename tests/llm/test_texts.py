"""Operators 2, 3, 4, 7 and 10."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import context_tree, digests, jaccard_join, language_id, line_templates, quality_rules, shared, words


def plain_digest(data):
    """The digest of the docstring, byte by byte."""
    counts = [0] * 128
    for k in range(len(data) - 3):
        w = data[k : k + 4]
        for (a, b, c), factor in (((0, 1, 2), 2654435761), ((0, 1, 3), 2246822519), ((0, 2, 3), 3266489917)):
            counts[(w[a] + (w[b] << 8) + (w[c] << 16)) * factor % 2**32 >> 25] += 1
    low, mid, high = (sorted(counts)[k] for k in (31, 63, 95))
    top = max(high, 1)
    out = [min(255, round(math.log1p(len(data)) / math.log(1.1))), min(15, low * 15 // top) * 16 + min(15, mid * 15 // top), zlib.crc32(data) & 255]
    codes = [(c > low) + (c > mid) + (c > high) for c in counts]
    return bytes(out + [sum(codes[k + j] << 2 * j for j in range(4)) for k in range(0, 128, 4)]).hex()


def plain_likeness(x, y):
    a, b = bytes.fromhex(x), bytes.fromhex(y)
    score = sum((0, 1, 2, 6)[abs((p >> s & 3) - (q >> s & 3))] for p, q in zip(a[3:], b[3:], strict=True) for s in (0, 2, 4, 6))
    length = abs(a[0] - b[0])
    score += (length if length <= 1 else 6 * length) + 2 * (abs(a[1] // 16 - b[1] // 16) + abs(a[1] % 16 - b[1] % 16)) + (a[2] != b[2])
    return 1 - min(score, 400) / 400


def plain_fingerprints(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    found = []
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = (plain_digest(x.encode()) for x in (text, changed, following))
        found.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, pytest.approx(plain_likeness(a, b)), pytest.approx(plain_likeness(a, c))))
    return found


def by_text(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))


@pytest.mark.parametrize("size", [300, 3000, 1 << 22])
def test_digests_equal_brute_force(docs, texts, empty, size):
    got = by_text(map(tuple, digests.fingerprints(docs, range_bytes=size).collect()))
    assert got == by_text(plain_fingerprints(texts))
    assert digests.fingerprints(empty).count() == 0


def test_digests_of_null_ids_and_repeats(spark):
    rows = [(None, f"no id {i % 3} " * (i + 1)) for i in range(9)] + [(5, "five " * 40)] * 4 + [(i, f"text {i} " * 30) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert by_text(map(tuple, digests.fingerprints(frame, range_bytes=400).collect())) == by_text(plain_fingerprints(rows))
    none = spark.createDataFrame(rows[:9], frame.schema)
    assert by_text(map(tuple, digests.fingerprints(none, range_bytes=50).collect())) == by_text(plain_fingerprints(rows[:9]))


def test_digest_single_row_and_bounds(docs):
    one = digests.fingerprints(docs.where("doc_id = 3")).first()
    assert one.near_next == 1.0 and 0 <= one.near_edited <= 1
    a, b = digests.digests([b"x" * 500, bytes(range(256)) * 3])
    assert digests.likeness([a], [a])[0] == 1 and 0 <= digests.likeness([a], [b])[0] < 0.8


def plain_quality(texts):
    out = []
    for i, t in texts:
        t = t or ""
        w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if x]
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    return sorted(out, key=repr)


def test_quality_base(docs, texts, empty):
    got = [tuple(r)[:7] for r in quality_rules.judge(docs).collect()]
    assert sorted(got, key=repr) == plain_quality(texts)
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep(empty).count() == 0


def test_quality_lines(spark):
    common = "this very line is everywhere"
    rows = [(i, f"{common}\n" + " ".join(f"w{i}x{j}" for j in range(30)), "s") for i in range(30)]
    rows += [(100 + i, (f"{common}\n" * 3 + f"{common.upper()}\n" * 3) + f"own{i}", "s") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert all(kept[i] for i in range(30)) and not any(kept[100 + i] for i in range(3))
    copies = spark.createDataFrame([(i, rows[0][1], "s") for i in range(50)], docs.schema)
    assert quality_rules.keep(copies).count() == 50  # copies of one text count once


def test_quality_long_lines(spark):
    licence = " ".join(f"clause{j}" for j in range(200))
    docs = spark.createDataFrame([(i, f"{licence}\nown{i} words here", "s") for i in range(30)], "doc_id long, text string, source string")
    assert not any(r.kept for r in quality_rules.judge(docs).collect()) and quality_rules.keep(docs).count() == 0
    assert quality_rules.keep(docs.limit(20)).count() == 20


def test_quality_keeps_columns(docs):
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == want


def test_templates(spark, docs, empty):
    rows = [(i, f"start {c * 4} alpha\nServer {i} at host h{i} took 12ms to start up today\nend {c * 5} of mine", "k") for i, c in enumerate("abcdefgh")]
    frame = spark.createDataFrame(rows + [(8, None, None), (9, "", ""), (7, rows[7][1], "k")], "doc_id long, text string, n_chars string")
    out = {r.doc_id: r for r in line_templates.drop_lines(frame).collect()}
    assert out[0].n_dropped == 0 and all(out[i].n_dropped == 1 for i in range(1, 8))
    assert out[3].text == "start dddd alpha\nend ddddd of mine"
    assert out[8].text is None and out[9].text == "" and line_templates.drop_lines(frame).count() == 11
    assert line_templates.drop_lines(empty).count() == 0
    assert line_templates.dedup(docs).columns == docs.columns
    assert line_templates.dedup(docs).count() == docs.count()


@pytest.mark.parametrize("large", [20_000, 1])
def test_templates_of_one_leaf(spark, monkeypatch, large):
    monkeypatch.setattr(line_templates, "LARGE", large)
    common = ["share this page on facebook now", "share this page with your friends", "share this page by electronic mail"]
    rows = [(100 * k + i, f"{c}\nown{'xyz'[k]} {'abcdefghijkl'[i]}") for k, c in enumerate(common) for i in range(6 + 3 * k)]
    out = line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    for k, c in enumerate(common):
        assert [r.doc_id for r in out if c in r.text] == [100 * k]


def test_two_kinds_of_lines_in_a_leaf(spark):
    kinds = ["server started at host now with full load today", "server started at node later under light traffic yesterday"]
    rows = [(20 * k + i, f"{line}\nown {'xyzuvwrst'[i] * 3} of {'ab'[k]}") for k, line in enumerate(kinds) for i in range(9 - k)]
    out = line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sum(r.n_dropped for r in out) == 15 and {r.doc_id for r in out if not r.n_dropped} == {0, 20}


def test_numbers_alone_make_no_template(spark):
    rows = [(i, f"{i}.{i} {i * 7} x{i}\nrow {i}") for i in range(30)]
    out = {r.doc_id: r.n_dropped for r in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert out == {i: int(i > 0) for i in range(30)}  # "row <*>" is half constant


def test_long_lines_recur_in_two_texts(spark):
    passage, short = " ".join(f"{c}{d}" for c in "abcdefghij" for d in "klmnop"), "a line of some seven words only"
    rows = [(i, f"{passage}\n{short}\nown {c * 9}") for i, c in enumerate("abc")] + [(7, passage.replace("ak", "ab") + "\nrest of it")]
    out = {r.doc_id: (r.n_dropped, r.text) for r in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert [out[i][0] for i in (0, 1, 2)] == [0, 1, 1] and all(short in out[i][1] for i in range(3))
    assert out[7][0] == 0  # another first word is another leaf


def test_ties_between_tokens_and_texts(spark):
    rows = [(None, "one two three four five\nz"), *((4, f"one two three four five\n{c * 5} end") for c in "abcde")]
    out = line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sum(r.n_dropped for r in out) == 5 and [r.n_dropped for r in out if r.doc_id is None] == [1]


NAMES = "doc_id long, text string, source string, __a int, __b string, __at int, __split string, __host string, __lines int, __dropped int, __word int, __bits int, __id int, `a.b` string"


def test_clashing_names(spark):
    rows = [(i, f"the same old line of a host\n{' '.join(c * 3 + str(j) for j in range(30))}" if i < 26 else None, "s", 1, "b", 2, "c", "h", 3, 4, 5, 6, 7, "d") for i, c in enumerate("abcdefghijklmnopqrstuvwxyzAB")]
    rows += [(90 + i, "the same old line of a host " * (i + 1), "s", 1, "b", 2, "c", "h", 3, 4, 5, 6, 7, "d") for i in range(2)]
    docs = spark.createDataFrame(rows, NAMES).repartition(2)
    for out in (quality_rules.keep(docs), line_templates.dedup(docs), jaccard_join.representatives(docs)):
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(tuple(r)[2:] == rows[0][2:] for r in found)
    assert quality_rules.keep(docs).count() == 26 and line_templates.dedup(docs).count() == 30


def test_dedup_of_short_lines(spark):
    rows = [(i, f"Les.\nAnd ornd.\n{c * 4} only") for i, c in enumerate("abcdefg")]
    out = {r.doc_id: r.text for r in line_templates.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert out == {0: rows[0][1]} | {i: f"{c * 4} only" for i, c in enumerate("abcdefg") if i}


def solved(codes, n):
    """values of all codes, in one place."""
    tree = context_tree.Tree(codes, n)
    pair, node, *rest = tree.bottom()
    first, places = np.unique(pair >> 8 << 8 | node, return_inverse=True)
    ones = [np.bincount(places, v, len(first)) for v in (rest[0], rest[1], context_tree.weigh(*rest)[0])]
    so_far, left = context_tree.upper(first >> 8, first & 255, *ones)
    order = np.argsort(pair << 8 | node)
    given = context_tree.second(pair, node, *rest, so_far, left)
    return tree.values((pair << 8 | node)[order], *(v[order] for v in given))


def test_context_tree_is_a_distribution():
    depth = context_tree.DEPTH
    texts = pa.array(["abracadabra", "abrabrabra", "cadabra"])
    data, offsets = shared.text_buffer(texts)
    codes = np.sort(context_tree.grams(data, offsets)[0])
    at = context_tree._runs(codes)
    context = int.from_bytes(b"dabra"[::-1].ljust(depth, b"\xfe")[:depth], "big") << 8
    wanted = np.array([context | b for b in range(256)], np.uint64)
    keys, n = context_tree.added([codes[at], wanted], [np.diff(np.append(at, len(codes))), np.zeros(256, np.int64)])
    probability = 10 ** solved(keys, n)[np.searchsorted(keys, wanted)]
    assert probability.sum() == pytest.approx(1)
    assert probability.argmax() in (ord("c"), ord("b"), 255)


class PlainTree:
    """Context-tree weighting as the docstring has it, with dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children, self.known = depth, collections.Counter(), collections.defaultdict(set), {}
        for text in texts:
            for context, byte in self.grams(text):
                for node, bit in self.decisions(byte):
                    for d in range(depth + 1):
                        self.counts[context[:d], node, bit] += 1
                        if d < depth:
                            self.children[context[:d], node].add(context[: d + 1])

    def grams(self, text):
        stream = b"\xfe" * self.depth + text.encode() + b"\xff"
        for k in range(self.depth, len(stream)):
            yield stream[k - self.depth : k][::-1], stream[k]  # the nearest byte first

    def decisions(self, byte):
        for k in range(8):
            yield 1 << k | byte >> (8 - k), byte >> (7 - k) & 1

    def both(self, context, node):
        return self.counts[context, node, 0], self.counts[context, node, 1]

    def estimate(self, context, node):
        zeros, ones = self.both(context, node)
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def weighted(self, context, node):
        if (context, node) not in self.known:
            own = self.estimate(context, node)
            if len(context) < self.depth:
                own = np.logaddexp(own, sum(self.weighted(c, node) for c in self.children[context, node])) - math.log(2)
            self.known[context, node] = own
        return self.known[context, node]

    def score(self, text):
        total = 0.0
        for context, byte in self.grams(text):
            for node, bit in self.decisions(byte):
                one, rest = 0.0, 1.0
                for d in range(self.depth + 1):
                    zeros, ones = self.both(context[:d], node)
                    stop = 1.0 if d == self.depth else math.exp(self.estimate(context[:d], node) - math.log(2) - self.weighted(context[:d], node))
                    one += rest * stop * (ones + 0.5) / (zeros + ones + 1)
                    rest *= 1 - stop
                total += math.log10(one if bit else 1 - one)
        return total


@pytest.mark.parametrize("group,fan", [(1_000_000, 64), (150, 2)])
def test_scores_equal_a_plain_tree(spark, monkeypatch, group, fan):
    monkeypatch.setattr(context_tree, "GROUP", group)  # the second time: pairs split by a third byte, and lists added up in turns
    monkeypatch.setattr(context_tree, "FAN", fan)
    texts = ["the cat sat on the mat", "the dog sat", None, "", "the cat and the dog and the cat", "üñ ünder the mat", "zzz", "other things that the dog thought", "a" * 300] * 2
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tree = PlainTree([t or "" for i, t in rows if not held(i)], context_tree.DEPTH)
    got = context_tree.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((repr(r.doc_id), round(r.score, 3)) for r in got) == sorted((repr(i), round(tree.score(t or ""), 3)) for i, t in rows)
    assert sum(r.held_out for r in got) == sum(held(i) for i, _ in rows) > 0


def test_no_training_text(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = context_tree.score(spark.createDataFrame([(i, "ab c") for i in held], "doc_id long, text string")).collect()
    assert all(r.score == pytest.approx(-5 * 8 * math.log10(2)) and r.train_tokens == r.n_known == 0 and r.base_score == 0 for r in rows)


def test_far_contexts(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(f"{'ab'[b]}....{'xy'[b]}" for b in rng.integers(0, 2, 200)) for _ in range(40)]
    rows = context_tree.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    # x or y follows from the byte five before it; without that it costs a bit in six bytes besides the bit of a or b
    assert max(r.bits_per_byte for r in rows if r.held_out) < 0.25


def test_log_gamma():
    n = np.array([0, 1, 2, 7, 4095, 4096, 10**6, 10**9])
    for more in (0.5, 1.0):
        assert np.allclose(context_tree.log_gamma(n, more), [math.lgamma(v + more) for v in n.tolist()], rtol=1e-12, atol=1e-12)


def test_score(docs, texts, empty):
    rows = context_tree.score(docs).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\0END"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in texts if not held(i) for w in tokens(t))
    total = sum(counts.values())
    want = sorted((repr(i), held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), total, round(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens(t)), 6)) for i, t in texts)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    assert context_tree.score(empty).count() == 0


def test_word_hashes():
    texts = pa.array(["The cat", None, "the  CAT\tthe", "", " ", "ß ẞ"])
    from gleaner.llm.shared import text_buffer

    hashes, begins = words.word_hashes(*text_buffer(texts))
    assert begins.tolist() == [0, 2, 2, 5, 5, 5, 7]
    assert hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 4
    assert words.word_hashes(*text_buffer(pa.array([], pa.string())))[0].size == 0


def test_signs_are_no_letters(spark):
    rows = [(i, "abc def ghi " * 9, "aa") for i in range(40)] + [(50, "² ½ 3 !", "aa"), (51, "² ½ é", "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in language_id.identify(frame, language_id.fit(frame)).collect()}
    assert out[50] == "und" and out[51] == "aa"


def test_language_sample_is_bounded(spark):
    rows = [(i, f"text {i} of it", ("aa", "bb", "cc")[min(i % 5, 2)]) for i in range(600)] + [(1, "the same", "bb")] * 50
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    import collections

    got = collections.Counter(r.lang for r in language_id._sample(frame, 4, 2, 30, 2).collect())
    assert got == {"cc": 30, "bb": 30}


def test_language(spark, docs, empty):
    import random

    rng = random.Random(3)
    sound = {"aa": "kolira muta senda", "bb": "xyzzy qwrt plgh", "cc": "été où ça"}
    rows = []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        stock = sound[lang].split()
        rows.append((i, " ".join("".join(rng.choices(rng.choice(stock), k=4)) for _ in range(40)), lang))
    frame = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !?", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    out = {r.doc_id: r for r in language_id.identify(frame, model).collect()}
    held = [i for i, _, _ in rows if out[i].held_out]
    assert len(held) > 30 and sum(out[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    assert all(out[i].lang_pred == "und" and out[i].rejected and out[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in out.values())
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    kept = language_id.accepted(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i in out if not out[i].rejected}
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"} and language_id.identify(empty, model).count() == 0
    assert language_id.identify(docs, model).count() == docs.count()
