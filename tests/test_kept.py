"""Name join, kept centroids, caches, timed batches, image store, and the text rules that fold over characters or lines."""

import collections
import hashlib
import html
import json
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import stem
from gleaner.functions import text as T
from gleaner.operators import centroids, names, tables, vectors
from gleaner.plans import catalog
from gleaner.sources import exchange, files
from gleaner.sources import logical as L
from gleaner.streaming import batches, cache


def alike(a, b):
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    if a in b or b in a:
        return min(len(a), len(b)) / max(len(a), len(b))
    x, y = set(a), set(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("floor", [0.6, 0.8, 0.85])
def test_similar_names_against_all_pairs(spark, floor):
    rng = random.Random(3)
    parts = ["data", "Base", "note", "notes", "code", "python", "Commands", "ab", "abab", "s", "ß", "😀x"]
    make = lambda: " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    there = sorted({make() for _ in range(120)} | {"abc", "bca", "cabcab", "ABC", ""})
    asked = sorted({make() for _ in range(150)} | {"cba", "abc", "acb", "bcabc", "", "Abc", "zq"})
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None]], "name string")
    want = {}
    for a in asked:
        best = min(((-alike(a, c), c) for c in there), default=None)
        if -best[0] > floor:
            want[a] = (best[1], pytest.approx(-best[0]))
    got = {r.name: (r.category, r.score) for r in names.similar_names(frame(there), frame(asked), floor).collect()}
    assert got == want


def test_similar_names_of_one_set_of_letters(spark):
    """Many names of the same letters: work follows the names, not their pairs."""
    rng = random.Random(1)
    letters = list("abcdefgh")
    make = lambda n: sorted({"".join(rng.sample(letters, 8)) for _ in range(n)})
    there, asked = make(3000), make(3000)
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    got = {r.name: r.category for r in names.similar_names(frame(there), frame(asked)).collect()}
    assert got == dict.fromkeys(asked, there[0])


def test_centroids_follow_changes(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "snippet_id long, embedding array<float>")
    schema = "snippet_id long, category_id long, assigned_at int"
    now = {i: (i % 5, i) for i in range(50)} | {90: (1, 3)}  # 90 has no vector
    frame = lambda d: spark.createDataFrame([(i, c, t) for i, (c, t) in d.items()], schema)
    for members in (100, 11):
        own = dict(now)
        state = centroids.centroid_sums(rows, frame(own), members)
        changes = [(51, None, 2), (52, None, 9), (5, 0, 3), (10, 0, 0), (90, 1, 4), (0, 0, None), (7, 2, None)] + [(i, 4, None) for i in range(4, 50, 5)]
        for i, _, new in changes:
            own.pop(i, None)
            if new is not None:
                own[i] = (new, i)
        state = centroids.changed_sums(state, spark.createDataFrame(changes, "snippet_id long, old_category long, new_category long"), rows, frame(own), members)
        as_rows = lambda d: {r.category_id: (r.n, pytest.approx(r.centroid)) for r in d.collect()}
        assert {r.category_id: (r.n, r.centroid) for r in centroids.centroids_of(state).collect()} == as_rows(vectors.centroids(rows, frame(own), members))
        assert {r.category_id: r.assigned for r in state.collect()} == collections.Counter(c for c, _ in own.values())


def lookups(seed, n=600):
    rng = random.Random(seed)
    at = 0
    for i in range(n):
        at += rng.choice([0, 1, 5, 400])
        yield (rng.choice(["a", "a", "a", "b", None]), f" Query {rng.randrange(9)} ", at, i)


def simulate(rows, capacity, seconds):
    caches, out = collections.defaultdict(list), {}
    for owner, query, at, i in sorted(rows, key=lambda r: (r[2], r[3])):
        own, key = caches[owner], " ".join(query.lower().split())
        there = next((e for e in own if e[0] == key), None)
        if there and at - there[1] < seconds:
            own.remove(there)
            own.append(there)
            out[i] = ("hit", None)
            continue
        if there:
            own.remove(there)
        gone = own.pop(0)[0] if len(own) >= capacity else None
        own.append((key, at))
        out[i] = ("expired" if there else "miss", gone)
    return out


@pytest.mark.parametrize("capacity,seconds", [(4, 900), (1, 10), (50, 3600)])
def test_cache_against_a_simulation(spark, capacity, seconds):
    rows = list(lookups(capacity))
    frame = spark.createDataFrame(rows, "user string, query string, s long, seq long").select("user", "query", F.timestamp_seconds("s").alias("ts"), "seq").repartition(3)
    got = {r.seq: (r.outcome, r.evicted) for r in cache.cached_lookups(frame, "user", capacity, seconds).collect()}
    assert got == simulate(rows, capacity, seconds)
    assert {"hit", "miss", "expired"} <= {o for o, _ in got.values()}


def test_cache_in_a_stream(spark, tmp_path):
    rows = list(lookups(5, 240))
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        part = [json.dumps({"user": u, "query": q, "s": s, "seq": i}) for u, q, s, i in rows[80 * k : 80 * (k + 1)]]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(part))
        time.sleep(0.05)  # files are taken in the order of their times
    read = spark.readStream.schema("user string, query string, s long, seq long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    found = cache.stream_lookups(read.select("user", "query", F.timestamp_seconds("s").alias("ts"), "seq"), "user", 4, 900)
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r.seq: (r.outcome, r.evicted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == simulate(rows, 4, 900)


def test_batches_survive_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = {}

    def sink(batch, _):
        for r in batch.collect():
            seen[r.queue, r.number] = (r.jobs, r.full)

    def jobs(name, ids):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"id": i, "priority": i % 3}) for i in ids))

    def start(wait_ms):
        read = spark.readStream.schema("id long, priority int").json(str(tmp_path / "in"))
        return batches.run_batches(batches.batched_jobs(read, 10, wait_ms, 2), str(tmp_path / "c"), sink)

    def until(condition, query):
        end = time.time() + 60
        while not condition() and time.time() < end:
            assert query.exception() is None
            time.sleep(0.2)
        assert condition()

    jobs("1.json", range(47))
    query = start(10**9)  # nothing goes out by time
    until(lambda: sum(len(j) for j, _ in seen.values()) >= 30, query)
    query.stop()
    assert all(full and len(j) == 10 for j, full in seen.values())
    before = dict(seen)
    jobs("2.json", range(47, 60))
    query = start(100)
    until(lambda: sum(len(j) for j, _ in seen.values()) >= 60, query)
    query.stop()
    assert {k: seen[k] for k in before} == before
    assert sorted(i for j, _ in seen.values() for i in j) == list(range(60))  # none lost, none twice
    assert any(not full for _, full in seen.values())


def test_image_store_is_idempotent(spark, tmp_path):
    source, store = tmp_path / "shots", tmp_path / "store"
    source.mkdir()
    for name, content in (("a.png", b"one"), ("b.PNG", b"two"), ("copy.png", b"one"), ("c.txt", b"no")):
        (source / name).write_bytes(content)
    for address in (str(store), f"file://{store}"):
        got = files.store_images(files.images(spark, str(source)), address).collect()
        assert len(got) == 2
        assert sorted(p.name for p in store.iterdir()) == sorted(f"{hashlib.sha256(c).hexdigest()}.png" for c in (b"one", b"two"))
        for r in got:
            assert hashlib.sha256(open(r.file_path.removeprefix("file://"), "rb").read()).hexdigest() == r.content_hash


def finished(stream, tmp_path, name):
    """The rows of a stream over the files that are there."""
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start().awaitTermination()
    return out


def test_log_and_image_streams_equal_their_batches(spark, tmp_path):
    logs, shots = tmp_path / "logs", tmp_path / "pictures"
    logs.mkdir()
    shots.mkdir()
    for k in range(3):
        (logs / f"{k}.log").write_text(f"170000000{k}|CMD_START|/w|echo a|b {k}\nshort|line\nx|CMD_END|/w|{k}\n")
        (shots / f"{k}.png").write_bytes(bytes([k] * 9))
    columns = ["session", "ts", "event", "cwd", "data"]
    want = sorted(map(tuple, files.parse_log(files.read_log(spark, str(logs))).select(columns).collect()))
    out = finished(files.parse_log(files.stream_log(spark, str(logs), 1)).select(columns), tmp_path, "log")
    assert len(want) == 6 and sorted(map(tuple, spark.read.parquet(f"{out}/rows").select(columns).collect())) == want
    assert {r[4] for r in want} == {"echo a|b 0", "echo a|b 1", "echo a|b 2", "0", "1", "2"} and sum(r[1].timestamp() == 0 for r in want) == 3
    named = ["content_hash", "managed_name"]
    want = sorted(map(tuple, files.images(spark, str(shots)).select(named).collect()))
    out = finished(files.stream_images(spark, str(shots), 1).select(named), tmp_path, "image")
    assert len(want) == 3 and sorted(map(tuple, spark.read.parquet(f"{out}/rows").select(named).collect())) == want


def test_whole_document_is_read(spark, tmp_path):
    document = {"version": "1.0", "exported_at": "x", "snippets": [{"id": 1, "content": "c", "summary": "s", "created_at": "2024-01-01T00:00:00", "source_app": "a", "category_id": 4, "versions": [{"version_number": 1, "content": "old"}]}, {"id": 2, "content": "d"}], "categories": [{"id": 4, "name": "K", "parent_id": None}]}
    (tmp_path / "export.json").write_text(json.dumps(document, indent=2))
    rows, categories = exchange.read_document(spark, f"{tmp_path}/export.json")
    assert [(r.id, r.content, r.category_id, r.versions and [tuple(v) for v in r.versions]) for r in rows.orderBy("id").collect()] == [(1, "c", 4, [(1, "old")]), (2, "d", None, None)]
    assert [tuple(r) for r in categories.collect()] == [(4, "K", None)]


@pytest.fixture(scope="module")
def of(spark):
    """The values of an expression over rows."""
    return lambda f, xs: [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_brackets(of):
    got = of(T.split_screenshot, ["[Caption: a [b] c] [Text: d ] [e]", "[Caption: x] [y] [Text: [[z]]]", "[Text: open [", "[Caption:  ] [Text: t]", "none", "", None, "pre [Caption: one] [Caption: two]"])
    assert [(r.caption, r.text) for r in got] == [("a [b] c", "d"), ("x", "[[z]]"), (None, None), (None, "t"), (None, None), (None, None), (None, None), ("one", None)]


def test_broken_answers(of):
    answers = {
        '{"action": "use_existing", "category_name": "Docs", "confidence": 0.8}': ("use_existing", "Docs", 0.8),
        'Here: {"action": "create_new", "name": "Docs", "confidence": 7,} bye': ("create_new", "Docs", 1.0),
        '"action": "create_new", "name": "Docs", "confidence": 0.9} and so on': ("create_new", "Docs", 0.9),
        '{"action": "create_new",\n "name": "My\nDocs", "tags": ["a", "b",], "confidence": 0.5}': ("create_new", "My Docs", 0.5),
        '{"category": "🚀 Launch Plans"}': ("create_new", "Launch Plans", 0.75),
        '{"category_name": "Notes"}': ("create_new", "Notes", 0.75),
        '{"action": "create_new", "name": "with } and , inside", "confidence": "0.25"}': ("create_new", "with } and , inside", 0.25),
        '{"action": "create_new", "name": ""}': (None, None, None), "no object": (None, None, None), '{"action": broken}': (None, None, None), "": (None, None, None),
    }
    assert [tuple(r) for r in of(T.parse_decision, list(answers))] == list(answers.values())
    assert of(T.repaired_json, ['{"a": 1,}', '{"a": [1,]}', '{"a": "x"}', None]) == ['{"a": 1}', '{"a": [1]}', '{"a": "x"}', None]


def test_whitespace_and_code(of):
    got = of(T.clean_whitespace, [
        "Line 1  \n\n\n\n  Line   2   \n  Line 3",
        "see:\n    if  x:\n      go  on\n  still  in\nout  of   it",
        "\tone  two\n\n  kept  too\nnow   plain", "  $ ls   -la\n  const  x = 1", "\n\n  a  b", "", None,
    ])
    assert got == [
        "Line 1\n\nLine 2\nLine 3", "see:\n    if  x:\n      go  on\n  still  in\nout of it",
        "one  two\n\n  kept  too\nnow plain", "$ ls -la\n  const  x = 1", "a b", "", None,
    ]


def test_app_folders(spark):
    there = spark.createDataFrame([(3, "Cursor", None, True, "Cursor"), (9, "Notes", None, False, None)], "id long, name string, parent_id long, is_app_folder boolean, app_name string")
    apps = spark.createDataFrame([(" Cursor ",), ("Notes",), ("Notes",), (" ",), (None,), ("Zed",)], "source_app string")
    got = tables.app_folders(there, apps, F.expr("timestamp_ntz '2024-01-01 00:00:00'"))
    assert sorted((r.id, r.name, r.app_name, r.emoji) for r in got.where("is_app_folder").collect()) == [(3, "Cursor", "Cursor", None), (10, "Notes", "Notes", "📝"), (11, "Zed", "Zed", "📱")]
    assert got.count() == 4


# queries that have no SQL twin, over the driver's smallest tables, against plain Python

DATA = "/root/testdata/sf0.001"
with_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")


@with_data
def test_stemmed_index_by_counting(spark):
    accents = str.maketrans(stem._ACCENTED, stem._PLAIN)
    words, rows = collections.Counter(), collections.defaultdict(set)
    for r in L.snippets(spark, DATA).select("id", "content", "summary").collect():
        for text in (r.content, r.summary):
            for w in re.findall(r"[^\W_]+", (text or "").lower().translate(accents)):
                words[stem.porter(w)] += 1
                rows[stem.porter(w)].add(r.id)
    got = {r.term: (r.n, r.df) for r in catalog.queries()["index_stemmed"](spark, DATA).collect()}
    assert got == {w: (n, len(rows[w])) for w, n in words.items()}


@with_data
def test_highlights_mark_all_and_only_matches(spark):
    texts = {r.id: r.content for r in L.snippets(spark, DATA).select("id", "content").collect()}
    marks = 0
    for r in catalog.queries()["highlight"](spark, DATA).collect():
        plain = html.unescape(re.sub(r"</?mark>", "", r.html))
        assert plain.removeprefix("...").removesuffix("...") in texts[r.id]
        marked = "".join(f"\x00{html.unescape(x)}\x01" if i % 2 else html.unescape(x) for i, x in enumerate(re.split(r"</?mark>", r.html)))
        for part in re.split("\x00.*?\x01", marked, flags=re.S):
            assert not re.search("thing|of the", part.lower())
        for m in re.findall("\x00(.*?)\x01", marked, re.S):
            assert re.fullmatch("(thing|of the)+", m.lower())
            marks += 1
    assert marks


@with_data
def test_nested_export_by_hand(spark):
    versions = collections.defaultdict(list)
    for r in L.versions(spark, DATA).collect():
        versions[r.snippet_id].append((r.version_number, r.content))
    categories = {r.id for r in L.categories(spark, DATA).collect()}
    own = {r.snippet_id: r.category_id for r in L.assignments(spark, DATA).collect() if r.category_id in categories}
    want = {r.id: (r.content, r.summary, r.created_at.isoformat(), r.source_app, own.get(r.id), sorted(versions[r.id])) for r in L.snippets(spark, DATA).collect()}
    got = {r.id: (r.content, r.summary, r.created_at, r.source_app, r.category_id, [tuple(v) for v in r.versions]) for r in catalog.queries()["export_nested"](spark, DATA).collect()}
    assert got == want


@with_data
def test_query_cache_by_simulation(spark):
    rows = [(r.user_id, f"{r.event_type}{json.loads(r.props)['k']}", r.ts.timestamp(), r.event_id) for r in L.read(spark, DATA, "events").collect()]
    got = {r.seq: (r.outcome, r.evicted) for r in catalog.queries()["query_cache"](spark, DATA).collect()}
    assert got == simulate(rows, 3, 12 * 3600)
