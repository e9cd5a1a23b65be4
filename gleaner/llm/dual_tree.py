"""Operator 12: Lloyd's centroid clustering with two trees.

Vectors are scaled to integers, so sums, means and distances are exact and the same
however rows are dealt. Each block of ``BLOCK`` vectors gets a cover tree once: a node
is a ball around one of its vectors, its children are balls of the next smaller radius
whose centres are farther apart than that. The trees are written as a table and read
in every round. A round builds a cover tree over the centroids and walks both trees
together: a pair of nodes is dropped where its distance less both radii is over what
another centroid surely offers; a node of vectors left with one centroid goes to it
whole; pairs of leaves are compared exactly. No vector moves between machines: each
task passes on at most k sums.

The driver holds k centroids of ``size`` integers and nothing that grows with the table.

Defined results: vectors of another size, null ones, and ones with null or non-finite
components are left out. Scaled components beyond 2**26 count as 2**26, so that
distances fit a long; sums of distances too large for a long are null. Repeated rows
are clustered row by row and equal vectors compared once a block; a null vec_id counts
as an empty text in the hash; rows of one hash start in order of their components.
With fewer than k vectors all of them start; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import prepare, written

#: Vectors to a tree; points of a leaf; ratio of a node's radius to its children's.
BLOCK, LEAF, RATIO = 512, 8, 1.4
#: Largest scaled component.
MOST = 1 << 26
#: Below this, products of components sum up exactly in doubles.
_EXACT = 1 << 22
#: Bounds are widened by this share, far more than square roots may be off.
_SLACK = 1e-9


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all rows of b."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < _EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)).astype(np.int64)
    return np.array([((b - row) ** 2).sum(1) for row in a], np.int64).reshape(len(a), len(b))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a to those of b, one by one."""
    return ((a - b) ** 2).sum(1)


class CoverTree:
    """Balls over the rows of ``points`` (int64), in the order of a walk: node i has the rows start[i]:stop[i] of order, centre[i] among them, all within radius[i]; its children follow it."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order, self.centre, self.radius, self.start, self.stop, self.children = [], [], [], [], [], []
        if len(points):
            self._grow(points, leaf)
        self.order = np.array(self.order, np.int64)

    def _grow(self, points: np.ndarray, leaf: int) -> None:
        rows = np.arange(len(points))
        work = [(0, rows, np.sqrt(squared(points[:1], points)[0]), -1)]
        while work:
            centre, rows, far, up = work.pop()
            node, most = len(self.centre), float(far.max())
            self.centre.append(centre)
            self.radius.append(most)
            self.start.append(len(self.order))
            self.stop.append(len(self.order) + len(rows))
            self.children.append([])
            if up >= 0:
                self.children[up].append(node)
            if len(rows) <= leaf or most == 0:
                self.order.extend(rows.tolist())
                continue
            parts, at, reach = [], centre, most / RATIO
            while len(rows):  # the centre's own ball first; then a ball around the row farthest from the centre
                near = far <= reach if at == centre else (own := np.sqrt(squared(points[at : at + 1], points[rows])[0])) <= reach
                parts.append((at, rows[near], (far if at == centre else own)[near], node))
                rows, far = rows[~near], far[~near]
                at = int(rows[far.argmax()]) if len(rows) else at
            work += parts[::-1]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.centre, np.int64), np.array(self.radius, np.float64), np.array(self.start, np.int64), np.array(self.stop, np.int64)


def _expand(which: np.ndarray, children: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each node its children, and the place in which of each."""
    found = [children[i] for i in which]
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), np.repeat(np.arange(len(which)), [len(x) for x in found])


def assign(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> tuple[np.ndarray, int]:
    """The nearest centroid (the smaller number on ties) of each point, and the number of distances computed."""
    centre, radius, start, stop = tree.arrays()
    c_centre, c_radius, c_start, c_stop = over.arrays()
    smallest = np.array([over.order[a:b].min() for a, b in zip(c_start, c_stop, strict=True)])
    kids, c_kids = ([np.array(x, np.int64) for x in t.children] for t in (tree, over))
    c_inner = np.array([len(x) > 0 for x in c_kids])
    inner = np.array([len(x) > 0 for x in kids])
    own = np.full(len(points), -1, np.int64)
    vs, cs = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes, all pairs of a node of vectors side by side
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    computed = 0
    while len(vs):
        apart = np.sqrt(paired(points[centre[vs]], centroids[c_centre[cs]]))
        computed += len(vs)
        low, high = apart - radius[vs] - c_radius[cs], apart + radius[vs]
        begins = np.flatnonzero(np.r_[True, vs[1:] != vs[:-1]])
        group = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(vs)]))
        best = np.minimum.reduceat(high, begins)[group]
        stay = low * (1 - _SLACK) <= best * (1 + _SLACK) + _SLACK
        vs, cs, group = vs[stay], cs[stay], group[stay]
        n = np.bincount(group, minlength=len(begins))[group]
        open_c = c_inner[cs]
        alone = (n == 1) & ~open_c
        for v, c in zip(vs[alone], cs[alone], strict=True):
            own[tree.order[start[v] : stop[v]]] = smallest[c]
        vs, cs, group, open_c = vs[~alone], cs[~alone], group[~alone], open_c[~alone]
        # the larger ball is opened: centroids' where one of them is as large as the vectors' or those can't be opened
        turn = open_c & ((c_radius[cs] >= radius[vs]) | ~inner[vs])
        opened = np.bincount(group[turn], minlength=len(begins))[group] > 0
        done = ~opened & ~inner[vs]  # only leaves are left: open_c is false here
        if done.any():
            leaves.append((vs[done], cs[done]))
        down, at = _expand(cs[turn], c_kids)
        by_c = (np.r_[vs[opened & ~turn], vs[turn][at]], np.r_[cs[opened & ~turn], down])
        rest = ~opened & ~done
        down, at = _expand(vs[rest], kids)
        vs, cs = np.r_[by_c[0], down], np.r_[by_c[1], cs[rest][at]]
        by = np.argsort(vs, kind="stable")
        vs, cs = vs[by], cs[by]
    for v, c in leaves:
        # rows of the leaves by the centroids of theirs
        count = stop[v] - start[v]
        pair = np.repeat(np.arange(len(v)), count)
        row = tree.order[np.repeat(start[v] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(pair))]
        number = smallest[c][pair]
        apart = paired(points[row], centroids[number])
        computed += len(row)
        by = np.lexsort((number, apart, row))
        first = by[np.r_[True, row[by][1:] != row[by][:-1]]]
        own[row[first]] = number[first]
    return own, computed


def kept(embeddings: DataFrame, size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v, the scaled integers, of whole finite vectors."""
    v = F.col("embedding").cast("array<double>")
    whole = (F.size("embedding") == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x * scale)))))
    return embeddings.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, bounded).cast("array<int>").alias("v"))


_FOREST = "ids array<long>, place array<int>, points binary, times array<int>, order array<int>, centre array<int>, radius array<double>, start array<int>, stop array<int>, parent array<int>"


def forest(vectors: DataFrame, size: int = 64) -> DataFrame:
    """A row for each block of vectors: ids, the place of each among the block's distinct points, the points, how often each stands there, and their tree."""

    def block(ids: list, rows: np.ndarray) -> pa.RecordBatch:
        points, place, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        tree = CoverTree(points.astype(np.int64))
        parent = np.full(len(tree.centre), -1)
        for i, x in enumerate(tree.children):
            parent[x] = i
        values = [ids, place.reshape(-1), points.astype("<i4").tobytes(), times, tree.order, tree.centre, tree.radius, tree.start, tree.stop, parent]
        return pa.RecordBatch.from_pylist([{f.name: v.tolist() if isinstance(v, np.ndarray) else v for f, v in zip(_SCHEMA, values, strict=True)}], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            rows.append(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int32))
            while len(ids) >= BLOCK:
                joined = np.concatenate(rows)
                yield block(ids[:BLOCK], joined[:BLOCK])
                ids, rows = ids[BLOCK:], [joined[BLOCK:]]
        if ids:
            yield block(ids, np.concatenate(rows))

    return vectors.mapInArrow(run, _FOREST)


_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("place", pa.list_(pa.int32())), ("points", pa.binary()), ("times", pa.list_(pa.int32())), ("order", pa.list_(pa.int32())), ("centre", pa.list_(pa.int32())), ("radius", pa.list_(pa.float64())), ("start", pa.list_(pa.int32())), ("stop", pa.list_(pa.int32())), ("parent", pa.list_(pa.int32()))])


def _read(row: dict, size: int) -> tuple[np.ndarray, CoverTree]:
    points = np.frombuffer(row["points"], "<i4").reshape(-1, size).astype(np.int64)
    tree = CoverTree(points[:0])
    tree.order, tree.centre, tree.radius, tree.start, tree.stop = np.array(row["order"], np.int64), row["centre"], row["radius"], row["start"], row["stop"]
    tree.children = [[] for _ in tree.centre]
    for i, p in enumerate(row["parent"]):
        if p >= 0:
            tree.children[p].append(i)
    return points, tree


def lloyd(embeddings: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of each kept vector (a written table), and the final centroids."""
    spark = embeddings.sparkSession
    prepare(spark)
    vectors = kept(embeddings, size, scale)
    by_hash = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = vectors.select("v", by_hash.alias("hash")).orderBy("hash", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in start], np.int64).reshape(-1, size)
    trees = written(forest(vectors, size))
    sums = ", ".join(f"s{i} long" for i in range(size))
    for _ in range(rounds if len(centroids) else 0):

        def run(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            over, total, count = CoverTree(centroids, 1), np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    points, tree = _read(row, size)
                    own, _ = assign(points, tree, centroids, over)
                    times = np.array(row["times"], np.int64)
                    np.add.at(count, own, times)
                    np.add.at(total, own, points * times[:, None])
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), *(pa.array(total[some, j]) for j in range(size))], names=["cluster", "n", *(f"s{j}" for j in range(size))])

        parts = trees.mapInArrow(run, f"cluster long, n long, {sums}")
        centroids = centroids.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(size)]).collect():  # k rows at most
            centroids[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(size)]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = CoverTree(centroids, 1)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                points, tree = _read(row, size)
                own, _ = assign(points, tree, centroids, over)
                apart, place = paired(points, centroids[own]), np.array(row["place"])
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(own[place].astype(np.int32)), pa.array(apart[place])], names=["vec_id", "cluster", "distance"])

    return written(trees.mapInArrow(final, "vec_id long, cluster int, distance long")), centroids


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    assigned, centroids = lloyd(embeddings, k, rounds)
    spark = embeddings.sparkSession
    sums = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    known = [r["cluster_inertia"] for r in sums]
    total = None if None in known or sum(known) >= 1 << 63 else sum(known)
    hashed = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    figures = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total, hashed[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """The same in DuckDB, a component a row, every vector against every centroid."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, unnest(range({size})) AS i, unnest(v) AS x FROM kept)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept ORDER BY 1 LIMIT {k})",
    ]
    for n in range(rounds + 1):
        parts += [
            f"y{n} AS MATERIALIZED (SELECT c, unnest(range({size})) AS i, unnest(v) AS y FROM c{n})",
            f"a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN y{n} USING (i) GROUP BY r, c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)",
        ]
        if n < rounds:
            parts += [
                f"m{n} AS MATERIALIZED (SELECT c, list(CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT) ORDER BY i) AS v FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY c, i) GROUP BY c)",
                f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))",
            ]
    last = f"""SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)"""
    return "WITH " + ",\n".join(parts) + "\n" + last
