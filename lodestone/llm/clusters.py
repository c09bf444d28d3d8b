"""Centroid clustering over integer vectors by filtering kd-trees.

Each partition's vectors are turned into integers and built into kd-trees of at most
``LOT`` vectors, whose nodes hold their count, their exact integer sums and their
bounding box.  The trees are written once; every round reads them and hands the
centroids down level by level: of a node's candidates the one nearest to the box's
middle is compared with each other one at the box corner that favours the other most,
and the other goes only if it is strictly farther even there.  So a tie is never
pruned, and ties go to the smaller number.  A node with one candidate left is assigned
as a whole by its count and sums; a leaf with more is resolved vector by vector.

A task hands on one row of sums for each centroid and tree; Spark adds these up, and
``k * dim`` sums (``CENTROID_CELLS`` at most) reach the driver, never a vector.

Arithmetic is exact: in doubles while no product can leave 2^53, in Python integers
beyond.

Defined results: a null vector, one of another length than ``dim``, and one with a
null or non-finite component take no part; a component beyond +-10^18 after scaling
counts as that; a distance, or a sum of distances, beyond a long is given as the
largest long.  Rows that repeat a vec_id each take part and each have a row; where
their seeds' hashes tie, the smaller vector comes first; a null vec_id takes part and
is a seed only after all others.  Fewer than ``k`` vectors give as many centroids; an
empty table an empty result.  No other columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table, tidied

LOT = 8192
LEAF = 16
#: Largest k * dim, which each task and the driver hold.
CENTROID_CELLS = 4_000_000
#: Cells (nodes x candidates x dimensions) that one step of the filter holds.
STEP_CELLS = 1 << 20
#: Components up to here keep every sum of 2^10 products within 2^53.
SAFE = 1 << 20
FARTHEST = 10**18
LONG_MAX = 2**63 - 1


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64."""
    return np.clip(np.floor(scale * vectors.astype(np.float64)), -float(FARTHEST), float(FARTHEST)).astype(np.int64)


@dataclass
class Tree:
    """Vectors in the order of the leaves; node i has children 2i + 1 and 2i + 2 and
    the vectors first[i] to last[i]."""

    points: np.ndarray
    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @property
    def leaves(self) -> int:
        """Index of the first leaf."""
        return len(self.first) // 2


def build(points: np.ndarray) -> Tree:
    """A balanced kd-tree: each node is halved along its box's widest side."""
    n, dim = points.shape
    depth = 0
    while n > LEAF << depth:
        depth += 1
    nodes = (2 << depth) - 1
    first, last = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    low, high = np.zeros((nodes, dim), np.int64), np.zeros((nodes, dim), np.int64)
    sums = np.zeros((nodes, dim), np.int64 if n * int(np.abs(points).max(initial=0)) < 2**62 else object)
    order, last[0] = np.arange(n), n
    for node in range(nodes):
        a, b = first[node], last[node]
        own = points[order[a:b]]
        if b > a:
            low[node], high[node] = own.min(0), own.max(0)
            sums[node] = own.astype(sums.dtype).sum(0)
        if 2 * node + 2 < nodes:
            half = (b - a) // 2
            if b > a:
                axis = int((high[node].astype(float) - low[node]).argmax())
                order[a:b] = order[a:b][np.argpartition(own[:, axis], half) if half else np.arange(b - a)]
            first[2 * node + 1], last[2 * node + 1] = a, a + half
            first[2 * node + 2], last[2 * node + 2] = a + half, b
    return Tree(points[order], order, first, last, low, high, sums)


def _exact(*arrays: np.ndarray) -> type:
    """The number type in which squared distances of these arrays are exact."""
    dim = arrays[0].shape[1]
    small = all(a.dtype != object and -SAFE <= int(a.min(initial=0)) and int(a.max(initial=0)) <= SAFE for a in arrays)
    return np.float64 if small and dim <= 1024 else object


def keep_candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, able: np.ndarray) -> np.ndarray:
    """``able`` (nodes x centroids) without what another candidate beats strictly in all
    of the node's box."""
    kind = _exact(low, high, centroids)
    middle = (low.astype(float) + high) / 2
    c = centroids.astype(float)
    near = np.where(able, (c * c).sum(1) - 2 * middle @ c.T, np.inf).argmin(1)
    out, step = able.copy(), max(1, STEP_CELLS // max(1, centroids.size))
    other = centroids.astype(kind)
    for at in range(0, len(low), step):
        rows = slice(at, at + step)
        best = other[near[rows]][:, None, :]
        # Twice the corner that favours the other centroid most.
        corner = np.where(other[None] > best, high[rows, None, :], low[rows, None, :]).astype(kind) * 2
        # |z - v|^2 - |best - v|^2 = (z - best)(z + best - 2 v)
        beaten = ((other[None] - best) * (other[None] + best - corner)).sum(2) > 0
        out[rows] &= ~beaten
    return out


def nearest(points: np.ndarray, centroids: np.ndarray, able: np.ndarray | None = None) -> np.ndarray:
    """The nearest centroid of each point (ties: the smaller), among ``able`` ones."""
    kind = _exact(points, centroids)
    out, step = np.zeros(len(points), np.int64), max(1, STEP_CELLS // max(1, centroids.size))
    c = centroids.astype(kind)
    square = (c * c).sum(1)
    for at in range(0, len(points), step):
        gap = square - 2 * (points[at : at + step].astype(kind) @ c.T)
        if able is not None:
            gap = np.where(able[at : at + step], gap, np.inf)
        out[at : at + step] = gap.argmin(1)
    return out


def assign(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster of each point in the tree's order, counts, sums, points that whole nodes
    brought) by the filter."""
    k, n = len(centroids), len(tree.points)
    cluster, counts = np.zeros(n, np.int64), np.zeros(k, np.int64)
    sums = np.zeros((k, tree.points.shape[1]), object)
    nodes, able, by_node = np.zeros(1, np.int64), np.ones((1, k), bool), 0
    while len(nodes):
        able = keep_candidates(tree.low[nodes], tree.high[nodes], centroids, able)
        alone = able.sum(1) == 1
        for node, to in zip(nodes[alone], able[alone].argmax(1), strict=True):
            a, b = tree.first[node], tree.last[node]
            cluster[a:b] = to
            counts[to] += b - a
            sums[to] += tree.sums[node].astype(object)
            by_node += int(b - a)
        open_, left = nodes[~alone], able[~alone]
        leaf = open_ >= tree.leaves
        if leaf.any():
            a, b = tree.first[open_[leaf]], tree.last[open_[leaf]]
            at = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)])
            own = nearest(tree.points[at], centroids, np.repeat(left[leaf], b - a, axis=0))
            cluster[at] = own
            for to in np.unique(own):
                mine = tree.points[at[own == to]]
                counts[to] += len(mine)
                sums[to] += mine.astype(object).sum(0) if _exact(mine) is object else mine.sum(0).astype(object)
        inner = open_[~leaf]
        nodes = np.stack([2 * inner + 1, 2 * inner + 2], 1).ravel()
        able = np.repeat(left[~leaf], 2, axis=0)
        held = tree.last[nodes] > tree.first[nodes]
        nodes, able = nodes[held], able[held]
    return cluster, counts, sums, by_node


def distances(points: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Squared distances to the own centroid, as longs."""
    kind = _exact(points, centroids)
    gap = points.astype(kind) - centroids.astype(kind)[cluster]
    square = (gap * gap).sum(1)
    return square.astype(np.int64) if kind is not object else np.array([min(x, LONG_MAX) for x in square], np.int64)


# -- trees as rows ----------------------------------------------------------------

_TREE = "ids array<bigint>, n int, points binary, first binary, last binary, low binary, high binary, sums binary, wide boolean"


def _packed(ids: np.ndarray, known: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
    tree = build(points)
    wide = tree.sums.dtype == object
    # Sums too large for a long are added up again where the tree is read.
    sums = b"" if wide else tree.sums.tobytes()
    raw = [tree.points.tobytes(), tree.first.tobytes(), tree.last.tobytes(), tree.low.tobytes(), tree.high.tobytes(), sums]
    own = pa.array(ids[tree.order], pa.int64(), mask=~known[tree.order])
    columns = [pa.array([own.to_pylist()], pa.list_(pa.int64())), pa.array([len(ids)], pa.int32()), *[pa.array([x], pa.binary()) for x in raw], pa.array([wide])]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "n", "points", "first", "last", "low", "high", "sums", "wide"])


def _unpacked(row: dict, dim: int) -> Tree:
    def ints(name: str) -> np.ndarray:
        return np.frombuffer(row[name], np.int64)

    points, first, last = ints("points").reshape(-1, dim), ints("first"), ints("last")
    if row["wide"]:
        sums = np.zeros((len(first), dim), object)
        for node in range(len(first)):
            sums[node] = points[first[node] : last[node]].astype(object).sum(0)
    else:
        sums = ints("sums").reshape(-1, dim)
    return Tree(points, np.arange(len(points)), first, last, ints("low").reshape(-1, dim), ints("high").reshape(-1, dim), sums)


def plant(vectors: DataFrame, *, vec_id: str, vector: str, dim: int, scale: int) -> DataFrame:
    """The partitions' vectors as kd-trees, one row a tree, written to the shared folder."""
    v = f"cast(`{vector}` as array<double>)"
    kept = vectors.selectExpr(f"cast(`{vec_id}` as bigint) as id", f"{v} as v").filter(f"size(v) = {dim} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        known: list[np.ndarray] = []
        points: list[np.ndarray] = []
        held = 0
        for batch in batches:
            column = batch.column(0)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            rows = whole(flat.reshape(-1, dim), scale)
            own, there = column.fill_null(0).to_numpy(zero_copy_only=False), ~column.is_null().to_numpy(zero_copy_only=False)
            for at in range(0, len(rows), LOT):
                part = slice(at, at + LOT)
                if held + len(rows[part]) > LOT:
                    yield _packed(np.concatenate(ids), np.concatenate(known), np.concatenate(points))
                    ids, known, points, held = [], [], [], 0
                ids.append(own[part])
                known.append(there[part])
                points.append(rows[part])
                held += len(rows[part])
        if held:
            yield _packed(np.concatenate(ids), np.concatenate(known), np.concatenate(points))

    return materialize(kept.mapInArrow(tidied(run), _TREE), "kd-trees")


def seeds(trees: DataFrame, k: int, dim: int, seed: int) -> np.ndarray:
    """The k vectors of smallest sha256 of ``<seed>:<vec_id>``, in that order.  Each task
    offers its own k at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for batch in batches:
            for row in batch.to_pylist():
                points = np.frombuffer(row["points"], np.int64).reshape(-1, dim)
                hashed = ["g" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in row["ids"]]
                first = sorted(range(len(hashed)), key=lambda i: hashed[i])[:k]
                # All vectors that tie with the last one.
                first += [i for i in range(len(hashed)) if hashed[i] == hashed[first[-1]] and i not in set(first)]
                best = sorted(best + [(hashed[i], points[i].tolist()) for i in first])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([p for _, p in best], pa.list_(pa.int64()))], names=["h", "v"])

    found = trees.select("ids", "points").mapInArrow(tidied(run), "h string, v array<bigint>").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in found], np.int64).reshape(-1, dim)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floored means; an empty one stays."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), object)
        for batch in batches:
            for row in batch.to_pylist():
                _, more, added, _ = assign(_unpacked(row, dim), centroids)
                counts += more
                sums += added
        own = np.flatnonzero(counts)
        text = [[str(x) for x in sums[i]] for i in own]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(counts[own], pa.int64()), pa.array(text, pa.list_(pa.string()))], names=["c", "n", "sums"])

    partial = trees.select("points", "first", "last", "low", "high", "sums", "wide").mapInArrow(tidied(run), "c int, n bigint, sums array<string>")
    counts = partial.groupBy("c").agg(F.sum("n").alias("n"))
    sums = partial.select("c", F.posexplode("sums").alias("d", "x")).groupBy("c", "d").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = [[int(x) for x in c] for c in centroids]
    for r in sums.join(F.broadcast(counts), "c").collect():  # k * dim rows
        out[r["c"]][r["d"]] = int(r["x"]) // r["n"]
    return np.array(out, np.int64).reshape(-1, dim)


def members(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = _unpacked(row, dim)
                cluster, _, _, _ = assign(tree, centroids)
                gap = distances(tree.points, centroids, cluster)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array(gap, pa.int64())], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(tidied(run), "vec_id bigint, cluster int, distance bigint")


def kmeans(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every kept vector, written to the shared folder; the
    final centroids)."""
    if k * dim > CENTROID_CELLS:
        raise ValueError(f"k * dim is {k * dim}, at most {CENTROID_CELLS} fit a task")
    trees = plant(vectors, vec_id=vec_id, vector=vector, dim=dim, scale=scale)
    centroids = seeds(trees, k, dim, seed)
    if not len(centroids):
        return members(trees, np.zeros((1, dim), np.int64)), centroids
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    return materialize(members(trees, centroids), "clusters"), centroids


def op11_kdtree_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256."""
    found, centroids = kmeans(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    # One row a centroid: k at most.
    own = {r["cluster"]: int(r["own"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    total = min(sum(own.values()), LONG_MAX)
    about = [(i, min(own.get(i, 0), LONG_MAX), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    side = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql() -> str:
    floor = "(s - ((s % n) + n) % n) // n"
    near = "list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))"
    steps = []
    for i in range(4):
        steps.append(f"a{i} AS MATERIALIZED (SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT p.rid, c.cluster, CAST({near} AS BIGINT) AS d FROM p, c{i} c) GROUP BY rid)")
        if i < 3:
            sums = f"SELECT a.cluster, d, sum(p.v[d]) AS s, count(*) AS n FROM a{i} a JOIN p ON p.rid = a.rid, range(1, 65) t(d) GROUP BY ALL"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT cluster, list(CAST({floor} AS BIGINT) ORDER BY d) AS v FROM (SELECT cluster, d, CAST(s AS HUGEINT) AS s, n FROM ({sums})) GROUP BY cluster) m ON m.cluster = c.cluster)")
    return f"""
WITH k AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64
           AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
p AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM k),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v
       FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM p WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)),
{', '.join(steps)},
i AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS own FROM a3 GROUP BY cluster)
SELECT p.vec_id, a.cluster, a.distance, i.own AS cluster_inertia, (SELECT CAST(sum(own) AS BIGINT) FROM i) AS inertia,
       sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 a JOIN p ON p.rid = a.rid JOIN i ON i.cluster = a.cluster JOIN c3 ON c3.cluster = a.cluster
"""


OP11_SQL = _op11_sql()
