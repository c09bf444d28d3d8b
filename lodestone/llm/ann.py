"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` tables hashes a unit vector by ``hashes`` Gaussian projections,
shifted and cut into slots of width ``width``.  A query visits its own bucket and
then perturbed buckets in the order of their estimated success, which the squared
distances to the slots' borders give.  Candidates of a bucket are ranked by the
exact cosine (double precision, original vectors) in one matrix product; each
bucket passes on its ``k`` best, and the tables' lists are merged.

Equal vectors are indexed once, with their ``k + 1`` smallest ids, which is all
that a list of k with ties to smaller ids can use; a third of all rows being one
vector makes one index entry.  A table's buckets are dealt into parts; a bucket of
more than ``PART_ROWS`` vectors is spread over several, and its queries visit all.
Queries that found too few are run once more against every part.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, nor does a null vec_id; vectors are compared with those of their own
length; a row repeated as a whole counts once; with k candidates or fewer, all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, maybe_broadcast, table, tidied

TABLES = 16
HASHES = 6
WIDTH = 1.5
PROBES = 48
SEED = 20240917
#: Vectors that one part of a table holds, about.
PART_ROWS = 20_000
#: How far the scores of a matrix product may be from those of single pairs.
CUT = 1e-12


def projections(dim: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(tables, dim, hashes)), rng.uniform(0, width, (tables, hashes))


def probe_sequence(fraction: np.ndarray, probes: int) -> np.ndarray:
    """Slot changes in the order of estimated success; the first is none.
    ``fraction``: the query's place within its slots, 0 to 1."""
    m = len(fraction)
    moves = sorted([(fraction[i] ** 2, i, -1) for i in range(m)] + [((1 - fraction[i]) ** 2, i, 1) for i in range(m)])
    cost = [x[0] for x in moves]
    out, heap = [np.zeros(m, np.int64)], [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        change = np.zeros(m, np.int64)
        valid = True
        for j in chosen:
            valid &= change[moves[j][1]] == 0
            change[moves[j][1]] = moves[j][2]
        if valid:
            out.append(change)
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return np.array(out)


def _key(slots: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row of slot numbers."""
    acc = np.full(slots.shape[:-1], 0x1234567, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(slots.shape[-1]):
            acc = (acc ^ slots[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
    return acc.view(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def _hasher(a: np.ndarray, b: np.ndarray, width: float, probes: int):
    """Task function: one row a table (and probe), with the bucket's key."""
    tables, dim, _ = a.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                v = _matrix(part.column("vec"), dim)
                v /= np.linalg.norm(v, axis=1)[:, None]
                for t in range(tables):
                    y = (v @ a[t] + b[t]) / width
                    slots = np.floor(y).astype(np.int64)
                    if probes:
                        keys = [_key(s + probe_sequence(f, probes)) for s, f in zip(slots, y - slots, strict=True)]
                        pick = np.repeat(np.arange(len(v)), [len(k) for k in keys])
                        keys = np.concatenate(keys)
                    else:
                        keys, pick = _key(slots), np.arange(len(v))
                    cols = [part.column(c).take(pa.array(pick)) for c in part.schema.names]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(keys), t), pa.int32()), pa.array(keys)], names=[*part.schema.names, "table", "bucket"])

    return run


def _rank(k: int, dim: int):
    """Group function: each query's k best among the vectors of its buckets here."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        v = _matrix(right.column("vec").combine_chunks(), dim)
        norm = np.linalg.norm(v, axis=1)
        reps, bucket = right.column("rep").to_numpy(), right.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        v, norm, reps, bucket = v[order], norm[order], reps[order], bucket[order]
        asks, want, everything = left.column("query").to_numpy(), left.column("bucket").to_numpy(), left.column("everything").to_numpy()
        q = _matrix(left.column("vec").combine_chunks(), dim)
        q_norm = np.linalg.norm(q, axis=1)
        want = np.where(everything, 0, want)
        out = []
        by = np.lexsort((want, everything))
        cuts = np.flatnonzero((np.diff(want[by]) != 0) | (np.diff(everything[by].astype(int)) != 0)) + 1
        for rows in np.split(by, cuts):
            if everything[rows[0]]:
                a, b = 0, len(reps)
            else:
                a, b = np.searchsorted(bucket, want[rows[0]], "left"), np.searchsorted(bucket, want[rows[0]], "right")
            if a == b:
                continue
            for s in range(0, len(rows), 256):
                some = rows[s : s + 256]
                score = (q[some] @ v[a:b].T) / (q_norm[some][:, None] * norm[None, a:b])
                least = np.partition(score, -k, axis=1)[:, -k] if b - a > k else np.full(len(some), -np.inf)
                # A matrix product's last bits depend on its shape: those near the cut stay,
                # and each pair is scored by itself.
                r, c = np.nonzero(score >= least[:, None] - CUT)
                exact = np.einsum("ij,ij->i", q[some][r], v[a:b][c]) / (q_norm[some][r] * norm[a:b][c])
                out.append((asks[some][r], reps[a:b][c], exact))
        if not out:
            return empty
        return pa.table({"query": np.concatenate([x[0] for x in out]), "rep": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})

    return run


def nearest(vectors: DataFrame, queries: Column, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which
    ``queries`` (a column over ``vec_id``) holds, its own id left out."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vec")).filter("vec_id IS NOT NULL AND vec IS NOT NULL")
    good = "NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(vec, x -> x <> 0)"
    base = base.filter(F.expr(good))
    kind = base.schema["vec"].dataType.simpleString()
    # Vectors meet those of their own length; lengths without a query need no search.
    sizes = base.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.count_if(queries).alias("asked")).filter("asked > 0").orderBy("dim").collect()  # a row a length
    out = None
    for r in sizes:
        one = _nearest_of_length(base.filter(F.size("vec") == r["dim"]), queries, r["dim"], r["n"], kind, k=k, tables=tables, hashes=hashes, width=width, probes=probes, seed=seed)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest_of_length(base: DataFrame, queries: Column, dim: int, rows: int, kind: str, *, k: int, tables: int, hashes: int, width: float, probes: int, seed: int) -> DataFrame:
    # Equal vectors: the k + 1 smallest ids, cut before the shuffle by a group limit.
    first = Window.partitionBy("vec").orderBy("vec_id")
    ranked = base.select("vec_id", "vec", F.dense_rank().over(first).alias("n")).filter(F.col("n") <= k + 1)
    entries = ranked.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vec")
    entries = materialize(entries, "ann-entries")
    # An id given to several vectors: entries are told apart by their own number.
    asked = base.filter(queries).distinct().select(F.col("vec_id").alias("query"), "vec")
    a, b = projections(dim, tables, hashes, width, seed)
    parts = max(8, -(-rows // PART_ROWS))
    index = entries.select("rep", "vec").mapInArrow(tidied(_hasher(a, b, width, 0)), f"rep long, vec {kind}, table int, bucket long")
    probe = asked.mapInArrow(tidied(_hasher(a, b, width, probes)), f"query long, vec {kind}, table int, bucket long")
    spread = index.groupBy("table", "bucket").count().filter(F.col("count") > PART_ROWS).select("table", "bucket", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("salts"))
    spread = maybe_broadcast(materialize(spread, "ann-hot-buckets"))
    part = F.pmod(F.col("bucket") + F.col("salt"), F.lit(parts)).cast("int").alias("part")
    salts = F.coalesce("salts", F.lit(1))
    index = index.join(spread, ["table", "bucket"], "left").withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("long"))
    index = index.select("rep", "vec", "table", "bucket", part)
    probe = probe.join(spread, ["table", "bucket"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long"))))
    probe = probe.select("query", "vec", "table", "bucket", F.lit(False).alias("everything"), part).dropDuplicates(["query", "vec", "table", "bucket", "part"])
    rank = _rank(k + 1, dim)
    found = probe.groupBy("table", "part").cogroup(index.groupBy("table", "part")).applyInArrow(rank, "query long, rep long, score double")
    found = materialize(found.groupBy("query", "rep").agg(F.max("score").alias("score")), "ann-found")

    def lists(found: DataFrame) -> DataFrame:
        # Ids of equal vectors come back; each query keeps its k best.
        near = found.join(entries.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query")
        near = near.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = materialize(lists(found), "ann-lists")
    others = base.select("vec_id").distinct().limit(k + 1).count() - 1
    have = near.groupBy("query").count().filter(F.col("count") >= min(k, others)).select("query")
    few = materialize(asked.join(have, "query", "left_anti"), "ann-few")
    if others > 0 and not few.isEmpty():
        again = few.select("query", "vec", F.lit(0).alias("table"), F.lit(0).cast("long").alias("bucket"), F.lit(True).alias("everything"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        more = again.groupBy("table", "part").cogroup(index.filter("table = 0").groupBy("table", "part")).applyInArrow(rank, "query long, rep long, score double")
        near = near.join(few.select("query").distinct(), "query", "left_anti").unionByName(lists(more.groupBy("query", "rep").agg(F.max("score").alias("score"))).select(*near.columns))
    return near.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every row whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
