"""Exact nearest vectors of a whole query set, by blocks against blocks.

Both sides are packed into blocks of some thousand rows, and every pair of blocks meets
in one matrix product.  What that product leaves within a margin of a query's ``k`` best
is scored again, in the order of the vector expressions in ``functions.vector``, so the
scores are theirs to the last bit.  A task keeps a query's best over all the blocks it
meets, and hands on those alone.  Neither side is broadcast or collected: memory of a
task is bounded by its blocks and its queries' ``k``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of queries and of vectors.
QUERY_ROWS, VECTOR_ROWS = 1024, 4096
#: Vectors and queries of one partition of pairs; fewest partitions of the vectors.
SIDE_VECTORS, SIDE_QUERIES, LEAST_SIDES = 65_536, 4096, 8
#: Scores are rounded to nine places behind the kernel; a rounded tie may differ by this.
MARGIN = 1.1e-9


def _pack(per: int):
    """Task function over (by, id, v): blocks of rows with one ``by`` and one length; of
    length -1 where a vector is null or holds a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            by, ids, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            lacking = pc.list_parent_indices(v).filter(pc.is_null(pc.list_flatten(v))).to_numpy(zero_copy_only=False)
            size[lacking] = -1
            order = np.lexsort((size, by))
            cut = np.flatnonzero((np.diff(by[order]) != 0) | (np.diff(size[order]) != 0)) + 1
            rows = []
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(order)], strict=True):
                for i in range(a, z, per):
                    own = order[i : min(i + per, z)]
                    dim = int(size[own[0]])
                    x = v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes() if dim >= 0 else b""
                    rows.append((int(by[own[0]]), dim, ids[own].astype(np.int64).tobytes(), x))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            for i in range(len(rows)):  # a block a batch: a batch of many would be large
                yield pa.RecordBatch.from_arrays([pa.array([c[i]], t) for c, t in zip(cols, kinds, strict=True)], names=["by", "dim", "ids", "x"])

    return run


def _sum(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added from the first to the last as an expression does."""
    return np.cumsum(x, 1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, queries: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices to keep, each query's k-th best score): all within MARGIN of it, of equal
    scores the ``k`` of smallest ids.  A score that is no number counts as the highest."""
    key = np.where(np.isnan(score), np.inf, score)
    order = np.lexsort((ids, -key, row))
    r, s = row[order], key[order]
    here = np.arange(len(order))
    fresh = np.concatenate([[True], r[1:] != r[:-1]])
    tie = fresh | np.concatenate([[True], s[1:] != s[:-1]])
    since = lambda at: here - np.maximum.accumulate(np.where(at, here, 0))
    place = since(fresh)
    kth = np.full(queries, -np.inf)
    at = place == k - 1
    kth[r[at]] = s[at]
    keep = (since(tie) < k) & ((place < k) | (s >= kth[r] - MARGIN))
    return order[keep], kth


def _scores(k: int, cosine: bool):
    """Task function over pairs of blocks: query_id, id, score of each query's best."""

    def norms(x: np.ndarray) -> np.ndarray:
        return np.sqrt(_sum(x * x))

    def meet(q: np.ndarray, v: np.ndarray, ids: np.ndarray, held: list | None) -> list:
        own, other = norms(q), norms(v)
        if cosine:
            length = lambda x, n: x / np.where(n == 0, 1.0, n)[:, None]
            value, slack = length(q, own) @ length(v, other).T, MARGIN + 1e-12
        else:
            value, slack = q @ v.T, MARGIN + 1e-12 * max(1.0, float(np.nanmax(own, initial=0)) * float(np.nanmax(other, initial=0)))
        least = held[3] if held is not None else np.full(len(q), -np.inf)
        if held is None and len(v) > k:
            least = np.partition(value, len(v) - k, axis=1)[:, len(v) - k]
            least = np.where(np.isnan(least), np.inf, least)
        row, col = np.nonzero(~(value < (least - slack)[:, None]))
        got = []
        for a in range(0, len(row), 65_536):
            r, c = row[a : a + 65_536], col[a : a + 65_536]
            score = _sum(q[r] * v[c])
            if cosine:
                under = own[r] * other[c]
                score = np.where(under == 0, 0.0, score / np.where(under == 0, 1.0, under))
            got.append(score)
        found = [row, ids[col], np.concatenate(got) if got else np.zeros(0)]
        if held is not None:
            found = [np.concatenate([a, b]) for a, b in zip(held[:3], found, strict=True)]
        keep, kth = _best(*found, k, len(q))
        return [*(x[keep] for x in found), kth]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        blank: dict[bytes, np.ndarray] = {}
        with np.errstate(all="ignore"):
            for b in batches:
                for i in range(b.num_rows):
                    q_dim, q_ids, q_x, dim, ids, x = (b.column(c)[i].as_py() for c in ("q_dim", "q_ids", "q_x", "dim", "ids", "x"))
                    here = np.frombuffer(ids, np.int64)
                    if q_dim != dim or dim < 0:
                        # No score: such rows come last, by their ids.
                        blank[q_ids] = np.sort(np.concatenate([blank.get(q_ids, here[:0]), here]))[:k]
                        continue
                    q, v = np.frombuffer(q_x, np.float64).reshape(-1, dim) if dim else np.zeros((len(q_ids) // 8, 0)), np.frombuffer(x, np.float64).reshape(-1, dim) if dim else np.zeros((len(here), 0))
                    held[q_ids] = meet(q, v, here, held.get(q_ids))
        for name, (row, ids, score, _) in held.items():
            yield batch(np.frombuffer(name, np.int64)[row], ids, pa.array(score))
        for name, ids in blank.items():
            asked = np.frombuffer(name, np.int64)
            yield batch(np.repeat(asked, len(ids)), np.tile(ids, len(asked)), pa.nulls(len(asked) * len(ids), pa.float64()))

    def batch(query: np.ndarray, ids: np.ndarray, score: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), score], names=["query_id", "id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, cosine: bool = True, by: str | None = None) -> DataFrame:
    """query_id, id, score: of (query_id, query) each one's ``k`` best among (id, v) and what
    comes within MARGIN of them, once for each part of the vectors; a caller rounds and
    ranks.  With ``by``, only rows of the same ``by`` meet."""
    n, asked = vectors.count(), queries.count()
    sides = max(LEAST_SIDES, -(-n // SIDE_VECTORS))
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    group = F.col(by).cast("long") if by else F.lit(0).cast("long")
    shape = "by long, dim int, ids binary, x binary"
    held = vectors.select(group.alias("by"), F.col("id").cast("long").alias("id"), double("v").alias("v"))
    asks = queries.select(group.alias("by"), F.col("query_id").cast("long").alias("id"), double("query").alias("v"))
    renamed = lambda rows: rows.select("by", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    if by:
        # A group's vectors are dealt over parts, each of which meets the group's queries.
        parts = -(-n // SIDE_VECTORS) or 1
        held = held.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
        held = held.select((F.col("by") * parts + F.col("part")).alias("by"), "id", "v")
        asks = asks.select(F.explode(F.sequence(F.col("by") * parts, F.col("by") * parts + parts - 1)).alias("by"), "id", "v")
        blocks = held.repartition("by").mapInArrow(_pack(VECTOR_ROWS), shape)
        pairs = blocks.join(renamed(asks.repartition("by").mapInArrow(_pack(QUERY_ROWS), shape)), "by")
    else:
        blocks = held.mapInArrow(_pack(VECTOR_ROWS), shape).repartition(sides)
        asks = renamed(asks.mapInArrow(_pack(QUERY_ROWS), shape)).repartition(max(1, -(-asked // SIDE_QUERIES)))
        pairs = blocks.drop("by").crossJoin(asks.drop("by").hint("shuffle_replicate_nl"))
    return pairs.select("q_dim", "q_ids", "q_x", "dim", "ids", "x").mapInArrow(_scores(k, cosine), "query_id long, id long, score double")
