"""Pools from product codes for a query set of any size.

Queries are packed into blocks, and every block is one task that all lists, and then all
codes, stream through: a code is a few bytes, so that they are read once a block and are
never held.  Of the lists a task keeps one number a query and list, which bounds the
queries of a block; of the codes it keeps each query's ``k`` best.  Neither queries nor
probes come to the driver, and what is shuffled behind it is the pools alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.index import Files
from lodestone.operators.ivfpq import Quantiser, Settings, _rows, opened

#: Queries of a block, at most and (where there are as many) at least; products of queries
#: and lists that a task holds.
QUERY_ROWS, LEAST_ROWS, CELLS = 1024, 64, 8_000_000
#: Codes of a block, and rows that wait before a query's best are settled.
CODE_ROWS, WAITING = 4096, 1_000_000
#: Products of one pair that were added in another order differ by less.
EVEN = 1e-12

_BLOCK = "ids binary, x binary, wanted binary"
_LISTS = "super_id int, lists binary, c binary"


def _pack(rows: int):
    """Task function over (query_id, query, wanted): blocks of ``rows`` queries; ``wanted`` as
    pairs (place in the block, row_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                pairs = [(at, row) for at, own in enumerate(part.column(2).to_pylist()) for row in own or ()]
                cols = [part.column(0).to_numpy().astype(np.int64).tobytes(), x.tobytes(), np.array(pairs, np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], names=["ids", "x", "wanted"])

    return run


def _packed_lists(q: Quantiser) -> DataFrame:
    """A row a super: its lists, of which there are not many, and their centroids."""
    dim = q.dim

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("list_id")
        ids, c = part.column("list_id").to_numpy().astype(np.int32), _rows(part.column("c"), dim)
        cols = [pa.array([key[0].as_py()], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())]
        return pa.Table.from_arrays(cols, names=["super_id", "lists", "c"])

    return q.lists.select("super_id", "list_id", "c").groupBy("super_id").applyInArrow(pack, _LISTS)


def _packed_codes(codes: DataFrame) -> DataFrame:
    """Blocks of the codes of one super, by lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lists, ids, pq = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3)
            order = np.lexsort((ids, lists, at))
            cut = np.flatnonzero(np.diff(at[order])) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(order)], strict=True):
                for i in range(a, z, CODE_ROWS):
                    own = order[i : min(i + CODE_ROWS, z)]
                    raw = b"".join(pq.take(pa.array(own)).to_pylist())
                    cols = [lists[own].astype(np.int32).tobytes(), ids[own].astype(np.int64).tobytes(), raw]
                    yield pa.RecordBatch.from_arrays([pa.array([int(at[own[0]])], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], names=["super_id", "of", "rows", "pq"])

    return codes.select("super_id", "list_id", "row_id", "pq").mapInArrow(run, "super_id int, of binary, rows binary, pq binary")


def _chosen(q: Quantiser, sizes: np.ndarray, nprobe: int, asks: np.ndarray) -> np.ndarray:
    """(queries x supers) whether a query looks at the lists of a super, as in
    ``ivfpq.nearest_lists``."""
    order = np.argsort(-(asks @ q.supers.T), 1, kind="stable")
    enough = np.cumsum(sizes[order], 1) >= 4 * nprobe
    many = np.maximum(np.where(enough.any(1), enough.argmax(1) + 1, len(q.supers)), q.settings.beam)
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order, np.arange(order.shape[1])[None] < many[:, None], 1)
    return out


def _borders(score: np.ndarray, lists: np.ndarray, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the product and the id of its last list of ``nprobe``: by falling
    products (12 places), then by ids.  ``lists`` rise; a list not looked at is -inf."""
    n = len(score)
    if score.shape[1] <= nprobe:
        return np.full(n, -np.inf), np.full(n, 2**31 - 1, np.int64)
    least = np.partition(score, score.shape[1] - nprobe, 1)[:, score.shape[1] - nprobe]
    more = nprobe - (score > least[:, None]).sum(1)
    even = score == least[:, None]
    last = (np.cumsum(even, 1, dtype=np.int32) < more[:, None]).sum(1)
    return least, lists[np.minimum(last, len(lists) - 1)].astype(np.int64)


def _bound(q: Quantiser, sizes: np.ndarray, nprobes: tuple[int, ...], total: int):
    """Task function over pairs of a block of queries and the lists of a super: the block,
    the supers that its queries look at, and the borders of each nprobe."""
    dim = q.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["ids"] not in held:
                    asks = np.frombuffer(r["x"], np.float64).reshape(-1, dim)
                    held[r["ids"]] = [r, _chosen(q, sizes, nprobes[-1], asks), np.zeros((len(asks), total)), np.zeros(total, np.int32), 0]
                _, chosen, score, names, n = own = held[r["ids"]]
                lists = np.frombuffer(r["lists"], np.int32)
                asks = np.frombuffer(r["x"], np.float64).reshape(-1, dim)
                product = np.round(asks @ np.frombuffer(r["c"], np.float64).reshape(-1, dim).T, 12)
                score[:, n : n + len(lists)] = np.where(chosen[:, [r["super_id"]]], product, -np.inf)
                names[n : n + len(lists)] = lists
                own[4] = n + len(lists)
        for r, chosen, score, names, _ in held.values():
            order = np.argsort(names, kind="stable")
            score, names = score[:, order], names[order]
            least, last = (np.stack(x) for x in zip(*(_borders(score, names, n) for n in nprobes), strict=True))
            yield _bounded(r, chosen, least, last)

    return run


def _bounded(r: dict, chosen: np.ndarray, least: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    cols = [r["ids"], r["x"], r["wanted"], np.packbits(chosen, axis=1).tobytes(), least.tobytes(), last.astype(np.int64).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], names=["ids", "x", "wanted", "chosen", "least", "last"])


class _Block:
    """A block of queries and the best rows that it has met."""

    def __init__(self, q: Quantiser, r: dict, levels: int, k: int) -> None:
        self.q, self.k, self.levels = q, k, levels
        self.ids = np.frombuffer(r["ids"], np.int64)
        n = len(self.ids)
        self.x = np.frombuffer(r["x"], np.float64).reshape(n, q.dim)
        self.wanted = np.frombuffer(r["wanted"], np.int64).reshape(-1, 2)
        bits = np.frombuffer(r["chosen"], np.uint8).reshape(n, -1)
        self.chosen = np.unpackbits(bits, axis=1, count=len(q.supers)).astype(bool)
        self.least = np.frombuffer(r["least"], np.float64).reshape(levels, n)
        self.last = np.frombuffer(r["last"], np.int64).reshape(levels, n)
        #: The value of each level's k-th row so far.
        self.kth = np.full((n, levels), -np.inf)
        self.held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int8)]
        self.more: list[list[np.ndarray]] = []
        self.waiting = 0

    def meet(self, at: int, lists: np.ndarray, c: np.ndarray, of: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        """Take the best of the codes ``rows`` (decoded: ``vectors``) of the lists ``of``."""
        own = np.flatnonzero(self.chosen[:, at])
        if not len(own):
            return
        x = self.x[own]
        here, place = np.unique(of, return_inverse=True)
        product = x @ c[np.searchsorted(lists, here)].T
        # The first level whose lists hold this one; ``levels`` where none does.
        level = np.zeros(product.shape, np.int8)
        for least, last in zip(self.least[:, own], self.last[:, own], strict=True):
            even = np.abs(product - least[:, None]) <= EVEN
            level += ~np.where(even, here[None] <= last[:, None], product > least[:, None])
        if (level == self.levels).all():
            return
        value, level = x @ vectors.T, level[:, place]
        bound = np.concatenate([self.kth[own], np.full((len(own), 1), np.inf)], 1)
        open_rows = np.flatnonzero(np.isneginf(bound[:, 0]))
        if value.shape[1] > self.k and len(open_rows):
            # No row is known yet: of each level no more than what this block settles.
            for j in range(self.levels):
                seen = np.where(level[open_rows] <= j, value[open_rows], -np.inf)
                kth = np.partition(seen, seen.shape[1] - self.k, 1)[:, seen.shape[1] - self.k]
                bound[open_rows, j] = np.maximum(bound[open_rows, j], kth)
        least = np.take_along_axis(bound, level.astype(np.int64), 1)
        # Values are rounded to six places behind this.
        i, j = np.nonzero((value >= least - 1e-6) & (level < self.levels))
        if len(i):
            self.more.append([own[i].astype(np.int32), rows[j], np.round(value[i, j], 6), level[i, j]])
            self.waiting += len(i)
            if self.waiting > WAITING:
                self.settle()

    def settle(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keep the ``k`` best of each query and level: by value, then by id.  (indices,
        places) of each level."""
        row, ids, value, level = self.held = [np.concatenate([a, *b]) for a, b in zip(self.held, zip(*self.more, strict=True), strict=True)] if self.more else self.held
        self.more, self.waiting = [], 0
        order = np.lexsort((ids, -value, row))
        kept, tops = np.zeros(len(row), bool), []
        for j in range(self.levels):
            own = order[level[order] <= j]
            r = row[own]
            at = np.arange(len(own))
            fresh = np.concatenate([[True], r[1:] != r[:-1]]) if len(own) else np.zeros(0, bool)
            place = at - np.maximum.accumulate(np.where(fresh, at, 0))
            full = own[place == self.k - 1]
            self.kth[row[full], j] = value[full]
            tops.append((own[place < self.k], place[place < self.k] + 1))
            kept[tops[-1][0]] = True
        new = np.cumsum(kept) - 1
        self.held = [x[kept] for x in self.held]
        return [(new[own], place) for own, place in tops]

    def found(self, nprobes: tuple[int, ...], only: bool) -> Iterator[pa.RecordBatch]:
        for nprobe, (own, place) in zip(nprobes, self.settle(), strict=True):
            row, ids, value = (x[own] for x in self.held[:3])
            if only:
                known = np.unique(self.wanted[:, 1])
                keep = np.zeros(len(ids), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                    asked = self.wanted[:, 0] * len(known) + np.searchsorted(known, self.wanted[:, 1])
                    keep = (known[at] == ids) & np.isin(row.astype(np.int64) * len(known) + at, asked)
                row, ids, value, place = row[keep], ids[keep], value[keep], place[keep]
            cols = [pa.array(self.ids[row]), pa.array(ids), pa.array(value), pa.array(np.full(len(row), nprobe), pa.int32()), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "row_id", "approx", "nprobe", "place"])


def _best(q: Quantiser, nprobes: tuple[int, ...], k: int, only: bool):
    """Task function over pairs of a block of queries and one of codes: the pools."""
    dim, parts = q.dim, q.settings.parts
    books = np.where(np.isfinite(q.books), q.books, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, _Block] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["ids"] not in held:
                    held[r["ids"]] = _Block(q, r, len(nprobes), k)
                lists, c = np.frombuffer(r["lists"], np.int32), np.frombuffer(r["c"], np.float64).reshape(-1, dim)
                of, code = np.frombuffer(r["of"], np.int32), np.frombuffer(r["pq"], np.uint8).reshape(-1, parts)
                vectors = c[np.searchsorted(lists, of)] + np.concatenate([books[p][code[:, p]] for p in range(parts)], 1)
                held[r["ids"]].meet(r["super_id"], lists, c, of, np.frombuffer(r["rows"], np.int64), vectors)
        for block in held.values():
            yield from block.found(nprobes, only)

    return run


def pools(spark: SparkSession, out: str, queries: DataFrame, *, nprobes: tuple[int, ...], k: int) -> DataFrame:
    """query_id, row_id, approx, nprobe, place (from 1) of the ``k`` best by codes of every
    query (query_id, query) among its ``nprobe`` nearest lists, for each of ``nprobes``.
    Where the queries have a column ``wanted`` (row ids), those of the pools alone."""
    settings = Settings(**json.loads(Files(spark, out).read(f"{out}/settings.json")))
    q = opened(spark, out, settings)
    nprobes = tuple(sorted(set(nprobes)))
    only = "wanted" in queries.columns
    sizes = np.zeros(len(q.supers), np.int64)
    for r in q.lists.groupBy("super_id").agg(F.count("*").alias("n")).collect():  # a row a super
        sizes[r["super_id"]] = r["n"]
    total = int(sizes.sum())
    asked = queries.count()
    per = max(1, min(QUERY_ROWS, CELLS // max(total, 1), max(LEAST_ROWS, -(-asked // (2 * spark.sparkContext.defaultParallelism)))))
    asks = queries.select(F.col("query_id").cast("long"), F.transform("query", lambda x: x.cast("double")), F.col("wanted") if only else F.lit(None).cast("array<long>"))
    blocks = asks.repartition(max(1, -(-asked // per))).mapInArrow(_pack(per), _BLOCK)
    lists = _packed_lists(q)
    shape = f"{_BLOCK}, chosen binary, least binary, last binary"
    met = lists.repartition(1).crossJoin(blocks.hint("shuffle_replicate_nl"))
    small = replace(q, lists=None)  # a task function cannot hold a frame
    bounded = met.mapInArrow(_bound(small, sizes, nprobes, total), shape)
    codes = _packed_codes(spark.read.parquet(f"{out}/codes")).join(lists, "super_id").repartition(1)
    pairs = codes.crossJoin(bounded.hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(_best(small, nprobes, k, only), "query_id long, row_id long, approx double, nprobe int, place int")
