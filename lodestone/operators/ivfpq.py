"""Inverted lists with product codes: a resumable build and a batched search.

The coarse quantiser has two levels: about sqrt(lists) *supers*, and under each its
lists.  A vector is compared with the supers and then with the lists of the ``beam``
nearest ones only; a super that cannot hold a nearer list, by the widest angle
between it and its lists, is left out before that.  Lists meet vectors in a shuffle by
super, salted by the vector's id, so no task and no broadcast holds all lists.  All
centroids have unit length, so the largest inner product and the smallest angle agree.

Codes are those of the residual to the list's centroid, one byte for each of ``parts``
sub-vectors.  A build pins its settings, trains once, and writes the codes of shards, as
many in a job as hold JOB_ROWS vectors, each with a folder and a marker; a build that was
stopped goes on from the markers, and the same centroids give the same codes.  At the end the parts are merged by super
and list, and the manifest is written last.

A search handles a batch of queries in one job (a set of any size: ``pools``): a query's nearest lists come from the lists of
its nearest supers, each task scores the codes it reads by tables of the queries'
products with the codewords, and hands on its best ``k`` a query.

Training samples: the ``each`` smallest seeded hashes of every shard (a group limit
before and behind the shuffle, no sort of all rows); supers learn from 64 vectors a
super, books from ``BOOK_ROWS``, each in one task of bounded size, and the lists of
different supers side by side.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.exact import nearest
from lodestone.operators.index import Files, scratch

#: Vectors a list that training wants, and its least sample.
PER_LIST, LEAST_SAMPLE = 40, 50_000
PER_SUPER = 64
BOOK_ROWS = 16_384
#: Vectors of one shard and super that one task holds, on average.
GROUP_ROWS = 100_000
#: Most (query, list) pairs and table cells of one batch; a larger one goes in blocks.
MAX_PROBES, MAX_CELLS = 1_000_000, 32_000_000
#: Vectors whose shards are encoded in one job.
JOB_ROWS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """``beam``: supers whose lists a vector or a query is compared with, at most.  README
    has the agreement with a comparison with all lists by ``beam``."""

    lists: int
    parts: int = 8
    codes: int = 256
    beam: int = 4
    rounds: int = 12
    seed: int = 20260831

    @property
    def supers(self) -> int:
        return max(1, round(math.sqrt(self.lists)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int, spherical: bool) -> np.ndarray:
    """At most k centroids of the rows of ``x``; one that is empty goes to the row that is
    farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        gap = (c * c).sum(1) - 2 * x @ c.T
        own, least = gap.argmin(1), gap.min(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        held = n > 0
        c[held] = sums[held] / n[held, None]
        far = np.argsort(-(least + (x * x).sum(1)), kind="stable")
        c[~held] = x[far[: (~held).sum()]]
        if spherical:
            c = unit(c)
    return c


def sample(vectors: DataFrame, each: int, seed: int) -> DataFrame:
    """Of every shard the ``each`` rows of the smallest seeded hash of their id (ties:
    smaller ids)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    order = Window.partitionBy("shard").orderBy("_h", "id")
    return vectors.withColumn("_h", h).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= each).drop("_n")


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _floats(x: np.ndarray) -> pa.Array:
    return pa.array(list(x.astype(np.float64)), pa.list_(pa.float64()))


def _numbered(spark: SparkSession, rows: np.ndarray, name: str) -> DataFrame:
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], f"{name} int, c array<double>")


def _fit(rows: DataFrame, fit: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """``fit`` over a bounded sample (column ``embedding``), in one task; its centroids come
    back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_rows(b.column(0), dim) for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([_floats(fit(np.concatenate(held)))], names=["c"])

    made = rows.select("embedding").repartition(1).mapInArrow(run, "c array<double>").collect()
    return np.array([r["c"] for r in made], np.float64).reshape(-1, dim)


@dataclass
class Quantiser:
    """What training gives: supers and books are small; lists stay in their table."""

    settings: Settings
    supers: np.ndarray
    reach: np.ndarray
    books: np.ndarray
    lists: DataFrame

    @property
    def dim(self) -> int:
        return self.supers.shape[1]


def _spread(counts: dict[int, int], lists: int, most: int) -> dict[int, int]:
    """How many of the lists each super gets: in proportion to its vectors, one at least,
    ``most`` at most; what is over goes to those with room."""
    total, out = sum(counts.values()), {}
    for s, n in counts.items():
        out[s] = min(most, n, max(1, lists * n // max(total, 1)))
    for s in sorted(out, key=lambda s: -counts[s]):
        more = min(lists - sum(out.values()), most - out[s], counts[s] - out[s])
        out[s] += max(0, more)
    return out


def train(vectors: DataFrame, settings: Settings, out: str) -> None:
    """Learn supers, lists and books from (id, shard, embedding) and write them to ``out``."""
    spark, s = vectors.sparkSession, settings
    shards = vectors.select("shard").distinct().count()
    each = math.ceil(max(LEAST_SAMPLE, PER_LIST * s.lists) / max(shards, 1))
    path = f"{scratch(spark)}/training-{uuid.uuid4().hex}"
    double = F.transform("embedding", lambda x: x.cast("double"))
    sample(vectors, each, s.seed).select("id", "_h", double.alias("embedding")).write.parquet(path)
    taken = spark.read.parquet(path)
    first = taken.select("embedding").first()
    if first is None:
        raise ValueError("no vectors to train on")
    dim = len(first["embedding"])
    few = lambda n: taken.orderBy("_h", "id").limit(n)  # noqa: E731  n is a bound of a task
    supers = unit(_fit(few(PER_SUPER * s.supers), lambda x: lloyd(unit(x), s.supers, s.seed, s.rounds, True), dim))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(_rows(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([pa.array((x @ supers.T).argmax(1), pa.int32()), b.column(0), _floats(x)], names=["super_id", "h", "x"])

    own = taken.select("_h", "embedding").mapInArrow(placed, "super_id int, h string, x array<double>")
    counts = {r["super_id"]: r["n"] for r in own.groupBy("super_id").agg(F.count("*").alias("n")).collect()}  # a row a super
    most = 4 * max(1, s.lists // len(supers) + 1)
    lists = _spread(counts, s.lists, most)
    begin = dict(zip(lists, np.cumsum([0, *lists.values()]).tolist(), strict=False))
    group = Window.partitionBy("super_id").orderBy("h")
    own = own.withColumn("_n", F.row_number().over(group)).filter(F.col("_n") <= PER_LIST * most).drop("_n")

    def split(key: tuple, part: pa.Table) -> pa.Table:
        at = key[0].as_py()
        part = part.sort_by("h")
        c = unit(lloyd(_rows(part.column("x"), dim), lists[at], s.seed + at, s.rounds, True))
        n = len(c)
        return pa.Table.from_arrays([pa.array([at] * n, pa.int32()), pa.array(range(begin[at], begin[at] + n), pa.int32()), _floats(c)], names=["super_id", "list_id", "c"])

    own.groupBy("super_id").applyInArrow(split, "super_id int, list_id int, c array<double>").write.mode("overwrite").partitionBy("super_id").parquet(f"{out}/lists")
    held = spark.read.parquet(f"{out}/lists")

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, c = b.column(0).to_numpy(), _rows(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((c * supers[at]).sum(1), pa.float64())], names=["super_id", "near"])

    near = {r["super_id"]: r["near"] for r in held.select("super_id", "c").mapInArrow(widest, "super_id int, near double").groupBy("super_id").agg(F.min("near").alias("near")).collect()}
    reach = np.array([math.acos(max(-1.0, min(1.0, near[i]))) if i in near else -1.0 for i in range(len(supers))])
    quantiser = Quantiser(s, supers, reach, np.zeros((s.parts, 1, dim // s.parts)), held)
    residuals = _placed(quantiser, few(BOOK_ROWS).select(F.col("id"), "embedding"), residual=True)
    width = dim // s.parts
    parts = residuals.select(F.explode(F.expr(f"transform(sequence(0, {s.parts - 1}), p -> named_struct('part', p, 'h', id, 'x', slice(r, p * {width} + 1, {width})))")).alias("x")).select("x.*")

    def book(key: tuple, part: pa.Table) -> pa.Table:
        c = lloyd(_rows(part.sort_by("h").column("x"), width), s.codes, s.seed + key[0].as_py(), s.rounds, False)
        n = len(c)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), _floats(c)], names=["part", "code", "c"])

    parts.groupBy("part").applyInArrow(book, "part int, code int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{out}/books")
    _numbered(spark, supers, "super_id").join(spark.createDataFrame([(i, float(r)) for i, r in enumerate(reach)], "super_id int, reach double"), "super_id").coalesce(1).write.mode("overwrite").parquet(f"{out}/supers")


def opened(spark: SparkSession, out: str, settings: Settings) -> Quantiser:
    """A trained quantiser; supers and books come to the driver (sqrt(lists) and ``parts`` *
    ``codes`` rows)."""
    top = spark.read.parquet(f"{out}/supers").orderBy("super_id").collect()
    supers = np.array([r["c"] for r in top], np.float64)
    rows = spark.read.parquet(f"{out}/books").orderBy("part", "code").collect()
    width = supers.shape[1] // settings.parts
    books = np.full((settings.parts, settings.codes, width), np.inf)
    for r in rows:
        books[r["part"], r["code"]] = r["c"]
    return Quantiser(settings, supers, np.array([r["reach"] for r in top]), books, spark.read.parquet(f"{out}/lists"))


def near_supers(supers: np.ndarray, reach: np.ndarray, beam: int, x: np.ndarray) -> np.ndarray:
    """(vectors x beam) supers that may hold the nearest list, -1 where none is left."""
    gap = np.arccos(np.clip(x @ supers.T, -1, 1))
    gap = np.where(reach < 0, np.inf, gap)  # a super without lists
    order = np.argsort(gap, 1, kind="stable")[:, :beam]
    near = np.take_along_axis(gap, order, 1)
    # The nearest super has a list within ``near + reach``; another's lists are no nearer
    # than ``near - reach``.
    able = near - reach[order] <= near[:, :1] + reach[order[:, :1]] + 1e-9
    return np.where(able & np.isfinite(near), order, -1)


def _placed(q: Quantiser, vectors: DataFrame, *, residual: bool = False) -> DataFrame:
    """id, list_id, super_id and the product code (or the residual ``r``) of (id,
    embedding)."""
    dim, s, books, supers, reach = q.dim, q.settings, q.books, q.supers, q.reach
    id_type = vectors.schema["id"].dataType.simpleString()
    salts = max(1, math.ceil(vectors.count() / GROUP_ROWS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = near_supers(supers, reach, s.beam, unit(_rows(b.column(1), dim)))
            row, rank = np.nonzero(near >= 0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(near[row, rank], pa.int32())], names=["id", "embedding", "super_id"])

    double = F.transform("embedding", lambda x: x.cast("double"))
    copies = vectors.select("id", double.alias("embedding")).mapInArrow(spread, f"id {id_type}, embedding array<double>, super_id int")
    copies = copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    lists = q.lists.select("super_id", "list_id", "c", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    width = dim // s.parts

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["id", "list_id", "super_id", "gap", "r" if residual else "pq"]
        if not left.num_rows or not right.num_rows:
            blank = pa.array([], pa.list_(pa.float64()) if residual else pa.binary())
            return pa.Table.from_arrays([left.column("id").slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.float64()), blank], names=names)
        right = right.sort_by("list_id")
        x, c, ids = _rows(left.column("embedding"), dim), _rows(right.column("c"), dim), right.column("list_id").to_numpy()
        close = unit(x) @ c.T
        own = close.argmax(1)
        rest = x - c[own]
        if residual:
            out = _floats(rest)
        else:
            codes = np.zeros((len(x), s.parts), np.uint8)
            for p in range(s.parts):
                words = books[p][np.isfinite(books[p]).all(1)]
                sub = rest[:, p * width : (p + 1) * width]
                codes[:, p] = ((words * words).sum(1) - 2 * sub @ words.T).argmin(1)
            out = pa.array([r.tobytes() for r in codes], pa.binary())
        near = np.round(-close[np.arange(len(x)), own], 12)
        return pa.Table.from_arrays([left.column("id"), pa.array(ids[own], pa.int32()), right.column("super_id").take(pa.array(own)), pa.array(near, pa.float64()), out], names=names)

    kind = "r array<double>" if residual else "pq binary"
    met = copies.groupBy("super_id", "salt").cogroup(lists.groupBy("super_id", "salt")).applyInArrow(best, f"id {id_type}, list_id int, super_id int, gap double, {kind}")
    value = kind.split()[0]
    nearest = F.min_by(F.struct("list_id", "super_id", value), F.struct("gap", "list_id"))
    return met.groupBy("id").agg(nearest.alias("b")).select("id", "b.list_id", "b.super_id", f"b.{value}")


def encode(q: Quantiser, vectors: DataFrame) -> DataFrame:
    """id, list_id, super_id, pq of (id, embedding), each id once."""
    return _placed(q, vectors)


def _groups(shards: list[int], counts: dict[int, int]) -> list[list[int]]:
    """Shards in order, of JOB_ROWS vectors together at most, or one larger alone."""
    out: list[list[int]] = []
    room = 0
    for shard in shards:
        if not out or counts[shard] > room:
            out.append([])
            room = JOB_ROWS
        out[-1].append(shard)
        room -= counts[shard]
    return out


def _encode_shards(q: Quantiser, files: Files, vectors: DataFrame, out: str, shards: list[int], counts: dict[int, int]) -> None:
    """Write the codes of ``shards``, which are next to each other among those that lack a
    marker, in one job: each to its own folder."""
    spark = vectors.sparkSession
    for shard in shards:
        files.delete(f"{out}/parts/shard={shard}")
    named = F.struct("shard", "id").alias("id")
    own = vectors.filter(F.col("shard").isin(shards)).select(named, "embedding")
    rows = encode(q, own).select(F.col("id.shard").alias("shard"), F.col("id.id").alias("id"), "list_id", "super_id", "pq")
    rows.repartition("shard").write.mode("append").partitionBy("shard").parquet(f"{out}/parts")
    kept = spark.read.parquet(f"{out}/parts").filter(F.col("shard").isin(shards)).groupBy("shard").count()
    held = {r["shard"]: r["count"] for r in kept.collect()}  # a row a shard
    for shard in shards:
        if held.get(shard) != counts[shard]:
            raise ValueError(f"shard {shard} holds an id twice")


def build(vectors: DataFrame, out: str, settings: Settings, *, stop_after: int | None = None) -> dict | None:
    """Codes of (id, shard, embedding), shards from 0, under ``out``; goes on from what an
    earlier run has committed.  Returns the manifest, or None where ``stop_after`` shards
    end it early."""
    from lodestone.operators.backfill import pin

    spark = vectors.sparkSession
    files = Files(spark, out)
    pin(files, f"{out}/settings.json", asdict(settings))
    if files.complete(f"{out}/manifest.json"):
        return json.loads(files.read(f"{out}/manifest.json"))
    if not files.complete(f"{out}/trained.json"):
        train(vectors, settings, out)
        files.write(f"{out}/trained.json", "{}")
    q = opened(spark, out, settings)
    counts = {r["shard"]: r["n"] for r in vectors.groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect()}  # a row a shard
    marker = lambda shard: f"{out}/markers/{shard}.json"
    for group in _groups([s for s in counts if not files.complete(marker(s))], counts):
        if stop_after is not None:
            group = [s for s in group if s in list(counts)[:stop_after]]
        if group:
            _encode_shards(q, files, vectors, out, group, counts)
            for shard in group:
                files.write(marker(shard), json.dumps({"shard": shard, "records": counts[shard]}))
    if not all(files.complete(marker(s)) for s in counts):
        return None
    total = sum(json.loads(files.read(marker(s)))["records"] for s in counts)
    merged = spark.read.parquet(f"{out}/parts").select("super_id", "list_id", F.col("id").alias("row_id"), "pq")
    files.delete(f"{out}/codes")
    merged.repartitionByRange("super_id", "list_id", "row_id").sortWithinPartitions("super_id", "list_id", "row_id").write.partitionBy("super_id").parquet(f"{out}/codes")
    held = spark.read.parquet(f"{out}/codes").count()
    if held != total:
        raise ValueError(f"{held} codes, but the markers say {total}")
    manifest = {"records": held, "lists": q.lists.count(), "settings": asdict(settings)}
    files.create(f"{out}/manifest.json", json.dumps(manifest))
    return manifest


def _blocks(ids: list, per: int) -> list[slice]:
    return [slice(a, a + per) for a in range(0, len(ids), per)]


def search(spark: SparkSession, out: str, queries: dict[int, list[float]], *, nprobe: int, k: int, by_list: bool = False) -> DataFrame:
    """query_id, row_id, approx of each query's ``k`` best by codes, among its ``nprobe``
    nearest lists.  More queries than fit one batch go in blocks.  With ``by_list``: the ``k``
    best of each list, with ``list_rank``, the list's place among the query's own from 1;
    the best of any smaller ``nprobe`` and ``k`` are among them."""
    settings = Settings(**json.loads(Files(spark, out).read(f"{out}/settings.json")))
    q = opened(spark, out, settings)
    codes = spark.read.parquet(f"{out}/codes")
    ids = sorted(queries)
    per = max(1, min(MAX_PROBES // nprobe, MAX_CELLS // (settings.parts * settings.codes)))
    found = None
    for block in _blocks(ids, per):
        one = _search_block(q, codes, ids[block], np.array([queries[i] for i in ids[block]], np.float64), nprobe, k, by_list)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], _FOUND + (", list_rank int" if by_list else ""))


def nearest_lists(q: Quantiser, asks: np.ndarray, nprobe: int) -> list[tuple[int, int, int, float, int]]:
    """(query, super_id, list_id, product, rank) of each query's nearest lists, from the lists of
    its nearest supers: ``beam`` of them, and as many more as ``4 * nprobe`` lists need."""
    sizes = np.zeros(len(q.supers), np.int64)
    for r in q.lists.groupBy("super_id").agg(F.count("*").alias("n")).collect():  # a row a super
        sizes[r["super_id"]] = r["n"]
    order = np.argsort(-(asks @ q.supers.T), 1, kind="stable")
    enough = np.cumsum(sizes[order], 1) >= 4 * nprobe
    many = np.maximum(np.where(enough.any(1), enough.argmax(1) + 1, len(q.supers)), q.settings.beam)
    chosen = np.zeros((len(asks), len(q.supers)), bool)
    for i, n in enumerate(many):
        chosen[i, order[i, :n]] = True
    dim = q.dim

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy()
            score = np.where(chosen[:, at], asks @ _rows(b.column(2), dim).T, -np.inf)
            top = np.argsort(-score, 1, kind="stable")[:, :nprobe]
            i = np.repeat(np.arange(len(asks)), top.shape[1])
            j = top.ravel()
            held = np.isfinite(score[i, j])
            i, j = i[held], j[held]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(at[j], pa.int32()), b.column(1).take(pa.array(j)), pa.array(score[i, j], pa.float64())], names=["q", "super_id", "list_id", "s"])

    wanted = [int(x) for x in np.flatnonzero(chosen.any(0))]
    rows = q.lists.filter(F.col("super_id").isin(wanted)).select("super_id", "list_id", "c").mapInArrow(near, "q int, super_id int, list_id int, s double")
    best = Window.partitionBy("q").orderBy(F.desc(F.round("s", 12)), "list_id")
    rows = rows.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= nprobe)
    return [tuple(r) for r in rows.collect()]  # nprobe rows a query, MAX_PROBES at most


_FOUND = "query_id long, row_id long, approx double"


def _search_block(q: Quantiser, codes: DataFrame, ids: list[int], asks: np.ndarray, nprobe: int, k: int, ranked: bool) -> DataFrame:
    s, width = q.settings, q.dim // q.settings.parts
    near = nearest_lists(q, asks, nprobe)
    held: dict[int, list[tuple]] = {}
    for query, _, at, score, rank in near:
        held.setdefault(at, []).append((query, score, rank))
    by_list = {at: tuple(np.array(x) for x in zip(*sorted(rows), strict=True)) for at, rows in held.items()}
    books = np.where(np.isfinite(q.books), q.books, 0.0)
    tables = np.stack([asks[:, p * width : (p + 1) * width] @ books[p].T for p in range(s.parts)], 1).astype(np.float32)
    names = np.array(ids, np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = b.column(0).to_numpy(), b.column(1).to_numpy()
            code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, s.parts)
            got: list[tuple[np.ndarray, ...]] = []
            for which in np.unique(at):
                asked = by_list.get(int(which))
                if asked is None:
                    continue
                own = np.flatnonzero(at == which)
                value = asked[1][:, None] + sum(tables[asked[0], p][:, code[own, p]] for p in range(s.parts))
                if len(own) > k:
                    top = np.argpartition(-value, k - 1, 1)[:, :k]
                    own_of, value = own[top], np.take_along_axis(value, top, 1)
                else:
                    own_of = np.broadcast_to(own, value.shape)
                wide = value.shape[1]
                got.append((np.repeat(asked[0], wide), own_of.ravel(), value.ravel(), np.repeat(asked[2], wide)))
            if got:
                who, row, value, rank = (np.concatenate(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(rows[row]), pa.array(np.round(value.astype(np.float64), 6)), pa.array(rank, pa.int32())], names=["query_id", "row_id", "approx", "list_rank"])

    wanted, tops = sorted(by_list), sorted({x[1] for x in near})
    rows = codes.filter(F.col("super_id").isin(tops)).filter(F.col("list_id").isin(wanted)).select("list_id", "row_id", "pq")
    rows = rows.mapInArrow(score, f"{_FOUND}, list_rank int")
    best = Window.partitionBy("query_id", *(["list_rank"] if ranked else [])).orderBy(F.desc("approx"), "row_id")
    rows = rows.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")
    return rows if ranked else rows.drop("list_rank")


def exact(vectors: DataFrame, queries: DataFrame | dict[int, list[float]], k: int, *, row_id: str = "row_id", vector: str = "embedding") -> DataFrame:
    """query_id, row_id, score, rank of each query's ``k`` nearest by cosine, from all
    vectors.  Queries (a dict, or a frame of query_id and query) may be any number: they
    meet the vectors in blocks, and nothing but each block's best is shuffled."""
    if isinstance(queries, dict):
        queries = vectors.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in queries.items()], "query_id long, query array<double>")
    found = nearest(vectors.select(F.col(row_id).alias("id"), F.col(vector).alias("v")), queries, k)
    rows = found.filter("score is not null").select("query_id", F.col("id").alias("row_id"), F.round("score", 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
