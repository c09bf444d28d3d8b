"""Near-duplicate detection with an LSH forest over MinHash signatures.

1. One scan hashes every text's word shingles: the set's size, a 128-bit key of the
   set, and ``trees * depth`` 16-bit MinHash values.  Equal sets are one class from
   here on (an aggregate, combined before the shuffle), so thousands of copies cost
   one row.  A class has a number of its own: two texts under one doc_id are two
   classes.
2. Each tree sorts the representatives by its own stretch of the signature.  A row's
   candidates are its longest-common-prefix neighbours: all rows of its region, and
   the ``window`` rows beside it.  A region's depth adapts: it is the least depth at
   which no more than ``region`` rows share the prefix.  A sketch that travels with
   the row drops candidates far from similar.  Where more than ``region`` rows share
   all values, the forest cannot part them: such rows, the crowd, are also searched
   exactly.
   Trees are cut into ranges over (values, id), so many equal signatures spread over
   tasks.
3. Links are confirmed on full sets (sorted hashes of all shingles), which are made
   once from the whole text of each class that has a candidate.  A pair already in one component adds nothing,
   so the forest is read three times: over all rows, for each document's likeliest
   candidate; then over the rows that had one, now with their components, for each
   one's likeliest candidate in another component; then, after step 4, for every
   candidate that still lies between two and that step 4 has not refuted.
4. The crowd's links between different components are found exactly: the rows that
   are not of their run's commonest component are queries, which are broadcast in
   blocks of bounded size as an inverted index of their whole sets; each row of the
   crowd counts its overlaps with a block at once, and only links that join two
   components for the first time leave the task.
5. Components come from star steps over the confirmed links.

Defined results: null or wordless text has an empty set, links with nothing and is
kept; fewer words than a shingle make the whole sequence its one shingle; rows with
a null doc_id take no part: component null, kept true; rows that repeat a doc_id
are copies of one document if their sets are equal, else the document links both
sets, whatever their likeness; an empty table gives an empty result.  Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm.common import materialize, maybe_broadcast, table, tidied, tidy_driver
from lodestone.llm.components import components

TREES = 12
DEPTH = 8
SKETCH = 64
WINDOW = 48
REGION = 48
#: Bytes of the crowd's query sets that are broadcast at once.
BLOCK_BYTES = 4 << 20
#: Sketch agreement of a pair at the threshold lies this many deviations above the cut.
MARGIN = 4.5
SHINGLE = 5
SIMILARITY = Fraction(4, 5)
SEED = 11


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(1, 2**63, n, dtype=np.int64).astype(np.uint64)
    return draw() * K.U64(2) + K.U64(1), draw()


def signatures(hashes: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (uint32) of each non-empty segment."""
    mult, add = _hash_family(n)
    out = np.empty((len(off) - 1, n), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(n):
            out[:, j] = np.minimum.reduceat(((hashes * mult[j] + add[j]) >> K.U64(32)).astype(np.uint32), off[:-1])
    return out


def _sketch(shingle: int, trees: int, depth: int):
    """Task function: doc_id, n, set key, tree values (big-endian uint16), sketch."""
    total = max(trees * depth, SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.chunks(batch):
                sh, sh_off = K.shingle_hashes(*K.words_of(data, off, K.SPACE), shingle)
                full = np.flatnonzero(np.diff(sh_off) > 0)
                n, hi, lo = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                values = [None] * part.num_rows
                sketch = [None] * part.num_rows
                if len(full):
                    own = [np.unique(sh[sh_off[i] : sh_off[i + 1]]) for i in full]
                    n[full] = [len(x) for x in own]
                    hi[full], lo[full] = _keys(own)
                    sig = signatures(sh, np.append(sh_off[full], sh_off[-1]), total)
                    tree = (sig[:, : trees * depth] & 0xFFFF).astype(">u2")
                    low = (sig[:, :SKETCH] >> 16).astype(np.uint8)
                    for row, i in enumerate(full):
                        values[i], sketch[i] = tree[row].tobytes(), low[row].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(hi), pa.array(lo), pa.array(values, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "n", "hi", "lo", "tree", "sketch"])

    return run


def _neighbours(depth: int, window: int, region: int, least: float, ratio: float, every: bool):
    """Task function over rows sorted by (tree, values, id): candidate pairs between
    different components that were not tried; ``every``, or each row's likeliest."""

    def some(tree: np.ndarray, values: np.ndarray, ids: np.ndarray, n: np.ndarray, sketch: np.ndarray, label: np.ndarray, tried: np.ndarray, mark: np.ndarray, old: int):
        m = len(ids)
        # Common prefix with the next row, in values; 0 across trees.
        same = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
        lcp = np.where(same.all(axis=1), depth, np.argmin(same, axis=1)) if m > 1 else np.zeros(0, np.int64)
        # Region: the run of the least depth with at most ``region`` rows.
        reach = np.zeros(m, np.int64)
        for d in range(depth, 0, -1):
            run = np.concatenate([[0], np.cumsum(lcp < d)])
            _, first, count = np.unique(run, return_index=True, return_counts=True)
            end = np.repeat(first + count, count)
            fits = np.repeat(count <= region, count)
            reach = np.where(fits, end - 1 - np.arange(m), reach)
        found = []
        for step in range(1, min(max(int(reach.max(initial=0)), window), m - 1) + 1):
            i = np.flatnonzero(((reach[: m - step] >= step) | (step <= window)) & (np.arange(step, m) >= old))
            j = i + step
            i, j = i[tree[i] == tree[j]], j[tree[i] == tree[j]]
            new = (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j])) & (label[i] != label[j]) & (tried[i] != ids[j]) & (tried[j] != ids[i])
            new &= np.minimum(mark[i], mark[j]) * np.maximum(mark[i], mark[j]) < 2  # else the search has had the pair
            i, j = i[new], j[new]
            agree = (sketch[i] == sketch[j]).mean(axis=1, dtype=np.float32)
            good = (agree >= least) & (ids[i] != ids[j])
            found.append((i[good], j[good], agree[good]))
        if not found:
            return None
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
        if not every:
            whole = np.zeros(len(i), bool)
            for side in (i, j):
                order = np.lexsort((-s, side))
                whole[order[np.concatenate([[True], np.diff(side[order]) != 0])] if len(order) else order] = True
            i, j, s = i[whole], j[whole], s[whole]
        i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(s, pa.float32()), pa.array(label[i]), pa.array(label[j])], names=["a", "b", "likely", "ca", "cb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # the last rows of the batch before, whose windows reach on
        for batch in batches:
            raw = b"".join(batch.column("values").to_pylist())
            now = [
                batch.column("tree").to_numpy(),
                np.frombuffer(raw, ">u2").reshape(-1, depth),
                batch.column("id").to_numpy(),
                batch.column("n").to_numpy(),
                np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH),
            ]
            named = batch.schema.names
            now.append(batch.column("label").to_numpy() if "label" in named else now[2])
            now.append(batch.column("tried").to_numpy() if "tried" in named else np.full(batch.num_rows, -1, np.int64))
            now.append(batch.column("mark").to_numpy() if "mark" in named else np.zeros(batch.num_rows, np.int32))
            if tail is not None:
                now = [np.concatenate([x, y]) for x, y in zip(tail, now, strict=True)]
            old = 0 if tail is None else len(tail[0])
            out = some(*now, old)
            if out is not None and out.num_rows:
                yield out
            tail = [x[-max(window, region) :] for x in now]

    return run


def _sets(data: np.ndarray, off: np.ndarray, shingle: int) -> list[np.ndarray]:
    return K.distinct_sets(*K.shingle_hashes(*K.words_of(data, off, K.SPACE), shingle))


def _keys(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two halves: sums of mixed hashes."""
    hi, lo = (np.zeros(len(own), np.int64) for _ in range(2))
    with np.errstate(over="ignore"):
        for i, x in enumerate(own):
            hi[i] = np.sum(K.mix(x ^ K.U64(0x5851F42D4C957F2D))).view(np.int64)
            lo[i] = np.sum(K.mix(x + K.U64(0x14057B7EF767814F))).view(np.int64)
    return hi, lo


def _full_sets(shingle: int):
    """Task function: id and set of the texts whose set is the one of their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.chunks(batch):
                own = _sets(data, off, shingle)
                hi, lo = _keys(own)
                right = (hi == part.column("hi").to_numpy()) & (lo == part.column("lo").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x in own], pa.large_binary()).cast(pa.binary())], names=["id", "set"]).filter(pa.array(right))

    return run


def _confirm(similarity: Fraction):
    """Task function: the pairs whose full sets are similar enough."""
    up, down = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = K.common(x, y)
                good.append(both > 0 and down * both >= up * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _block(rows: list) -> tuple:
    """Queries (id, label, set) as arrays: ids, labels, sizes, their distinct shingles in
    order, where each one's owners start, and the owners."""
    own = [np.frombuffer(r["set"], np.uint64) for r in rows]
    every = np.concatenate(own)
    order = np.argsort(every, kind="stable")
    owners = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])[order]
    values, starts = np.unique(every[order], return_index=True)
    return np.array([r["id"] for r in rows]), np.array([r["label"] for r in rows]), np.array([len(x) for x in own]), values, np.append(starts, len(every)), owners


def _search(similarity: Fraction, shared):
    """Task function over (id, label, set): links to the queries of the block that are
    similar enough, of which those that join two labels that no earlier link of the
    task has joined.  All overlaps with the block come from one pass over the set."""
    up, down = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, sizes, values, starts, owners = shared.value
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up_one := root.get(x, x)) != x:
                root[x] = root.get(up_one, up_one)
                x = up_one
            return x

        for batch in batches:
            out = []
            for label, raw in zip(batch.column("label").to_numpy(), batch.column("set"), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(values, x), len(values) - 1)
                at = at[values[at] == x]
                count = starts[at + 1] - starts[at]
                total = np.cumsum(count)
                where = np.arange(total[-1] if len(total) else 0) + np.repeat(starts[at] - (total - count), count)
                both = np.bincount(owners[where], minlength=len(ids))
                good = np.flatnonzero((both > 0) & (down * both >= up * (len(x) + sizes - both)) & (labels != label))
                for other in np.unique(labels[good]).tolist():
                    one, two = top(int(label)), top(other)
                    if one != two:
                        root[max(one, two)] = min(one, two)
                        out.append((min(label, other), max(label, other)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["ca", "cb"])

    return run


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: Fraction = SIMILARITY, trees: int = TREES, depth: int = DEPTH, window: int = WINDOW, region: int = REGION) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = materialize(source.mapInArrow(tidied(_sketch(shingle, trees, depth)), "doc_id long, n long, hi long, lo long, tree binary, sketch binary"), "neardup-sketch")
    # Classes of equal sets; the values are a function of the set.
    own = sketched.filter("n > 0 AND doc_id IS NOT NULL")
    classes = own.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.first("tree").alias("tree"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "neardup-classes")

    width = 2 * depth
    per_tree = F.posexplode(F.array(*[F.substring("tree", 1 + t * width, width) for t in range(trees)]))
    j = float(similarity)
    share = j + (1 - j) / 256  # agreement of 8-bit values at the threshold
    least = share - MARGIN * (share * (1 - share) / SKETCH) ** 0.5

    def candidates(of: DataFrame, every: bool, *more: str) -> DataFrame:
        """One reading of the forest over ``of``: a, b, likely, and their components."""
        rows = of.select("id", "n", "sketch", *more, per_tree.alias("tree", "values"))
        rows = rows.repartitionByRange("tree", "values", "id").sortWithinPartitions("tree", "values", "id").select("tree", "values", "id", "n", "sketch", *more)
        pairs = rows.mapInArrow(tidied(_neighbours(depth, window, region, least, j, every)), "a long, b long, likely float, ca long, cb long")
        return pairs.groupBy("a", "b").agg(F.max("likely").alias("likely"), F.first("ca").alias("ca"), F.first("cb").alias("cb"))

    # A document's likeliest candidate: a maximum, combined before the shuffle.
    first = candidates(classes, False)
    first = first.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "likely")
    best = materialize(first.groupBy("e.x").agg(F.max(F.struct("likely", "e.y")).getField("y").alias("y")), "neardup-best")

    # Rows that share all values of a tree with more rows than a region holds.
    deep = classes.select("id", per_tree.alias("tree", "values"))
    full = materialize(deep.groupBy("tree", "values").count().filter(F.col("count") > region).select("tree", "values"), "neardup-full")
    crowd = materialize(deep.join(maybe_broadcast(full), ["tree", "values"], "left_semi").select("id").distinct(), "neardup-crowd")

    # Full sets of the classes that have a candidate.
    needed = best.select(F.col("x").alias("id"), F.col("y").alias("tried"))
    read = materialize(needed.select("id").union(crowd).distinct(), "neardup-read")
    of = materialize(classes.join(maybe_broadcast(read), "id").select("id", "doc_id", "hi", "lo"), "neardup-of")
    sets = source.join(maybe_broadcast(of), "doc_id").select("id", "hi", "lo", "text").mapInArrow(tidied(_full_sets(shingle)), "id long, set binary")
    sets = materialize(sets.groupBy("id").agg(F.first("set").alias("set")), "neardup-sets")

    def confirm(some: DataFrame) -> DataFrame:
        some = some.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        return materialize(some.select("a", "b", "set_a", "set_b").mapInArrow(tidied(_confirm(similarity)), "a long, b long"), "neardup-links")

    def relabel(rows: DataFrame, column: str, found: DataFrame) -> DataFrame:
        """Replace a node by its component, where it has one."""
        return rows.join(found.withColumnRenamed("node", column), column, "left").withColumn(column, F.coalesce("component", column)).drop("component")

    links = confirm(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    # A doc_id with several sets links their classes.
    key = F.struct("n", "hi", "lo")
    several = materialize(own.groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).filter("x <> y").select("doc_id"), "neardup-several")
    if not several.isEmpty():
        held = own.join(maybe_broadcast(several), "doc_id").join(classes.select("n", "hi", "lo", "id"), ["n", "hi", "lo"]).select("doc_id", "id").distinct()
        least_of = held.groupBy("doc_id").agg(F.min("id").alias("a"))
        links = links.unionByName(held.join(least_of, "doc_id").filter("a <> id").select("a", F.col("id").alias("b")))
    merges = [components(links)]
    tidy_driver(source.sparkSession)
    # Documents that had a candidate, each with its component and the partner it tried.
    nodes = classes.join(maybe_broadcast(needed), "id").withColumn("label", F.col("id"))
    nodes = materialize(relabel(nodes, "label", merges[-1]), "neardup-nodes")
    # Each row's likeliest candidate in another component, one a pair of components.
    pick = candidates(nodes, False, "label", "tried").groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max(F.struct("likely", "a", "b", "ca", "cb")).alias("p"))
    pick = materialize(pick.select("p.a", "p.b", "p.ca", "p.cb"), "neardup-pick")
    merges.append(components(confirm(pick).join(pick, ["a", "b"]), "ca", "cb"))
    tidy_driver(source.sparkSession)
    # The crowd, exactly.  In each run its commonest component is set against the rows of
    # all others: these, the queries, meet every row of the crowd in blocks.
    marked = crowd.withColumn("label", F.col("id"))
    for found in merges:
        marked = relabel(marked, "label", found)
    marked = materialize(sets.join(maybe_broadcast(marked), "id"), "neardup-marked")
    runs = deep.join(maybe_broadcast(full), ["tree", "values"], "left_semi").join(marked.select("id", "label"), "id")
    parts = runs.groupBy("tree", "values", "label").count()
    main = parts.groupBy("tree", "values").agg(F.max(F.struct("count", "label")).getField("label").alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    asked = runs.join(main, ["tree", "values"]).filter("label <> main").select("id").distinct()
    asked = materialize(marked.join(maybe_broadcast(materialize(asked, "neardup-asked")), "id"), "neardup-queries")
    blocks = -(-(asked.agg(F.sum(F.octet_length("set"))).first()[0] or 0) // BLOCK_BYTES)
    met = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        if not rows:
            continue
        shared = source.sparkSession.sparkContext.broadcast(_block(rows))
        one = materialize(marked.mapInArrow(tidied(_search(similarity, shared)), "ca long, cb long"), "neardup-met")
        shared.destroy()
        met = one if met is None else met.unionByName(one)
    if met is not None:
        merges.append(components(met, "ca", "cb"))

    # Every candidate that still lies between two components, but for the crowd's rows
    # that the search has set against each other.
    for found in merges[1:]:
        nodes = relabel(nodes, "label", found)
    marks = marked.select("id", F.lit(1).alias("m")).unionByName(asked.select("id", F.lit(2).alias("m"))).groupBy("id").agg(F.max("m").alias("mark"))
    nodes = nodes.join(maybe_broadcast(materialize(marks, "neardup-marks")), "id", "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    left = candidates(nodes, True, "label", "tried", "mark").join(pick.select("a", "b"), ["a", "b"], "left_anti")
    left = materialize(left.select("a", "b", "ca", "cb"), "neardup-left")
    merges.append(components(confirm(left).join(left, ["a", "b"]), "ca", "cb"))

    tidy_driver(source.sparkSession)
    # Members of a class share its component, which is named by its smallest doc_id.
    of_class = classes.select("n", "hi", "lo", "doc_id", F.col("id").alias("own"))
    for found in merges:
        of_class = relabel(of_class, "own", found)
    of_class = materialize(of_class, "neardup-of-class")
    named = of_class.groupBy("own").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes")).filter("classes > 1").drop("classes")
    of_class = of_class.join(named, "own", "left").select("n", "hi", "lo", F.coalesce("component_id", "doc_id").alias("component_id"))
    empty = sketched.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = own.join(of_class, ["n", "hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = linked.unionByName(empty)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
