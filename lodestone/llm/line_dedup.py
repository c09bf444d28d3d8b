"""Line deduplication with two Bloom filters.

Pass 1 gives each task two bit arrays over hashes of its line keys: *once* (seen)
and *twice* (seen again in another document).  Arrays are cut into blocks and
merged block by block on the executors: once by OR; twice by OR, plus the bits set
in two tasks' once arrays.  A key of two documents has all its bits in the merged
twice filter; some others have too (false positives), none is missed.

Pass 2 sends only keys that the twice filter suspects to a shuffle, where
min(doc_id) <> max(doc_id) confirms on the key itself and names the first
document.  Keys in more than ``HOT_ROWS`` documents (and one in ``HOT_SHARE`` rows, so
they are few) are joined by broadcast, the others by shuffle.  Documents without a
suspect finish in the scan; only the rest are joined with their lines to drop.

The filter has 8 bits a line, within ``max_filter_bits``, which is the bound of
what is broadcast.  Beyond it more lines are suspects, up to all of them, which costs
a shuffle of all keys; results stay exact.

Defined results: null text is one empty line; a null doc_id keeps all its lines
and makes no line repeated; rows that repeat a doc_id are one document for the
rule and stay separate rows; an empty table gives an empty result.  Other columns
are passed through whatever their names, except that names starting with
``_ld_`` are reserved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm.common import hex_sha256, materialize, table, tidied

MIN_POINTS = 10
MAX_FILTER_BITS = 1 << 30
BLOCK_BITS = 1 << 18
#: A key of more rows than this, and than one in HOT_SHARE rows, is hot.
HOT_ROWS = 10_000
HOT_SHARE = 1000
STRIP = b" \t\n\x0b\x0c\r"


def long_keys(data: np.ndarray, off: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lower-cased bytes, text, start, end, hash) of the keys of at least ``least``
    code points, a stretch of the texts at a time."""
    for at, lowered, cut in K.stretches(data, off, K.NEWLINE):
        starts, ends, _ = K.word_spans(lowered, cut, K.NEWLINE)
        solid = np.flatnonzero(~K.SPACE[lowered])
        if not len(starts) or not len(solid):
            continue
        a = solid[np.minimum(np.searchsorted(solid, starts), len(solid) - 1)]
        b = solid[np.maximum(np.searchsorted(solid, ends) - 1, 0)] + 1
        points = np.concatenate([[0], np.cumsum((lowered & 0xC0) != 0x80)])
        good = (a >= starts) & (b <= ends) & (a < b)
        good[good] = points[b[good]] - points[a[good]] >= least
        a, b = a[good], b[good]
        yield lowered, np.searchsorted(off, a + at, "right") - 1, a, b, K.word_hashes(lowered, a, b)


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Positions of each hash's three bits, one row a hash."""
    h = hashes[:, None]
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + np.arange(3, dtype=np.uint64) * step) & np.uint64(bits - 1)).astype(np.int64)


def _build(bits: int, least: int):
    """Task function of pass 1: (block, once, twice), compressed, for blocks with bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Hashes with their documents, cleared into the bit arrays now and then.
        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)

        def test(array, hashes):
            at = _bits(hashes, bits)
            return ((array[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

        def put(array, hashes):
            at = _bits(hashes, bits).ravel()
            np.bitwise_or.at(array, at >> 3, (1 << (at & 7)).astype(np.uint8))

        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids, parts = batch.column(0).to_numpy(), []
            for part, data, off in K.chunks(batch):
                first = part.column(0).to_numpy()
                parts += [(h, first[row]) for _, row, _, _, h in long_keys(data, off, least)]
            if not parts or not len(ids):
                continue
            h, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
            # Within the batch: the same hash in two documents.
            order = np.lexsort((docs, h))
            h, docs = h[order], docs[order]
            same = np.flatnonzero((h[1:] == h[:-1]) & (docs[1:] != docs[:-1]))
            unique = np.unique(h)
            again = np.union1d(h[same], unique[test(once, unique)])
            put(twice, again)
            put(once, unique)
        size = BLOCK_BITS >> 3
        for b in range(max(1, len(once) // size)):
            one, two = once[b * size : (b + 1) * size], twice[b * size : (b + 1) * size]
            if one.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([zlib.compress(one.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(two.tobytes(), 1)], pa.binary())],
                    names=["block", "once", "twice"],
                )

    return run


def _merge(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge one block's arrays; a stream, so that many tasks' rows need no memory."""
    once = twice = None
    for batch in rows:
        for one, two in zip(batch.column("once"), batch.column("twice"), strict=True):
            a = np.frombuffer(zlib.decompress(one.as_py()), np.uint8)
            b = np.frombuffer(zlib.decompress(two.as_py()), np.uint8)
            if once is None:
                once, twice = a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if twice is not None and twice.any():
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["block", "twice"])


def twice_filter(docs: DataFrame, doc_id: str, text: str, *, bits: int, least: int) -> np.ndarray:
    """The merged twice filter, at most ``bits / 8`` bytes."""
    part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(_build(bits, least)), "block int, once binary, twice binary")
    merged = part.groupBy("block").applyInArrow(_merge, "block int, twice binary")
    out, size = np.zeros(bits >> 3, np.uint8), min(bits, BLOCK_BITS) >> 3
    for row in merged.toLocalIterator():  # a filter of bounded size, not the corpus
        out[row["block"] * size : row["block"] * size + size] = np.frombuffer(zlib.decompress(bytes(row["twice"])), np.uint8)
    return out


def filter_bits(docs: DataFrame, text: str, most: int) -> int:
    """A power of two of about 8 bits a line, within ``most``."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.sum(F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"] or 1
    return min(1 << max(18, (8 * int(lines)).bit_length()), most)


def _suspects(shared, bits: int, least: int, keys: bool):
    """Task function of pass 2: distinct suspected keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in batches:
            for part, data, off in K.chunks(batch, batch.schema.names[1]):
                ids = part.column(0)
                marked = np.zeros(part.num_rows, bool)
                owner, found = [], []
                for lowered, row, a, b, h in long_keys(data, off, least):
                    at = _bits(h, bits)
                    hit = np.flatnonzero(((twice[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))
                    marked[row[hit]] = True
                    if keys and len(hit):
                        # Once a document, or in a long one once a stretch.
                        order = hit[np.lexsort((h[hit], row[hit]))]
                        order = order[np.concatenate([[True], (np.diff(row[order]) != 0) | (h[order][1:] != h[order][:-1])])]
                        owner.append(row[order])
                        raw = lowered.tobytes()
                        found += [raw[s:e].decode() for s, e in zip(a[order].tolist(), b[order].tolist(), strict=True)]
                if keys:
                    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
                    rows = pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(found, pa.string())], names=["doc_id", "key"])
                    yield rows.filter(rows.column(0).is_valid())
                else:
                    marked &= ~np.array(ids.is_null())
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marked)], names=[*part.schema.names, "_ld_suspect"])

    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: text without its lines of dropped keys, lines before, dropped."""
    for batch in batches:
        row, texts, keys = batch.columns
        kept, lines, dropped = [], [], []
        for text, gone in zip(texts, keys, strict=True):
            parts, gone = (text.as_py() or "").split("\n"), gone.as_py()
            if gone:
                gone = {x.encode() for x in gone}
                rest = [x for x in parts if x.encode().strip(STRIP).lower() not in gone]
            else:
                rest = parts
            kept.append("\n".join(rest))
            lines.append(len(parts))
            dropped.append(len(parts) - len(rest))
        yield pa.RecordBatch.from_arrays([row, pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["_ld_row", "_ld_text", "_ld_lines", "_ld_dropped"])


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_points: int = MIN_POINTS, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines`` (before)
    and ``n_dropped`` as columns ``_ld_lines`` and ``_ld_dropped``."""
    spark = docs.sparkSession
    bits = filter_bits(docs, text, max_filter_bits)
    twice = twice_filter(docs, doc_id, text, bits=bits, least=min_points)
    shared = spark.sparkContext.broadcast(twice)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    suspects = narrow.mapInArrow(tidied(_suspects(shared, bits, min_points, True)), "doc_id long, key string")
    suspects = materialize(suspects, "line-suspects")
    first = suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).filter("first <> last").select("key", "first", "rows")
    first = materialize(first, "line-first")
    limit = max(HOT_ROWS, suspects.count() // HOT_SHARE)
    hot = F.broadcast(first.filter(F.col("rows") > limit).select("key", "first"))  # HOT_SHARE rows at most
    cold = suspects.join(hot.select("key"), "key", "left_anti").join(first.filter(F.col("rows") <= limit).select("key", "first"), "key")
    drop = cold.unionByName(suspects.join(hot, "key")).filter("doc_id <> first").groupBy(F.col("doc_id").alias("_ld_doc")).agg(F.collect_set("key").alias("_ld_keys"))

    others = [c for c in docs.columns if c not in (doc_id, text)]
    row = docs.select(F.col(doc_id).cast("long").alias("_ld_id"), F.col(text).alias("_ld_text"), F.struct(*[F.col(f"`{c}`") for c in [doc_id, *others]]).alias("_ld_row"))
    kind = row.schema["_ld_row"].dataType.simpleString()
    flagged = row.mapInArrow(tidied(_suspects(shared, bits, min_points, False)), f"_ld_id long, _ld_text string, _ld_row {kind}, _ld_suspect boolean")

    value = F.coalesce("_ld_text", F.lit(""))
    lines = F.split(value, "\n", -1)
    clean = flagged.filter(~F.col("_ld_suspect")).select("_ld_row", value.alias("_ld_text"), F.size(lines).cast("long").alias("_ld_lines"), F.lit(0).cast("long").alias("_ld_dropped"))
    mixed = flagged.filter("_ld_suspect").join(drop, F.col("_ld_id") == F.col("_ld_doc"), "left").select("_ld_row", "_ld_text", "_ld_keys")
    mixed = mixed.mapInArrow(tidied(_drop), f"_ld_row {kind}, _ld_text string, _ld_lines long, _ld_dropped long")
    both = clean.unionByName(mixed)
    return both.select(*[F.col("_ld_text").alias(c) if c == text else F.col(f"_ld_row.`{c}`").alias(c) for c in docs.columns], "_ld_lines", "_ld_dropped")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), hex_sha256(F.col("text")).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(d.parts) AS line, generate_subscripts(d.parts, 1) AS pos) u
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.first_doc IS NOT NULL AND f.first_doc <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE f.first_doc IS NULL OR f.first_doc = l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN firsts f ON f.key = l.key
GROUP BY l.doc_id
"""
