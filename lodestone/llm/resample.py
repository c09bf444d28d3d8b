"""Target-distribution importance resampling with hashed word features.

Features are all runs of 1 to ``n`` words of a text, hashed into buckets by CRC-32.
The bucket counts of the corpus and of the target give each bucket a gain (the floored
log ratio of its smoothed shares); a document's weight is the floored mean gain of its
features, and a seeded Gumbel term on top makes the highest scores a weighted draw
without replacement.

Long texts are skewed work, so a text of more than ``CHUNK`` characters is cut at word
boundaries into chunks.  A chunk owns the features that start in it and carries the
``n - 1`` words behind it, so that features across a cut are counted once, by the chunk
they start in.  Chunks are written once, dealt evenly over the tasks, and their counts
and weights are summed by document; other texts are chunks of their own where they lie.
Only chunks of long texts are shuffled.

Counting hands on one row of ``buckets`` counts a task; the gains (``buckets`` whole
numbers) are all that reaches the driver.  The draw ranks by a range partition and the
sizes of the ranges before, so no task sorts all documents.

Defined results: a null or wordless text has no features and weight 0; a null doc_id
has weight and counts, but no score, is never drawn and not among the N that the draw's
size is a share of; rows that repeat a doc_id are scored, and may be drawn, one by one,
equal scores in the order of doc_id, weight and n_features; empty tables give no gain
and an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import kernels
from lodestone.llm.common import materialize, table, tidied

BUCKETS = 10_000
#: Characters of the longest text that is not cut.
CHUNK = 1 << 16
#: Bytes up to which words are hashed side by side.
SIDE_BY_SIDE = 32

CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each span; with ``before``, of the bytes of that CRC-32 and the span."""
    out = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    size = ends - starts
    short = np.flatnonzero(size <= SIDE_BY_SIDE)
    short = short[np.argsort(-size[short], kind="stable")]
    at, left, state = starts[short], size[short], ~out[short]
    for j in range(int(left.max(initial=0))):
        m = int(np.searchsorted(-left, -j, "left"))  # spans of more than j bytes
        state[:m] = CRC[(state[:m] ^ data[at[:m] + j]) & 0xFF] ^ (state[:m] >> np.uint32(8))
    out[short] = ~state
    for i in np.flatnonzero(size > SIDE_BY_SIDE):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(out[i]))
    return out


def _spaced(crc: np.ndarray) -> np.ndarray:
    """CRC-32 with one space behind."""
    state = ~crc
    return ~(CRC[(state ^ np.uint32(32)) & 0xFF] ^ (state >> np.uint32(8)))


def features(data: np.ndarray, off: np.ndarray, own: np.ndarray, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every feature of texts, one length of feature after another.
    ``own`` is how many first words of each text own features (-1: all)."""
    starts, ends, first = kernels.word_spans(data, off, kernels.NON_WORD)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(starts)) - first[:-1][text]
    owned = place < np.where(own < 0, count, own)[text]
    at, crc = np.flatnonzero(owned), None
    for k in range(n):
        on = place[at] + k < count[text[at]]  # the text goes on that far
        at, so_far = at[on], None if crc is None else _spaced(crc[on])
        crc = crc32(data, starts[at + k], ends[at + k], so_far)
        yield (crc % np.uint32(buckets)).astype(np.int64), text[at]


def cut(data: np.ndarray, n: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, words owned) of the chunks of one text of lower-cased bytes: about
    ``size`` bytes of own words, then up to ``n - 1`` words that are carried."""
    begun, ended = [], []
    for at, lowered, inner in kernels.stretches(data, np.array([0, len(data)]), kernels.NON_WORD):
        starts, ends, _ = kernels.word_spans(lowered, inner, kernels.NON_WORD)
        begun.append(starts + at)
        ended.append(ends + at)
    starts, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begun, ended))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + size)))
        last = min(j + n - 1, len(starts))
        yield int(starts[i]), int(ends[last - 1]), j - i
        i = j


def chunked(docs: DataFrame, *, doc_id: Column, text: str, n: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, text, own) of the texts that are not cut (rid null, own -1), and of
    the chunks of the others, written to the shared folder."""
    base = docs.select(doc_id.alias("doc_id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = base.filter(~is_long).select(F.lit(None).cast("bigint").alias("rid"), "doc_id", "text", F.lit(-1).cast("bigint").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = kernels.text_bytes(batch.column(2))
            for i in range(batch.num_rows):
                raw = data[off[i] : off[i + 1]]
                pieces = list(cut(raw, n, chunk)) or [(0, 0, 0)]
                head = batch.slice(i, 1)
                for a, b, own in pieces:
                    yield pa.RecordBatch.from_arrays([head.column(0), head.column(1), pa.array([raw[a:b].tobytes().decode()], pa.string()), pa.array([own], pa.int64())], names=["rid", "doc_id", "text", "own"])

    longs = base.filter(is_long).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    schema = f"rid bigint, doc_id {base.schema['doc_id'].dataType.simpleString()}, text string, own bigint"
    spread = longs.mapInArrow(tidied(run), schema).repartition(docs.sparkSession.sparkContext.defaultParallelism * 4)
    return short, materialize(spread, "chunks")


def _lots(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """Slices of bounded text, their features and their numbers of owned words."""
    for batch in batches:
        for part, data, off in kernels.chunks(batch):
            lowered, own = kernels.LOWER[data], part.column(part.schema.get_field_index("own")).to_numpy(zero_copy_only=False)
            yield part, features(lowered, off, own, n, buckets), own


def bucket_counts(chunks: list[DataFrame], n: int, buckets: int) -> np.ndarray:
    """How many features fall in each bucket, over all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, found, _ in _lots(batches, n, buckets):
            for bucket, _ in found:
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["b", "n"])

    parts = [c.select("text", "own").mapInArrow(tidied(run), "b int, n bigint") for c in chunks]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = np.zeros(buckets, np.int64)
    for r in both.groupBy("b").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows
        out[r["b"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares), by bucket."""
    m = len(corpus)
    s_all, t_all = float(int(corpus.sum()) + m), float(int(target.sum()) + m)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(chunks: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """rid, doc_id, words, n_features and total gain of each chunk."""
    buckets, id_type = len(gain), chunks.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, own in _lots(batches, n, buckets):
            words, total, count = None, np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for bucket, text in found:
                here = np.bincount(text, minlength=part.num_rows)
                words = here if words is None else words  # features of one word
                count += here
                np.add.at(total, text, gain[bucket])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in (words, count, total)]], names=["rid", "doc_id", "words", "n_features", "gain"])

    return chunks.select("rid", "doc_id", "text", "own").mapInArrow(tidied(run), f"rid bigint, doc_id {id_type}, words bigint, n_features bigint, gain bigint")


def drawn(scored: DataFrame, few: int, order: list) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3, ... of the first ``few`` rows in ``order``, null
    beyond.  Rows without a score come last and have no rank."""
    spark = scored.sparkSession
    ranges = scored.filter("able").repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")
    sizes = sorted((r["_part"], r["n"]) for r in ranges.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row a range
    before, at = [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    side = F.broadcast(spark.createDataFrame(before, "_part int, _before bigint"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    ranked = ranges.join(side, "_part").withColumn("rank", place.cast("bigint")).withColumn("rank", F.when(F.col("rank") <= few, F.col("rank")))
    rest = scored.filter("NOT able").withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.select(*scored.columns, "rank").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 2, buckets: int = BUCKETS, percent: int = 25, min_words: int = 20, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null where
    not drawn)."""
    short, longs = chunked(docs, doc_id=F.col(doc_id), text=text, n=n, chunk=chunk)
    wanted = chunked(target, doc_id=F.lit(None).cast("bigint"), text=target_text, n=n, chunk=chunk)
    gain = gains(bucket_counts([short, longs], n, buckets), bucket_counts(list(wanted), n, buckets))
    by_doc = weighed(longs, gain, n).groupBy("rid").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("words", "n_features", "gain")])
    docs_ = weighed(short, gain, n).unionByName(by_doc)
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("bigint")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = docs_.select("doc_id", F.col("words").alias("n_words"), "n_features", mean.alias("weight"))
    scored = scored.withColumn("score", (F.col("weight") + noise).cast("bigint")).withColumn("able", F.coalesce((F.col("n_words") >= min_words) & F.col("score").isNotNull(), F.lit(False)))
    scored = materialize(scored, "scored")
    few = percent * scored.filter("able").count() // 100
    order = [F.col("score").desc(), F.col("doc_id"), F.col("weight").desc(), F.col("n_features").desc(), F.col("n_words").desc()]
    return drawn(scored, few, order).drop("able")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_FEATURES = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

#: CRC-32 by eight shifts a byte over the hexadecimal form of the UTF-8 bytes; the
#: initial value is the first element of the fold.
_BIT = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, octet_length(encode(f))), lambda i: CAST(('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2]) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


def _op12_sql() -> str:
    tab = "range(0, 256)"
    for _ in range(8):
        tab = f"list_transform({tab}, lambda x: {_BIT.format(x='x')})"
    return rf"""
WITH t AS MATERIALIZED (SELECT {tab} AS tab),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS MATERIALIZED (SELECT rid, f, count(*) AS n FROM (SELECT rid, unnest({_FEATURES}) AS f FROM d) GROUP BY ALL),
bf AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest({_FEATURES}) AS f FROM b) GROUP BY ALL),
h AS MATERIALIZED (SELECT f, {_CRC} % 10000 AS k FROM (SELECT f FROM df UNION SELECT f FROM bf), t),
s AS (SELECT k, sum(n) AS s FROM df JOIN h USING (f) GROUP BY k),
q AS (SELECT k, sum(n) AS t FROM bf JOIN h USING (f) GROUP BY k),
g AS MATERIALIZED (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM df)::DOUBLE + 10000)
        / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM bf)::DOUBLE + 10000)))) AS BIGINT) AS g
      FROM s FULL JOIN q USING (k)),
m AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * g) AS BIGINT) AS g FROM df JOIN h USING (f) JOIN g USING (k) GROUP BY rid),
v AS (SELECT d.doc_id, len(w) AS words, coalesce(m.n, 0) AS n_features,
        CASE WHEN m.n > 0 THEN (m.g - ((m.g % m.n) + m.n) % m.n) // m.n ELSE 0 END AS weight,
        CAST('0x' || sha256('7:' || CAST(d.doc_id AS VARCHAR))[1:8] AS BIGINT) AS h
      FROM d LEFT JOIN m ON m.rid = d.rid),
w AS (SELECT doc_id, words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score FROM v),
r AS (SELECT *, words >= 20 AND score IS NOT NULL AS able,
        row_number() OVER (PARTITION BY words >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id, weight DESC, n_features DESC, words DESC) AS place
      FROM w)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN able AND place <= (SELECT count(*) * 25 // 100 FROM r WHERE able) THEN CAST(place AS BIGINT) END AS rank
FROM r
"""


OP12_SQL = _op12_sql()
