"""Build bookkeeping as queries: shard history, progress, differences, checks."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.numbering import numbered

#: Most rows of a block, which one task compresses.
MAX_BLOCK = 65_536


def config_history(markers: DataFrame) -> DataFrame:
    """Runs of shards with one configuration: first, last and the configuration."""
    w = Window.orderBy("shard")  # one row a shard: a bounded log
    change = F.when(F.col("config") != F.lag("config").over(w), 1).otherwise(0)
    runs = markers.withColumn("c", change).withColumn("run", F.sum("c").over(w))
    return runs.groupBy("run", "config").agg(F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard")).select("config", "first_shard", "last_shard")


def progress(markers: DataFrame) -> DataFrame:
    """Shards and records of the longest prefix without a gap whose running sums agree."""
    w = Window.orderBy("shard")
    seen = markers.withColumn("n", F.row_number().over(w) - 1).withColumn("run", F.sum("records").over(w))
    good = seen.withColumn("ok", (F.col("shard") == F.col("n")) & (F.col("run") == F.col("records_done")))
    kept = good.withColumn("all_ok", F.min(F.col("ok").cast("int")).over(w)).filter("all_ok = 1")
    return kept.agg(F.count("*").alias("shards"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with repeats: ``side`` and the columns."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def field_bytes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, bytes, distinct_values) of string columns, in one pass."""
    sums = rows.agg(*[F.sum(F.octet_length(c)).alias(f"b_{c}") for c in columns], *[F.count_distinct(c).alias(f"d_{c}") for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"b_{c}").alias("bytes"), F.col(f"d_{c}").alias("distinct_values")) for c in columns])).alias("x")).select("x.*")


def recall_at(results: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """By query type: queries, and the share whose first right result is within k."""
    first = labels.join(results, "query_id", "left").withColumn("hit", F.when(F.col("label") == F.col("expected"), F.col("rank")))
    best = first.groupBy("query_id", "type").agg(F.min("hit").alias("best"))
    return best.groupBy("type").agg(F.count("*").alias("queries"), *[F.round(F.avg(F.coalesce(F.col("best") <= k, F.lit(False)).cast("int")), 6).alias(f"recall_{k}") for k in ks])


def behaviour(results: DataFrame) -> DataFrame:
    """By query: scores in order, no repeated row, ranks without a gap."""
    w = Window.partitionBy("query_id").orderBy("rank")
    prior = results.withColumn("before", F.lag("score").over(w))
    return prior.groupBy("query_id").agg(
        F.bool_and(F.coalesce(F.col("before") >= F.col("score"), F.lit(True))).alias("sorted"),
        (F.count_distinct("vec_id") == F.count("*")).alias("no_repeats"),
        (F.max("rank") == F.count("*")).alias("no_gaps"),
    )


def block_compression(rows: DataFrame, order: str, fields: list[str], sizes: list[int], *, effort: int = 6) -> DataFrame:
    """(block_rows, field, blocks, bytes, compressed) of string columns: rows in ``order`` are
    cut into blocks of each size, and a block's values of a field, joined by a zero byte, are
    compressed (zlib) in the task that holds the block."""
    if not 0 < min(sizes) <= max(sizes) <= MAX_BLOCK:
        raise ValueError(f"a block has 1 to {MAX_BLOCK} rows")
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"f_{i}") for i, c in enumerate(fields)]
    held = numbered(rows.select(F.col(order).alias("o"), *texts), "o", name="pos")
    each = held.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("block_rows")).withColumn("block", F.expr("pos div block_rows"))

    def squeeze(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        raw = ["\0".join(part.column(f"f_{i}").to_pylist()).encode() for i in range(len(fields))]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(fields), pa.int32()), pa.array(fields), pa.array([len(x) for x in raw], pa.int64()), pa.array([len(zlib.compress(x, effort)) for x in raw], pa.int64())], names=["block_rows", "field", "bytes", "compressed"])

    one = each.groupBy("block_rows", "block").applyInArrow(squeeze, "block_rows int, field string, bytes long, compressed long")
    return one.groupBy("block_rows", "field").agg(F.count("*").alias("blocks"), F.sum("bytes").alias("bytes"), F.sum("compressed").alias("compressed"))


def checks(results: DataFrame, *, page: int = 5, pool: int | None = None) -> DataFrame:
    """By query, over (query_id, rank, vec_id, score, year, flagged, wanted, low, high): the
    first row is the wanted one, years are within bounds, the first is not flagged, the
    ranks of each page go on where the page before ended, and no rank is past the pool.
    ``wanted``, ``low`` and ``high`` may be null: nothing is asked then."""
    first = F.col("rank") == 1
    lacking = F.lit(True)
    pages = F.transform(F.array_sort(F.collect_list("rank")), lambda r: F.floor((r - 1) / page).cast("int"))
    full = F.transform(F.sequence(F.lit(0), F.greatest(F.count("*") - 1, F.lit(0))), lambda i: F.floor(i / page).cast("int"))
    return results.groupBy("query_id").agg(
        F.coalesce(F.bool_or(first & (F.col("vec_id") == F.col("wanted"))) | (F.count("wanted") == 0), lacking).alias("first_is"),
        F.bool_and(F.coalesce((F.col("year") >= F.col("low")) & (F.col("year") <= F.col("high")), lacking)).alias("years_within"),
        (~F.bool_or(first & F.col("flagged"))).alias("first_not_flagged"),
        (pages == full).alias("page_consistent"),
        (F.max("rank") <= F.lit(pool if pool is not None else 2**31 - 1)).alias("within_pool"),
    )
