"""Streaming ingest: files in order, first version of an id wins, exactly once.

Each micro-batch is deduplicated, anti-joined with the keys of earlier batches, and
written to its own ``batch_id`` partition, which a retried batch overwrites.  Keys lie
in a table of their own, partitioned by a bucket of their hash, of which a batch reads
only the buckets it has keys in.  The stream's checkpoint is the resume state; a batch
counts when its checkpoint entry is written, after both tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.index import Files
from lodestone.sources.works import first_wins

KEY_BUCKETS = 256


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, *, schema, key: str, order: list[str], files_per_batch: int = 1, snapshot: Callable[[], str] | None = None) -> DataFrame:
    """Run over all files now in ``source`` (Parquet) and return the sink's table.  If
    ``snapshot`` gives another identity than at the start, the run stops."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    keys = f"{sink.rstrip('/')}-keys"
    begun = snapshot() if snapshot else None

    def unchanged() -> None:
        if snapshot and snapshot() != begun:
            raise RuntimeError("the snapshot changed during the ingest")

    def put(rows: DataFrame, path: str, *parts: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        unchanged()
        new = first_wins(batch, key, *order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int"))
        if Files(batch.sparkSession, keys).exists(keys):
            wanted = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # KEY_BUCKETS at most
            seen = batch.sparkSession.read.parquet(keys).filter(F.col("bucket").isin(wanted) & (F.col("batch_id") < batch_id)).select(key)
            new = new.join(seen, key, "left_anti")
        new = new.withColumn("batch_id", F.lit(batch_id))
        put(new.drop("bucket"), sink, "batch_id")
        put(batch.sparkSession.read.schema(new.drop("bucket").schema).parquet(sink).filter(F.col("batch_id") == batch_id).select(key, F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int").alias("bucket"), "batch_id"), keys, "bucket", "batch_id")
        unchanged()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink)
