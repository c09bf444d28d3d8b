"""Numbers from 0 in an order, without a sort or a window in one task.

Rows are dealt into ranges of the order and sorted inside; the ranges' sizes are summed
up before them (a row a range), so a number is the sum before its range plus its place
in it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.index import scratch

#: Bits of ``monotonically_increasing_id`` below the partition's number.
_PLACE = 33


def numbered(rows: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2, ... in the order, whose keys should be distinct.  The
    ranged rows are written to the shared folder, so that their places stay as they are."""
    spark = rows.sparkSession
    path = f"{scratch(spark)}/numbered-{uuid.uuid4().hex}"
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    held = spark.read.schema(ranged.schema).parquet(path).withColumn("_part", F.shiftright("_place", _PLACE).cast("int"))
    before, at = [], 0
    for r in held.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row a range
        before.append((r["_part"], at))
        at += r["n"]
    side = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
    place = F.col("_place").bitwiseAND(F.lit((1 << _PLACE) - 1))
    return held.join(side, "_part").select(*rows.columns, (F.col("_before") + place).alias(name))
