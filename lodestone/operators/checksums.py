"""Checksums of a generation's files, by ranges.

A file's checksum is the SHA-256 of the SHA-256 digests of its ranges of ``RANGE`` bytes,
so tasks hash ranges side by side and a file of any size needs no more than one range
in memory.  Ranges are read where the file system has a Python reader (local, HDFS and
the common object stores); elsewhere Spark's own binary reader gives the same sums,
for files up to its limit of 2 GB.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from lodestone.operators.index import Files

RANGE = 64 << 20
#: Scheme and host of an address.
URI = r"^[^:/]+:(//[^/]*)?"
READABLE = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def _files(spark: SparkSession, path: str) -> Files:
    from lodestone.operators.index import Files

    return Files(spark, path)


def sums(spark: SparkSession, path: str, folders: list[str], *, size: int = RANGE) -> DataFrame:
    """(name, bytes, sha256) of all files of ``folders`` under ``path``; hidden ones are left
    out.  One row a file comes back from each; the listing alone is on the driver."""
    files = _files(spark, path)
    found = {f"{folder}/{name}": n for folder in folders if files.exists(f"{path}/{folder}") for name, n in files.sizes(f"{path}/{folder}").items()}
    root = files.qualified(path)
    scheme = root.split(":", 1)[0]
    if scheme not in READABLE:
        return _by_binary_reader(spark, path, found, size)
    parts = [(name, i, at, min(size, n - at)) for name, n in found.items() for i, at in enumerate(range(0, max(n, 1), size))]
    ranges = spark.createDataFrame(parts, "name string, part int, at long, n long").repartition(max(1, min(len(parts), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            rows, digests = batch.to_pylist(), []
            for r in rows:
                with system.open_input_file(f"{base}/{r['name']}") as f:
                    digests.append(hashlib.sha256(f.read_at(r["n"], r["at"]) if r["n"] else b"").digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(digests, pa.binary())], names=["name", "part", "n", "digest"])

    hashed = ranges.mapInArrow(run, "name string, part int, n long, digest binary")
    # As many digests a file as it has ranges: 32 bytes for each 64 MB.
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: F.hex(x["digest"])), ""))
    return hashed.groupBy("name").agg(F.sum("n").alias("bytes"), F.sha2(joined, 256).alias("sha256"))


def _by_binary_reader(spark: SparkSession, path: str, found: dict[str, int], size: int) -> DataFrame:
    top = max(found.values(), default=0)
    if top >= 2**31 - 1:
        raise ValueError(f"a file of {top} bytes is beyond Spark's binary reader")
    top_path = re.sub(URI, "", _files(spark, path).qualified(path))
    held = {n for n, b in found.items() if b}
    none = hashlib.sha256(hashlib.sha256().digest()).hexdigest()
    empty = spark.createDataFrame([(n, 0, none) for n, b in found.items() if not b], "name string, bytes long, sha256 string")
    if not held:
        return empty
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{path}/{f}" for f in sorted({n.split("/", 1)[0] for n in held})])
    name = F.substring(F.regexp_replace("path", URI, ""), len(top_path) + 2, 1 << 20)
    digests = F.expr(f"transform(sequence(0L, (length - 1) div {size}), i -> sha2(substring(content, cast(i * {size} + 1 as int), {size}), 256))")
    return read.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2(F.unhex(F.array_join(digests, "")), 256).alias("sha256")).unionByName(empty)


def write(spark: SparkSession, path: str, folders: list[str]) -> None:
    """Store the sums beside the tables, as ``path/checksums``."""
    sums(spark, path, folders).coalesce(1).write.mode("overwrite").parquet(f"{path}/checksums")  # a row a file


def verify(spark: SparkSession, path: str) -> None:
    """Refuse a generation with a file that is missing, new, or other than it was."""
    held = spark.read.parquet(f"{path}/checksums")
    folders = [r["f"] for r in held.select(F.substring_index("name", "/", 1).alias("f")).distinct().collect()]  # a row a table
    now = sums(spark, path, folders).select("name", F.struct("bytes", "sha256").alias("now"))
    both = held.select("name", F.struct("bytes", "sha256").alias("then")).join(now, "name", "full")
    bad = both.filter("NOT (then <=> now)").orderBy("name").select("name").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['name']} is not what was written")
