"""Shared plumbing of the training-data operators.

Nothing here holds corpus data on the driver.  Intermediate tables that cut
lineage are written as Parquet under the folder the session names in
``spark.checkpoint.dir``, so they survive the loss of any executor.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z, the only letters that the word contracts lower-case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Largest row count of a side that is broadcast; callers count it first.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.  Where none is set, a local session (a
    test) makes one; a cluster is told to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table.

    The returned frame has no lineage beyond its files, so a lost executor costs
    a reread and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidied(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` that gives what it freed back to the system when it ends: a Python
    worker lives on through all later stages, beside the JVM of its executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def trim_driver(spark: SparkSession) -> bool:
    """Have the driver's JVM give native memory that it has freed (compilers, buffers)
    back to the system, as jcmd's System.trim_native_heap does.  False where the JVM
    has no such command (it is glibc's); nothing else depends on it."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    found = jvm.java.lang.Class.forName
    kinds = array(jvm.java.lang.Class, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = found(name)
    given = array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    try:
        found("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return False
    return True


def tidy_driver(spark: SparkSession) -> None:
    """Have the driver let go of finished plans, broadcasts and shuffles; a long job
    calls it between its steps."""
    gc.collect()
    spark._jvm.System.gc()
    trim_driver(spark)


def fit_in_task(rows: DataFrame, fit: Callable[[pa.Table | None], Any]) -> Any:
    """``fit`` over all of a bounded frame, in one executor task, which a lost executor
    only repeats; its result comes back to the driver, the rows do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        made = fit(pa.Table.from_batches(own) if own else None)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made, protocol=5)], pa.binary())], names=["made"])

    found = rows.repartition(1).mapInArrow(tidied(run), "made binary").collect()  # one row
    return pickle.loads(bytes(found[0]["made"])) if found else fit(None)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without input columns that an operator is about to make."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``limit`` rows (stops counting beyond)."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a check of the size; else a plain frame, which
    Spark joins by shuffle with adaptive skew splitting."""
    return F.broadcast(df) if bounded(df, limit) else df


def lower_ascii(col):
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def hex_sha256(col):
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(F.encode(col, "UTF-8"), 256)
