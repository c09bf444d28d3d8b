import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import vector as V
from lodestone.operators import exact, ivfpq, search


def _vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(700, 8)))]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, [0.0] * 8), (2001, None), (2002, [1.0, None] + [0.5] * 6), (2003, [float("nan")] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def _asks(rows):
    return rows.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _plain(rows, asks, k, score):
    scored = rows.crossJoin(asks).select("query_id", "vec_id", F.round(score(F.col("embedding"), F.col("query")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _set(rows):
    return sorted(repr(tuple(r)) for r in rows.select("query_id", "vec_id", "score", "rank").collect())


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    """Copies that tie, vectors of zeros, null ones, and ones that hold null or NaN."""
    monkeypatch.setattr(exact, "VECTOR_ROWS", 50)
    monkeypatch.setattr(exact, "QUERY_ROWS", 16)
    monkeypatch.setattr(exact, "SIDE_QUERIES", 32)
    rows = _vectors(spark)
    for score in (V.cosine, V.dot):
        for k in (1, 10, 770):
            assert _set(search.topk_batch(rows, _asks(rows), k, score=score)) == _set(_plain(rows, _asks(rows), k, score))


def test_exact_takes_a_frame_and_no_task_holds_all_pairs(spark, monkeypatch):
    """A task's matrix is a block of queries by a block of vectors, whatever their numbers."""
    monkeypatch.setattr(exact, "QUERY_ROWS", 100)
    monkeypatch.setattr(exact, "VECTOR_ROWS", 200)
    rows = _vectors(spark).filter("vec_id < 2000")
    plan = ivfpq.exact(rows, _asks(rows), 5, row_id="vec_id")
    assert "CartesianProduct" in plan._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in plan._jdf.queryExecution().toString()
    want = _set(_plain(rows, _asks(rows), 5, V.cosine))
    assert _set(plan.withColumnRenamed("row_id", "vec_id")) == want


def test_more_queries_than_a_broadcast_held(spark):
    """10,001 queries were refused."""
    rows = spark.range(20_002).select(F.col("id").alias("vec_id"), F.array(F.cos(F.col("id").cast("double")), F.sin(F.col("id").cast("double"))).alias("embedding"))
    got = search.topk_batch(rows, rows.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 2)
    assert got.filter("rank = 1 AND vec_id = query_id").count() == 10_001
