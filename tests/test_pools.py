"""Pools of query sets by blocks, and shards that share a job."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import ivfpq, pools
from lodestone.plans import service

DIM, N = 16, 1500


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, DIM))[rng.integers(0, 30, N)] + 0.35 * rng.normal(size=(N, DIM))
    x[700:1000] = x[700]  # one list of many equal vectors
    x[5] = 0
    rows = [(i, i // 100, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, shard int, embedding array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def built(vectors, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pools") / "pq")
    ivfpq.build(vectors, out, ivfpq.Settings(40, codes=64))
    return out


def test_pools_are_those_of_single_searches(spark, vectors, built, monkeypatch):
    monkeypatch.setattr(pools, "CELLS", 40 * 7)  # blocks of 7 queries
    asks = vectors.filter("id % 60 = 5 OR id = 701").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    rows = pools.pools(spark, built, asks, nprobes=(2, 5, 1000), k=30).collect()
    given = {r["query_id"]: list(r["query"]) for r in asks.collect()}
    for n in (2, 5, 1000):
        got = {(r["query_id"], r["row_id"]): r for r in rows if r["nprobe"] == n}
        want = ivfpq.search(spark, built, given, nprobe=n, k=30).collect()
        assert len(got) == len(want)
        # Values may differ in their sixth place, where single searches add float32.
        for i in given:
            one, two = (sorted((r["approx"] for r in own if r["query_id"] == i), reverse=True) for own in (got.values(), want))
            assert np.allclose(one, two, atol=2e-6)
        places = sorted((r["query_id"], -r["approx"], r["row_id"]) for r in got.values())
        own = [sum(q == i for q, _, _ in places) for i in sorted(given)]
        assert max(own) == 30 and [got[q, r]["place"] for q, _, r in places] == [p + 1 for n in own for p in range(n)]
    wanted = asks.withColumn("wanted", F.array(F.col("query_id"), F.lit(710).cast("long")))
    some = {tuple(r) for r in pools.pools(spark, built, wanted, nprobes=(2, 5, 1000), k=30).collect()}
    assert some == {tuple(r) for r in rows if r["row_id"] in (r["query_id"], 710)}
    assert pools.pools(spark, built, asks.limit(0), nprobes=(2,), k=3).collect() == []


def test_truth_rows_stay_in_a_frame(spark, tmp_path):
    spark.createDataFrame([(i, "a") for i in range(30)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    truth = service._truth(spark, str(tmp_path))
    assert isinstance(truth, DataFrame) and sorted(r["query_id"] for r in truth.collect()) == [0, 7, 14, 21, 28]


def test_shards_share_jobs(spark, vectors, built, tmp_path):
    """15 shards take no more jobs than 3 and give the same codes."""

    def jobs(rows, name):
        spark.sparkContext.setJobGroup(name, name)
        ivfpq.build(rows, str(tmp_path / name), ivfpq.Settings(40, codes=64))
        spark.sparkContext._jsc.clearJobGroup()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few = jobs(vectors.withColumn("shard", (F.col("shard") / 5).cast("int")), "few")
    assert jobs(vectors, "many") <= few + 6
    codes = lambda out: sorted((r["row_id"], r["list_id"], bytes(r["pq"])) for r in spark.read.parquet(f"{out}/codes").collect())
    assert codes(tmp_path / "many") == codes(built)


def test_groups_of_shards():
    counts = {0: 400_000, 1: 500_000, 2: 200_000, 3: 3_000_000, 4: 1}
    assert ivfpq._groups(list(counts), counts) == [[0, 1], [2], [3], [4]]
