"""Product codes: resume, assignment by two levels, recall, search through an index."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import engine, ivfpq
from lodestone.operators import index as I
from lodestone.operators import papers as P

DIM, N = 16, 3000
SCHEMA = "id long, shard int, embedding array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    """40 groups of close vectors, in three shards; some of length zero."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, DIM))[rng.integers(0, 40, N)] + 0.35 * rng.normal(size=(N, DIM))
    x[[5, 1500]] = 0
    rows = [(i, i // 1000, v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def _codes(spark, out):
    return {(r["row_id"], r["super_id"], r["list_id"], bytes(r["pq"])) for r in spark.read.parquet(f"{out}/codes").collect()}


@pytest.fixture(scope="module")
def built(spark, vectors, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pq") / "whole")
    assert ivfpq.build(vectors[1], out, ivfpq.Settings(64, codes=64))["records"] == N
    return out


def test_a_stopped_build_goes_on_to_the_same_codes(spark, vectors, built, tmp_path):
    out, settings = str(tmp_path / "stopped"), ivfpq.Settings(64, codes=64)
    assert ivfpq.build(vectors[1], out, settings, stop_after=1) is None
    assert not Path(f"{out}/manifest.json").exists() and Path(f"{out}/markers/0.json").exists()
    # What a stopped run left of the second shard is no shard.
    vectors[1].filter("shard = 1").limit(3).select("id").write.parquet(f"{out}/parts/shard=1")
    with pytest.raises(ValueError, match="beam"):
        ivfpq.build(vectors[1], out, ivfpq.Settings(64, codes=64, beam=3))
    assert ivfpq.build(vectors[1], out, settings)["records"] == N
    assert _codes(spark, out) == _codes(spark, built)
    assert json.loads(I.Files(spark, out).read(f"{out}/markers/1.json")) == {"shard": 1, "records": 1000}


def test_two_levels_agree_with_all_lists(spark, vectors, built):
    q = ivfpq.opened(spark, built, ivfpq.Settings(64, codes=64))
    lists = {r["list_id"]: r["c"] for r in q.lists.collect()}
    ids = sorted(lists)
    c = np.array([lists[i] for i in ids])
    assert len(ids) <= 64 and np.allclose((c * c).sum(1), 1)
    flat = (ivfpq.unit(vectors[0]) @ c.T).round(9)
    sizes = {r["super_id"]: r["count"] for r in q.lists.groupBy("super_id").count().collect()}
    for beam in (2, 4):
        q.settings = ivfpq.Settings(64, codes=64, beam=beam)
        own = {r["id"]: r["list_id"] for r in ivfpq.encode(q, vectors[1]).collect()}
        agree = np.mean([flat[i, ids.index(own[i])] == flat[i].max() for i in range(N)])
        near = ivfpq.near_supers(q.supers, q.reach, beam, ivfpq.unit(vectors[0]))
        products = len(q.supers) + np.mean([sum(sizes[s] for s in row if s >= 0) for row in near])
        assert agree >= 0.98 and len(own) == N and products < (1 + 1.5 * beam) * 8


def test_recall_over_all_truth_rows(spark, vectors, built):
    truth = {i: vectors[0][i].tolist() for i in range(0, N, 7)}
    right = ivfpq.exact(vectors[1], truth, 20, row_id="id")
    x = ivfpq.unit(vectors[0])
    for i in (0, 7, 700):
        score = (x[i] @ x.T).round(9)
        want = np.lexsort((np.arange(N), -score))[:20].tolist()
        assert [r["row_id"] for r in right.filter(F.col("query_id") == i).orderBy("rank").collect()] == want
    found = ivfpq.search(spark, built, truth, nprobe=16, k=200)
    hits = right.join(found, ["query_id", "row_id"], "left_semi").groupBy("query_id").count()
    share = [r["count"] / 20 for r in hits.collect()]
    assert sum(share) / len(truth) >= 0.95
    assert ivfpq.search(spark, built, {}, nprobe=4, k=5).collect() == []
    # The best of each list hold those of any smaller nprobe.
    few = {i: truth[i] for i in (0, 7, 14)}
    ranked = ivfpq.search(spark, built, few, nprobe=8, k=30, by_list=True).collect()
    for n in (1, 3, 8):
        for i in few:
            own = sorted(((-r["approx"], r["row_id"]) for r in ranked if r["query_id"] == i and r["list_rank"] <= n))[:30]
            got = ivfpq.search(spark, built, {i: few[i]}, nprobe=n, k=30).collect()
            assert [x[1] for x in own] == [r["row_id"] for r in sorted(got, key=lambda r: (-r["approx"], r["row_id"]))]


def test_blocks_of_queries_give_the_same(spark, vectors, built, monkeypatch):
    asks = {i: vectors[0][i].tolist() for i in range(20)}
    one = {tuple(r) for r in ivfpq.search(spark, built, asks, nprobe=8, k=10).collect()}
    monkeypatch.setattr(ivfpq, "MAX_PROBES", 8 * 6)
    assert {tuple(r) for r in ivfpq.search(spark, built, asks, nprobe=8, k=10).collect()} == one
    plan = ivfpq.search(spark, built, {0: asks[0]}, nprobe=2, k=5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(super_id" in plan or "PartitionFilters: [super_id" in plan


def test_sample_takes_from_every_shard(spark, vectors):
    import hashlib

    got = {(r["shard"], r["id"]) for r in ivfpq.sample(vectors[1], 50, 9).collect()}
    want = set()
    for shard in range(3):
        ids = sorted(range(1000 * shard, 1000 * shard + 1000), key=lambda i: hashlib.sha256(f"9:{i}".encode()).hexdigest())
        want |= {(shard, i) for i in ids[:50]}
    assert got == want
    plan = ivfpq.sample(vectors[1], 50, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_search_takes_its_pool_from_product_codes(spark, vectors, tmp_path):
    papers = spark.createDataFrame([(i, f"W{i}", f"title number {i}", "s", 2000, i, "t", "en", True, "", []) for i in range(N)], "row_id long, work_id string, title string, snippet string, publication_year int, cited_by_count long, topic string, field string, is_oa boolean, doi string, authors array<string>")
    papers = papers.withColumn("normalized_title", X.normalize_title(F.col("title")))
    rows = vectors[1].select(F.col("id").alias("vec_id"), "embedding")
    first = rows.filter("vec_id < 4").select(F.col("vec_id").cast("int").alias("list_id"), F.col("embedding").alias("c"))
    out = str(tmp_path / "index")
    I.build(papers, rows, out, centroids=first, pq=ivfpq.Settings(64, codes=64), shard_rows=1000)
    index = I.open_index(spark, out, verify=True, tuning=I.Tuning(candidates=200, nprobe=16))
    ask = vectors[0][10].tolist()
    pool, _ = engine.semantic_candidates(index, ask, P.Filters())
    ids = [r["row_id"] for r in pool.collect()]
    x = ivfpq.unit(vectors[0])
    best = np.argsort(-(x[10] @ x.T), kind="stable")[:20].tolist()
    assert len(ids) == 200 and len(set(best) & set(ids[:25])) >= 19
    truth = {i: vectors[0][i].tolist() for i in range(0, N, 100)}
    report = engine.recall_over_truth(index, truth, rows, nprobe=16, pool=200).first()
    assert report["queries"] == 30 and report["mean"] >= 0.95 and report["pool_mean"] >= report["mean"] - 1e-9
    assert engine.search(index, "title number 77", ask).page.filter("exact").count() == 1
