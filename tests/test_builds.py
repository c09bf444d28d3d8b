"""Block compression, behaviour checks, concurrency, lookups with a status, pins."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.embed import HashingEmbedder
from lodestone.operators import backfill, builds, engine, evaluation, search
from lodestone.operators import index as I
from lodestone.sources import works

PAPERS = "row_id long, work_id string, title string, snippet string, publication_year int, cited_by_count long, topic string, field string, is_oa boolean, doi string, authors array<string>"


def test_block_compression_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), None if i % 17 == 0 else " ".join(f"w{rng.integers(50)}" for _ in range(rng.integers(0, 40))), f"é{i % 3}") for i in rng.permutation(500)]
    got = {(r["block_rows"], r["field"]): (r["blocks"], r["bytes"], r["compressed"]) for r in builds.block_compression(spark.createDataFrame(rows, "id long, a string, b string").repartition(5), "id", ["a", "b"], [1, 7, 64, 1000]).collect()}
    want = {}
    ordered = sorted(rows)
    for size in (1, 7, 64, 1000):
        for at, field in ((1, "a"), (2, "b")):
            blocks = ["\0".join(r[at] or "" for r in ordered[i : i + size]).encode() for i in range(0, 500, size)]
            want[size, field] = (len(blocks), sum(map(len, blocks)), sum(len(zlib.compress(b, 6)) for b in blocks))
    assert got == want
    with pytest.raises(ValueError, match="rows"):
        builds.block_compression(spark.createDataFrame(rows, "id long, a string, b string"), "id", ["a"], [0])


def test_behaviour_checks_find_what_is_wrong(spark):
    kinds = "query_id long, rank int, vec_id long, score double, year int, flagged boolean, wanted long, low int, high int"
    good = [(0, r, r, 1.0 / r, 2000 + r, r == 3, 1, 2000, 2011) for r in range(1, 12)]
    bad = [(1, 1, 9, 1.0, 1990, True, 8, 2000, 2010), (1, 2, 8, 0.5, 2001, False, 8, 2000, 2010), (1, 7, 7, 0.4, 2001, False, 8, 2000, 2010)]
    free = [(2, 1, 5, 1.0, 1, False, None, None, None)]
    got = {r["query_id"]: tuple(r)[1:] for r in builds.checks(spark.createDataFrame(good + bad + free, kinds), page=5, pool=11).collect()}
    assert got == {0: (True, True, True, True, True), 1: (False, False, False, False, True), 2: (True, True, True, True, True)}
    assert not builds.checks(spark.createDataFrame(good, kinds), pool=10).first()["within_pool"]


def test_concurrent_calls_are_timed():
    runs = evaluation.concurrent(lambda: 1 / 0, 6, (1, 2))
    assert [(r["callers"], r["requests"]) for r in runs] == [(1, 6), (2, 6)]
    assert all(e == "ZeroDivisionError" and ms >= 0 for r in runs for ms, e in r["runs"]) and all(r["qps"] > 0 for r in runs)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(i, f"W{i}", f"title of {w}", "t", 2000, i, "t", "en", True, "", []) for i, w in enumerate(("seas", "rivers", "hills", "lakes"))]
    papers = spark.createDataFrame(rows, PAPERS).withColumn("normalized_title", X.normalize_title(F.col("title")))
    e = HashingEmbedder(16)
    vectors = spark.createDataFrame([(r[0], [float(x) for x in e.encode([r[2]])[0]]) for r in rows], "vec_id long, embedding array<double>")
    out = str(tmp_path_factory.mktemp("builds") / "one")
    I.build(papers, vectors, out, centroids=vectors.filter("vec_id < 2").select(F.col("vec_id").cast("int").alias("list_id"), F.col("embedding").alias("c")))
    return I.open_index(spark, out)


def test_a_search_embeds_its_query(index):
    found = engine.search(index, "title of hills", embedder=HashingEmbedder(16)).page.orderBy("pos").collect()
    assert found[0]["row_id"] == 2 and found[0]["exact"] and found[0]["sem"] > 0.99
    with pytest.raises(ValueError, match="embedder"):
        engine.search(index, "title of hills")


def test_every_asked_id_has_an_answer(index):
    got = [(r["value"], r["status"], r["row_id"]) for r in engine.looked_up(index, ["w2", "W77", "two", "https://x.example/W0/", "W2"]).collect()]
    assert got == [("w2", "found", 2), ("W77", "not found", None), ("two", "no id", None), ("https://x.example/W0/", "found", 0), ("W2", "found", 2)]


def test_seed_and_code_are_pinned(spark, tmp_path):
    rows = spark.createDataFrame([(0, i, i, [1.0, float(i)]) for i in range(5)], "shard int, line long, id long, embedding array<double>")
    go = lambda **more: backfill.run(rows, str(tmp_path / "b"), settings={}, snapshot=lambda: "a", shards=1, **more)
    assert go(seed="s1", code="c1")[0]["records"] == 5
    for other in ({"seed": "s2"}, {"code": "c2"}):
        with pytest.raises(ValueError, match=next(iter(other))):
            go(**other)


def test_the_draw_of_files_can_be_repeated_and_follows_weights(spark):
    files = spark.createDataFrame([(f"f{i}", 1 if i < 200 else 50) for i in range(400)], "file string, record_count long")
    one = [r["file"] for r in works.sample_files(files, 40).collect()]
    assert one == [r["file"] for r in works.sample_files(files.repartition(3), 40).collect()] and len(set(one)) == 40
    assert sum(int(f[1:]) >= 200 for f in one) > 30
    assert {r["file"] for r in works.sample_files(files, 40, seed=5).collect()} != set(one)


def test_flat_lists_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_LISTS", 1)
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "list_id int, c array<double>")
    with pytest.raises(ValueError, match="two levels"):
        search.assign(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>"), two)


def test_suspects_are_corrections_of_counts(spark):
    patches = spark.createDataFrame([("W1", True), ("W1", True), ("W2", False), ("W3", None)], "work_id string, unreliable boolean")
    assert [r[0] for r in evaluation.suspects(patches).collect()] == ["W1"]
