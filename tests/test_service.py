"""The built index, searches over it, backfills, and what they refuse."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import embed
from lodestone.functions import text as X
from lodestone.operators import backfill, engine, evaluation
from lodestone.operators import index as I
from lodestone.operators import papers as P
from lodestone.operators import titles as T
from lodestone.sources import works
from lodestone.streaming.ingest import ingest

PAPERS = "row_id long, work_id string, title string, snippet string, publication_year int, cited_by_count long, topic string, field string, is_oa boolean, doi string, authors array<string>"
TITLES = ["Retrieval-augmented generation for knowledge-intensive tasks", "Deep seas", "Deep seas", "A long title about many deep seas and rivers", "A long title about many hills", "O'Neil's theorem"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = [(i, f"W{i}", t, "" if i == 1 else "text", 2000 + i, 10 * i, "t", "en", i % 2 == 0, "", [f"Ann Name{i}"]) for i, t in enumerate(TITLES)]
    papers = spark.createDataFrame(rows, PAPERS).withColumn("normalized_title", X.normalize_title(F.col("title")))
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(6)], "vec_id long, embedding array<double>")
    centroids = vectors.filter("vec_id < 2").select(F.col("vec_id").cast("int").alias("list_id"), F.col("embedding").alias("c"))
    out = str(tmp_path_factory.mktemp("index") / "one")
    I.build(papers, vectors, out, records=6, centroids=centroids)
    with pytest.raises(FileExistsError):
        I.build(papers, vectors, out)
    with pytest.raises(ValueError, match="wants 7"):
        I.build(papers, vectors, out + "2", records=7, centroids=centroids)
    return out


def test_lookups_read_only_their_buckets(spark, built):
    index = I.open_index(spark, built)
    found = index.probe_plain("titles", ["deep seas"])
    assert {r["row_id"] for r in found.collect()} == {1, 2}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "EqualTo(plain,deep seas)" in plan or "In(plain" in plan
    words = index.probe("postings", "word", ["deep", "seas"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in words or "PartitionFilters: [bucket" in words
    probed = engine._probed(index, [1.0] * 8, 1, 5)
    assert "list_id" in probed._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1][:60]


def test_open_refuses_what_does_not_match(spark, built, tmp_path):
    files = I.Files(spark, built)
    manifest = files.read(f"{built}/manifest.json")
    with pytest.raises(ValueError, match="no complete generation"):
        I.open_index(spark, str(tmp_path))
    for old, new, said in (('"format_version": 2', '"format_version": 3', "format"), ('"records": 6', '"records": 5', "counts disagree"), ('"titles": 6', '"titles": 7', "rows of the manifest")):
        try:
            files.write(f"{built}/manifest.json", manifest.replace(old, new))
            with pytest.raises(ValueError, match=said):
                I.open_index(spark, built)
        finally:
            files.write(f"{built}/manifest.json", manifest)


def test_title_candidates_by_stages(spark, built):
    index = I.open_index(spark, built)
    ids = set
    exact, prefix, _ = engine.title_candidates(index, "retrieval augmented generation for knowledge intensive tasks", P.Filters())
    assert ids(exact) == {0} and not ids(prefix)
    exact, prefix, _ = engine.title_candidates(index, "A long title about", P.Filters())
    assert not ids(exact) and ids(prefix) == {3, 4}
    exact, prefix, _ = engine.title_candidates(index, "O’Neil’s theorem", P.Filters())
    assert ids(exact) == {5}
    assert ids(engine.title_candidates(index, "Deep seas", P.Filters(is_oa=True))[0]) == {2}


def test_search_with_corrections_and_supplement(spark, built):
    patches = spark.createDataFrame([("W2", {}, True), ("W4", {"title": "Deep seas"}, False)], "work_id string, changes map<string,string>, unreliable boolean")
    raw = {"format_version": 1, "records": [{"work_id": "W77", "title": "Deep Seas", "verified_at": "2026-01-01", "sources": ["https://x.example"], "publication_year": 1999, "authors": ["Zed Other"]}, {"work_id": "W1", "title": "known", "verified_at": "2026-01-01", "sources": ["https://x.example"], "publication_year": 1999}]}
    index = I.open_index(spark, built, patches=patches, supplement=engine.supplement(raw))
    found = engine.search(index, "deep seas", [1.0] * 8, limit=4)
    rows = found.page.orderBy("pos").collect()
    # Exact titles first, by effective citations: W4 (40, retitled), W1 (10), then those of none.
    assert [r["work_id"] for r in rows] == ["W4", "W1", "W2", "W77"]
    counts = found.counters.first()
    assert counts["total_matches"] == 7 and counts["has_more"] and counts["next_offset"] == 4
    assert {r["work_id"] for r in engine.lookup(index, ["w77", "https://x.example/W2/"]).collect()} == {"W77", "W2"}
    only = engine.search(index, "deep seas", [1.0] * 8, filters=P.Filters(min_citations=1))
    assert "W2" not in {r["work_id"] for r in only.page.collect()}
    assert engine.semantic_candidates(index, [1.0] * 8, P.Filters(field="nowhere"))[1] == 0


@pytest.mark.parametrize("call", [("", "relevance", 0, 20), ("x", "best", 0, 20), ("x", "newest", 0, 51), ("x", "newest", 10_001, 5)])
def test_requests_are_checked(call):
    with pytest.raises(ValueError):
        engine.validate(*call)


@pytest.mark.parametrize("change", [{"work_id": "A1"}, {"title": " "}, {"verified_at": "1.1.2026"}, {"sources": []}, {"sources": ["http://x"]}, {"publication_year": True}, {"cited_by_count": -1}, {"is_oa": 1}, {"authors": "Ann"}, {"doi": 5}])
def test_supplement_refuses(change):
    good = {"work_id": "W1", "title": "t", "verified_at": "2026-01-01", "sources": ["https://x"], "publication_year": 2000}
    assert engine.supplement({"format_version": 1, "records": [good]})[0]["work_id"] == "W1"
    with pytest.raises(ValueError):
        engine.supplement({"format_version": 1, "records": [good | change]})
    assert engine.supplement_or_none({"format_version": 1, "records": [good, good]}) == []
    assert "t" in engine.supplement_keys(engine.supplement({"format_version": 1, "records": [good]})[0])


def test_budget_stages_and_tuning():
    now = [0.0]
    budget = engine.ScanBudget(2, 10.0, lambda: now[0])
    assert [budget.take() for _ in range(3)] == [True, True, False]
    now[0] = 10.0
    assert budget.take()
    assert I.stage("10K").records == 10_000 and I.confirm_stage("1m", "1m").records == 10**6
    with pytest.raises(ValueError, match="one of"):
        I.stage("2k")
    with pytest.raises(ValueError, match="confirmation"):
        I.confirm_stage("1m", None)
    assert I.Tuning.from_environment({"LODESTONE_NPROBE": "7"}).nprobe == 7
    with pytest.raises(ValueError):
        I.Tuning.from_environment({"LODESTONE_NPROBE": "0"})
    assert (I.list_count(1), I.list_count(10**6), I.list_count(10**12)) == (16, 4000, 131_072)
    assert evaluation.gates(0.96, 0.9, True, True, 1750, 100, 0)["storage"] and not evaluation.gates(0.96, 0.9, True, True, 1750, 100, 0)["refined_recall"]


def _shards(spark, wide: float = 1.0):
    rows = [(s, i, 10 * s + i % 8, [wide if s else 1.0, float(i)]) for s in range(3) for i in range(10)] + [(2, 99, 0, [1.0, 1.0])]
    return spark.createDataFrame(rows, "shard int, line long, id long, embedding array<double>")


def test_backfill_refuses_and_resumes(spark, tmp_path):
    out, rows, seen = str(tmp_path / "b"), _shards(spark), ["a"]
    run = lambda **more: backfill.run(rows, out, settings=more.pop("settings", {"dim": 2}), snapshot=lambda: seen[0], shards=3, **more)
    run(stop_after=1)
    with pytest.raises(ValueError, match="1 of 3"):
        backfill.assemble(spark, out, shards=3)
    with pytest.raises(ValueError, match="dim"):
        run(settings={"dim": 3})
    seen[0] = "b"
    with pytest.raises(ValueError, match="identity"):
        run()
    seen[0] = "a"
    files = I.Files(spark, out)
    files.write(f"{out}/markers/2.json", "{}")
    assert backfill.clear_orphans(files, out, 1) == ["2.json"]
    assert [m["records"] for m in run()] == [8, 8, 8]
    whole = backfill.assemble(spark, out, shards=3)
    assert [r["row_id"] for r in whole.orderBy("row_id").collect()] == list(range(24))
    assert backfill.truth_rows(whole.filter("truth"), whole).count() == 6
    assert backfill.manifest(spark, out)["history"] == [{"config": '{"dim": 2}', "first_shard": 0, "last_shard": 2}]
    with pytest.raises(ValueError, match="missing or repeated"):
        backfill.truth_rows(whole.filter("truth").withColumn("id", F.col("id") + 1000), whole)
    with pytest.raises(ValueError, match="clipped"):
        backfill.run(_shards(spark, 5.0), str(tmp_path / "c"), settings={}, snapshot=lambda: "a", shards=3)


def test_ingest_resumes_and_stops_on_a_changed_snapshot(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, "k long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda **more: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), schema="k long, v long", key="k", order=["v"], **more)
    write([(1, 1), (2, 2)])
    assert go().count() == 2
    write([(2, 3), (3, 4)])
    assert {(r["k"], r["v"]) for r in go().collect()} == {(1, 1), (2, 2), (3, 4)}
    write([(4, 5)])
    turn = iter(range(100))
    with pytest.raises(Exception, match="snapshot changed"):
        go(snapshot=lambda: str(next(turn)))


def test_sources(spark, tmp_path):
    assert works.sample_size(1000, 10**6) == (64, 46_875) and works.sample_size(3, 10) == (3, 10)
    assert works.sample_size(1000, 10**9)[0] == 512
    good = spark.createDataFrame([("1", " A  title ", None)], "id string, title string, year int")
    assert works.custom_corpus(good).first()["title"] == "A title"
    with pytest.raises(ValueError):
        works.custom_corpus(spark.createDataFrame([("1", " ")], "id string, title string"))
    good.select("id").write.json(str(tmp_path / "j"))
    assert backfill.read_shards(spark, str(tmp_path / "j"), "id string", 1).count() == 1
    with pytest.raises(ValueError, match="not 2"):
        backfill.read_shards(spark, str(tmp_path / "j"), "id string", 2)
    name = next((tmp_path / "j").glob("part-*.json"))
    sums = {r["name"]: r["sha256"] for r in backfill.checksums(spark, str(tmp_path / "j")).collect()}
    assert sums[name.name] == hashlib.sha256(name.read_bytes()).hexdigest()


def test_checksums_of_empty_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    held = {"a.json": b"x", "b.json": b"", "deep/c.json": b"", "_SUCCESS": b"", ".hidden": b""}
    for name, data in held.items():
        (tmp_path / "in" / name).write_bytes(data)
    want = [(name.split("/")[-1], len(held[name]), hashlib.sha256(held[name]).hexdigest()) for name in ("a.json", "b.json", "deep/c.json")]
    assert sorted(map(tuple, backfill.checksums(spark, str(tmp_path / "in")).collect())) == want
    assert [tuple(r)[:2] for r in backfill.checksums(spark, str(tmp_path / "in" / "deep")).collect()] == [("c.json", 0)]
    assert [tuple(r)[:2] for r in backfill.checksums(spark, str(tmp_path / "in" / "b.json")).collect()] == [("b.json", 0)]


def test_hashing_embedder(spark):
    own = embed.HashingEmbedder(16)
    x = own.encode(["Deep-sea Deep-sea fish", "", "Straße"])
    want = np.zeros(16)
    for word, n in (("deep-sea", 2), ("fish", 1)):
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        want[h % 16] += n if h % 2 else -n
    assert np.allclose(x[0], want / np.linalg.norm(want)) and not x[1].any()
    assert np.array_equal(x[2], own.encode_query("STRASSE"))
    rows = embed.embedded(spark.createDataFrame([(1, "fish"), (2, None)], "id long, text string"), own).collect()
    assert np.allclose(rows[0]["embedding"], own.encode_query("fish")) and not any(rows[1]["embedding"])
    assert evaluation.measured(lambda: 1 / 0, 2)[1][1] == "ZeroDivisionError"


def test_abstract_keeps_the_order_of_the_map(spark):
    row = spark.range(1).select(works.abstract(F.expr("map('zeta', array(0), 'alpha', array(0, 1))"))).first()
    assert row[0] == "zeta alpha alpha"


def test_every_paper_that_passes_is_scored(spark, built):
    """Neither the number that passes nor the sizes of a search's pool cut any off."""
    index = I.open_index(spark, built, tuning=I.Tuning(candidates=1, filter_candidates=1, nprobe=1, filter_nprobe=1, selective=1))
    filters = P.Filters(year_min=2001)
    assert {r["row_id"] for r in engine.scored_eligible(index, [1.0] * 8, filters).collect()} == {1, 2, 3, 4, 5}
    assert engine.semantic_candidates(index, [1.0] * 8, filters)[0].count() == 1


def test_years_too_large_for_their_list_come_from_papers(spark, built, monkeypatch):
    index = I.open_index(spark, built)
    monkeypatch.setattr(P, "EXACT_ROWS", 2)
    assert index.year_ids(2001, 2003) is None
    assert [r["row_id"] for r in index.all_year_ids(2001, 2003).collect()] == [1, 2, 3]
    assert [r["row_id"] for r in index.all_year_ids(2002, None).collect()] == [2, 3, 4, 5]


def test_build_makes_each_paper_once(spark, tmp_path):
    """Dealing by ranges samples its rows; what it samples must not be made for that anew."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x

    rows = [(i, f"W{i}", f"Title {i} of many", "text", 2000, i, "t", "en", True, "", ["Ann"]) for i in range(40)]
    papers = spark.createDataFrame(rows, PAPERS).withColumn("title", seen("title")).withColumn("normalized_title", X.normalize_title(F.col("title")))
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "vec_id long, embedding array<double>")
    I.build(papers, vectors, str(tmp_path / "one"), centroids=vectors.filter("vec_id < 2").select(F.col("vec_id").cast("int").alias("list_id"), F.col("embedding").alias("c")))
    assert made.value == 40


def test_postings_are_those_of_the_words_one_by_one(spark):
    titles = [(0, "a b a"), (1, ""), (2, "b"), (3, "é-x é a"), (4, "c c c c")]
    rows = spark.createDataFrame(titles, "row_id long, normalized_title string").selectExpr("*", "row_id as cited_by_count", "1 as publication_year", "true as is_oa", "'t' as topic", "cast(null as string) as field")
    got = sorted((r["word"], r["row_id"], r["size"], r["places"], r["cited_by_count"], r["field"]) for r in T.posting_rows(rows).collect())
    want = [("a", 0, 3, [0, 2], 0, None), ("a", 3, 4, [3], 3, None), ("b", 0, 3, [1], 0, None), ("b", 2, 1, [0], 2, None), ("c", 4, 4, [0, 1, 2, 3], 4, None), ("e", 3, 4, [0, 2], 3, None), ("x", 3, 4, [1], 3, None)]
    assert got == want
