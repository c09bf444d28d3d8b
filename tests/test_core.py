from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone import catalogue
from lodestone.functions import text as X
from lodestone.functions import vector as V
from lodestone.operators import builds, papers, ranking
from lodestone.sources import works

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["vector_topk_filtered", "int8_codes", "exact_title_lookup", "prefix_rows_top50", "overrides_applied", "sort_relevance", "artifact_diff", "build_progress", "abstract_rebuild"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not Path(SMOKE).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "events", "lineitem"):
        con.execute(f"create view {t} as select * from '{SMOKE}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, SMOKE).toPandas(), con.execute(catalogue.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted(map(repr, x[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_quantise_rounds_half_to_even(spark):
    row = spark.range(1).select(V.quantize(F.array(*[F.lit(x) for x in (-1.2, -0.5, 0.0, 0.5, 1.2)]), F.array(*[F.lit(1 / 127)] * 5)).alias("c")).first()
    assert row["c"] == [-127, -64, 0, 64, 127]


def test_work_id_spellings(spark):
    pairs = [("https://x.example/W12/", "W12"), ("w12?a", "W12"), (" W12#t ", "W12"), ("A12", ""), (None, "")]
    got = spark.createDataFrame(pairs, "u string, want string").select(X.work_id(F.col("u")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


@pytest.mark.parametrize("typed, stored", [("Pre-training", "pre training"), ("naïve", "naive"), ("Q&A", "q amp a"), ("Straße", "strasse"), ("H<sub>2</sub>O", "h 2 o"), ("a &lt;b&gt; c", "a c"), ("x < y and z > w", "x y and z w"), ("it`s", "its")])
def test_title_variants_hold_stored_spelling(typed, stored):
    assert stored in X.title_key_variants(typed)


def test_year_bound_drops_unknown_years(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1999)], "row_id long, publication_year int")
    assert [r["row_id"] for r in rows.filter(papers.Filters(year_min=0).column()).collect()] == [2]
    assert rows.filter(papers.Filters().column()).count() == 2


def test_collapse_is_greedy_and_not_transitive(spark):
    rows = [(0, 1, 10, "t", "", [], 2000, 5), (0, 2, 11, "t", "", [], 2001, 9), (0, 3, 12, "t", "", [], 2002, 1), (0, 4, 13, "u", "", [], 2000, 1)]
    rows += [(0, 5, 14, "", "", [], 2000, 1), (0, 6, 15, "", "", [], 2000, 1)]
    rows += [(0, 7, 16, "v", "doi:10.1/A", ["Ann Núñez"], 1990, 1), (0, 8, 17, "v", "10.1/b", ["Bo Nunez"], 2020, 1), (0, 9, 18, "v", "https://doi.org/10.1/a", ["Xi Wu"], 0, 0)]
    df = spark.createDataFrame(rows, "query_id long, pos int, row_id long, normalized_title string, doi string, authors array<string>, publication_year int, citations long")
    got = [r["row_id"] for r in ranking.collapse(df).orderBy("pos").collect()]
    assert got == [11, 13, 14, 15, 16]


def test_resume_and_first_wins(spark):
    rows = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "c")], "file_rank int, line int, id string")
    assert {r["id"] for r in works.first_wins(rows, "id", "file_rank", "line").filter("file_rank = 0").collect()} == {"a", "b"}
    assert works.resume(rows, 0, 1).count() == 3


def test_progress_stops_at_a_gap(spark):
    rows = spark.createDataFrame([(0, "a", 5, 5), (2, "a", 5, 10)], "shard int, config string, records int, records_done int")
    assert tuple(builds.progress(rows).first()) == (1, 5)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
