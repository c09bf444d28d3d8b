"""Repeats of a work among all rows of a title."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ranking as R


def _plain(rows):
    """Every row against every kept one."""
    kept = []
    for r in rows:
        hit = next((i for i, k in enumerate(kept) if R.same_work(k, r)), None)
        if hit is None:
            kept.append(r)
        elif r["verified"] if r["verified"] != kept[hit]["verified"] else r["citations"] > kept[hit]["citations"]:
            kept[hit] = r | {"pos": kept[hit]["pos"]}
    return [r["row_id"] for r in kept]


@pytest.mark.parametrize("seed", range(40))
def test_kept_rows_are_found_by_their_marks(seed):
    rng = random.Random(seed)
    rows = [{"row_id": i, "pos": i, "doi": rng.choice(["", "", f"d{rng.randrange(9)}"]), "surname": rng.choice(["", f"s{rng.randrange(12)}"]), "year": rng.choice([0, 1990 + rng.randrange(30)]), "citations": rng.randrange(9), "verified": rng.random() < 0.1} for i in range(150)]
    kept = R.Kept()
    for r in rows:
        kept.take(r)
    assert [r["row_id"] for r in kept.rows] == _plain(rows)


def test_titles_stream_through_few_tasks(spark):
    """Titles over the borders of batches, one of 30,000 rows by as many authors."""
    one = spark.range(30_000).select(F.col("id").alias("row_id"), F.lit("one").alias("normalized_title"), F.array(F.concat(F.lit("A N"), "id")).alias("authors"))
    more = spark.range(6000).select((F.col("id") + 30_000).alias("row_id"), F.concat(F.lit("t"), F.expr("id div 3")).alias("normalized_title"), F.array(F.concat(F.lit("A N"), F.col("id") % 3 % 2)).alias("authors"))
    blank = spark.range(2).select((F.col("id") + 90_000).alias("row_id"), F.lit("").alias("normalized_title"), F.array(F.lit("A N")).alias("authors"))
    rows = one.unionByName(more).unionByName(blank).withColumns({"doi": F.lit(""), "publication_year": F.lit(2000), "citations": F.col("row_id")})
    found = R.collapse_titles(rows)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("pos").alias("top"), F.min("pos").alias("low"), F.sort_array(F.collect_list("row_id")).alias("ids")).collect()
    assert sorted((r["n"], r["top"], r["low"]) for r in got) == [(2, 2, 1)] * 2000 + [(30_000, 30_000, 1)]
    # The more cited of two rows by one author.
    assert {i for r in got if r["n"] == 2 for i in r["ids"]} == {30_000 + i for i in range(6000) if i % 3}
