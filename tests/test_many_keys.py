"""The most cited rows of more keys than one lookup by literals takes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_titles import HOT, PATCHES, _now, built  # noqa: F401

from lodestone import catalogue
from lodestone.functions import text as X
from lodestone.operators import index as I
from lodestone.operators import papers as P
from lodestone.operators import titles

SMOKE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("patches", [{}, PATCHES])
def test_rows_of_many_keys_equal_a_full_sort(spark, built, patches):  # noqa: F811
    out, rows = built
    frame = spark.createDataFrame([(w, c, u) for w, (c, u) in patches.items()], "work_id string, changes map<string,string>, unreliable boolean") if patches else None
    index = I.open_index(spark, out, patches=frame)
    keys = sorted({X.plain_key(r[2]) for r in rows[:HOT]} | {"a study of patched things"})
    assert len(keys) > I.MAX_KEYS
    asked = spark.createDataFrame([(k,) for k in [*keys, *keys[:9], "no title", None]], "key string")
    now, known = list(_now(rows, patches)), set(keys)
    for filters, passes in ((P.Filters(), lambda r: True), (P.Filters(is_oa=True, year_min=2005), lambda r: r[5] and r[2] >= 2005)):
        want = sorted(((r[3], r[0]) for r in now if passes(r) and r[1] in known), key=lambda x: (-x[0], x[1]))[:100]
        assert [tuple(r) for r in titles.most_cited_of(index, "titles", asked, filters, 100).collect()] == want
    begun = spark.createDataFrame([("a study of",), ("something else entirely",), ("a study of deep",)], "key string")
    want = sorted(((r[3], r[0]) for r in now if r[1].startswith("a study of ")), key=lambda x: (-x[0], x[1]))[:50]
    assert [tuple(r) for r in titles.most_cited_of(index, "prefixes", begun, P.Filters(), 50).collect()] == want


@pytest.mark.parametrize("name", ["index_exact_rows", "index_prefix_rows"])
def test_queries_take_more_keys_than_a_lookup(spark, name, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    if not Path(SMOKE).exists():
        pytest.skip("no test tables")
    monkeypatch.setattr(I, "MAX_KEYS", 3)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SMOKE}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SMOKE).select("row_id", F.col("citations")).collect()
    assert [tuple(r) for r in got] == con.execute(catalogue.SQL[name]).fetchall()
