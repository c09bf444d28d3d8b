from lodestone.plans import corpus


def test_dedupe_same_work_takes_all_papers(spark, tmp_path):
    """60 titles with two rows a year apart, and one title of 100 rows in one year."""
    docs = [(35 * i + side, f"Title {i:03}\ntext", 10 + side, "s", "en") for i in range(60) for side in range(2)]
    docs += [(35 * (1000 + i), "Zeta\ntext", i, "s", "en") for i in range(100)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["row_id"] for r in corpus.dedupe_same_work(spark, str(tmp_path)).collect()}
    assert got == {35 * i + 1 for i in range(60)} | {35 * 1099}
