"""The stages of the pipeline on rows at the edge of what they define."""

import corpus_pipeline
import pytest


def test_near_dedup_stage_on_edge_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "a"), (2, text, "b"), (3, None, "c"), (4, "", "d"), (5, "", "e"), (None, text, "f"), (6, "alone in here", "g"), (7, text + " more", "h"), (6, "alone in here", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["kept"] for r in out.collect()) == ["a", "c", "d", "e", "f", "g", "i"]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")


EDGE = [(1, None), (2, ""), (3, "same line here\nand another one"), (4, "Same Line Here \nits own text"), (4, "Same Line Here \nits own text"), (None, "same line here"), (5, "word " * 5000)]


@pytest.fixture
def folder(spark, tmp_path):
    items = [(i, " ".join(f"b{i}x{j}" for j in range(12))) for i in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(300)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_rows_and_empty_tables(spark, folder, stage):
    docs = _docs(spark, EDGE)
    out = stage(spark, docs, folder)
    if stage is not corpus_pipeline.bpe_stage:
        assert out.columns == docs.columns
    assert out.count() <= len(EDGE) and stage(spark, docs.limit(0), folder).collect() == []


def test_line_dedup_stage_keeps_first_places(spark, folder):
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup_stage(spark, _docs(spark, EDGE), folder).collect()]
    assert (3, "same line here\nand another one", 30) in got and (1, "", 0) in got and (2, "", 0) in got
    assert got.count((4, "its own text", 12)) == 2 and len(got) == len(EDGE)


def test_decontamination_stage_drops_holders_of_a_window(spark, folder):
    rows = [*EDGE, (10, "before " + " ".join(f"b1x{j}" for j in range(8)) + " after"), (11, " ".join(f"b1x{j}" for j in range(7)))]
    got = {r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, _docs(spark, rows), folder).collect()}
    assert got == {1, 2, 3, 4, None, 5, 11}


def test_toxicity_stage_drops_what_it_learned(spark, folder):
    rows = [(i, ("nasty vile words here " if i % 5 == 1 else "kind and calm words here ") * 3 + f"n{i}") for i in range(300)] + [(1000, None), (1001, "")]
    got = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, _docs(spark, rows), folder).collect()}
    assert {1000, 1001} <= got and sum(i in got for i in range(1, 300, 5)) < 6 and sum(i in got for i in range(300) if i % 5 != 1) > 230


def test_bpe_stage_counts_tokens(spark, folder):
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in corpus_pipeline.bpe_stage(spark, _docs(spark, EDGE), folder).collect())
    assert len(got) == len(EDGE) and ("1", 0) in got and ("2", 0) in got and all(n > 0 for i, n in got if i not in "12")
