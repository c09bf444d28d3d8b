"""Edge rows and brute-force twins of the training-data operators."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, bpe, decontaminate, line_dedup, neardup, passages, pseudonyms, quality, reshard, toxicity

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "alpha beta " * 3000), (None, "nobody's text"), (7, "same words here"), (7, "same words here")]
DOCS = "doc_id long, text string"


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_decontaminate_edges_and_short_items(spark, edge, empty):
    items = spark.createDataFrame([(7, "a b c d e f g h i"), (9, "b c d e f g h i"), (8, "d e F"), (6, None), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "aa A b c d e f g h i j"), (2, "zz a b c d e f g"), (3, None)], DOCS)
    for limit in (1000, 0):  # broadcast and shuffle
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.contamination(docs, items, broadcast_windows=limit).collect()}
        assert got == {1: (11, 9, ["7", "8", "9"]), 2: (8, 3, ["8"]), 3: (0, 0, [])}
    assert decontaminate.contamination(edge, items).count() == len(EDGE)
    assert decontaminate.contamination(edge, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0


def test_bpe_matches_tiktoken(spark, edge, empty):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    mine, theirs = bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(3)
    texts = ["", "aaaa" * 200, "é" * 70, "😀 x\n\n  y", "\x1c\x85\xa0"] + ["".join(rng.choice(list("ab \n'é9Z"), 60)) for _ in range(200)]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert ids.tolist() == theirs.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()
    got = bpe.encode_decode(edge, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(got) == len(EDGE) and sum(r["n_tokens"] == 0 for r in got) == 2
    assert bpe.encode_decode(empty, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def _components(texts, k=2):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_neardup_against_all_pairs(spark, edge, empty):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for base in range(12):
        own = list(rng.choice(words, 60))
        for v in range(6):
            text = list(own)
            for _ in range(v):
                text[rng.integers(60)] = str(rng.choice(words))
            texts[base * 10 + v] = " ".join(text)
    texts |= {900: None, 901: "", 902: "solo", 903: "Solo"}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), DOCS), shingle=2).collect()}
    assert got == _components(texts)
    rows = neardup.near_duplicates(edge, shingle=2).collect()
    assert len(rows) == len(EDGE) and all(r["kept"] for r in rows)
    assert neardup.near_duplicates(empty).count() == 0


def test_ann_exact_when_few_and_bad_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(1, 40)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, k=5).collect()
    good = {i: np.array(v) for i, v in rows[:39]}
    for q in (10, 20, 30):
        want = sorted(((-round(float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)), 12), i) for i, v in good.items() if i != q))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert sum(abs(-s - r["score"]) < 1e-9 for (s, _), r in zip(want, mine, strict=True)) >= 4
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    three = ann.nearest(df.filter("vec_id <= 3"), F.col("vec_id") == 1).collect()
    assert {r["vec_id"] for r in three} == {2, 3}


def test_flow_moves_the_least():
    flow = reshard.min_cost_flow([10, 2, 0], [4, 4, 4], [[0, 1, 1], [1, 0, 1], [1, 1, 0]])
    assert sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j) == 6
    assert [sum(r) for r in flow] == [10, 2, 0]


def test_reshard_slots_and_files(spark, edge, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(400)] + [(None, None)], DOCS)
    placed, plan = reshard.reshard(docs, old_shard=F.lit(0), old_shards=4, shards=4)
    rows = placed.collect()
    for s in range(4):
        assert sorted(r["_rs_slot"] for r in rows if r["_rs_shard"] == s) == list(range(sum(r["_rs_shard"] == s for r in rows)))
    sizes = [sum(r["_rs_size"] for r in rows if r["_rs_shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 60
    report = reshard.rewrite_affected(docs, str(tmp_path / "out"), old_shard=F.lit(0), old_shards=4, shards=4)
    assert report["rewritten"] == [0, 1, 2, 3] and spark.read.parquet(str(tmp_path / "out")).count() == 401


def test_pseudonyms_keep_format_and_undo(spark, edge):
    texts = [(1, "und.34@mail7.example.com at 97.51.17.173, card 4111 1111 1111 1111 not 4111111111111112"), (2, "+1 (017) 555-7713, 1999-02-28, 30/02/1999, 123-45-6789 and 97.51.17.173"), (3, None)]
    out = pseudonyms.pseudonymise(spark.createDataFrame(texts, DOCS), "k")
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com at [\d.]+, card (\d{4} ){3}\d{4} not 4111111111111112", got[1])
    assert re.search(r"at ([\d.]+),", got[1])[1] == re.search(r"and ([\d.]+)$", got[2])[1] != "97.51.17.173"
    assert "30/02/1999" in got[2] and got[3] is None
    back = pseudonyms.pseudonymise(out.drop("found"), "k", undo=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(texts)
    assert pseudonyms.pseudonymise(edge, "k").count() == len(EDGE)


def test_passages_find_shared_runs(spark, edge, empty):
    rng = np.random.default_rng(9)
    fill = lambda n: [f"v{rng.integers(10**6)}" for _ in range(n)]
    run = fill(80)
    fuzzy = list(run)
    fuzzy[40] = "changed"
    texts = [(1, " ".join(fill(100) + run + fill(30))), (2, " ".join(fill(20) + run)), (3, " ".join(fuzzy + fill(50))), (4, " ".join(fill(200)))]
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(texts, DOCS)).collect()}
    assert set(got) == {2, 3}
    assert (got[2]["start"], got[2]["end"], got[2]["other_start"]) == (20, 100, 100)
    assert got[3]["start"] == 0 and got[3]["end"] == 80 and 0.95 < got[3]["identity"] < 1
    assert passages.repeated_passages(empty).count() == 0
    assert passages.repeated_passages(edge).count() == 0


def test_line_dedup_edges(spark, edge, empty):
    line = "a line of its own"
    docs = spark.createDataFrame([(2, f"x\n{line.upper()} \nshort"), (1, f"{line}\n{line}"), (3, f"short\n{line}"), (None, line), (5, None)], DOCS)
    got = {r["doc_id"]: (r["text"], r["_ld_lines"], r["_ld_dropped"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (f"{line}\n{line}", 2, 0), 2: ("x\nshort", 3, 1), 3: ("short", 2, 1), None: (line, 1, 0), 5: ("", 1, 0)}
    assert line_dedup.dedup_lines(edge).count() == len(EDGE)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_toxicity_learns_and_handles_edges(spark, edge):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        text = [f"w{rng.integers(80)}" for _ in range(30)]
        if i % 3 == 0:
            text[rng.integers(30)] = "nasty"
        rows.append((i, " ".join(text), "en"))
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in out]) > 0.9
    assert toxicity.score(edge.withColumn("lang", F.lit(None).cast("string")), model).count() == len(EDGE)
    constant = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, constant).select("score").distinct().count() == 1


def test_neardup_two_texts_under_one_id(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    rows = [(1, text(1)), (1, text(2)), (2, text(2) + " more"), (3, text(1) + " more"), (4, text(4)), (4, text(4))]
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_cotraining_rounds_help_and_both_views_count():
    """Two views of which each alone tells the class: the exchange lowers the held-out
    loss of the view whose few shown rows teach it least, and both keep weight."""
    rng = np.random.default_rng(8)
    n = 3000
    y = rng.integers(0, 2, n)
    meta = np.zeros((n, quality.META), np.float32)
    meta[:, 0] = 1
    meta[:, 1:31] = rng.normal(size=(n, 30))
    meta[:, 1] += 2.2 * (2 * y - 1)
    slots, off = rng.integers(0, 400, 20 * n), np.arange(0, 20 * n + 1, 20)
    slots[np.arange(n) * 20] = 1000 + y + 2 * rng.integers(0, 30, n)
    slots[np.arange(n) * 20 + 1] = 1000 + np.where(rng.random(n) < 0.9, y, 1 - y) + 2 * rng.integers(0, 30, n)
    features = (slots, off, np.zeros((n, quality.REPEATS), np.float32), meta)
    train, held = np.arange(2000), np.arange(2000, n)
    role = np.where(train % 6 == 5, 2, np.where(train % 40 == 0, 0, 1))
    loss = []
    for rounds in (0, 3):
        model = quality.co_train(quality._take(features, train), y[train], role, rounds)
        p = model.scores(quality._take(features, held)).clip(1e-6, 1 - 1e-6)
        loss.append(-np.log(np.where(y[held] == 1, p, 1 - p)).mean())
        assert min(model.union[:2]) > 0
    print(loss)
    assert loss[1] < loss[0]
