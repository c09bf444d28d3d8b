"""Brute-force twins and edge rows that earlier tests lack: flows, pseudonyms over whole
domains, convolution by plain loops, the quality classifier's Spark path, and columns
whose names clash with the operators' own."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, line_dedup, neardup, passages, pseudonyms, quality, reshard, toxicity

CLASH = ["n_words", "hashes", "w", "rid", "lang", "source", "score", "found", "seed", "size", "kept", "component_id", "_rs_old_", "bucket", "text_"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)


def _clashing(spark, rows):
    return spark.createDataFrame([(i, t, *(["x"] * len(CLASH))) for i, t in rows], SCHEMA)


ROWS = [(1, None), (2, ""), (3, "alpha beta gamma " * 30), (4, "alpha beta gamma " * 30), (None, "one\ntwo"), (4, "alpha beta gamma " * 30)]


def test_flows_against_all_flows():
    """Every way to send small supplies to capacities; the least cost of all."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        n, m = int(rng.integers(1, 4)), int(rng.integers(1, 4))
        supply = rng.integers(0, 4, n).tolist()
        capacity = rng.integers(0, 5, m).tolist()
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = rng.integers(0, 4, (n, m)).tolist()

        def ways(left, parts):
            if parts == 1:
                yield (left,)
                return
            for x in range(left + 1):
                for rest in ways(left - x, parts - 1):
                    yield (x, *rest)

        least = min(
            sum(f * c for row, price in zip(flow, cost) for f, c in zip(row, price))
            for flow in itertools.product(*[list(ways(s, m)) for s in supply])
            if all(sum(row[j] for row in flow) <= capacity[j] for j in range(m))
        )
        flow = reshard.min_cost_flow(supply, capacity, cost)
        assert [sum(row) for row in flow] == supply and all(sum(row[j] for row in flow) <= capacity[j] for j in range(m))
        assert sum(f * c for row, price in zip(flow, cost) for f, c in zip(row, price)) == least


def test_reshard_on_edge_rows_and_an_empty_table(spark):
    docs = spark.createDataFrame([(i, t, s) for (i, t), s in zip(ROWS, [0, None, 1, 1, 0, 1])], "doc_id long, text string, old int")
    placed, _ = reshard.reshard(docs, old_shard=F.col("old"), old_shards=2, shards=3)
    rows = placed.collect()
    assert len(rows) == len(ROWS) and {r["_rs_size"] for r in rows if r["text"] in (None, "")} == {1}
    for shard in {r["_rs_shard"] for r in rows}:
        assert sorted(r["_rs_slot"] for r in rows if r["_rs_shard"] == shard) == list(range(sum(r["_rs_shard"] == shard for r in rows)))
    none, plan = reshard.reshard(docs.limit(0), old_shard=F.col("old"), old_shards=2, shards=3)
    assert none.collect() == [] and plan.moved == 0


@pytest.mark.parametrize("a, b", [(10, 10), (7, 13), (100, 9), (1, 50)])
def test_feistel_permutes_whole_domains(spark, a, b):
    rows = spark.range(a * b).select(F.expr(f"id div {b}").alias("l"), F.expr(f"id % {b}").alias("r"))
    made = rows.select("l", "r", F.expr(pseudonyms.feistel("l", "r", f"{a}L", f"{b}L", "kind", "key")).alias("p"))
    back = made.select("l", "r", "p", F.expr(pseudonyms.feistel("p.l", "p.r", f"{a}L", f"{b}L", "kind", "key", undo=True)).alias("q")).collect()
    assert {(r["p"]["l"], r["p"]["r"]) for r in back} == set(itertools.product(range(a), range(b)))
    assert all((r["q"]["l"], r["q"]["r"]) == (r["l"], r["r"]) for r in back)


def test_digits_and_dates_are_permuted_among_all_of_their_form(spark):
    for n in (2, 3):
        rows = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        made = [r[0] for r in rows.select(F.expr(pseudonyms.digits("d", "k", "key"))).collect()]
        assert sorted(made) == [f"{i:0{n}d}" for i in range(10**n)]
    days = spark.range(400).select(F.col("id").alias("doc_id"), F.date_format(F.expr("date_add(date'1999-12-01', cast(id as int))"), "yyyy-MM-dd").alias("text"))
    out = pseudonyms.pseudonymise(days, "key")
    new = [r["text"] for r in out.collect()]
    assert len(set(new)) == 400 and all("1800-01-01" <= t <= "2199-12-31" for t in new)
    again = pseudonyms.pseudonymise(out.drop("found"), "key", undo=True)
    assert {(r["doc_id"], r["text"]) for r in again.collect()} == {(r["doc_id"], r["text"]) for r in days.collect()}


def test_pseudonyms_on_clashing_repeated_and_empty_rows(spark):
    rows = [*ROWS, (9, "mail a.b@example.com and 10.0.0.1 on 2020-01-31"), (9, "mail a.b@example.com and 10.0.0.1 on 2020-01-31")]
    out = pseudonyms.pseudonymise(_clashing(spark, rows).drop("found"), "key")
    same = [r["text"] for r in out.filter("doc_id = 9").collect()]
    assert out.count() == len(rows) and len(set(same)) == 1 and "a.b@example.com" not in same[0]
    assert pseudonyms.pseudonymise(_clashing(spark, []).drop("found"), "key").collect() == []


def test_convolution_and_pooling_by_plain_loops():
    rng = np.random.default_rng(6)
    model = toxicity.fresh()
    model.embed[:] = rng.normal(size=model.embed.shape)
    model.embed[toxicity.PAD] = 0
    texts = [" ".join(f"w{rng.integers(50)}" for _ in range(n)) for n in (0, 1, 2, 3, 17, 60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ids, cut = toxicity.token_ids(data, off)
    tops = model.maxima(ids, cut)
    for t in range(len(texts)):
        own = ids[cut[t] : cut[t + 1]]
        real = len(own) - max(toxicity.WIDTHS) + 1
        assert real == max(1, len(texts[t].split()))
        h = []
        for k, w in enumerate(toxicity.WIDTHS):
            best = [max(sum(float(model.embed[own[i + j]] @ model.filters[w][j][:, f]) for j in range(w)) for i in range(real)) for f in range(toxicity.FILTERS)]
            assert np.allclose(tops[k][t], best, atol=1e-3)
            h += [max(b + model.bias[w][f], 0) for f, b in enumerate(best)]
        assert np.isclose(model.logits(ids, cut)[t], np.array(h) @ model.out + model.out_bias, atol=1e-2)


def test_quality_by_spark_on_edge_rows(spark):
    """Good texts have other words and another language than bad ones."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"{'good' if i % 2 else 'junk'}{rng.integers(40)}" for _ in range(25)), "en" if i % 2 else "xx", f"s{i % 3}", "a", 1) for i in range(600)]
    kinds = "doc_id long, text string, lang string, source string, score string, y int"
    docs = spark.createDataFrame(rows, kinds)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(600)] + [(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    held = [r for r in quality.score(docs, model).filter(toxicity.held_out(F.col("doc_id"))).collect()]
    assert held and np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in held]) > 0.95
    edge = spark.createDataFrame([(1, None, None, None, "a", 1), (2, "", "en", "s1", "a", 1), (None, "good1 " * 20_000, None, "s0", "a", 1), (2, "", "en", "s1", "a", 1)], kinds)
    scores = [r["score"] for r in quality.score(edge, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    assert quality.score(docs.limit(0), model).collect() == []
    for labelled in (labels.limit(0), labels.filter("quality = 1")):
        assert quality.score(edge, quality.train(docs, labelled)).select("score").distinct().count() == 1
    assert quality.score(edge, quality.train(docs.limit(0), labels)).count() == 4


def test_toxicity_on_empty_tables_and_a_clashing_score(spark):
    docs = spark.createDataFrame([(i, "nasty words" if i % 2 else "kind words", "en", "old") for i in range(100)], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert toxicity.score(docs, toxicity.train(docs.limit(0), labels)).count() == 100


def test_clashing_columns_do_no_harm(spark):
    """Extra columns named like the operators' own; each result is that of the plain table."""
    import public_tokenizers as pt

    plain, more = spark.createDataFrame(ROWS, "doc_id long, text string"), _clashing(spark, ROWS)
    items = spark.createDataFrame([(1, "alpha beta gamma alpha beta gamma alpha beta", "x")], "item_id long, text string, w string")
    path = pt.path("byte_bpe_multi_50k.tiktoken")
    runs = (
        lambda d: decontaminate.contamination(d, items),
        lambda d: bpe.encode_decode(d, path, pt.PATTERN),
        lambda d: neardup.near_duplicates(d, shingle=2),
        lambda d: line_dedup.dedup_lines(d),
        lambda d: passages.repeated_passages(d),
    )
    for run in runs:
        one, two = run(plain), run(more)
        names = [c for c in one.columns if c in two.columns]
        assert "doc_id" in names
        assert sorted(map(str, one.select(*names).collect())) == sorted(map(str, two.select(*names).collect()))
