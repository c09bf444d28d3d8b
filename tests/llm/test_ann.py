"""Nearest neighbours against brute force: recall, ties, repeated rows, lengths."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import ann

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", "r") for i, v in rows], SCHEMA).repartition(3)


def _cosine(q, v):
    return float(np.einsum("i,i->", q, v) / (np.linalg.norm(q) * np.linalg.norm(v)))


def test_recall_over_all_queries(spark):
    """Vectors without groups, the hard case, and near-copies."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2500, 24))
    x[2000:] = x[:500] + 0.05 * rng.normal(size=(500, 24))
    got: dict[int, list] = {}
    for r in ann.nearest(_frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 2500, 50):
        score = u @ u[q]
        score[q] = -2
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5] and all(abs(s - score[i]) < 1e-12 for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & set(np.argsort(-score)[:5].tolist()))
    assert hits / (5 * 50) >= 0.9


def test_ties_go_to_smaller_ids(spark):
    """Multiples by powers of two have exactly equal cosines, in any plan."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base * 2.0 ** (i % 5)).tolist()) for i in range(2, 80)] + [(100 + i, rng.normal(size=16).tolist()) for i in range(300)]
    q = base + 0.1 * rng.normal(size=16)
    rows += [(0, q.tolist())]
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(_frame(spark, rows), F.col("vec_id") == 0).collect()]
    want = sorted((-_cosine(q, np.array(v)), i) for i, v in rows if i)[:5]
    assert [i for _, i, _ in sorted(got)] == [i for _, i in want] == [2, 3, 4, 5, 6]
    assert len({s for _, _, s in got}) == 1


def test_repeated_rows_and_lengths(spark):
    rng = np.random.default_rng(3)
    short = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    long = [(i, rng.normal(size=5).tolist()) for i in range(100, 106)]
    rows = short + short[:4] + [(0, short[1][1])] + long + [(200, None), (201, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    got = ann.nearest(_frame(spark, rows), F.col("vec_id").isin(0, 100)).collect()
    mine = [(r["rank"], r["vec_id"]) for r in got if r["query_id"] == 100]
    want = sorted((-_cosine(np.array(long[0][1]), np.array(v)), i) for i, v in long[1:])[:5]
    assert [i for _, i in sorted(mine)] == [i for _, i in want]
    # Row 0 asks with both of its vectors; its own id is left out, and no id comes twice.
    zero = [r["vec_id"] for r in got if r["query_id"] == 0]
    best = sorted((-max(_cosine(np.array(q), np.array(v)) for q in (short[0][1], short[1][1])), i) for i, v in short if i)[:5]
    assert 0 not in zero and sorted(zero) == sorted(i for _, i in best)
