"""Lookups of many queries that share a key."""

from pyspark.sql import functions as F

from lodestone.operators import papers as P


def _rows(spark):
    return spark.range(300).select(F.col("id").alias("row_id"), F.lit("a b c d").alias("normalized_title"), (F.col("id") % 7).alias("cited_by_count"))


def _joined(plan, name):
    """Most rows that a join made."""
    plan.collect()
    most = 0
    todo = [plan._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if name in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_a_key_is_looked_up_once_for_all_its_queries(spark):
    """300 queries of one key, which 300 rows have: 90,000 pairs were made and ranked."""
    rows = _rows(spark)
    want = [r[0] for r in rows.orderBy(F.desc("cited_by_count"), "row_id").limit(5).collect()]
    for look, key in ((P.title_lookup, "a b c d"), (P.prefix_rows, "a b c")):
        keys = rows.select(F.col("row_id").alias("query_id"), F.lit(key).alias("key"))
        plan = look(rows, keys, 5)
        got = plan.collect()
        assert len(got) == 1500
        assert [r["row_id"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 17] == want
        assert _joined(look(rows, keys, 5), "Join") <= 1500
