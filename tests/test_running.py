from pyspark.sql import functions as F

from nearlabel.operators import dictionary as D
from nearlabel.plans import registry


def test_rows_are_moved_once(spark, sf):
    """Documents' rows by token and batch, then a row a batch by token: two shuffles, and a document's repeats stay home."""
    plan = registry.queries()["running_doc_freq"](spark, sf)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning(") == 2 and "array_distinct" in plan


def test_repeats_count_once(spark):
    rows = [(1, 0, "a"), (1, 0, "a"), (2, 0, "a"), (3, 1, "a"), (3, 1, "b"), (None, 2, "a"), (None, 2, "a")]
    got = D.running_freq(spark.createDataFrame(rows, "doc_id long, batch long, token string"))
    assert sorted(map(tuple, got.collect())) == [("a", 0, 2), ("a", 1, 3), ("a", 2, 4), ("b", 1, 1)]
    assert got.filter(F.col("df").isNull()).count() == 0
