import pytest
from pyspark.sql import functions as F

from nearlabel.operators import lsh
from nearlabel.plans import registry


def test_top_collisions_in_parts(spark, monkeypatch):
    """Many parts, slices and blocks, full buckets, ties, a null id: as the pairs themselves, counted and ranked."""
    monkeypatch.setattr(lsh, "HELD", 40)
    monkeypatch.setattr(lsh, "ASKING", 9)
    monkeypatch.setattr(lsh, "PAIRS", 16)
    p = lsh.Params(tables=4, bits=3, capacity=5, top_candidates=3)
    ids = spark.range(60).select(F.when(F.col("id") > 0, F.col("id") * 7).alias("doc_id"), "id")
    sigs = ids.select("doc_id", "id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tbl")).select("doc_id", "tbl", F.pmod(F.hash("id", "tbl"), F.lit(8)).alias("bucket"))
    queries = sigs.withColumnRenamed("doc_id", "query_id")
    names = ["query_id", "cand_id", "n", "rank"]
    want = lsh.top_n(lsh.collisions(lsh.query_only(queries, sigs, p)), 3, "n").select(names).collect()
    got = lsh.top_collisions(queries, sigs, p).select(names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) > 100


@pytest.mark.parametrize("name", ["topn_by_count", "filter_low"])
def test_pairs_are_not_moved(spark, sf, monkeypatch, name):
    """The best candidates come without a row a pair and table."""
    monkeypatch.setattr(lsh, "query_only", lambda *_: pytest.fail("pairs"))
    assert registry.queries()[name](spark, sf).limit(1).count() == 1


def test_all_counts_in_parts(spark, monkeypatch):
    """Every pair with its count and the candidate's rows (two, one or none of an id): as the pairs, counted and joined."""
    monkeypatch.setattr(lsh, "HELD", 40)
    monkeypatch.setattr(lsh, "COUNTING", 9)
    monkeypatch.setattr(lsh, "PAIRS", 16)
    p = lsh.Params(tables=4, bits=3, capacity=5)
    ids = spark.range(60).select(F.when(F.col("id") > 0, F.col("id") * 7).alias("doc_id"), "id")
    sigs = ids.select("doc_id", "id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tbl")).select("doc_id", "tbl", F.pmod(F.hash("id", "tbl"), F.lit(8)).alias("bucket"))
    queries = sigs.withColumnRenamed("doc_id", "query_id")
    rows = ids.filter("id < 58").select(F.col("doc_id").alias("cand_id"), F.nullif(F.col("id") % 5, F.lit(3)).cast("int").alias("label"))
    rows = rows.union(rows.filter("cand_id % 2 = 0"))
    names = ["query_id", "cand_id", "n", "label"]
    want = lsh.collisions(lsh.query_only(queries, sigs, p)).join(rows, "cand_id").select(names).collect()
    got = lsh.counted(queries, sigs, rows, p).select(names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) > 300
    assert lsh.counted(queries.limit(0), sigs, rows, p).count() == lsh.counted(queries, sigs.limit(0), rows, p).count() == 0


def test_counted_pairs_are_not_moved(spark, sf, monkeypatch):
    monkeypatch.setattr(lsh, "query_only", lambda *_: pytest.fail("pairs"))
    assert registry.queries()["collision_count_keep"](spark, sf).limit(1).count() == 1
