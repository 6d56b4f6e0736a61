from pyspark.sql import functions as F

from nearlabel.operators import dictionary as D


def test_documents_rows_meet_the_states_once(spark):
    """One join of term frequencies; counts, positions and new words as of each batch."""
    rows = [(0, 0, ["a", "b", "a"]), (1, 0, ["b"]), (2, 1, ["a", "c"]), (3, 1, []), (4, 2, ["c", "c", "b"])]
    out = D.online_vectors(spark.createDataFrame(rows, "doc_id long, batch long, tokens array<string>"))
    scans = [p for p in out._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n").split("\n") if "tf#" in p]
    assert len(scans) == 1
    d, df = {0: 2, 1: 4, 2: 5}, {("a", 0): 1, ("b", 0): 2, ("a", 1): 2, ("c", 1): 1, ("c", 2): 2, ("b", 2): 3}
    place, first = {"a": 0, "b": 1, "c": 2}, {"a": 0, "b": 0, "c": 2}
    import math

    want = []
    for i, b, tokens in rows:
        w = {t: tokens.count(t) * math.log10(d[b]) / (df[t, b] + 1) for t in set(tokens)}
        size = math.sqrt(sum(x * x for x in w.values()))
        want += [(i, place[t], round(x / size, 6), sum(first[t] == i for t in w)) for t, x in w.items()]
    assert sorted(map(tuple, out.withColumn("w", F.round("w", 6)).collect())) == sorted(want)
