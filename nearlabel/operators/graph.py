"""Graph exploration by minimum labels: account normalisation, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nearlabel.session import remove, scratch_dir


class Scratch:
    """Frames cut into one new folder of the shared one. Frames go by ``drop`` once nothing needs them; what a result still
    reads goes with ``session.release`` or at the end of the driver."""

    def __init__(self, spark: SparkSession, name: str = "cut"):
        self.spark, self.path = spark, scratch_dir(spark, name)
        self.made: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame, name: str = "cut") -> DataFrame:
        """The same rows, written to the shared folder and read again: lineage ends here and survives lost executors."""
        return self.counted(df, name)[0]

    def counted(self, df: DataFrame, name: str = "cut", **counts: Column) -> tuple[DataFrame, dict]:
        """As ``cut``, with aggregates of the rows that are taken while they are written."""
        path, seen = f"{self.path}/{name}-{len(self.made)}", Observation()
        (df.observe(seen, *[c.alias(k) for k, c in counts.items()]) if counts else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = out, path
        return out, seen.get if counts else {}

    def drop(self, *frames: DataFrame) -> None:
        """Delete some frames, or without any all of them."""
        for path in [self.made[id(f)][1] for f in frames] or [self.path]:
            remove(self.spark, path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """One frame cut into a folder of its own, which goes with ``session.release`` or at the end of the driver."""
    return Scratch(df.sparkSession, name).cut(df, name)


def adjacency(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines ``v n1 n2 ...`` to (id, neighbours): a sorted array without repeats; blank lines give no row."""
    parts = F.filter(F.split(F.trim(F.col(column)), r"\s+"), lambda x: x != "")
    ids = lines.select(F.transform(parts, lambda x: x.cast("bigint")).alias("p")).filter(F.size("p") > 0)
    return ids.select(F.get("p", F.lit(0)).alias("id"), F.array_sort(F.array_distinct(F.slice("p", 2, F.size("p")))).alias("neighbours"))


def edges_of(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst"))


def first_labels(vertices: DataFrame) -> DataFrame:
    """Round one: a vertex sends the smaller of its id and its smallest out-neighbour to itself and its out-neighbours;
    each takes the smallest it gets. Rows: id, label, activated (whether the label fell)."""
    sent = vertices.select("id", "neighbours", F.least("id", F.array_min("neighbours")).alias("m"))
    messages = sent.select(F.explode(F.concat(F.array("id"), "neighbours")).alias("id"), "m")
    return messages.groupBy("id").agg(F.min("m").alias("m")).select("id", F.least("id", "m").alias("label"), (F.col("m") < F.col("id")).alias("activated"))


def min_label_directed(vertices: DataFrame) -> DataFrame:
    """Fixpoint of messages along out-edges only: id, label. Only vertices whose label fell send again; how many did is
    counted while a round is written."""
    scratch, fell = Scratch(vertices.sparkSession, "min-label"), F.count_if("activated")
    edges = scratch.cut(edges_of(vertices), "edges")
    state, n = scratch.counted(first_labels(vertices), "labels", fell=fell)
    while n["fell"]:
        sent = state.filter("activated").join(edges, state.id == edges.src).groupBy("dst").agg(F.min("label").alias("m"))
        after = state.join(sent, state.id == sent.dst, "left").select("id", F.least("label", "m").alias("label"), F.coalesce(F.col("m") < F.col("label"), F.lit(False)).alias("activated"))
        before, (state, n) = state, scratch.counted(after, "labels", fell=fell)
        scratch.drop(before)
    return state.select("id", "label")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex of ``edges`` (src, dst; either direction): label is its component's smallest id.

    Alternates large-star and small-star steps, so rounds grow with the logarithm of the longest path. A step is a
    minimum by key, which is combined before the shuffle, and a join, which may be split where a key is crowded: no
    neighbourhood is ever collected. Whether a round changed anything is seen while it is written. Self-loops count as
    vertices.
    """
    scratch = Scratch(edges.sparkSession, "components")
    edges = scratch.cut(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), "edges")
    links = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    count = {"n": F.count(F.lit(1)), "mark": F.bit_xor(F.xxhash64("u", "v"))}
    links, mark = scratch.counted(links, "links", **count)
    before = None
    while mark != before and mark["n"]:
        before = mark
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.cut(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, (links, mark) = links, scratch.counted(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links", **count)
        scratch.drop(large, old)
    roots = links.select(F.col("u").alias("id"), F.col("v").alias("label"))
    alone = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(roots.select("id"), "id", "left_anti")
    return roots.union(alone.select("id", F.col("id").alias("label")))
