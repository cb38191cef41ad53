"""Connected components of links that come in batches, without computing those that are known anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.operators import graph
from lanternfish.operators.skew import join_hot
from lanternfish.sources.scratch import forget, written
from lanternfish.sources.snapshots import Table

SCHEMA = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType()), T.StructField("led", T.BooleanType())])


class Folded:
    """Components as a table keyed by node, at ``path``: each node with the root under which it was last written; ``led`` marks nodes that were the
    root of others and are no more, and their rows are always up to date. So a node's root is that of its root's row, two
    steps away whatever came meanwhile, and a batch rewrites the rows of new nodes and of roots that it joins, and no others."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = Table(spark, path, SCHEMA, key="node", group="root")

    @staticmethod
    def _settled(some: DataFrame, rows: DataFrame) -> DataFrame:
        """(node, root) as it is now, of ``some`` of the ``rows``; a component may hold a third of all nodes."""
        now = rows.where("led or node = root").select(F.col("node").alias("root"), F.col("root").alias("now"))
        return join_hot(some.select("node", "root"), now, "root", F.col("node"), how="inner").select("node", F.col("now").alias("root"))

    def labels(self, version: int | None = None) -> DataFrame:
        """(node, root) of every node that a link named: the least node that links reach."""
        rows = self.table.snapshot(version).read()
        return self._settled(rows, rows)

    def fold(self, links: DataFrame) -> int:
        """The version with ``links`` (two columns of integers) folded in, published at once. A batch that died before that is folded again, and folding
        a batch twice changes nothing. Links of a node with itself or with null say nothing."""
        x, y = (F.col(c).cast("bigint") for c in links.columns)
        new = written(links.where(x != y).select(x.alias("a"), y.alias("b")).distinct(), "fold-links")
        rows = self.table.snapshot().read()
        ends = new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))).distinct()
        known = written(ends.join(self._settled(rows.join(ends, "node", "left_semi"), rows), "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("new")), "fold-ends")
        # links between the roots that the batch's nodes have: each end may be in many links
        half = join_hot(new, known.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", F.col("b"), how="inner")
        both = join_hot(half, known.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", F.col("a"), how="inner")
        moved = written(graph.components(both.where("x <> y").select("x", "y").distinct(), "fold-roots"), "fold-moved").toDF("root", "now")
        fresh = known.where("new").select("node", F.col("node").alias("root")).join(moved, "root", "left").select("node", F.coalesce("now", "root").alias("root"), F.lit(False).alias("led"))
        old = moved.join(known.where("new").select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("now").alias("root"), F.lit(True).alias("led"))
        before = rows.where("led").join(moved, "root").select("node", F.col("now").alias("root"), "led")
        version = self.table.upsert(fresh.unionByName(old).unionByName(before))
        forget(new)
        return version
