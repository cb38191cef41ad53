"""Connected components, and near-duplicate clusters with what they count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.operators.skew import join_hot
from lanternfish.sources.scratch import forget, written

#: Links that a task contracts at once. Memory only.
CHUNK = 1 << 20


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, least of its component) that join what the links (a, b) among 0..n-1 join; at most n - 1 of them."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if np.array_equal(before, label) and np.array_equal(label[a], label[b]):
            break
    i = np.flatnonzero(label != np.arange(n))
    return i, label[i]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that join what each run of CHUNK links joins."""
    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.concatenate([np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)])
        nodes, at = np.unique(ends, return_inverse=True)
        x, y = spanning(at[: len(at) // 2], at[len(at) // 2 :], len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[x], pa.int64()), pa.array(nodes[y], pa.int64())], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield star(held)
            held, n = [], 0
    if n:
        yield star(held)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b), a > b. Minima are summed per task before they shuffle; a hub's neighbours
    are dealt over many tasks when they meet its minimum."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg((F.least(F.min("b"), F.first("a")) if large else F.min("b")).alias("m"))
    joined = join_hot(both, least, "a", F.col("b"), how="inner")
    if large:  # neighbours above a point to the least one around
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    # a itself and its other neighbours below it point to the least of them
    return joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")


def _settled(links: DataFrame) -> bool:
    """Whether every node points to one root, and no root points on."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where("out > 1 or (out = 1 and root = 1)").isEmpty()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(a, b): every node of ``links`` (two columns of one integer type) but the least of its component, with that least node.

    Each task first contracts its links to stars; alternating large and small stars (Kiveris et al., 2014)
    then join these over all tasks, until every node points to a root: rounds grow with the log of the size,
    each is written to the shared folder, and each lowers some label, so they come to an end. Links
    between a node and itself, or to null, say nothing.
    """
    x, y = (F.col(c).cast("bigint") for c in links.columns)
    now = written(links.where(x != y).select(x.alias("a"), y.alias("b")).mapInArrow(_contract, "a bigint, b bigint").distinct(), name)
    while not _settled(now):
        mid = written(_star(now, True).distinct(), name)
        forget(now)
        now = written(_star(mid, False).distinct(), name)
        forget(mid)
    return now


def clusters(pairs: DataFrame) -> DataFrame:
    """(image_id, cluster) of every image in ``pairs`` (a, b): cluster is the least id that links reach."""
    stars = components(pairs.select("a", "b"), "clusters")
    kind = pairs.schema["a"].dataType
    members = stars.unionByName(stars.select(F.col("b").alias("a"), "b").distinct())
    return members.select(F.col("a").cast(kind).alias("image_id"), F.col("b").cast(kind).alias("cluster"))


def best_partner(pairs: DataFrame) -> DataFrame:
    """(image_id, partner, cosine): for each image of ``pairs`` its most similar one, of equals the least id."""
    both = pairs.select("a", "b", "cosine").union(pairs.select("b", "a", "cosine")).toDF("image_id", "partner", "cosine")
    best = both.groupBy("image_id").agg(F.max(F.struct("cosine", (-F.col("partner")).alias("p"))).alias("m"))
    return best.select("image_id", (-F.col("m.p")).alias("partner"), F.col("m.cosine").alias("cosine"))


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 1")


def twins(sample: DataFrame, members: DataFrame) -> DataFrame:
    """Images that share a cluster with one of ``sample`` (image_id), the sample's own included."""
    hit = members.join(sample.select("image_id"), "image_id", "left_semi").select("cluster").distinct().withColumn("hit", F.lit(True))
    return join_hot(members, hit, "cluster", F.col("image_id"), how="inner").select("image_id")


def further_twins(sample: DataFrame, members: DataFrame) -> DataFrame:
    """One row (sampled, twins, added): images of ``sample``, images that share a cluster with one of them, and
    how many of those leaving out twins takes from an index that the sample has left already."""
    asked = sample.select("image_id").distinct()
    found = twins(asked, members).distinct().join(asked.withColumn("own", F.lit(True)), "image_id", "left")
    counts = found.agg(F.count(F.lit(1)).alias("twins"), F.count_if(F.col("own").isNull()).alias("added"))
    return asked.agg(F.count(F.lit(1)).alias("sampled")).join(F.broadcast(counts))  # one row each


def audit(best: DataFrame, members: DataFrame, sample: DataFrame, near_exact: float = 0.9999) -> DataFrame:
    """One row (near_duplicates, near_exact, clusters, members, largest, sampled, flagged, flagged_pct): images of ``best``
    (image_id, partner, cosine), those whose partner is closer than ``near_exact``, the ten largest clusters'
    sizes, and how many of ``sample`` (image_id) have a partner."""
    counts = best.agg(F.count(F.lit(1)).alias("near_duplicates"), F.count_if(F.col("cosine") > near_exact).alias("near_exact"))
    sizes = cluster_sizes(members)
    total = sizes.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("members"))
    top = sizes.orderBy(F.desc("size"), "cluster").limit(10).agg(F.array_join(F.transform(F.sort_array(F.collect_list("size"), False), lambda x: x.cast("string")), " ").alias("largest"))
    asked = sample.select("image_id").distinct().join(best.select("image_id", F.lit(True).alias("hit")), "image_id", "left")
    flagged = asked.agg(F.count(F.lit(1)).alias("sampled"), F.count("hit").alias("flagged"))
    one = counts.join(F.broadcast(total)).join(F.broadcast(top)).join(F.broadcast(flagged))  # one row each
    return one.withColumn("flagged_pct", F.try_divide(F.col("flagged") * 100.0, "sampled"))
