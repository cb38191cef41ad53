"""What rankings lose when vectors are stored in fewer bits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import vector as V


def int8_round_trip(vectors: DataFrame) -> DataFrame:
    """``vectors`` normalised, with ``embedding`` rounded to signed bytes at one scale for the whole table and back."""
    unit = vectors.withColumn("embedding", V.normalise(F.col("embedding")))
    peak = unit.agg(F.max(F.array_max(F.transform("embedding", F.abs))).alias("peak"))
    scaled = unit.join(F.broadcast(peak)).withColumn("scale", F.try_divide(F.lit(127.0), "peak"))  # one row
    return scaled.withColumn("codes", V.int8(F.col("embedding"), F.col("scale"))).withColumn("embedding", F.transform("codes", lambda x: x.cast("double") / F.col("scale"))).drop("peak")


def fp16_round_trip(vectors: DataFrame) -> DataFrame:
    @F.pandas_udf("array<float>")
    def halve(v: pd.Series) -> pd.Series:
        import numpy as np

        return v.map(lambda x: np.asarray(x, dtype=np.float16).astype(np.float32))

    return vectors.withColumn("embedding", halve(V.normalise(F.col("embedding")).cast("array<float>")))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """One row (queries, shared, overlap, flips, flip_rate) of two rankings (query_id, id, rank)."""
    met = a.select("query_id", "id").join(b.select("query_id", "id"), ["query_id", "id"]).agg(F.count(F.lit(1)).alias("shared"))
    tops = a.where("rank = 1").select("query_id", F.col("id").alias("x")).join(b.where("rank = 1").select("query_id", F.col("id").alias("y")), "query_id")
    flips = tops.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("x") != F.col("y")).alias("flips"))
    size = a.agg(F.count(F.lit(1)).alias("ranked"))
    one = flips.join(F.broadcast(met)).join(F.broadcast(size))  # one row each
    return one.select("queries", "shared", F.try_divide(F.col("shared").cast("double"), "ranked").alias("overlap"), "flips", F.try_divide(F.col("flips").cast("double"), "queries").alias("flip_rate"))


def flip_examples(a: DataFrame, b: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, before, after) of the first ``most`` queries, by id, whose first row is another in ``b``: a report of that length."""
    first = lambda df, name: df.where("rank = 1").select("query_id", F.col("id").alias(name))
    return first(a, "before").join(first(b, "after"), "query_id").where("before <> after").orderBy("query_id").limit(most)


def memory_table(vectors: DataFrame) -> DataFrame:
    """(precision, bytes, megabytes, saved_pct): array sizes, which no store promises."""
    size = vectors.agg(F.sum(F.size("embedding").cast("bigint")).alias("values"))
    rows = size.select("values", F.explode(F.array(*[F.struct(F.lit(n).alias("precision"), F.lit(w).alias("width")) for n, w in (("float32", 4), ("float16", 2), ("int8", 1))])).alias("p"))
    total = (F.col("values") * F.col("p.width")).alias("bytes")
    return rows.select("p.precision", total, (F.col("values") * F.col("p.width") / 1e6).alias("megabytes"), ((1 - F.col("p.width") / 4) * 100).alias("saved_pct"))
