"""Samples, percentiles, shifts and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.operators.ingest import numbered


def at_places(rows: DataFrame, by: list[str], value: str, places: list[tuple[str, Column]]) -> DataFrame:
    """(by, name, value): of the sorted values of each group those at ``places``, pairs of a name and a place
    that starts at 0 and may use ``n``, the group's size. Nulls are left out. Groups are sorted in ranges
    that may end inside a group, so that a group of any size is no one task's."""
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    placed = numbered(known, [*by, "__v"], 0, "__at")
    groups = placed.groupBy(*by).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("n"))
    asked = groups.select(*by, "__first", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in places])).alias("__p"))
    wanted = asked.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], F.col("__p.name").alias("name"), (F.col("__first") + F.col("__p.at")).alias("__at"))
    got = wanted.join(placed.select("__at", "__v"), "__at")
    return got.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(by)], "name", F.col("__v").alias(value))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(mean, median, least, most, n) of ``value``; the median interpolates."""
    whole = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))
    middle = at_places(rows, by, value, [("low", F.floor((F.col("n") - 1) / 2)), ("high", F.floor(F.col("n") / 2))]).groupBy(*by).agg(F.avg(value).alias("median"))
    same = [F.col(f"w.`{c}`").eqNullSafe(F.col(f"m.`{c}`")) for c in by]
    met = whole.alias("w").join(middle.alias("m"), same, "left") if by else whole.alias("w").join(F.broadcast(middle).alias("m"))  # one row each
    return met.select(*[F.col(f"w.`{c}`") for c in by], "mean", "median", "least", "most", "n")


def percentiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(by, p, latency): of n sorted values the one at min(int(n * p), n - 1)."""
    got = at_places(rows, [by], value, [(str(p), F.least(F.floor(F.col("n") * p), F.col("n") - 1)) for p in shares])
    return got.select(by, F.col("name").cast("double").alias("p"), F.col(value).alias("latency"))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the first by a hash of key and seed: the same rows in any order and on any cluster."""
    return rows.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def stride_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Every (N / n)th row by ``key``, at most ``n``."""
    placed = numbered(rows, [key], 0, "__at")
    step = max(1, placed.count() // n)
    return placed.where(F.col("__at") % step == 0).orderBy("__at").limit(n).drop("__at")


def percent_shift(a: Column, b: Column) -> Column:
    return (F.try_divide(a, b) - 1.0) * 100.0


def recall_at(ranks: DataFrame, queries: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, hits, recall): share of all ``queries`` whose first hit is within k; ``ranks`` is (query_id, first_hit)."""
    rows = queries.select("query_id").join(ranks, "query_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.coalesce(F.col("first_hit") <= F.col("k"), F.lit(False))
    return rows.groupBy("k").agg(F.count_if(hit).alias("hits"), F.avg(hit.cast("double")).alias("recall"))


def median_first_hit(ranks: DataFrame) -> DataFrame:
    """One row (found, median): of the queries whose own image was found, how many and the median rank of its first row."""
    return summary(ranks, [], "first_hit").select(F.col("n").alias("found"), "median")


def first_hits(found: DataFrame) -> DataFrame:
    """(query_id, first_hit): the least rank of a row of the query's own image."""
    return found.where("image_id = query_id").groupBy("query_id").agg(F.min("rank").alias("first_hit"))


def order_mismatches(a: DataFrame, a_order: list[str], b: DataFrame, b_order: list[str], key: str = "id") -> DataFrame:
    """One row (rows_a, rows_b, mismatches): places at which two fetches, each in its own order, have another ``key``."""
    x, y = (numbered(df, order, 0, "__at").select("__at", F.col(key).alias(name)) for df, order, name in ((a, a_order, "x"), (b, b_order, "y")))
    met = x.withColumn("in_a", F.lit(1)).join(y.withColumn("in_b", F.lit(1)), "__at", "full")
    return met.agg(F.count("in_a").alias("rows_a"), F.count("in_b").alias("rows_b"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("mismatches"))


def random_vectors(ids: DataFrame, dims: int, seed: int = 43) -> DataFrame:
    """(query_id, embedding) for each of ``ids`` (query_id): vectors of no meaning, to see what chance would find.

    Each value is the sum of four uniform numbers, the digits of one MD5, less their mean: nearly Gaussian,
    and the same on any cluster.
    """
    def value(i: Column) -> Column:
        h = F.md5(F.concat_ws("-", F.col("query_id").cast("string"), i.cast("string"), F.lit(str(seed))))
        parts = [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("double") for k in range(4)]
        return (parts[0] + parts[1] + parts[2] + parts[3]) / 4294967296.0 - 2.0

    return ids.select("query_id", F.transform(F.sequence(F.lit(1), F.lit(dims)), value).alias("embedding"))


def chance_floor(index: DataFrame, most: int) -> DataFrame:
    """One row (floor): the recall at ``most`` of a search that draws rows by lot."""
    return index.agg(F.try_divide(F.lit(float(most)), F.count(F.lit(1))).alias("floor"))


def disagreement(a: DataFrame, b: DataFrame, value: str, tolerance: float = 1e-6) -> DataFrame:
    """One row (a, b, agree): whether the means of ``value`` of two runs that should be equal are within ``tolerance``."""
    one = a.agg(F.avg(value).alias("a")).join(F.broadcast(b.agg(F.avg(value).alias("b"))))
    return one.withColumn("agree", F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)))


def probe(found: DataFrame) -> DataFrame:
    """(query_id, top1_distance, top1_caption, mean_topk_distance) of ranked candidates (query_id, rank, document, distance)."""
    first = F.min_by(F.struct("distance", "document"), "rank")
    got = found.groupBy("query_id").agg(first.alias("f"), F.avg("distance").alias("mean_topk_distance"))
    return got.select("query_id", F.col("f.distance").alias("top1_distance"), F.col("f.document").alias("top1_caption"), "mean_topk_distance")


def mean_siblings(index: DataFrame, queries: DataFrame) -> DataFrame:
    """One row (queries, mean_excluded): how many rows of the index a query's own image has, which a search leaves out."""
    own = index.groupBy(F.col("image_id").alias("query_id")).agg(F.count(F.lit(1)).alias("n"))
    return queries.select("query_id").join(own, "query_id", "left").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_excluded"))


def tie_ranks(found: DataFrame) -> DataFrame:
    """(query_id, ties, other): of ranked images (query_id, image_id, cosine, rank) how many are as near as the first, and the
    one of these with the greatest id, which a ranking that breaks ties the other way puts first."""
    first = found.where("rank = 1").select("query_id", F.col("cosine").alias("top"), F.col("image_id").alias("first"))
    met = found.join(first, "query_id").where("cosine = top")
    return met.groupBy("query_id").agg(F.count(F.lit(1)).alias("ties"), F.max("image_id").alias("other"))


def chain_disagreement(found: DataFrame) -> DataFrame:
    """One row (queries, disagreements, share, deepest): of ranked rows (query_id, image_id, ann_id, distance) of one search, queries whose
    first row is another if ties go to the last row of equal distance in place of the first, as in a chain that selects before it sorts; and how
    far down such a row is ranked, the first being 0. Distances are equal if they agree to nine decimals."""
    near = found.select("query_id", F.round("distance", 9).alias("d"), F.struct("image_id", "ann_id").alias("row"))
    least = near.groupBy("query_id").agg(F.min(F.struct("d", "row")).alias("first"))
    tied = near.join(least, "query_id").where(F.col("d") == F.col("first.d")).groupBy("query_id").agg(F.max("row").alias("last"), F.first("first.row").alias("first"), F.count(F.lit(1)).alias("ties"))
    other = F.col("last") != F.col("first")
    got = tied.agg(F.count(F.lit(1)).alias("queries"), F.count_if(other).alias("disagreements"), F.coalesce(F.max(F.when(other, F.col("ties") - 1)), F.lit(0)).alias("deepest"))
    return got.select("queries", "disagreements", F.try_divide(F.col("disagreements").cast("double"), "queries").alias("share"), "deepest")


def source_shift(records: DataFrame, base: str) -> DataFrame:
    """(source, mean, median, least, most, n, shift_pct) of nearest distances (source, top1_distance) of several sources that were asked in one
    run: by how much each mean is above that of the source ``base``; null if there is none."""
    told = summary(records, ["source"], "top1_distance")
    first = told.where(F.col("source") == base).agg(F.max("mean").alias("__base"))
    return told.join(F.broadcast(first)).withColumn("shift_pct", percent_shift(F.col("mean"), F.col("__base"))).drop("__base")  # one row
