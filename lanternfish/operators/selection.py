"""From a pool of candidates (query_id, variant_no, rank, document, distance) to one caption a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions import text as T
from lanternfish.functions import vector as V

MODES = ("top1", "medoid", "aggregated")


def first_places(pool: DataFrame) -> DataFrame:
    """Distinct documents of each query in order of variant and rank: pos, and the distance where each is first met."""
    first = pool.groupBy("query_id", "document").agg(F.min(F.struct("variant_no", "rank", "distance")).alias("f"))
    w = Window.partitionBy("query_id").orderBy("f.variant_no", "f.rank")
    return first.select("query_id", "document", F.col("f.distance").alias("distance"), F.row_number().over(w).alias("pos"))


def select_top1(pool: DataFrame) -> DataFrame:
    """(query_id, caption, distance): the nearest first-ranked document; the earliest variant wins ties.

    Distances tie if they agree to nine decimals: the last bits depend on the order of summation.
    """
    near = (F.round("distance", 9) + F.lit(0.0)).alias("near")
    best = pool.where("rank = 1").groupBy("query_id").agg(F.min(F.struct(near, "variant_no", "document", "distance")).alias("b"))
    return best.select("query_id", F.col("b.document").alias("caption"), F.col("b.distance").alias("distance"))


def token_weights(pool: DataFrame) -> DataFrame:
    """(query_id, pos, token, weight): a bag of words at unit length for each distinct document."""
    words = first_places(pool).select("query_id", "pos", F.explode(T.tokens(F.col("document"))).alias("token"))
    counts = words.groupBy("query_id", "pos", "token").agg(F.count(F.lit(1)).cast("double").alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("query_id", "pos")))
    return counts.select("query_id", "pos", "token", (F.col("n") / size).alias("weight"))


def vector_weights(pool: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, pos, token, weight) of the texts' own ``vectors`` (document, embedding; see ``models.encoded``): a
    token is a place in the unit vector, so what :func:`token_weights` is for words this is for an encoder."""
    unit = vectors.select("document", V.normalise(F.col("embedding")).alias("__v"))
    met = first_places(pool).join(unit, "document")
    return met.select("query_id", "pos", F.posexplode("__v").alias("token", "weight"))


def select_medoid(pool: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, caption, distance, mean_similarity): the distinct document most like the others of its pool.

    Similarity is the cosine of the documents' ``vectors`` (document, embedding), or of bags of words without. The mean over the others needs no pairs: it is the
    document's product with the pool's summed vector, less its own. Ties go to the first place; a single
    document is itself, with mean 0. The distance is that of the document's first place in the pool.
    """
    docs = first_places(pool)
    w = token_weights(pool) if vectors is None else vector_weights(pool, vectors)
    total = F.sum("weight").over(Window.partitionBy("query_id", "token"))
    dots = w.withColumn("total", total).groupBy("query_id", "pos").agg(F.sum(F.col("weight") * (F.col("total") - F.col("weight"))).alias("others"))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    mean = F.round(F.coalesce(F.try_divide(F.coalesce("others", F.lit(0.0)), F.col("n") - 1), F.lit(0.0)), 9)
    scored = docs.withColumn("n", n).join(dots, ["query_id", "pos"], "left").withColumn("mean", mean)
    best = scored.groupBy("query_id").agg(F.max(F.struct("mean", (-F.col("pos")).alias("p"), "document", "distance")).alias("b"))
    return best.select("query_id", F.col("b.document").alias("caption"), F.col("b.distance").alias("distance"), F.col("b.mean").alias("mean_similarity"))


def match_distance(pool: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, caption, distance): of the first candidate with the chosen text, not the least; null if it is none."""
    return chosen.select("query_id", "caption").join(first_places(pool).withColumnRenamed("document", "caption"), ["query_id", "caption"], "left").select("query_id", "caption", "distance")


def aggregate_captions(blocks: DataFrame, most: int = 500, least: int = 4) -> DataFrame:
    """(query_id, caption) of (query_id, pos, document): distinct sentences in order, cut at a sentence.

    Sentences are compared without case, spacing and final dots; short ones and null or empty blocks are
    passed over. A query without a sentence has the empty caption.
    """
    parts = blocks.select("query_id", "pos", F.posexplode_outer(T.sentences(F.col("document"))).alias("i", "s"))
    keyed = parts.withColumn("key", T.sentence_key(F.col("s"))).where(F.char_length("key") >= least)
    first = keyed.groupBy("query_id", "key").agg(F.min(F.struct("pos", "i", "s")).alias("f"))
    joined = first.groupBy("query_id").agg(F.array_sort(F.collect_list("f")).alias("all"))
    text = F.array_join(F.transform("all", lambda f: T.with_dot(f["s"])), " ")
    got = joined.select("query_id", T.cut_at_sentence(text, most).alias("caption"))
    return blocks.select("query_id").distinct().join(got, "query_id", "left").select("query_id", F.coalesce("caption", F.lit("")).alias("caption"))


def choose(pool: DataFrame, mode: str = "medoid", aggregate: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, caption, distance, mode); an unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown selection mode {mode!r}; one of {MODES}")
    if mode == "top1":
        got = select_top1(pool)
    elif mode == "medoid":
        got = select_medoid(pool, vectors).drop("mean_similarity")
    else:
        ranked = pool.withColumn("pos", F.struct("variant_no", "rank"))
        if aggregate:
            got = aggregate_captions(ranked)
        else:
            got = ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "document"))), lambda x: x["document"]), " ").alias("caption"))
        got = got.withColumn("distance", F.lit(None).cast("double"))
    return got.select("query_id", "caption", "distance", F.lit(mode).alias("mode"))
