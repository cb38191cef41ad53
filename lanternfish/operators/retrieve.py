"""Retrieval of a caption for each query: one vector, or several variants of it, and what backends make of it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions import vector as V
from lanternfish.operators import knn, selection
from lanternfish.sources.scratch import written

TOP_K, PER_VARIANT = 5, 3
FLOOR = "a photo of a scene"


def variant_name(kind: str, number: int) -> str:
    """``original``, or ``segment_1``, ``object_1`` and so on."""
    return kind if kind == "original" else f"{kind}_{number}"


def variant_names(variants: DataFrame) -> DataFrame:
    """(query_id, variant_no, name) of variants (query_id, variant_no, kind): :func:`variant_name` by the place among the query's variants of the kind."""
    number = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("variant_no"))
    return variants.select("query_id", "variant_no", F.when(F.col("kind") == "original", F.col("kind")).otherwise(F.concat_ws("_", "kind", number.cast("string"))).alias("name"))


def pool_of(queries: DataFrame, index: DataFrame, k: int, exclude_self: bool = False, images: DataFrame | None = None) -> DataFrame:
    found = knn.nearest_captions(queries, index, k, exclude_self, images)
    return found.withColumn("variant_no", F.lit(0))


def basic(queries: DataFrame, index: DataFrame, mode: str = "medoid", top_k: int = TOP_K, exclude_self: bool = False) -> DataFrame:
    """(query_id, caption, distance, mode) from one vector a query; top1 asks for one row only."""
    return selection.choose(pool_of(queries, index, 1 if mode == "top1" else top_k, exclude_self), mode)


def variant_pool(variants: DataFrame, index: DataFrame, k: int = PER_VARIANT, exclude_self: bool = False, images: DataFrame | None = None) -> DataFrame:
    """Candidates of (query_id, variant_no, embedding): every variant of every query is asked in the same scan."""
    return knn.nearest_captions(variants, index, k, exclude_self, images, keys=("query_id", "variant_no"))


def advanced(variants: DataFrame, index: DataFrame, mode: str = "medoid", images: DataFrame | None = None) -> DataFrame:
    """(query_id, caption, distance, mode, variants) from all variants, PER_VARIANT rows each (one if top1)."""
    got = selection.choose(variant_pool(variants, index, 1 if mode == "top1" else PER_VARIANT, images=images), mode)
    n = variants.groupBy("query_id").agg(F.count(F.lit(1)).alias("variants"))
    return got.join(n, "query_id")


def generate(retrieved: DataFrame, backend: str = "retrieval", model: Callable | None = None) -> DataFrame:
    """``retrieved`` with generated_caption. ``retrieval`` passes the caption on; ``blip`` calls ``model``, a
    pandas UDF of (context, prompt) that loads its weights once a worker; another backend is an error."""
    if backend == "retrieval":
        return retrieved.withColumn("generated_caption", F.col("caption"))
    if backend != "blip":
        raise ValueError(f"unknown backend {backend!r}")
    if model is None:
        raise RuntimeError("the model isn't loaded")
    from lanternfish.functions.text import prompt, without_prompt

    asked = retrieved.withColumn("prompt", prompt(F.col("caption")))
    return asked.withColumn("generated_caption", without_prompt(model("caption", "prompt"), F.col("prompt"))).drop("prompt")


def generation_probe(retrieved: DataFrame, model: Callable) -> DataFrame:
    """(query_id, prompt, prompted, bare, echoed) of retrieved captions (query_id, caption): what ``model`` (see :func:`generate`) writes with the prompt and
    without any, as it comes, and whether the first one begins with the prompt."""
    from lanternfish.functions.text import prompt

    asked = retrieved.select("query_id", "caption", prompt(F.col("caption")).alias("prompt"), F.lit("").alias("__none"))
    told = asked.withColumn("prompted", model("caption", "prompt")).withColumn("bare", model("caption", "__none"))
    return told.select("query_id", "prompt", "prompted", "bare", F.coalesce(F.startswith(F.lower("prompted"), F.lower("prompt")), F.lit(False)).alias("echoed"))


def timed(variants: DataFrame, index: DataFrame, mode: str = "medoid", images: DataFrame | None = None, vectors: DataFrame | None = None) -> tuple[DataFrame, dict[str, float]]:
    """((query_id, caption, distance, mode, clip_score), seconds of each stage): each stage is written before the next
    begins, so its wall time is its own. The score is of the caption's vector (``vectors``: document, embedding)
    with that of variant 0, the whole image; null without vectors, and 0 for an empty caption."""
    took, clock = {}, time.perf_counter
    began = clock()
    asked = written(variants, "variants")
    took["variants"], began = clock() - began, clock()
    pool = written(variant_pool(asked, index, 1 if mode == "top1" else PER_VARIANT, images=images), "pool")
    took["search"], began = clock() - began, clock()
    chosen = written(selection.choose(pool, mode, vectors=vectors), "chosen")
    took["choose"], began = clock() - began, clock()
    if vectors is None:
        out = chosen.withColumn("clip_score", F.when(F.coalesce("caption", F.lit("")) == "", 0.0))
    else:
        said = vectors.select(F.col("document").alias("caption"), F.col("embedding").alias("__t")).dropDuplicates(["caption"])
        whole = asked.where("variant_no = 0").select("query_id", F.col("embedding").alias("__i"))
        cosine = V.dot(V.normalise(F.col("__t")), V.normalise(F.col("__i")))
        out = chosen.join(whole, "query_id", "left").join(said, "caption", "left").withColumn("clip_score", V.clip_score(cosine, F.col("caption"))).drop("__t", "__i")
    out = written(out.select("query_id", "caption", "distance", "mode", "clip_score"), "scored")
    took["score"] = clock() - began
    return out, took


def query_latency(queries: DataFrame, index: DataFrame, images: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, ms): wall time of each query asked alone, as a user would; for a few queries, as each is a job."""
    rows = []
    for r in queries.select("query_id", "embedding").toLocalIterator():
        one = queries.sparkSession.createDataFrame([r], queries.select("query_id", "embedding").schema)
        began = time.perf_counter()
        knn.nearest_captions(one, index, k, images=images).write.format("noop").mode("overwrite").save()
        rows.append((r["query_id"], (time.perf_counter() - began) * 1000))
    return queries.sparkSession.createDataFrame(rows, "query_id bigint, ms double")


def search_latency(queries: DataFrame, images: DataFrame, k: int = TOP_K, round_bytes: int = knn.ROUND_BYTES) -> DataFrame:
    """(query_id, ms, work_ms, tasks) of ``queries`` (query_id, embedding): how long each query, asked alone, takes the slowest task of a
    scan of ``images`` (image_id, embedding), which is what it waits for on a cluster where all run at once, and all tasks together.

    Every task times every query on its part, one after another and vectors being read already, so many queries are one job for each round of
    ``round_bytes`` of them, and times hold no planning. What was found is dropped."""
    spark = images.sparkSession
    known, out = images.where("embedding is not null").select("embedding"), None
    for ids, q in knn._rounds(queries.where("embedding is not null"), ["query_id"], round_bytes):
        sent = spark.sparkContext.broadcast(([i[0] for i in ids], knn._unit(q)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            took, best, read = np.zeros(len(ids)), [np.zeros(0)] * len(ids), False
            for b in batches:
                for lo in range(0, b.num_rows, knn.STEP):
                    m, read = knn._unit(knn._matrix(b.column(0).slice(lo, knn.STEP))), True
                    for i in range(len(ids)):
                        began = time.perf_counter()
                        s = np.concatenate([best[i], m @ q[i]])
                        best[i] = np.partition(s, -k)[-k:] if len(s) > k else s
                        took[i] += time.perf_counter() - began
            if read:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(took * 1000)], names=["query_id", "ms"])

        part = known.mapInArrow(run, "query_id bigint, ms double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, ms double, work_ms double, tasks bigint")
    return out.groupBy("query_id").agg(F.max("ms").alias("ms"), F.sum("ms").alias("work_ms"), F.count(F.lit(1)).alias("tasks"))


#: Kinds of variants that each configuration of an ablation asks with, beside the original.
CROPS = {"none": (), "segmentation": ("segment",), "object-detection": ("object",), "both": ("segment", "object"), "random": ("random",)}


def ablation(pool: DataFrame, crops: tuple[str, ...] = tuple(CROPS), modes: tuple[str, ...] = selection.MODES) -> DataFrame:
    """(query_id, crops, mode, caption, distance) of every configuration, from one pool whose candidates have the
    ``kind`` of their variant. A query of a configuration is a query of its own, so one plan chooses for all."""
    if unknown := [c for c in crops if c not in CROPS]:
        raise ValueError(f"unknown crops {unknown}")
    table = F.array(*[F.struct(F.lit(c).alias("crops"), F.array(*map(F.lit, ("original", *CROPS[c]))).alias("kinds")) for c in crops])
    dealt = pool.withColumn("c", F.explode(table)).where(F.array_contains("c.kinds", F.col("kind")))
    dealt = dealt.withColumn("query_id", F.struct("query_id", F.col("c.crops").alias("crops"))).drop("c", "kind")
    out = None
    for mode in modes:
        part = selection.choose(dealt, mode).select("query_id.query_id", "query_id.crops", F.lit(mode).alias("mode"), "caption", F.col("distance").cast("double").alias("distance"))
        out = part if out is None else out.unionByName(part)
    return out
