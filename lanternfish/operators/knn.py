"""Exact nearest neighbours, in blocks, and rankings with a unique last key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.sources.scratch import new_path, written

#: Query vectors that are multiplied at once, and bytes of query vectors that one scan of the images answers.
BLOCK, ROUND_BYTES = 4096, 32 << 20
#: Images that are multiplied at once, and found rows (ids and numbers) that are sent to every task at most. Memory only.
STEP, SENT = 1024, 200_000
TINY = 1e-8
#: Cosines are compared to so many decimals: the last bits depend on the order of summation.
PLACES = 9


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), TINY, None)


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _rounded(s: np.ndarray) -> np.ndarray:
    return np.round(s, PLACES) + 0.0


class _Best:
    """The ``k`` best images of each of ``n`` queries so far, of equal cosines the least ids."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.cosine = k, np.zeros((n, k), dtype=np.int64), np.full((n, k), -np.inf)

    def offer(self, lo: int, s: np.ndarray, at: np.ndarray, own: np.ndarray | None) -> None:
        """Products ``s`` of the queries from ``lo`` on with the images ``at``; ``own`` are ids that queries leave out."""
        k, hi = self.k, lo + len(s)
        floor, most = self.cosine[lo:hi, -1], k + (own is not None)
        if s.shape[1] > most and not np.isfinite(floor).all():
            floor = np.maximum(floor, np.partition(s, -most, axis=1)[:, -most])
        x, y = np.nonzero(s >= floor[:, None] - 10.0**-PLACES)
        if own is not None:
            other = own[x] != at[y]
            x, y = x[other], y[other]
        if not len(x):
            return
        rows = np.unique(x)
        q = np.r_[np.repeat(rows, k), x]
        ids = np.r_[self.ids[lo + rows].ravel(), at[y]]
        v = np.r_[self.cosine[lo + rows].ravel(), _rounded(s[x, y])]
        order = np.lexsort((ids, -v, q))
        first = np.searchsorted(q[order], rows)
        keep = order[first[:, None] + np.arange(k)[None, :]]
        self.ids[lo + rows], self.cosine[lo + rows] = ids[keep], v[keep]


def _rounds(queries: DataFrame, keys: list[str], most: int) -> Iterator[tuple[list[tuple], np.ndarray]]:
    """(keys, vectors) of ``most`` bytes of vectors at a time."""
    held, vectors = [], []
    for *key, v in queries.select(*keys, "embedding").toLocalIterator():
        held.append(tuple(key))
        vectors.append(np.array(v, dtype=np.float64))
        if len(held) * vectors[-1].nbytes >= most:
            yield held, np.array(vectors)
            held, vectors = [], []
    if held:
        yield held, np.array(vectors)


def top_images(queries: DataFrame, images: DataFrame, k: int, exclude_self: bool = False, block: int = BLOCK, unit: bool = True,
               keys: tuple[str, ...] = ("query_id",), round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(keys, image_id, cosine, rank): the ``k`` images of greatest cosine for each query vector, of equals the least id.

    ``queries`` (keys, embedding; keys are integers, the first one the query's id) are normalised and broadcast
    ``round_bytes`` at a time, which is a bound whatever their number; one scan of ``images`` (image_id,
    embedding) answers a round, a block at a time. Each task keeps the best ``k`` of its part for each query,
    so k rows a query and task shuffle. If there are several rounds, each is written to the shared folder.
    ``exclude_self`` leaves out the image whose id is the query's; ``unit=False`` ranks by plain products.
    Null vectors match nothing. Cosines are rounded to nine decimals.
    """
    spark = images.sparkSession
    schema = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in keys) + ", image_id bigint, cosine double"
    names = [*keys, "image_id", "cosine"]
    known = images.where("embedding is not null").select("image_id", "embedding")

    def asked(ids: list[tuple], q: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, _unit(q) if unit else q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            own = np.array([i[0] for i in ids], dtype=np.int64) if exclude_self else None
            best = _Best(len(ids), k)
            for batch in batches:
                for lo in range(0, batch.num_rows, STEP):
                    part = batch.slice(lo, STEP)
                    at, m = part.column(0).to_numpy(), _matrix(part.column(1))
                    m = (_unit(m) if unit else m).T
                    for first in range(0, len(ids), block):
                        best.offer(first, q[first : first + block] @ m, at, None if own is None else own[first : first + block])
            ok = np.isfinite(best.cosine)
            which = np.repeat(np.arange(len(ids)), ok.sum(axis=1))
            out = [pa.array([ids[i][c] for i in which.tolist()], kinds[c]) for c in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(best.ids[ok]), pa.array(best.cosine[ok])], names=names)

        return known.mapInArrow(run, schema)

    kinds = [pa.int32() if queries.schema[c].dataType.simpleString() == "int" else pa.int64() for c in keys]
    found, path = spark.createDataFrame([], schema), None
    for n, (ids, q) in enumerate(_rounds(queries.where("embedding is not null"), list(keys), round_bytes)):
        part = asked(ids, q)
        if n == 0 and len(ids) * q.shape[1] * 8 < round_bytes:
            found = part  # one round: nothing has to be written
            break
        path = path or new_path(spark, "nearest")
        part.write.mode("append").parquet(path)
    if path:
        found = spark.read.schema(schema).parquet(path)
    w = Window.partitionBy(*keys).orderBy(F.desc("cosine"), "image_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def images_of(index: DataFrame) -> DataFrame:
    """(image_id, embedding): rows of an image share one vector."""
    return index.groupBy("image_id").agg(F.first("embedding", ignorenulls=True).alias("embedding"))


def nearest_captions(queries: DataFrame, index: DataFrame, k: int, exclude_self: bool = False, images: DataFrame | None = None,
                     keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, rank, id, image_id, ann_id, document, distance): the ``k`` nearest rows of ``index``, whose ids are unique.

    Images are searched and captions joined afterwards: ``k`` images have ``k`` rows or more, and of each image
    only the first ``k`` rows can be among them. Rows are ranked by their numbers alone; texts, which may be long,
    meet what was found by id and take no part before. Ties go by image_id and ann_id. ``exclude_self`` leaves out
    every row of the query's own image.
    """
    found = top_images(queries, images if images is not None else images_of(index), k, exclude_self, keys=keys)
    first = Window.partitionBy("image_id").orderBy("ann_id")
    rows = index.select("id", "image_id", "ann_id").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k).drop("__n")
    w = Window.partitionBy(*keys).orderBy(F.desc("cosine"), "image_id", "ann_id")
    near = written(found.drop("rank").join(rows, "image_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "near")
    # texts are scanned where they lie: what was found goes to them, if it is as little as a round of queries finds
    asked = F.broadcast(near) if near.count() <= SENT else near
    return index.select("id", "document").join(asked, "id").select(
        *keys, "rank", "id", "image_id", "ann_id", "document", (2.0 * (1.0 - F.col("cosine"))).alias("distance"))
