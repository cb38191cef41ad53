"""Caption vectors in the space of image vectors: a ridge regression from the words of captions to the vectors of their images.

What a task sees of the corpus it sums up in a matrix of outer products, whose size is a parameter; matrices are added by rows, so the
whole corpus is fitted and nothing of its size is held anywhere. The solution is a matrix that tasks multiply word counts by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.text import tokens
from lanternfish.operators.knn import _matrix, _unit

#: Places that words are hashed to, and captions that a task holds as a matrix at once.
PLACES, STEP = 512, 1024


def _words(text: Column, places: int) -> Column:
    """The place of each word of a text."""
    return F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(places)).cast("int"))


def _counts(column: pa.Array, places: int) -> np.ndarray:
    """A row a text: damped counts of words by place at unit length, and a 1. A text without words, or null, has the 1 only."""
    out = np.zeros((len(column), places + 1))
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    np.add.at(out, (row, flat), 1.0)
    out[:, :places] = _unit(np.log1p(out[:, :places]))
    out[:, places] = 1.0
    return out


@dataclass(frozen=True)
class Space:
    """``weights``: places + 1 rows of the images' dimensions."""

    weights: np.ndarray
    captions: int

    def said(self, texts: DataFrame) -> DataFrame:
        """(document, embedding) of the distinct ``texts`` (document): unit vectors in the images' space."""
        places = len(self.weights) - 1
        sent = texts.sparkSession.sparkContext.broadcast(self.weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, STEP):
                    part = b.slice(lo, STEP)
                    m = _unit(_counts(part.column(1), places) @ sent.value).astype(np.float32)
                    ends = pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(m.ravel()))], names=["document", "embedding"])

        return texts.select("document").distinct().select("document", _words(F.col("document"), places).alias("w")).mapInArrow(run, "document string, embedding array<float>")


def fit(captions: DataFrame, images: DataFrame, places: int = PLACES, ridge: float = 1e-3) -> Space | None:
    """The space of ``captions`` (image_id, document) and ``images`` (image_id, embedding), all rows that have both; None if there are none.

    ``ridge`` is the weight of the penalty, as a share of the captions. Words are hashed to ``places``. A task sends places + 1 rows,
    which are added up by row: one task solves for the weights, (places + 1) x dimensions numbers, which come to the driver."""
    rows = captions.where("document is not null").select("image_id", _words(F.col("document"), places).alias("w"))
    rows = rows.join(images.where("embedding is not null").select("image_id", F.col("embedding").cast("array<float>").alias("v")), "image_id").select("w", "v")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                part = b.slice(lo, STEP)
                x = _counts(part.column(0), places)
                both = x.T @ np.c_[x, _unit(_matrix(part.column(1)))]
                total = both if total is None else total + both
        if total is not None:
            ends = pa.array(np.arange(len(total) + 1) * total.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], names=["at", "v"])

    def added(rows: pa.Table) -> pa.Table:
        total = _matrix(rows.column("v").combine_chunks()).sum(axis=0)
        return pa.table([rows.column("at").slice(0, 1), pa.array([total], pa.list_(pa.float64()))], names=["at", "v"])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        order = np.argsort(np.concatenate([b.column(0).to_numpy() for b in got]))
        total = np.concatenate([_matrix(b.column(1)) for b in got])[order]
        square, target = total[:, : places + 1], total[:, places + 1 :]
        n = square[places, places]
        penalty = np.full(places + 1, ridge * n)
        penalty[places] = 1e-9 * n  # the mean is not damped
        found = [*np.linalg.solve(square + np.diag(penalty), target), np.array([n])]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["at", "v"])

    schema = "at int, v array<double>"
    rows = rows.mapInArrow(summed, schema).groupBy("at").applyInArrow(added, schema)
    got = [r["v"] for r in rows.repartition(1).mapInArrow(solved, schema).orderBy("at").collect()]  # one task solves what the parameters make of any corpus
    return Space(np.array(got[:-1]), int(round(got[-1][0]))) if got else None


def own_rank(space: Space, captions: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, document, rank, of): the place of each caption's own image among ``images`` by the cosine with the caption's vector, of how many. ``images`` (image_id,
    embedding) are few enough for a task: a held-out sample whose size is a parameter."""
    held = images.where("embedding is not null").select("image_id", F.col("embedding").cast("array<float>").alias("v")).toArrow()
    ids, m = held.column("image_id").to_numpy(), _unit(_matrix(held.column("v").combine_chunks())) if held.num_rows else np.zeros((0, 0))
    sent = captions.sparkSession.sparkContext.broadcast((ids, m))
    known = captions.select("image_id", "document").join(space.said(captions.select("document")), "document").select("image_id", "document", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = sent.value
        at = {i: k for k, i in enumerate(ids.tolist())}
        for b in batches:
            own = [at.get(i) for i in b.column(0).to_pylist()]
            keep = [k for k, o in enumerate(own) if o is not None]
            part, own = b.take(pa.array(keep, pa.int64())), np.array([own[k] for k in keep], dtype=int)
            s = _matrix(part.column(2)) @ m.T if len(own) else np.zeros((0, len(ids)))
            rank = (s > s[np.arange(len(own)), own][:, None]).sum(axis=1) + 1
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rank, pa.int64()), pa.array(np.full(len(own), len(ids)), pa.int64())], names=["image_id", "document", "rank", "of"])

    return known.mapInArrow(run, "image_id bigint, document string, rank bigint, of bigint")
