"""Approximate and exact nearest neighbours from product-quantised vectors (Jegou, Douze and Schmid, 2011).

Vectors are dealt to lists by their nearest centre; what is left of a vector after its centre is cut into parts, and each part is
a byte, the nearest entry of a codebook. A search scans bytes in place of vectors, a few lists a query, and computes cosines only
of the best by code. Each row also keeps how far its code is from it, so that a code bounds the cosine from above:
the exact search computes the cosines of those whose bound reaches the k-th best, and misses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.operators.knn import PLACES, _matrix, _rounded, _unit
from lanternfish.operators.skew import join_hot
from lanternfish.sources.scratch import written

#: Vectors that centres and codebooks are fitted on at most, entries of a codebook, and rounds of a fit.
SAMPLE, ENTRIES, ROUNDS = 20_000, 256, 8
#: Rows of a list that a task holds at once, rows that are decoded at once, and ids that are sent to every task at most.
HELD, STEP, SENT = 65_536, 2048, 500_000
#: More than rounding takes from a bound.
SLACK = 2 * 10.0**-PLACES


@dataclass(frozen=True)
class Model:
    centres: np.ndarray  # lists x dims
    books: np.ndarray  # parts x ENTRIES x width; parts x width is dims, filled up with zeros

    def cut(self, m: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        out = np.zeros((len(m), parts * width))
        out[:, : m.shape[1]] = m
        return out.reshape(len(m), parts, width)

    def encode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, distance of the code to the row) of unit rows."""
        own = (m @ self.centres.T).argmax(axis=1)
        rest = self.cut(m - self.centres[own])
        code = np.stack([_nearest(rest[:, p], self.books[p]) for p in range(len(self.books))], axis=1).astype(np.uint8)
        return own, code, np.linalg.norm(m - self.decode(own, code), axis=1)

    def decode(self, own: np.ndarray, code: np.ndarray) -> np.ndarray:
        parts = len(self.books)
        return self.centres[own] + self.books[np.arange(parts)[None, :], code].reshape(len(code), -1)[:, : self.centres.shape[1]]


def _nearest(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(m[lo : lo + 4096] @ c.T - half).argmax(axis=1) for lo in range(0, len(m), 4096)]) if len(m) else np.zeros(0, dtype=int)


def _means(m: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """``n`` means of the rows of ``m``; the last row is repeated if there are fewer."""
    c = m[np.linspace(0, len(m) - 1, min(n, len(m))).astype(int)]
    for _ in range(rounds):
        own = _nearest(m, c)
        total = np.zeros_like(c)
        np.add.at(total, own, m)
        count = np.bincount(own, minlength=len(c))[:, None]
        c = np.where(count > 0, total / np.maximum(count, 1), c)
    return np.concatenate([c, np.repeat(c[-1:], n - len(c), axis=0)])


def fit(images: DataFrame, lists: int, parts: int, sample: int = SAMPLE) -> Model | None:
    """Centres and codebooks, from the ``sample`` vectors of the least hashes, in one task. None without vectors."""
    picked = images.where("embedding is not null").select("image_id", "embedding").orderBy(F.xxhash64("image_id"), "image_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        ids = np.concatenate([b.column(0).to_numpy() for b in got])
        m = _unit(np.concatenate([_matrix(b.column(1)) for b in got]))[np.argsort(ids)]
        centres = _means(m, min(lists, len(m)), ROUNDS)
        width = -(-m.shape[1] // parts)
        rest = Model(centres, np.zeros((parts, 1, width))).cut(m - centres[(m @ centres.T).argmax(axis=1)])
        books = np.stack([_means(rest[:, p], ENTRIES, ROUNDS) for p in range(parts)])
        rows = [*centres.tolist(), *books.reshape(-1, width).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["n", "v"])

    # lists + parts x ENTRIES rows: parameters, whatever the images are
    got = [r["v"] for r in picked.repartition(1).mapInArrow(run, "n int, v array<double>").orderBy("n").collect()]
    if not got:
        return None
    books = np.array(got[-parts * ENTRIES :]).reshape(parts, ENTRIES, -1)
    return Model(np.array(got[: -parts * ENTRIES]), books)


@dataclass(frozen=True)
class Index:
    """``rows`` (key, list, code, off), written; ``told`` holds the rows and the greatest angle to its centre of each list."""

    model: Model | None
    rows: DataFrame
    told: dict[int, tuple[int, float]]


def build(images: DataFrame, lists: int = 64, parts: int = 16, sample: int = SAMPLE) -> Index:
    """The index of ``images`` (image_id, embedding), written to the shared folder; images without a vector are not in it."""
    model = fit(images, lists, parts, sample)
    known = images.where("embedding is not null").select("image_id", F.col("embedding").cast("array<float>").alias("embedding"))
    schema = "key bigint, list int, code binary, off double, angle double"
    if model is None:
        return Index(None, known.sparkSession.createDataFrame([], schema).drop("angle"), {})
    sent = known.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                part = b.slice(lo, STEP)
                m = _unit(_matrix(part.column(1)))
                own, code, off = sent.value.encode(m)
                angle = np.arccos(np.clip((m * _unit(sent.value.centres)[own]).sum(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(own, pa.int32()), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(off), pa.array(angle)], names=["key", "list", "code", "off", "angle"])

    rows = written(known.mapInArrow(run, schema), "codes")
    told = {r["list"]: (r["n"], r["a"]) for r in rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("a")).collect()}  # a row a list
    return Index(model, rows.drop("angle"), told)


def _asked(queries: DataFrame, index: Index, probes: int | None) -> DataFrame:
    """(list, key, embedding, floor): each query with the lists it goes to: the ``probes`` whose centres are nearest; or, without a number, all
    that may hold something of its ``floor`` or more."""
    number = np.array(sorted(index.told))
    sent = queries.sparkSession.sparkContext.broadcast((_unit(index.model.centres[number]), number, np.array([index.told[i][1] for i in number])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, number, cover = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                s = _unit(_matrix(part.column(1))) @ centres.T
                if probes is not None:
                    go = np.zeros(s.shape, dtype=bool)
                    np.put_along_axis(go, np.argsort(-s, axis=1, kind="stable")[:, :probes], True, axis=1)
                else:  # no vector of the list is nearer to the query than this
                    gap = np.maximum(np.arccos(np.clip(s, -1, 1)) - cover[None, :] - 1e-6, 0)
                    floor = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                    go = ~(np.cos(gap) < floor[:, None] - SLACK)
                x, y = np.nonzero(go)
                take = part.take(pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(number[y], pa.int32()), *take.columns], names=["list", "key", "embedding", "floor"])

    return queries.select(F.col("query_id").cast("bigint").alias("key"), F.col("embedding").cast("array<float>").alias("embedding"), "floor").mapInArrow(run, "list int, key bigint, embedding array<float>, floor double")


def _by_code(queries: DataFrame, index: Index, probes: int | None, most: int | None, exclude_self: bool) -> DataFrame:
    """(query_id, image_id, score): of the lists that each query goes to the ``most`` rows of greatest cosine by code; or, without
    a number, all rows whose bound reaches the query's floor. A list of over HELD rows is several parts."""
    spark = queries.sparkSession
    parts = spark.createDataFrame([(int(i), -(-n // HELD)) for i, (n, _) in index.told.items()], "list int, parts int")  # a row a list
    asked = _asked(queries, index, probes).join(F.broadcast(parts), "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "key", F.lit(None).cast("binary").alias("code"), "floor", "embedding")
    held = index.rows.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), F.lit(False).alias("asks"), "key", "code", F.col("off").alias("floor"), F.lit(None).cast("array<float>").alias("embedding"))
    model = spark.sparkContext.broadcast(index.model)

    def scored(keys: np.ndarray, code: np.ndarray, off: np.ndarray, own: int, q: np.ndarray, ids: np.ndarray, floor: np.ndarray) -> Iterator[tuple]:
        best, at = np.full((len(q), most or 0), -np.inf), np.zeros((len(q), most or 0), dtype=np.int64)
        for lo in range(0, len(keys), STEP):
            k = keys[lo : lo + STEP]
            s = q @ model.value.decode(np.full(len(k), own), code[lo : lo + STEP]).T
            if exclude_self:
                s[ids[:, None] == k[None, :]] = -np.inf
            if most is None:
                s += off[None, lo : lo + STEP]
                x, y = np.nonzero(~(s < floor[:, None] - SLACK) & np.isfinite(s))
                yield ids[x], k[y], s[x, y]
                continue
            both, names = np.concatenate([best, s], axis=1), np.concatenate([at, np.broadcast_to(k, s.shape)], axis=1)
            if both.shape[1] > most:
                top = np.argpartition(-both, most - 1, axis=1)[:, :most]
                both, names = np.take_along_axis(both, top, axis=1), np.take_along_axis(names, top, axis=1)
            best, at = both, names
        if most is not None:
            x, y = np.nonzero(np.isfinite(best))
            yield ids[x], at[x, y], best[x, y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            lists, part, asks, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            change = (lists[1:] != lists[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])
            cut = np.flatnonzero(np.r_[True, change]) if len(lists) else []
            for lo, hi in zip(cut, [*cut[1:], len(lists)]):
                if (lists[lo], part[lo]) != now:
                    now, held = (lists[lo], part[lo]), []
                rows, off = b.slice(lo, hi - lo), b.column(5).to_numpy(zero_copy_only=False)[lo:hi].astype(float)
                if not asks[lo]:
                    code = np.frombuffer(b"".join(rows.column(4).to_pylist()), dtype=np.uint8).reshape(hi - lo, -1)
                    held.append((key[lo:hi], code, off))
                elif held:
                    keys, code, far = (np.concatenate(c) for c in zip(*held))
                    held = [(keys, code, far)]
                    q = _unit(_matrix(rows.column(6)))
                    for first in range(0, hi - lo, 256):
                        some = slice(first, min(hi - lo, first + 256))
                        for found in scored(keys, code, far, int(now[0]), q[some], key[lo:hi][some], off[some]):
                            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["query_id", "image_id", "score"])

    cells = held.unionByName(asked).select("list", "part", "asks", "key", "code", "floor", "embedding")
    return cells.repartition("list", "part").sortWithinPartitions("list", "part", "asks").mapInArrow(run, "query_id bigint, image_id bigint, score double")


def candidates(queries: DataFrame, index: Index, most: int, probes: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, image_id): for each query the ``most`` rows of greatest cosine by code, in the ``probes`` lists nearest to it."""
    if index.model is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, image_id bigint")
    found = _by_code(queries.where("embedding is not null").withColumn("floor", F.lit(None).cast("double")), index, probes, most, exclude_self)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "image_id")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("query_id", "image_id")


def ranked(found: DataFrame, queries: DataFrame, images: DataFrame, k: int) -> DataFrame:
    """(query_id, image_id, cosine, rank): the ``k`` of greatest cosine of ``found`` (query_id, image_id), of equals the least id. Vectors of
    images that were not found are scanned, but go nowhere."""
    ids = written(found.select("image_id").distinct(), "found-ids")
    known = images.select(F.col("image_id").cast("bigint").alias("image_id"), F.col("embedding").cast("array<float>").alias("v"))
    known = known.join(F.broadcast(ids) if ids.count() <= SENT else ids, "image_id", "left_semi")
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<float>").alias("q"))
    both = join_hot(found, known, "image_id", F.col("query_id"), salts=4, how="inner").join(asked, "query_id").select("query_id", "image_id", "q", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, v = _unit(_matrix(b.column(2))), _unit(_matrix(b.column(3)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_rounded((q * v).sum(axis=1) if len(q) else np.zeros(0)))], names=["query_id", "image_id", "cosine"])

    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "image_id")
    return both.mapInArrow(run, "query_id bigint, image_id bigint, cosine double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, images: DataFrame, index: Index, k: int, probes: int = 8, rerank: int = 10, exclude_self: bool = False) -> DataFrame:
    """(query_id, image_id, cosine, rank): the nearest ``k`` images of each query (query_id, embedding), approximately. ``rerank`` times ``k``
    images a query have their cosine computed, those that are best by code in ``probes`` lists."""
    return ranked(candidates(queries, index, rerank * k, probes, exclude_self), queries, images, k)


def bounded(queries: DataFrame, images: DataFrame, index: Index, k: int, probes: int = 8, rerank: int = 2, exclude_self: bool = False) -> DataFrame:
    """(query_id, image_id): what the exact search has to compute: the rows whose code and its distance to them leave room for a cosine
    as great as the ``k``-th best of an approximate search. The ``k`` nearest images are among them."""
    first = search(queries, images, index, k, probes, rerank, exclude_self)
    floor = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).alias("floor"))
    asked = queries.where("embedding is not null").join(floor, "query_id", "left").select("query_id", "embedding", "floor")
    return written(_by_code(asked, index, None, None, exclude_self).select("query_id", "image_id"), "bounded")


def exact_search(queries: DataFrame, images: DataFrame, index: Index, k: int, probes: int = 8, exclude_self: bool = False) -> DataFrame:
    """(query_id, image_id, cosine, rank): the nearest ``k`` images of each query, of equals the least id; exact, whatever the
    sample that the index was fitted on: lists and rows are left out only if their bounds say so."""
    if index.model is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, image_id bigint, cosine double, rank int")
    return ranked(bounded(queries, images, index, k, probes, exclude_self=exclude_self), queries, images, k)
