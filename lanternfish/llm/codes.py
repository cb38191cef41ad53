"""Product codes of vectors of whole numbers, assigned by partial-distance search (Bei and Gray, 1985)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.batches import released
from lanternfish.llm.mtree import floored, usable
from lanternfish.llm.store import join_hot, picked, written

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors that are compared with a codebook at once. Memory only.
STEP = 2048


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry of ``book``, of equals the least; its squared distance; squares added) for each row of ``v``.

    Positions come in the order of their variance over the codebook, the greatest first. After the first ones the entry with
    the least sum so far is measured completely: its distance is the best so far, and a mask drops
    every entry whose sum strictly exceeds it. Entries that are left go on, are dropped as their sums grow, and halfway
    the best is measured anew. What is left at the end has a complete distance no greater than the best.
    """
    n, width = v.shape
    index, error = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n or not width:
        return index, error, 0
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    # four bytes a sum where no distance can need more
    reach = max(abs(int(x)) for x in (v.min(), v.max(), book.min(), book.max()))
    kind = np.int32 if width * (2 * reach) ** 2 < 1 << 31 else np.int64
    c, added, first = np.ascontiguousarray(book[:, order].astype(kind)), 0, min(width, 4)
    for lo in range(0, n, STEP):
        x = np.ascontiguousarray(v[lo : lo + STEP, order].astype(kind))
        total = np.zeros((len(x), len(c)), dtype=kind)
        for i in range(first):
            gap = x[:, i, None] - c[None, :, i]
            gap *= gap
            total += gap
        added += total.size * first

        def complete(rows: np.ndarray, entries: np.ndarray, x=x) -> np.ndarray:
            gap = x[rows] - c[entries]
            return (gap * gap).sum(axis=1, dtype=kind)

        every = np.arange(len(x))
        best = complete(every, total.argmin(axis=1))
        row, entry = np.nonzero(total <= best[:, None])
        total = total[row, entry]
        for i in range(first, width):
            gap = x[row, i] - c[entry, i]
            gap *= gap
            total += gap
            added += len(total)
            if i == (first + width) // 2 and len(row):
                # the least sum of each row so far, measured completely
                least = np.lexsort((entry, total, row))
                least = least[np.r_[True, row[least][1:] != row[least][:-1]]]
                at = row[least]
                best[at] = np.minimum(best[at], complete(at, entry[least]))
            left = total <= best[row]
            row, entry, total = row[left], entry[left], total[left]
        final = np.lexsort((entry, total, row))
        final = final[np.r_[True, row[final][1:] != row[final][:-1]]]
        index[lo : lo + len(x)], error[lo : lo + len(x)] = entry[final], total[final]
    return index, error, added


def _parts(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """rows x parts x width whole numbers; shorter vectors are filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), parts * width), dtype=np.int64)
    out[np.arange(parts * width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out.reshape(len(sizes), parts, width)


def codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """parts x entries x width: the parts of the ``entries`` rows of ``rows`` (vec_id, v) with the least ids, moved ``rounds`` times to the
    floored mean of the parts that are nearest to them. A task sends a sum for each entry, so a round's shuffle is
    bounded by tasks x parts x entries, and codebooks, which are parameters in size, are all that the driver holds."""
    spark = rows.sparkSession
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    books = _parts(first.column(0).combine_chunks(), width, parts).transpose(1, 0, 2)
    sums = ", ".join(f"s{i} bigint" for i in range(width))

    for _ in range(rounds if len(first) else 0):
        sent = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            books = sent.value
            total, count = np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64)
            for b in batches:
                v = _parts(b.column(0), width, parts)
                for p in range(parts):
                    own = nearest(v[:, p], books[p])[0]
                    np.add.at(total[p], own, v[:, p])
                    count[p] += np.bincount(own, minlength=books.shape[1])
            part, entry = np.nonzero(count)
            got = total[part, entry]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), *[pa.array(got[:, i]) for i in range(width)]], names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

        moved = rows.select("v").mapInArrow(released(run), f"part int, entry int, n bigint{', ' + sums if sums else ''}")
        moved = moved.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).toArrow()
        got = np.column_stack([c.to_numpy() for c in moved.columns]).reshape(moved.num_rows, 3 + width)
        books = books.copy()
        books[got[:, 0], got[:, 1]] = got[:, 3:] // got[:, 2:3]
        sent.unpersist()
    return books


def vector_codes(rows: DataFrame, scale: int = 1024, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row whose vector is there and finite.

    Components are floor(scale * x), x as a double. Vectors are cut into ``parts`` equal consecutive parts; where the longest
    vector's length isn't a multiple of that, and for shorter vectors, zeros follow. ``code`` has two hex digits a part
    (``entries`` is 256 at most), ``error`` the squared distances of the parts to their entries, ``label_error`` their sum over
    equal labels, null labels being equal. Rows that repeat an id are coded each; null ids come last where
    the least ids are taken, and equal ids in the order of their vectors. Sums must fit a long. An empty table gives an empty result; other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 256 entries")
    spark = rows.sparkSession
    known = picked(rows, id_col, vector_col, label_col).toDF("vec_id", "vector", "label").where(usable(F.col("vector"))).select("vec_id", "label", floored(F.col("vector"), scale).alias("v"))
    longest = known.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    width = -(-longest // parts)
    books = codebooks(known.select("vec_id", "v"), width, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _parts(b.column(2), width, parts)
            found = [nearest(v[:, p], sent.value[p]) for p in range(parts)]
            index, error = np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)
            code = index.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([code[i : i + 2 * parts] for i in range(0, len(code), 2 * parts)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    coded = written(known.mapInArrow(released(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), "vector-codes")
    key = F.struct(F.col("label").isNull().alias("none"), "label")
    # a label may hold a third of all rows
    sums = coded.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error"))
    keyed = coded.select("vec_id", "code", "error", key.alias("key"))
    plain = F.struct(F.col("key.none").alias("none"), F.xxhash64("key.label").alias("h"))
    same = join_hot(keyed.withColumn("k", plain), sums.withColumn("k", plain).select("k", F.col("key").alias("other"), "label_error"), "k", F.xxhash64("vec_id", "code"))
    return same.where(F.col("key.label").eqNullSafe(F.col("other.label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
