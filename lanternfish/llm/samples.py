"""Bounded samples that models are fitted on: bounded in ids, in rows and in bytes, whatever the tables hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm.store import written

#: Bytes of text of a class that a model is fitted on at most.
FIT_BYTES = 32 << 20


def held_out(id_: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(__id, __y) of each id that ``docs`` has, that has a label and may be learnt from; 1 if any of its labels is."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label) == 1).cast("int")).alias("__y"))
    return written(known.join(docs.select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi"), "labelled")


def first_ids(ids: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of ``ids`` (__id, ...; a row an id), the first by a hash of the id."""
    return ids.orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(most)


def whole_rows(docs: DataFrame, picked: DataFrame, id_col: str, columns: list[str], text_col: str, group: Column, bytes_most: int) -> DataFrame:
    """``picked`` (__id, ...; few enough to broadcast) with ``columns`` of ``docs``: one row an id, that of the least
    hash if several have it. Of each ``group`` texts are kept in the order of a hash of the id until they hold
    ``bytes_most``; a text longer than that is passed over."""
    others = [c for c in picked.columns if c != "__id"]
    met = docs.select(F.col(id_col).alias("__id"), *columns).join(F.broadcast(picked), "__id")
    least = F.min_by(F.struct(*columns, *others), F.xxhash64(*columns)).alias("__row")
    rows = written(met.groupBy("__id").agg(least).select("__id", "__row.*"), "sample")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    sizes = rows.select("__id", group.alias("__group"), size.alias("__size")).where(F.col("__size") <= bytes_most)
    running = F.sum("__size").over(Window.partitionBy("__group").orderBy(F.xxhash64("__id"), "__id").rowsBetween(Window.unboundedPreceding, 0))  # a picked id a row
    kept = sizes.withColumn("__sum", running).where(F.col("__sum") <= bytes_most).select("__id")
    return rows.join(F.broadcast(kept), "__id", "left_semi")
