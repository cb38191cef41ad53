"""Exact deduplication: a first Bloom pass finds words with a bit set twice, a second one the rows that set them; only those rows shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.bloom import bitmap_of, probe, repeated_words, words_for
from lanternfish.llm.store import apart, join_hot, one_of_each, replace_columns, written

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """``text`` without any of space, tab, line feed, vertical tab, form feed, carriage return; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\r\t\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _judged(docs: DataFrame, id_col: str, text_col: str, carried: list[str] | None) -> DataFrame:
    """(``carried`` columns of each row as ``apart`` names them, __id, keep_id, group_size, kept, __key, and __same, the rows
    of the group that repeat the id and length of the best). Without ``carried`` columns the results come from the
    narrow table, so that texts are read once."""
    narrow = [F.col(id_col).alias("__id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("__chars"),
              F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("__key")]
    counted = written(docs.select(*narrow), "dedup-keys")
    hashed = F.xxhash64("__key")
    words = words_for(counted.count())
    bitmap = bitmap_of(repeated_words(counted.select(hashed.alias("__h")), words))

    each = probe(counted, hashed, bitmap, words).where("__maybe").groupBy("__key", "__id", "__chars").agg(F.count(F.lit(1)).alias("__n"))
    groups = each.groupBy("__key").agg(
        F.sum("__n").alias("__size"), F.min(F.struct((-F.col("__chars")).alias("c"), F.col("__id").alias("i"), F.col("__n").alias("n"))).alias("__best")
    )
    groups = written(groups.where("__size > 1"), "dedup-groups")

    held = [] if carried is None else apart(carried)[0]
    rows = counted if carried is None else docs.select(*held, *narrow)
    kept_columns = [*(f"__c{i}" for i in range(len(held))), "__id"]
    looked = probe(rows, hashed, bitmap, words)
    one = looked.where("not __maybe").select(
        *kept_columns, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "__key", F.lit(1).cast("long").alias("__same"))
    many = join_hot(looked.where("__maybe"), groups, "__key", F.col("__id")).select(
        *kept_columns, F.when(F.col("__best").isNull(), F.col("__id")).otherwise(F.col("__best.i")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("__best").isNull() | (F.col("__id").eqNullSafe(F.col("__best.i")) & (F.col("__chars") == -F.col("__best.c")))).alias("kept"), "__key", F.coalesce("__best.n", F.lit(1)).alias("__same"))
    return one.unionByName(many)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = True) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256.

    Rows are equal when their texts are, white space aside. Of equal rows the one with the most code
    points in the original text stays, then the one with the smallest id (a null id is smallest).

    A null text is an empty one; empty texts are equal to each other. Rows that repeat an id, text and
    length share one verdict: all are kept or none. Columns called like a result are replaced by it. A very
    long text is normalised and hashed whole, in its row. An empty table gives an empty result.
    ``carry=False`` returns the id and the results only.
    """
    carried = replace_columns(docs, RESULT) if carry else None
    front = apart(carried)[1] if carry else [F.col("__id").alias(id_col)]
    return _judged(docs, id_col, text_col, carried).select(*front, "keep_id", "group_size", "kept", F.lower(F.hex("__key")).alias("text_sha256"))


def keep_best(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal rows, with all its columns, whatever these are called: of the rows that
    :func:`exact_dedup` keeps, and if several repeat id and length, one of these."""
    kept = _judged(docs, id_col, text_col, docs.columns).where("kept")
    columns = [f"__c{i}" for i in range(len(docs.columns))]
    one = one_of_each(kept.where("__same > 1").select("__key", *columns), "__key")
    return kept.where("__same = 1").select(*columns).unionByName(one.select(*columns)).select(*apart(docs.columns)[1])
