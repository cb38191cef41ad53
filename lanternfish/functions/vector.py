"""Vector expressions over ``ARRAY<FLOAT>`` columns, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """``a`` at unit length; a zero vector stays near zero."""
    size = F.greatest(norm(a), F.lit(TINY))
    return F.transform(a.cast("array<double>"), lambda x: x / size)


def squared_l2(cosine: Column) -> Column:
    """Squared Euclidean distance of unit vectors."""
    return 2.0 * (1.0 - cosine)


def clip_score(cosine: Column, caption: Column, weight: float = 2.5) -> Column:
    return F.when(F.coalesce(caption, F.lit("")) == "", F.lit(0.0)).otherwise(weight * F.greatest(cosine, F.lit(0.0)))


def int8(a: Column, scale: Column) -> Column:
    """Rounded half to even, clipped to a signed byte."""
    return F.transform(a.cast("array<double>"), lambda x: F.greatest(F.least(F.rint(x * scale), F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))


def is_uncertain(distance: Column, cutoff: float = 0.45) -> Column:
    return F.coalesce(distance > cutoff, F.lit(False))


def hashed_words(words: Column, dims: int) -> Column:
    """A vector of ``dims`` of a text's words: each adds one, or takes it off, at a place that its MD5 names. A text
    encoder without weights, for tests and where no model is loaded."""
    hashes = F.transform(words, F.md5)
    marks = F.transform(hashes, lambda h: F.struct(F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(dims)).alias("at"), F.when(F.substring(h, 9, 1) < "8", 1.0).otherwise(-1.0).alias("sign")))
    nothing = F.array_repeat(F.lit(0.0), dims)
    return F.aggregate(marks, nothing, lambda v, m: F.transform(v, lambda x, i: x + F.when(i == m["at"], m["sign"]).otherwise(0.0)))
