"""Joins where a few keys hold much of one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_hot(rows: DataFrame, facts: DataFrame, key: str | list[str], spread: Column, salts: int = 16, how: str = "left") -> DataFrame:
    """Equi-join of ``rows`` to ``facts`` (one row a key) where a few keys may hold a third of the rows.

    Each key of ``rows`` is dealt over ``salts`` partitions by the hash of ``spread``; ``facts`` is
    narrow and is repeated for each salt. AQE may split what is still large.
    """
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*([key] if isinstance(key, str) else key), "__salt"], how).drop("__salt")
