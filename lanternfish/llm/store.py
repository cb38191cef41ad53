"""Shared storage, lineage cuts and skew-proof joins for the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from lanternfish.operators.skew import join_hot
from lanternfish.sources.scratch import CHECKPOINT, delete_path, forget, new_path, shared_dir, written

__all__ = ["CHECKPOINT", "apart", "delete_path", "forget", "join_hot", "new_path", "one_of_each", "picked", "place_of", "replace_columns", "shared_dir", "written"]


def apart(columns: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """(``columns`` under names that no operator uses, and those names turned back into ``columns``)."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
    return [c.alias(f"__c{i}") for i, c in enumerate(quoted)], [F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)]


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of each value of ``key``, whichever partitions they lie in: that of the least hash of its plain columns.
    Each task keeps one row a key before the shuffle."""
    others = [c for c in rows.columns if c != key]
    plain = [F.col(c) for c in others if isinstance(rows.schema[c].dataType, AtomicType) and not isinstance(rows.schema[c].dataType, VariantType)]
    least = F.min_by(F.struct(*others), F.xxhash64(*plain)).alias("__row")
    return rows.groupBy(key).agg(least).select(*[F.col(f"__row.{c}").alias(c) if c != key else F.col(c) for c in rows.columns])


def replace_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns of ``df`` that keep their place beside results called ``names``: on a clash the result wins."""
    low = {c.lower() for c in names}
    return [c for c in df.columns if c.lower() not in low]


def place_of(df: DataFrame, name: str) -> int:
    """The place of the column that Spark finds under ``name``, in any case."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    found = exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are called {name!r}")
    return found[0]


def picked(df: DataFrame, *names: str) -> DataFrame:
    """The columns of ``df`` that Spark finds under ``names``, and no others."""
    at = [place_of(df, n) for n in names]
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))]).select(*[F.col(f"__c{i}").alias(n) for i, n in zip(at, names)])
