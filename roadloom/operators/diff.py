"""Differences between two states of a table, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that came, changed or went, with ``change`` (insert, update, delete); of deleted rows the old values."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("_a"))
    b = new.select(*keys, F.struct(*rest).alias("_b"))
    j = a.join(b, keys, "full").where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").otherwise("update")
    return j.select(*keys, F.coalesce("_b", "_a").alias("_v"), change.alias("change")).select(*keys, "_v.*", "change")


def applied(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The new state: rows that the delta names are replaced or go."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta.where("change != 'delete'").drop("change"))


def merged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two deltas, one after the other, as one; deletions are kept."""
    return first.join(second.select(*keys), keys, "left_anti").unionByName(second)
