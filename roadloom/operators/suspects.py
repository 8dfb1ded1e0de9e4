"""Lists of suspect places: merging, status, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import suspect_level


def merged(suspects: DataFrame) -> DataFrame:
    """One row for each place: largest priority, all triggers."""
    return suspects.groupBy("id").agg(F.max("prio").alias("prio"), F.bit_or("triggers").alias("triggers"))


def listed(suspects: DataFrame, status: DataFrame, least_level: int, now=None) -> DataFrame:
    """Places of at least this level without a status that hides them: false positives, and those deferred until later."""
    now = F.current_timestamp() if now is None else now
    hidden = status.where((F.col("status") == "false positive") | ((F.col("status") == "deferred") & (F.col("ts") > now))).select("id")
    return suspects.withColumn("level", suspect_level("prio")).where(F.col("level") >= least_level).join(hidden, "id", "left_anti")


def priority_offsets(suspects: DataFrame) -> DataFrame:
    """(prio, n, offset): how many places of higher priority stand before those of each."""
    sizes = suspects.groupBy("prio").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("prio")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each priority
    return sizes.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))
