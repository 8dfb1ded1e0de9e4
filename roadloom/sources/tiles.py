"""Routing tiles as Parquet: a folder for each 5 degree tile, sorted by 1 degree square, 1/32 degree cell and place in the cell.

A manifest holds each cell's number of rows and a checksum over them, so a tile can be tested as a whole; tiles carry the version of the tag
dictionary that they were made with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

CELL = 31_250


class VersionError(ValueError):
    """Tiles that were made with another dictionary."""


def placed(rows: DataFrame, x: str = "ilon", y: str = "ilat") -> DataFrame:
    """``rows`` with ``tile`` (name), ``square``, ``cell`` and ``place`` (the order in a cell)."""
    square = (F.floor(F.pmod(F.col(x), F.lit(5_000_000)) / 1_000_000) * 5 + F.floor(F.pmod(F.col(y), F.lit(5_000_000)) / 1_000_000)).cast("int")
    cell = (F.floor(F.pmod(F.col(y), F.lit(1_000_000)) / CELL) * 32 + F.floor(F.pmod(F.col(x), F.lit(1_000_000)) / CELL)).cast("int")
    return rows.withColumns({"tile": geo.tile_name(x, y), "square": square, "cell": cell, "place": geo.zorder(F.pmod(F.col(x), F.lit(CELL)), F.pmod(F.col(y), F.lit(CELL)))})


def _sums(rows: DataFrame) -> DataFrame:
    data = [c for c in rows.columns if c not in ("tile", "version")]
    return rows.groupBy("tile", "square", "cell").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.to_json(F.struct(*sorted(data))))).alias("checksum"))


def write(rows: DataFrame, folder: str, version: tuple[int, int], x: str = "ilon", y: str = "ilat") -> None:
    """Writes rows with a position and the manifest; a tile's rows are a contiguous range of the sort."""
    found = placed(rows, x, y)
    found.repartitionByRange("tile", "square", "cell", "place").sortWithinPartitions("tile", "square", "cell", "place").write.mode("overwrite").partitionBy("tile").parquet(f"{folder}/tiles")
    _sums(found).withColumns({"major": F.lit(version[0]), "minor": F.lit(version[1])}).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, version: tuple[int, int], box: tuple[int, int, int, int] | None = None, x: str = "ilon", y: str = "ilat") -> DataFrame:
    """The rows, of a box (x0, y0, x1, y1) only those of its tiles; tiles of another major version are an error, minor ones are not."""
    made = spark.read.parquet(f"{folder}/manifest").agg(F.min("major"), F.max("major")).first()
    if made[0] is not None and (made[0], made[1]) != (version[0], version[0]):
        raise VersionError(f"tiles of dictionary version {made[1]}, not {version[0]}")
    rows = spark.read.parquet(f"{folder}/tiles")
    if box is None:
        return rows
    x0, y0, x1, y1 = box
    corners = [(a * 5_000_000, b * 5_000_000) for a in range(x0 // 5_000_000, x1 // 5_000_000 + 1) for b in range(y0 // 5_000_000, y1 // 5_000_000 + 1)]
    names = [f"{'W' if a < 180_000_000 else 'E'}{abs(a // 1_000_000 - 180)}_{'S' if b < 90_000_000 else 'N'}{abs(b // 1_000_000 - 90)}" for a, b in corners]
    return rows.where(F.col("tile").isin(names) & F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def check(spark: SparkSession, folder: str) -> DataFrame:
    """(tile, message) of tiles whose rows don't fit their manifest; none if all is well."""
    sums, want = _sums(spark.read.parquet(f"{folder}/tiles")), spark.read.parquet(f"{folder}/manifest")
    both = want.join(sums.withColumnsRenamed({"n": "_n", "checksum": "_c"}), ["tile", "square", "cell"], "full")
    wrong = F.when(F.col("_n").isNull(), "missing cells").when(F.col("n").isNull(), "unknown cells").when(F.col("n") != F.col("_n"), "wrong number of rows").when(F.col("checksum") != F.col("_c"), "checksum error")
    return both.withColumn("message", wrong).where("message is not null").groupBy("tile").agg(F.array_join(F.array_sort(F.collect_set("message")), ", ").alias("message"))
