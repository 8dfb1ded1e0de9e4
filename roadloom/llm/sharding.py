"""Proportional stratified interleaving: every shard has the mixture of sources that the whole has.

Rows are shuffled by a seeded hash and ranked within their source; the rank as a fraction of the source's size says where
in the whole a row stands.  Sorted by that fraction, the rows are cut into shards whose counts differ by one at most.
Ranks come from a range-partitioned sort: rows are numbered within each partition, and the partitions' counts, one row
for each, give the rest.  So no source is ever gathered in one task, however large it is.

Defined results: a null source is a source of its own; null ids are shuffled like others; equal rows get different
places; with fewer rows than shards some shards are empty; an empty table gives no rows.  Carried columns are kept in
one struct inside, so their names can't clash with those used here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

INDEX = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in this order, as column ``name``."""
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each partition
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(INDEX)).drop("_part", "_at", "_before")


def interleave(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", source_col: str = "source", carry: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``shard`` and ``slot`` (from 0 in each shard) of each row, beside a struct ``row`` of its id and the columns to carry."""
    names = [*dict.fromkeys([id_col, *(carry or [])])]
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    rows = docs.select(F.col(source_col).cast("string").alias("source"), key.alias("key"), F.struct(*names).alias("row"))
    first = numbered(rows.withColumn("tie", F.xxhash64("row")), ["source", "key", "tie"], "at")
    sizes = first.groupBy("source").agg(F.count("*").alias("n"), F.min("at").alias("begin"))
    s = sizes.select(F.col("source").alias("its"), "n", "begin")
    ranked = first.join(s, F.col("source").eqNullSafe(F.col("its")))
    fraction = (2 * (F.col("at") - F.col("begin")) + 1).cast("double") / (2 * F.col("n")).cast("double")
    second = numbered(ranked.select(fraction.alias("fraction"), "at", "row"), ["fraction", "at"], "place")
    total = first.count()
    shard = F.expr(f"cast(place * {shards}L div {max(1, total)}L as int)")
    begin = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return second.withColumn("shard", shard).withColumn("slot", F.col("place") - begin).select("row", "shard", "slot")


def write(docs: DataFrame, folder: str, shards: int = 8, id_col: str = "doc_id", source_col: str = "source", seed: int = 0) -> None:
    """Writes all columns of ``docs`` to a folder for each shard, in order of slot within each file."""
    placed = interleave(docs, shards, id_col, source_col, docs.columns, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("row", "shard", "slot").write.partitionBy("shard").parquet(folder)
