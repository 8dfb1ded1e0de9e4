"""Sessions, recent points, tailing and change streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sessions(events: DataFrame, user: str, ts: str, idle: str = "15 minutes", late: str | None = None) -> DataFrame:
    """Requests of a user with less than ``idle`` between them, as one row: start, end, number.  Works on streams and tables."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    w = F.session_window(ts, idle)
    return rows.groupBy(user, w.alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tail(spark: SparkSession, folder: str, schema: T.StructType, file_format: str = "parquet", most: int = 100) -> DataFrame:
    """Files as they arrive in a folder."""
    return spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", most).load(folder)


def published(stream: DataFrame, keys: list[str], path: str, checkpoint: str, order: str):
    """A started query that applies each micro-batch of changes (with ``change``) to a versioned Parquet state under ``path``.

    Of several changes of a key in a batch the one with the largest ``order`` counts.  A batch that runs again writes the same version again, so its effect is once only.
    """
    from ..operators import diff

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        changes = batch.groupBy(*keys).agg(F.max(F.struct(order, F.struct(*rest).alias("row"))).alias("m")).select(*keys, "m.row.*").drop(order)
        state = changes.where("change != 'delete'").drop("change") if number == 0 else diff.applied(spark.read.parquet(f"{path}/version={number - 1}"), changes, keys)
        state.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent(events: DataFrame, key: str, order: str, value: str, most: int = 2000) -> DataFrame:
    """The last ``most`` values of each key, kept as state on a stream and by rank on a table."""
    if events.isStreaming:
        import pandas as pd

        kind = events.schema[value].dataType.simpleString()
        name = events.schema[key].dataType.simpleString()

        def keep(k, batches, state):
            held = list(state.get[0]) if state.exists else []
            for pdf in batches:
                held += pdf.sort_values(order)[value].tolist()
            held = held[-most:]
            state.update((held,))
            yield pd.DataFrame({key: [k[0]], "held": [held]})

        return events.groupBy(key).applyInPandasWithState(keep, f"{key} {name}, held array<{kind}>", f"held array<{kind}>", "update", "NoTimeout")
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
