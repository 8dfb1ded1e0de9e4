"""No-go areas and way-points of requests: which areas are left out, which way-points can be used.

Areas are rows (req, nogo, kind, cx, cy, radius, weight, points): a circle, or a polygon or polyline within its circle; a null
weight forbids.  Way-points are rows (req, seq, x, y, direct).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def hits(waypoints: DataFrame, nogos: DataFrame) -> DataFrame:
    """(req, seq, nogo, weight) of the way-points that lie in an area."""
    near = geo.distance_int("x", "y", "cx", "cy") < F.col("radius")
    inside = F.when(F.col("kind") == "polygon", geo.within("x", "y", F.col("points"))).when(F.col("kind") == "polyline", geo.on_polyline("x", "y", F.col("points"))).otherwise(F.lit(True))
    return waypoints.join(nogos, "req").where(near & inside).select("req", "seq", "nogo", "weight")


def cleaned(nogos: DataFrame, waypoints: DataFrame) -> DataFrame:
    """The areas without those that a way-point of their request lies in."""
    return nogos.join(hits(waypoints, nogos).select("req", "nogo").distinct(), ["req", "nogo"], "left_anti")


def all_in_one(nogos: DataFrame, waypoints: DataFrame) -> DataFrame:
    """(req, all_in): whether one forbidden area holds all way-points of a request, which makes the route a beeline."""
    total = waypoints.groupBy("req").agg(F.count("*").alias("n"))
    held = hits(waypoints, nogos).where("weight is null").groupBy("req", "nogo").agg(F.count("*").alias("held"))
    most = held.groupBy("req").agg(F.max("held").alias("held"))
    return total.join(most, "req", "left").select("req", F.coalesce(F.col("held") == F.col("n"), F.lit(False)).alias("all_in"))


def usable(waypoints: DataFrame, nogos: DataFrame) -> DataFrame:
    """``waypoints`` with ``kept`` and, per request, ``error``.

    A way-point in a forbidden area goes, unless it is the first, or it or the one before is direct, or the one before it lies in
    an area too and was kept.
    """
    inside = hits(waypoints, nogos).where("weight is null").select("req", "seq").distinct().withColumn("inside", F.lit(True))
    order = Window.partitionBy("req").orderBy("seq")
    rows = waypoints.join(inside, ["req", "seq"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    rows = rows.withColumns({"_seed": F.lag("seq").over(order).isNull() | F.col("direct") | F.coalesce(F.lag("direct").over(order), F.lit(False)), "_run": F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(order), "_last": F.lead("seq").over(order).isNull()})
    # rows inside share a run with the row outside before them, which starts none
    run = Window.partitionBy("req", "_run").orderBy("seq")
    rows = rows.withColumn("kept", ~F.col("inside") | F.max(F.col("_seed") & F.col("inside")).over(run))
    whole = Window.partitionBy("req")
    error = F.when(F.max(F.col("_last") & ~F.col("kept")).over(whole), "last wpt in restricted area ").when(F.sum(F.col("kept").cast("int")).over(whole) < 2, "a wpt in restricted area")
    return rows.withColumn("error", error).drop("_seed", "_run", "_last")


def in_boundary(df: DataFrame, x: str, y: str, cx: int, cy: int, radius: float | None = None, box: int | None = None):
    """Whether positions lie within a radius of a point, or in the tiles of ``box`` units around its own."""
    if radius is not None:
        return df.where(geo.distance_int(x, y, F.lit(cx), F.lit(cy)) < radius)
    low = lambda c: c // box * box - box
    return df.where(F.col(x).between(low(cx), low(cx) + 3 * box - 1) & F.col(y).between(low(cy), low(cy) + 3 * box - 1))
