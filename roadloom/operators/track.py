"""Folds and windows over the ordered points of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def steps(points: DataFrame, key: str, order: list[str], x: str = "ilon", y: str = "ilat") -> DataFrame:
    """Distance from the point before (0 for the first) and the turn at it (null at the ends)."""
    w = ordered([key], order)
    px, py, nx, ny = F.lag(x).over(w), F.lag(y).over(w), F.lead(x).over(w), F.lead(y).over(w)
    out = points.withColumns({"_px": px, "_py": py, "_nx": nx, "_ny": ny})
    angle, _ = geo.turn("_px", "_py", x, y, "_nx", "_ny")
    out = out.withColumn("step", F.coalesce(geo.distance("_px", "_py", x, y), F.lit(0.0)))
    return out.withColumn("angle", F.when(F.col("_px").isNotNull() & F.col("_nx").isNotNull(), angle)).drop("_px", "_py", "_nx", "_ny")


def running(points: DataFrame, key: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running sums (new column: summed column) up to each point."""
    w = ordered([key], order).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumns({new: F.sum(old).over(w) for new, old in sums.items()})


def runs(points: DataFrame, key: str, order: list[str], changed: Column) -> DataFrame:
    """``run`` numbers from 1, with a new run where ``changed`` holds; the first point always starts one."""
    w = ordered([key], order)
    first = F.row_number().over(w) == 1
    marked = points.withColumn("_new", F.when(first | F.coalesce(changed, F.lit(False)), 1).otherwise(0))
    return marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged_messages(points: DataFrame, key: str, order: list[str], tags: str, node_tags: str, sums: list[str]) -> DataFrame:
    """Stretches of equal way tags as one row; a point with node tags ends its stretch."""
    w = ordered([key], order)
    marked = points.withColumns({"_t": F.lag(tags).over(w), "_n": F.lag(node_tags).over(w)})
    cut = ~F.col(tags).eqNullSafe(F.col("_t")) | (F.coalesce(F.col("_n"), F.lit("")) != "")
    return runs(marked, key, order, cut).groupBy(key, "run").agg(F.first(tags).alias(tags), F.max(node_tags).alias(node_tags), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])


def changes(points: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """The points at which a column differs from the point before."""
    w = ordered([key], order)
    return points.withColumns({"_p": F.lag(column).over(w), "_r": F.row_number().over(w)}).where((F.col("_r") == 1) | ~F.col("_p").eqNullSafe(F.col(column))).drop("_p", "_r")


def without_repeats(points: DataFrame, key: str, order: list[str], x: str = "ilon", y: str = "ilat") -> DataFrame:
    """The points without those at the place of the point before."""
    w = ordered([key], order)
    return points.withColumns({"_x": F.lag(x).over(w), "_y": F.lag(y).over(w)}).where(F.col("_x").isNull() | (F.col("_x") != F.col(x)) | (F.col("_y") != F.col(y))).drop("_x", "_y")


def gaps_filled(points: DataFrame, key: str, order: list[str], value: str, along: str) -> DataFrame:
    """``filled``: missing values interpolated by the column ``along``; ends take the nearest value."""
    w = ordered([key], order)
    back, fore = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(along))
    out = points.withColumns({"_a": F.last(value, True).over(back), "_b": F.first(value, True).over(fore), "_da": F.last(at, True).over(back), "_db": F.first(at, True).over(fore)})
    share = F.when(F.col("_db") > F.col("_da"), (F.col(along) - F.col("_da")) / (F.col("_db") - F.col("_da"))).otherwise(0.0)
    return out.withColumn("filled", F.coalesce(F.col(value).cast("double"), F.col("_a") + (F.col("_b") - F.col("_a")) * share, F.col("_a").cast("double"), F.col("_b").cast("double"))).drop("_a", "_b", "_da", "_db")


def filtered_ascent(elevations: Column, floor: float = -10.0) -> Column:
    """Ascent in metres of quarter-metre elevations: falls up to the floor must be made good before a rise counts."""
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("last"))

    def step(s, e):
        b = F.when(s["last"].isNull(), F.lit(0.0)).otherwise(s["b"] + (e - s["last"]) / 4.0)
        return F.struct((s["up"] + F.greatest(b, F.lit(0.0))).alias("up"), F.when(b > 0, F.lit(0.0)).otherwise(F.greatest(b, F.lit(floor))).alias("b"), e.cast("double").alias("last"))

    return F.aggregate(F.transform(elevations, lambda x: x.cast("double")), start, step, lambda s: s["up"])


def decayed(steps_: Column, reach: float = 100.0) -> Column:
    """The exponentially decaying sum of structs (rise, distance), as an incline."""
    return F.aggregate(steps_, F.lit(0.0), lambda b, s: (b + s["rise"]) * F.exp(-s["distance"] / reach)) / reach


def totals(points: DataFrame, key: str, order: list[str], x: str = "ilon", y: str = "ilat", elevation: str = "selev") -> DataFrame:
    """Of each track: points, metres, plain and filtered ascent."""
    s = steps(points, key, order, x, y)
    line = F.transform(F.array_sort(F.collect_list(F.struct(*order, elevation))), lambda p: p[elevation])
    out = s.groupBy(key).agg(F.count("*").alias("points"), F.sum("step").alias("metres"), line.alias("_line"))
    known = F.filter("_line", lambda e: e.isNotNull())
    out = out.withColumn("_line", known)
    plain = F.when(F.size("_line") > 0, F.floor((F.element_at("_line", -1) - F.col("_line")[0]) / 4.0 + 0.5).cast("int"))
    return out.select(key, "points", "metres", plain.alias("plain_ascent"), filtered_ascent(F.col("_line")).alias("ascent"))


def trimmed_median(samples: DataFrame, keys: list[str], value: str, weight: str, fraction: float) -> DataFrame:
    """The weighted mean of what is left when ``fraction`` of the weight is cut from both ends together."""
    w = ordered(keys, [value, weight])
    low = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = samples.withColumns({"_low": F.coalesce(low, F.lit(0.0)), "_all": F.sum(weight).over(Window.partitionBy(*keys))})
    cut = F.col("_all") * fraction / 2
    held = F.greatest(F.lit(0.0), F.least(F.col("_low") + F.col(weight), F.col("_all") - cut) - F.greatest(F.col("_low"), cut))
    return out.withColumn("_held", held).groupBy(*keys).agg((F.sum(F.col("_held") * F.col(value)) / F.sum("_held")).alias("median"))
