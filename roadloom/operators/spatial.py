"""Spatial joins by grid cells: an equi join on cells, then the exact predicate.

The left side is put into the cells that its circle touches, the right side into its own cell, so the join's shuffle
follows the cells.  The left side is dealt to many tasks first, as tables of few bytes make many pairs.  No side is broadcast
unless Spark itself finds it small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .tables import stored


def tasks(df: DataFrame) -> int:
    """How many parts a side is dealt to: pairs may be many where rows and bytes are few."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def worked_out(pairs: DataFrame, columns: dict[str, Column], condition: Column) -> DataFrame:
    """``pairs`` with these columns, where a condition on them holds.

    Spark would copy the columns' expressions into the join, with all that they share, into a method too long to be compiled;
    a projection with a row number stays apart and works each part out once.
    """
    return pairs.withColumns(columns | {"_n": F.monotonically_increasing_id()}).where(condition & (F.col("_n") >= 0)).drop("_n")


def cell_key(x, y) -> Column:
    """A cell's column and row as one number."""
    return F.shiftleft(geo.col(x).cast("long"), 32) + geo.col(y).cast("long")


def covered(df: DataFrame, x: str, y: str, reach: tuple[Column, Column], cell: int, box: tuple[int | None, ...] = (None,) * 4) -> DataFrame:
    """``df`` with one row for each cell that the ellipse of these half axes around its position touches.

    Cells out of ``box`` (the first and last column, the first and last row) are not wanted, and mostly left out.
    """
    low = lambda c, least: F.greatest(F.floor(c / cell).cast("long"), F.lit(least)) if least is not None else F.floor(c / cell).cast("long")
    top = lambda c, most: F.least(F.floor(c / cell).cast("long"), F.lit(most)) if most is not None else F.floor(c / cell).cast("long")
    span = lambda c, r, least, most: F.sequence(low(F.col(c) - r, least), top(F.col(c) + r, most))
    out = df.withColumn("_cx", F.explode(span(x, reach[0], *box[:2]))).withColumn("_cy", F.explode(span(y, reach[1], *box[2:])))
    # from the position to the nearest place in the cell
    off = lambda c, k, r: F.greatest(F.lit(0), F.col(k) * cell - F.col(c), F.col(c) - (F.col(k) + 1) * cell) / r
    dx, dy = off(x, "_cx", reach[0]), off(y, "_cy", reach[1])
    return out.where(dx * dx + dy * dy <= 1).withColumn("_cell", cell_key("_cx", "_cy")).drop("_cx", "_cy")


def in_cells(df: DataFrame, x: str, y: str, cell: int) -> DataFrame:
    return df.withColumn("cell_x", F.floor(F.col(x) / cell).cast("long")).withColumn("cell_y", F.floor(F.col(y) / cell).cast("long"))


def cell_join(left: DataFrame, right: DataFrame, reach: tuple[Column, Column], predicate: Column, cell: int, left_xy: tuple[str, str], right_xy: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows of both sides whose positions are within ``reach`` (units in each direction, of the left row) and meet ``predicate``.

    ``how`` is inner, left, left_semi or left_anti; column names of the sides must differ.
    """
    dealt = left.repartition(tasks(left))
    # row numbers are stored, as all uses of them must agree
    keyed = stored(dealt.withColumn("_row", F.monotonically_increasing_id()), "rows").repartition(tasks(left)) if how != "inner" else dealt
    a = covered(keyed, *left_xy, reach, cell)
    b = right.withColumn("_there", cell_key(F.floor(F.col(right_xy[0]) / cell), F.floor(F.col(right_xy[1]) / cell)))
    meet = (F.col("_cell") == F.col("_there")) & predicate
    pairs = lambda: a.join(b, meet).drop("_cell", "_there", "_row")
    if how == "inner":
        return pairs()
    # whether a row has a match is asked apart, which ends at the first one and moves no pairs
    matched = a.join(b, meet, "left_semi").select("_row").distinct()
    if how != "left":
        return keyed.join(matched, "_row", how).drop("_row")
    return pairs().unionByName(keyed.join(matched, "_row", "left_anti").drop("_row"), allowMissingColumns=True)


def within_distance(left: DataFrame, right: DataFrame, metres: Column, cell: int = 31_250, names: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), how: str = "inner") -> DataFrame:
    """Pairs at most so many metres apart, with their ``distance``; the radius may differ from row to row.

    The scales of all bands of latitude that a left row's pairs can lie in are worked out before the join.
    """
    x1, y1, x2, y2 = names
    # fixed value: a degree of latitude is 110.57 km at least
    high = F.ceil(metres / 0.1105).cast("long") + 1
    band = lambda y: F.floor(y / 100_000).cast("long")
    rows = left.withColumns({"_metres": metres.cast("double"), "_high": high, "_bands": F.sequence(band(F.col(y1) - high), band(F.col(y1) + high))})
    rows = rows.withColumns({"_first": F.col("_bands")[0], "_kx": F.transform("_bands", lambda b: geo.band_scales(b)[0]), "_ky": F.transform("_bands", lambda b: geo.band_scales(b)[1])})
    wide = F.ceil(F.col("_metres") / F.array_min("_kx")).cast("long") + 1
    rows = rows.withColumn("_wide", F.when(wide.between(0, 360_000_000), wide).otherwise(360_000_000)).drop("_bands")
    at = (band(F.floor((F.col(y1) + F.col(y2)) / 2)) - F.col("_first")).cast("int")
    dx, dy = (F.col(x1) - F.col(x2)) * F.get("_kx", at), (F.col(y1) - F.col(y2)) * F.get("_ky", at)
    distance = F.sqrt(dx * dx + dy * dy)
    out = cell_join(rows, right, (F.col("_wide"), F.col("_high")), distance <= F.col("_metres"), cell, (x1, y1), (x2, y2), how)
    if how in ("inner", "left"):
        out = out.withColumn("distance", distance)
    return out.drop("_metres", "_high", "_first", "_kx", "_ky", "_wide")


def within_own_radius(left: DataFrame, right: DataFrame, metres: Column, cell: int = 250_000, names: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Pairs as of ``within_distance``, with their ``distance``, for radii of many cells, where pairs are far more than rows.

    Left rows go to the large cells that their circle touches, with no more than the join needs, and each cell's are dealt to
    many tasks.  The right side goes to all of these, as strips of a cell ordered by x.  A strip is joined with all left rows
    before the next one, so that what a left row finds in it repeats what others found, which files of columns store in few
    bytes.
    """
    x1, y1, x2, y2 = names
    n = tasks(left)
    deals = -(-n // 4)
    # fixed value: a degree of latitude is 110.57 km at least
    high = F.ceil(F.col("_metres") / 0.1105).cast("long") + 1
    around = 360_000_000
    wide = lambda k: F.when(k > 0, F.ceil(F.least(F.col("_metres") / k, F.lit(float(around)))) + 1).otherwise(around)
    first, last = F.floor((F.col(y1) - high) / 100_000), F.floor((F.col(y1) + high) / 100_000)
    rows = left.withColumn("_metres", metres.cast("double")).repartition(n)
    rows = worked_out(rows, {"_high": high, "_low": first, "_top": last, "_deal": F.pmod(F.xxhash64(*left.columns), F.lit(deals)).cast("int")}, F.col("_metres") >= 0)
    # a unit of longitude is shortest at one end of the bands, as long as they do not go around the globe
    shortest = F.when((F.col("_low") >= -900) & (F.col("_top") <= 2700), F.least(geo.band_scales(F.col("_low"))[0], geo.band_scales(F.col("_top"))[0])).otherwise(0.0)
    rows = worked_out(rows, {"_k": shortest}, F.col("_high") >= 0).withColumn("_wide", wide(F.col("_k")))
    box = right.agg(*(F.floor(f(c) / cell).cast("long") for c in (x2, y2) for f in (F.min, F.max))).first()
    a = covered(rows, x1, y1, (F.col("_wide"), F.col("_high")), cell, box).drop("_wide", "_high", "_low", "_top", "_k").repartition(n, "_cell", "_deal")
    # bands of a cell's pairs; the cell's row is the lower half of its key
    row = F.pmod(F.col("_cell") + 2**31, F.lit(2**32)) - 2**31
    lowest = F.floor((F.col(y1) + row * cell) / 200_000)
    scales = [geo.band_scales(lowest + k) for k in range(-(-cell // 200_000) + 1)]
    a = a.withColumns({"_first": lowest, "_high": high, "_kx": F.array(*(kx for kx, _ in scales)), "_ky": F.array(*(ky for _, ky in scales))})
    a = worked_out(a, {}, F.lit(True)).withColumn("_wide", wide(F.array_min("_kx")))
    b = strips(right, x2, y2, cell).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    off = lambda c, low, top, r: F.greatest(F.lit(0), F.col(low) - F.col(c), F.col(c) - F.col(top)) / F.col(r)
    dx, dy = off(x1, "_x0", "_x1", "_wide"), off(y1, "_y0", "_y1", "_high")
    pairs = b.hint("merge").join(a, ["_cell", "_deal"]).where(dx * dx + dy * dy <= 1).select(*left.columns, "_metres", "_first", "_kx", "_ky", F.inline("_strip"))
    at = (F.floor((F.col(y1) + F.col(y2)) / 200_000) - F.col("_first")).cast("int")
    dx, dy = (F.col(x1) - F.col(x2)) * F.get("_kx", at), (F.col(y1) - F.col(y2)) * F.get("_ky", at)
    distance = F.sqrt(dx * dx + dy * dy)
    return pairs.where(distance <= F.col("_metres")).select(*left.columns, *right.columns, distance.alias("distance"))


def strips(df: DataFrame, x: str, y: str, cell: int, size: int = 128) -> DataFrame:
    """Cells cut from south to north into strips of so many rows: ``_cell``, ``_strip`` (rows by x) and the corners of each."""
    keyed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_cell", cell_key(F.floor(F.col(x) / cell), F.floor(F.col(y) / cell)))
    keyed = keyed.withColumn("_n", F.floor((F.row_number().over(Window.partitionBy("_cell").orderBy(y, x)) - 1) / size))
    corners = (F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    rest = [c for c in df.columns if c not in (x, y)]
    return keyed.groupBy("_cell", "_n").agg(F.sort_array(F.collect_list(F.struct(x, y, *rest))).alias("_strip"), *corners).drop("_n")


def nearest(left: DataFrame, right: DataFrame, k: int, metres: float, left_id: str, right_id: str, cell: int = 31_250, names: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """The k nearest of the right side within so many metres of each left row, with ``distance`` and ``rank`` (ties by id).

    They are looked for in rings, the first one as large as the right side's density asks for.
    """
    return nearest_ring(left, right, k, ring_for(right, k, metres, names[2:]), left_id, right_id, metres, cell, names)


def ring_for(right: DataFrame, k: int, most: float, xy: tuple[str, str]) -> float:
    """A radius that holds about three times k rows where they lie evenly."""
    x, y = xy
    n, width, height = right.agg(F.count("*"), F.max(x) - F.min(x), F.max(y) - F.min(y)).first()
    if not n:
        return most
    # fixed value: metres in a unit of latitude
    return max(1.0, min(most, math.sqrt(3 * k * max(float(width), 1.0) * max(float(height), 1.0) / (n * math.pi)) * 0.111))


def _ranked(left: DataFrame, right: DataFrame, k: int, metres: float, left_id: str, right_id: str, cell: int, names: tuple[str, str, str, str]) -> DataFrame:
    pairs = within_distance(left, right, F.lit(metres), cell, names)
    order = Window.partitionBy(left_id).orderBy("distance", right_id)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_ring(left: DataFrame, right: DataFrame, k: int, first: float, left_id: str, right_id: str, most: float = 200_000.0, cell: int = 31_250, names: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """The k nearest, with the radius doubled for the rows that found too few, up to ``most`` metres.

    ``cell`` is the most; small rings have smaller cells.
    """
    found, metres, todo = None, min(first, most), left
    while True:
        size = max(1, min(cell, round(metres * 9)))
        ranked = _ranked(todo, right, k, metres, left_id, right_id, size, names)
        got = stored(ranked.withColumn("_n", F.count("*").over(Window.partitionBy(left_id))), "nearest")
        last = metres >= most
        full = (got if last else got.where(F.col("_n") >= k)).drop("_n")
        found = full if found is None else found.unionByName(full)
        if last:
            return found
        todo = stored(todo.join(full.select(left_id).distinct(), left_id, "left_anti"), "unplaced")
        if todo.isEmpty():
            return found
        metres = min(most, metres * 2)


def in_areas(points: DataFrame, areas: DataFrame, x: str, y: str, ring: str, cell: int = 31_250) -> DataFrame:
    """Pairs of a point and an area (ring of structs x, y) that holds it."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    boxes = areas.withColumn("cell_x", F.explode(F.sequence(F.floor(F.array_min(xs) / cell).cast("long"), F.floor(F.array_max(xs) / cell).cast("long"))))
    boxes = boxes.withColumn("cell_y", F.explode(F.sequence(F.floor(F.array_min(ys) / cell).cast("long"), F.floor(F.array_max(ys) / cell).cast("long"))))
    return in_cells(points, x, y, cell).join(boxes, ["cell_x", "cell_y"]).where(geo.within(x, y, F.col(ring))).drop("cell_x", "cell_y")


def pieces(lines: DataFrame, metres: str, step: float = 20.0) -> DataFrame:
    """One row for each stretch of at most ``step`` metres of a line: ``piece`` from 0, ``begin`` and ``end`` as shares of it."""
    n = F.greatest(F.lit(1), F.ceil(F.col(metres) / step).cast("int"))
    out = lines.withColumn("_n", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return out.withColumn("begin", F.col("piece") * step / F.col(metres)).withColumn("end", F.least(F.lit(1.0), (F.col("piece") + 1) * step / F.col(metres))).drop("_n")


def grid(spark, x0: int, y0: int, x1: int, y1: int, step: int) -> DataFrame:
    """Cells of a box: ``id`` from 1 in order of x and y, and corners."""
    cells = spark.range(1).select(F.explode(F.sequence(F.lit(x0), F.lit(x1 - 1), F.lit(step))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(y0), F.lit(y1 - 1), F.lit(step))))
    rows = -(-(y1 - y0) // step)
    return cells.select((F.floor((F.col("x") - x0) / step) * rows + F.floor((F.col("y") - y0) / step) + 1).cast("long").alias("id"), "x", "y", (F.col("x") + step).alias("x1"), (F.col("y") + step).alias("y1"))
