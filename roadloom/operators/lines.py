"""Joins of line segments with positions, other segments and areas, by the grid cells that their boxes touch.

Segments are rows with two positions; long ones should be cut before (``spatial.pieces``), as a box covers cells by its area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .spatial import cell_key, in_cells, tasks, worked_out
from .tables import stored


#: How much larger the next ring of ``matched`` is; its pairs grow in proportion, and few positions are left by then.
GROWTH = 8


def boxed(df: DataFrame, xs: tuple[Column, Column], ys: tuple[Column, Column], reach: Column, cell: int) -> DataFrame:
    """``df`` with a row for each cell of its box, widened by ``reach`` units."""
    span = lambda lo, hi: F.sequence(F.floor((lo - reach) / cell).cast("long"), F.floor((hi + reach) / cell).cast("long"))
    return df.withColumn("cell_x", F.explode(span(*xs))).withColumn("cell_y", F.explode(span(*ys)))


def _box(names: tuple[str, str, str, str]):
    x1, y1, x2, y2 = names
    return (F.least(x1, x2), F.greatest(x1, x2)), (F.least(y1, y2), F.greatest(y1, y2))


def along(segments: DataFrame, reach: Column, cell: int, ends: tuple[str, str, str, str]) -> DataFrame:
    """``segments`` with a row and ``_cell`` for each cell that may hold a position within ``reach`` metres of it, not for its whole box."""
    (x_lo, x_hi), (y_lo, y_hi) = _box(ends)
    band = lambda y: F.floor(y / 100_000)
    # fixed value: a degree of latitude is 110.57 km at least
    out = segments.withColumn("_high", F.ceil(reach / 0.1105).cast("long") + 1)
    # longitudes are shortest at the end that is nearer to a pole
    kx = F.least(*[geo.band_scales(band(y))[0] for y in (y_lo - F.col("_high"), y_hi + F.col("_high"))])
    wide = F.ceil(reach / kx).cast("long") + 1
    out = out.withColumn("_wide", F.when(wide.between(0, 360_000_000), wide).otherwise(360_000_000))
    span = lambda lo, hi, r: F.sequence(F.floor((lo - F.col(r)) / cell).cast("long"), F.floor((hi + F.col(r)) / cell).cast("long"))
    out = out.withColumn("_cx", F.explode(span(x_lo, x_hi, "_wide")))
    # of each column only the heights of the stretch that its positions can be near to, one unit more for rounding
    x1, y1, x2, y2 = map(F.col, ends)
    slope = F.coalesce((y2 - y1) / F.nullif(x2 - x1, F.lit(0)), F.lit(0.0))
    at = lambda x: y1 + (F.greatest(x_lo, F.least(x_hi, x)) - x1) * slope
    left, right = at(F.col("_cx") * cell - F.col("_wide")), at((F.col("_cx") + 1) * cell + F.col("_wide"))
    low, high = (F.when(x1 == x2, whole).otherwise(part) for whole, part in ((y_lo, F.least(left, right) - 1), (y_hi, F.greatest(left, right) + 1)))
    out = out.withColumns({"_low": low, "_top": high}).withColumn("_cy", F.explode(span(F.col("_low"), F.col("_top"), "_high"))).drop("_low", "_top")
    # the cell's middle is at most its half diagonal farther off, all in units of the reach
    x1, y1, x2, y2 = (F.col(c) / F.col(r) for c, r in zip(ends, ("_wide", "_high") * 2, strict=True))
    px, py = (F.col("_cx") + 0.5) * cell / F.col("_wide"), (F.col("_cy") + 0.5) * cell / F.col("_high")
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / square))).otherwise(0.0)
    ex, ey = px - x1 - t * dx, py - y1 - t * dy
    half = F.sqrt(F.pow(F.lit(cell / 2) / F.col("_wide"), F.lit(2)) + F.pow(F.lit(cell / 2) / F.col("_high"), F.lit(2)))
    out = worked_out(out, {"_off": F.sqrt(ex * ex + ey * ey) - half}, F.col("_off") <= 1 + 1e-6).drop("_off")
    return out.withColumn("_cell", cell_key("_cx", "_cy")).drop("_cx", "_cy", "_high", "_wide")


def near(points: DataFrame, segments: DataFrame, metres: float, cell: int = 31_250, at: tuple[str, str] = ("x", "y"), ends: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Pairs of a position and a segment at most so many metres apart, with ``share`` of the way to its foot and ``distance``."""
    n = tasks(points)
    kx, ky = geo.scales(at[1])
    rows = points.repartition(n).withColumns({"_kx": kx, "_ky": ky, "_there": cell_key(F.floor(F.col(at[0]) / cell), F.floor(F.col(at[1]) / cell))}).repartition(n, "_there")
    keyed = along(segments.repartition(n), F.lit(float(metres)), cell, ends).repartition(n, "_cell")
    share, distance = geo.foot(*at, *ends, (F.col("_kx"), F.col("_ky")))
    # the cells' rows are many more than Spark reckons from the segments, so it must not broadcast them
    pairs = rows.join(keyed.hint("shuffle_hash"), F.col("_there") == F.col("_cell"))
    return worked_out(pairs, {"share": share, "distance": distance}, F.col("distance") <= metres).drop("_cell", "_there", "_kx", "_ky")


def matched(points: DataFrame, segments: DataFrame, metres: float, key: str, segment: str, toward: tuple[str, str] | None = None, k: int = 5, cell: int = 31_250, at: tuple[str, str] = ("x", "y"), ends: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """The k nearest segments of each position, in both directions, with ``foot_x``, ``foot_y``, ``reverse`` and ``rank``.

    Distances count to the millimetre and directions to a thousandth of a degree, so that what is equal is a tie.  Among equally near ones the direction that differs least from that to the next way-point (columns ``toward``) comes first.
    Segments are looked for in rings that grow up to ``metres``.
    """
    found, todo, ring = None, points, _first_ring(segments, k, metres, ends)
    segments = stored(segments, "segments")
    while True:
        last = ring >= metres
        size = max(1, min(cell, round(ring * 36)))
        ranked = _ranked(todo, segments, ring, key, segment, toward, k, size, at, ends)
        # what lies beyond the ring may still tie with what lies within a millimetre of it
        sure = F.count(F.when(F.col("distance") < ring - 0.002, True)).over(Window.partitionBy(key))
        got = stored(ranked.withColumn("_sure", sure), "matched")
        full = (got if last else got.where(F.col("_sure") >= k)).drop("_sure")
        found = full if found is None else found.unionByName(full)
        if last:
            return found
        todo = stored(todo.join(full.select(key).distinct(), key, "left_anti"), "unmatched")
        if todo.isEmpty():
            return found
        ring = min(metres, ring * GROWTH)


def _first_ring(segments: DataFrame, k: int, most: float, ends: tuple[str, str, str, str]) -> float:
    """Metres to either side in which segments that lie evenly come about three times k."""
    x1, y1, x2, y2 = ends
    (x_lo, x_hi), (y_lo, y_hi) = _box(ends)
    length, width, height = segments.agg(F.sum(geo.distance(*ends)), F.max(x_hi) - F.min(x_lo), F.max(y_hi) - F.min(y_lo)).first()
    if not length:
        return most
    # fixed value: metres in a unit of latitude
    return max(1.0, min(most, 3 * k * float(width) * float(height) * 0.111 * 0.111 / (2 * length)))


def _ranked(points, segments, metres, key, segment, toward, k, cell, at, ends) -> DataFrame:
    x1, y1, x2, y2 = ends
    both = near(points, segments, metres, cell, at, ends).withColumn("reverse", F.explode(F.array(F.lit(False), F.lit(True))))
    way = F.when(F.col("reverse"), geo.bearing(x2, y2, x1, y1)).otherwise(geo.bearing(x1, y1, x2, y2))
    off = geo.bearing_difference(way, geo.bearing(*at, *toward)) if toward else F.lit(0.0)
    both = both.withColumns({"distance": F.round("distance", 3), "difference": F.round(off, 3)})
    order = Window.partitionBy(key).orderBy("distance", "difference", segment, "reverse")
    foot = lambda a, b: F.floor(F.col(a) + F.col("share") * (F.col(b) - F.col(a)) + 0.5).cast("long")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumns({"foot_x": foot(x1, x2), "foot_y": foot(y1, y2)})


def meeting(left: DataFrame, right: DataFrame, left_ends: tuple[str, str, str, str], right_ends: tuple[str, str, str, str], keys: list[str], cell: int = 31_250, only: Column | None = None) -> DataFrame:
    """Pairs of segments that meet, once each by ``keys``, with ``kind``: 1 in a point, 2 along a stretch; ``only`` those that meet a condition."""
    none, n = F.lit(0), tasks(left)
    # two boxes share several cells; the pair counts in the first one of both
    low = lambda p, q: F.floor(F.least(p, q) / cell).cast("long")
    (a1, b1, a2, b2), (c1, d1, c2, d2) = left_ends, right_ends
    a = boxed(left.repartition(n).withColumns({"_ax": low(a1, a2), "_ay": low(b1, b2)}), *_box(left_ends), none, cell)
    b = boxed(right.withColumns({"_bx": low(c1, c2), "_by": low(d1, d2)}), *_box(right_ends), none, cell)
    here = (F.col("cell_x") == F.greatest("_ax", "_bx")) & (F.col("cell_y") == F.greatest("_ay", "_by"))
    apart = (F.greatest(a1, a2) < F.least(c1, c2)) | (F.greatest(c1, c2) < F.least(a1, a2)) | (F.greatest(b1, b2) < F.least(d1, d2)) | (F.greatest(d1, d2) < F.least(b1, b2))
    pairs = a.join(b, ["cell_x", "cell_y"]).where(here & only if only is not None else here).where(~apart)
    pairs = worked_out(pairs, {"kind": geo.meetings(*left_ends, *right_ends)}, F.col("kind") > 0)
    return pairs.select(*keys, "kind")


def inside(segments: DataFrame, areas: DataFrame, ring: str, ends: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), cell: int = 31_250, whole: bool = False) -> DataFrame:
    """Pairs of a segment and an area that it touches, or lies in with both ends (``whole``)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    b = boxed(areas, (F.array_min(xs), F.array_max(xs)), (F.array_min(ys), F.array_max(ys)), F.lit(0), cell)
    x1, y1, x2, y2 = ends
    ends_in = [geo.within(x1, y1, F.col(ring)), geo.within(x2, y2, F.col(ring))]
    if whole:
        a = in_cells(segments, x1, y1, cell)
        return a.join(b, ["cell_x", "cell_y"]).where(ends_in[0] & ends_in[1]).drop("cell_x", "cell_y")
    a = boxed(segments, *_box(ends), F.lit(0), cell).withColumns({"_lo_x": F.floor(F.least(x1, x2) / cell).cast("long"), "_lo_y": F.floor(F.least(y1, y2) / cell).cast("long")})
    first = (F.col("cell_x") == F.greatest(F.col("_lo_x"), F.floor(F.array_min(xs) / cell).cast("long"))) & (F.col("cell_y") == F.greatest(F.col("_lo_y"), F.floor(F.array_min(ys) / cell).cast("long")))
    return a.join(b, ["cell_x", "cell_y"]).where(first & (ends_in[0] | ends_in[1] | geo.crosses(x1, y1, x2, y2, F.col(ring), True))).drop("cell_x", "cell_y", "_lo_x", "_lo_y")
