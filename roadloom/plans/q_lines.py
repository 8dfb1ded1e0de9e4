"""Lines: nearest segments, crossings, lines in areas, what ways collect from lines and areas around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import enrich, lines
from .registry import query
from .views import bearing_sql, distance_sql, duck, foot_sql, view


def points(spark, sf):
    """Places, each with the next one's position."""
    p = view(spark, sf, "places").select(F.col("id").alias("place"), F.col("ilon").alias("x"), F.col("ilat").alias("y"), "nation", "population")
    after = p.select((F.col("place") - 1).alias("place"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return p.join(after, "place")


def rings(spark, sf):
    """The areas as rings."""
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).cast("bigint").alias("x"), (F.col("y0") + dy).cast("bigint").alias("y"))
    return view(spark, sf, "areas").select("area_id", F.array(corner(0, 0), corner(90_000, 0), corner(90_000, 70_000), corner(0, 70_000)).alias("ring"))


_SHARE, _OFF = foot_sql("p.x", "p.y", "s.x1", "s.y1", "s.x2", "s.y2")
_POINTS = f"(SELECT a.id AS place, a.ilon AS x, a.ilat AS y, a.population, b.ilon AS nx, b.ilat AS ny FROM {duck('places')} a JOIN {duck('places')} b ON b.id = a.id + 1)"
_TURN = "least((w - t + 360.0) % 360.0, 360.0 - (w - t + 360.0) % 360.0)"


@query(f"""SELECT place, seg, reverse, rank, distance, CAST(floor(x1 + share * (x2 - x1) + 0.5) AS BIGINT) AS foot_x FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY distance, round({_TURN}, 3), seg, reverse) AS rank
FROM (SELECT p.place, s.*, reverse, {_SHARE} AS share, round({_OFF}, 3) AS distance, CASE WHEN reverse THEN {bearing_sql('s.x2', 's.y2', 's.x1', 's.y1')} ELSE {bearing_sql('s.x1', 's.y1', 's.x2', 's.y2')} END AS w, {bearing_sql('p.x', 'p.y', 'p.nx', 'p.ny')} AS t
FROM {_POINTS} p JOIN {duck('segments')} s ON {_OFF} <= 15000, (SELECT unnest([false, true]) AS reverse))) WHERE rank <= 5""")
def segment_match(spark, sf):
    """JOIN29, SRT02: the five nearest segments of each way-point, in the direction of the next one first."""
    got = lines.matched(points(spark, sf), view(spark, sf, "segments"), 15_000.0, "place", "seg", ("nx", "ny"), 5, 125_000)
    return got.select("place", "seg", "reverse", "rank", "distance", "foot_x")


def _side(a, b, c):
    return f"sign((CAST({b}_x AS HUGEINT) - {a}_x) * ({c}_y - {a}_y) - (CAST({b}_y AS HUGEINT) - {a}_y) * ({c}_x - {a}_x))"


_CROSS = f"(SELECT *, {_side('a', 'b', 'c')} AS s1, {_side('a', 'b', 'd')} AS s2, {_side('c', 'd', 'a')} AS s3, {_side('c', 'd', 'b')} AS s4 FROM (SELECT l.seg AS l, r.seg AS r, l.x1 AS a_x, l.y1 AS a_y, l.x2 AS b_x, l.y2 AS b_y, r.x1 AS c_x, r.y1 AS c_y, r.x2 AS d_x, r.y2 AS d_y FROM {duck('segments')} l JOIN {duck('segments')} r ON l.seg < r.seg))"


_WIDE, _HIGH = (f"(least(greatest(a_{c}, b_{c}), greatest(c_{c}, d_{c})) - greatest(least(a_{c}, b_{c}), least(c_{c}, d_{c})))" for c in "xy")


@query(f"SELECT * FROM (SELECT l AS seg, r AS other, CASE WHEN s1 <> 0 OR s2 <> 0 THEN 1 WHEN {_WIDE} < 0 OR {_HIGH} < 0 THEN 0 WHEN {_WIDE} > 0 OR {_HIGH} > 0 THEN 2 ELSE 1 END AS kind FROM {_CROSS} WHERE s1 * s2 <= 0 AND s3 * s4 <= 0) WHERE kind > 0")
def segment_crossings(spark, sf):
    """JOIN17, GEO09: segments that meet, in a point or along a stretch of a common line."""
    s = view(spark, sf, "segments")
    names = ("x1", "y1", "x2", "y2")
    other = s.toDF("other", "u1", "v1", "u2", "v2")
    return lines.meeting(s, other, names, ("u1", "v1", "u2", "v2"), ["seg", "other"], 250_000, F.col("seg") < F.col("other"))


#: A segment clipped to the box of an area, as shares of its way.
_CLIP = f"""(SELECT s.seg, a.area_id, {distance_sql('s.x1', 's.y1', 's.x2', 's.y2')} AS metres,
greatest(0.0, CASE WHEN s.x2 = s.x1 THEN 0.0 ELSE least((a.x0 - s.x1)::DOUBLE / (s.x2 - s.x1), (a.x0 + 90000 - s.x1)::DOUBLE / (s.x2 - s.x1)) END, CASE WHEN s.y2 = s.y1 THEN 0.0 ELSE least((a.y0 - s.y1)::DOUBLE / (s.y2 - s.y1), (a.y0 + 70000 - s.y1)::DOUBLE / (s.y2 - s.y1)) END) AS t0,
least(1.0, CASE WHEN s.x2 = s.x1 THEN 1.0 ELSE greatest((a.x0 - s.x1)::DOUBLE / (s.x2 - s.x1), (a.x0 + 90000 - s.x1)::DOUBLE / (s.x2 - s.x1)) END, CASE WHEN s.y2 = s.y1 THEN 1.0 ELSE greatest((a.y0 - s.y1)::DOUBLE / (s.y2 - s.y1), (a.y0 + 70000 - s.y1)::DOUBLE / (s.y2 - s.y1)) END) AS t1
FROM {duck('segments')} s, {duck('areas')} a)"""


@query(f"SELECT seg, area_id, round((t1 - t0) * metres, 3) AS metres FROM {_CLIP} WHERE t0 <= t1")
def lines_in_areas(spark, sf):
    """JOIN10, JOIN11, GEO10, GEO11: segments that touch areas, and their length inside."""
    got = lines.inside(view(spark, sf, "segments"), rings(spark, sf), "ring", cell=250_000)
    return got.select("seg", "area_id", F.round(geo.length_in_ring("x1", "y1", "x2", "y2", F.col("ring")), 3).alias("metres"))


@query(f"SELECT s.seg, a.area_id FROM {duck('segments')} s, {duck('areas')} a WHERE least(s.x1, s.x2) >= a.x0 AND greatest(s.x1, s.x2) <= a.x0 + 90000 AND least(s.y1, s.y2) >= a.y0 AND greatest(s.y1, s.y2) <= a.y0 + 70000")
def lines_within_areas(spark, sf):
    """JOIN11: segments that lie in an area."""
    return lines.inside(view(spark, sf, "segments"), rings(spark, sf), "ring", cell=250_000, whole=True).select("seg", "area_id")


def _collected(name, scale, reach, weight, weight_sql, ids):
    near_ = f"(SELECT p.place, p.population % 900 + 1 AS metres, {_OFF} AS d, {weight_sql} AS w FROM {_POINTS} p JOIN {duck('segments')} s ON {_OFF} <= {reach})"

    @query(f"SELECT place, round(sum(w / ((d + {scale}) / {scale})) / (any_value(round_even(metres / 20.0, 0)) + 1), 6) AS factor FROM {near_} GROUP BY place", name)
    def run(spark, sf):
        ways = points(spark, sf).withColumn("metres", F.col("population") % 900 + 1)
        pairs = lines.near(ways, view(spark, sf, "segments"), float(reach))
        return enrich.proximity(pairs, ["place"], "metres", "distance", float(scale), weight()).select("place", F.round("factor", 6).alias("factor"))

    run.__doc__ = f"{ids}: what ways collect from lines near them."


_collected("noise_sums", 15, 7500, lambda: F.col("seg") % 5 / 4.0, "s.seg % 5 / 4.0", "AGG01, JOIN10")
_collected("river_sums", 50, 8000, lambda: F.lit(1.0), "1.0", "AGG02")
_collected("forest_sums", 25, 6430, lambda: F.lit(1.0), "1.0", "AGG03, JOIN13")


@query(f"""SELECT place, round(sum(f), 6) AS factor FROM (SELECT place, sum(0.5 / ((d + 15) / 15.0)) / (any_value(round_even(metres / 20.0, 0)) + 1) AS f FROM (SELECT p.place, p.population % 900 + 1 AS metres, {_OFF} AS d FROM {_POINTS} p JOIN {duck('segments')} s ON {_OFF} <= 7500) GROUP BY place
UNION SELECT p.place, (a.area_id % 3 + 1) / 4.0 AS f FROM {_POINTS} p JOIN {duck('areas')} a ON p.x BETWEEN a.x0 AND a.x0 + 90000 AND p.y BETWEEN a.y0 AND a.y0 + 70000) GROUP BY place""")
def noise_with_airports(spark, sf):
    """AGG04, SET01: the sum over the distinct union of road noise and areas."""
    ways = points(spark, sf).withColumn("metres", F.col("population") % 900 + 1)
    roads = enrich.proximity(lines.near(ways, view(spark, sf, "segments"), 7500.0), ["place"], "metres", "distance", 15.0, F.lit(0.5)).select("place", F.col("factor").alias("f"))
    fields = lines.inside(ways.selectExpr("place", "x as x1", "y as y1", "x as x2", "y as y2"), rings(spark, sf), "ring", cell=125_000, whole=True).select("place", ((F.col("area_id") % 3 + 1) / 4.0).alias("f"))
    return roads.union(fields).distinct().groupBy("place").agg(F.round(F.sum("f"), 6).alias("factor"))


@query(f"SELECT p.id AS place, s.seg, true AS on_it FROM {duck('places')} p JOIN {duck('segments')} s ON p.id % 1000 = s.seg % 1000 WHERE p.id % 2 = 0 UNION ALL SELECT p.id, s.seg, false FROM {duck('places')} p JOIN {duck('segments')} s ON p.id % 1000 = s.seg % 1000 WHERE p.id % 2 = 1")
def position_on_segment(spark, sf):
    """GEO08: ends lie on a segment, positions beside an end don't."""
    p, s = view(spark, sf, "places").select(F.col("id").alias("place")), view(spark, sf, "segments")
    j = p.join(s, F.col("place") % 1000 == F.col("seg") % 1000)
    on = F.when(F.col("place") % 2 == 0, geo.on_segment("x2", "y2", "x1", "y1", "x2", "y2")).otherwise(geo.on_segment(F.col("x2") + F.col("x2") - F.col("x1"), F.col("y2") + F.col("y2") - F.col("y1"), "x1", "y1", "x2", "y2"))
    return j.select("place", "seg", on.alias("on_it"))


@query("WITH RECURSIVE k AS (SELECT DISTINCT CAST(l_quantity AS INT) + 5 AS l FROM lineitem), c AS (SELECT l::DOUBLE AS l, 2 * 0.4 * pow(80 / 3.6, 3) AS p FROM k), b AS (SELECT l, p, p / l + 0.4 * 0.7 * l * l + (1 - 0.7) * 232.0 AS g FROM c), r AS (SELECT 0 AS n, l, p, g, l * 0.8 AS v FROM b UNION ALL SELECT n + 1, l, p, g, v - (p / v + 0.4 * 0.7 * v * v - g) / (2 * 0.7 * 0.4 * v - p / (v * v)) FROM r WHERE n < 5) SELECT CAST(l AS INT) AS limit_speed, round(v, 6) AS speed FROM r WHERE n = 5")
def braking_speeds(spark, sf):
    """GEO22."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_quantity").cast("int") + 5).alias("limit_speed")).distinct()  # noqa: E741
    return l.select("limit_speed", F.round(geo.braking_speed("limit_speed", 2 * 0.4 * (80 / 3.6) ** 3), 6).alias("speed"))


@query("SELECT event_id, CASE WHEN event_id % 9 > 0 THEN CAST(trunc(floor(value) * (1 - event_id % 5 / 4.0) + (event_id % 400) * (event_id % 5 / 4.0)) AS SMALLINT) END AS ele FROM events")
def elevation_on_segment(spark, sf):
    """GEO18."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    first = F.when(F.col("event_id") % 9 > 0, F.floor("value"))
    return e.select("event_id", geo.elevation_between(first, F.col("event_id") % 400, F.col("event_id") % 5 / 4.0).alias("ele"))
