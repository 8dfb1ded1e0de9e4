"""Spatial joins, nearest neighbours, grids and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial
from .registry import query
from .views import distance_sql, duck, scales_sql, view

D = distance_sql("p.ilon", "p.ilat", "s.ilon", "s.ilat")


def sides(spark, sf):
    p = view(spark, sf, "places").select(F.col("id").alias("place"), F.col("ilon").alias("x1"), F.col("ilat").alias("y1"), "population")
    s = view(spark, sf, "sites").select(F.col("id").alias("site"), F.col("ilon").alias("x2"), F.col("ilat").alias("y2"))
    return p, s


@query(f"SELECT p.id AS place, s.id AS site, round({D}, 3) AS metres FROM {duck('places')} p JOIN {duck('sites')} s ON {D} <= 9645")
def range_join_fixed(spark, sf):
    """JOIN10, JOIN13."""
    p, s = sides(spark, sf)
    return spatial.within_distance(p, s, F.lit(9645.0), 62_500).select("place", "site", (F.floor(F.col("distance") * 1000 + 0.5) / 1000).alias("metres"))


R = "3215 + 64300.0 * p.population / (p.population + 1000000)"


@query(f"SELECT p.id AS place, s.id AS site FROM {duck('places')} p JOIN {duck('sites')} s ON {D} <= {R}")
def range_join_row_radius(spark, sf):
    """JOIN12: the radius depends on the row."""
    p, s = sides(spark, sf)
    radius = 3215 + 64300.0 * F.col("population") / (F.col("population") + 1_000_000)
    return spatial.within_own_radius(p, s, radius).select("place", "site")


@query(f"SELECT p.id AS place, s.id AS site FROM {duck('places')} p LEFT JOIN {duck('sites')} s ON {D} <= 5500")
def spatial_left_outer(spark, sf):
    """JOIN14."""
    p, s = sides(spark, sf)
    return spatial.within_distance(p, s, F.lit(5500.0), 31_250, how="left").select("place", "site")


@query(f"SELECT p.id AS place FROM {duck('places')} p WHERE NOT EXISTS (SELECT 1 FROM {duck('sites')} s WHERE {D} <= 5500)")
def spatial_anti(spark, sf):
    """JOIN21 with a spatial predicate."""
    p, s = sides(spark, sf)
    return spatial.within_distance(p, s, F.lit(5500.0), 31_250, how="left_anti").select("place")


@query(f"SELECT p.id AS a, s.id AS b, round({D}, 3) AS metres FROM {duck('places')} p JOIN {duck('places')} s ON p.id < s.id AND p.nation = s.nation AND {D} <= 2000")
def spatial_self_twin(spark, sf):
    """JOIN15."""
    p = view(spark, sf, "places")
    a = p.select(F.col("id").alias("a"), F.col("ilon").alias("x1"), F.col("ilat").alias("y1"), F.col("nation").alias("n1"))
    b = p.select(F.col("id").alias("b"), F.col("ilon").alias("x2"), F.col("ilat").alias("y2"), F.col("nation").alias("n2"))
    return spatial.within_distance(a, b, F.lit(2000.0)).where("a < b and n1 = n2").select("a", "b", F.round("distance", 3).alias("metres"))


@query(f"SELECT p.id AS place, a.area_id FROM {duck('places')} p JOIN {duck('areas')} a ON p.ilon BETWEEN a.x0 AND a.x0 + 40000 AND p.ilat BETWEEN a.y0 AND a.y0 + 40000")
def within_area(spark, sf):
    """JOIN11, JOIN16, GEO07."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("x0").cast("bigint"), F.col("y0").cast("bigint")
    areas = view(spark, sf, "areas").select("area_id", F.array(corner(x, y), corner(x + 40000, y), corner(x + 40000, y + 40000), corner(x, y + 40000)).alias("ring"))
    points = view(spark, sf, "places").select(F.col("id").alias("place"), "ilon", "ilat")
    return spatial.in_areas(points, areas, "ilon", "ilat", "ring").select("place", "area_id")


@query(f"SELECT place, site, CAST(r AS INT) AS rank FROM (SELECT p.id AS place, s.id AS site, row_number() OVER (PARTITION BY p.id ORDER BY {D}, s.id) AS r FROM {duck('places')} p JOIN {duck('sites')} s ON {D} <= 30000) WHERE r <= 5")
def knn_top5(spark, sf):
    """JOIN29, SRT02."""
    p, s = sides(spark, sf)
    return spatial.nearest(p, s, 5, 30_000, "place", "site", 250_000).select("place", "site", F.col("rank").cast("int").alias("rank"))


@query(f"SELECT place, site, CAST(r AS INT) AS rank FROM (SELECT p.id AS place, s.id AS site, row_number() OVER (PARTITION BY p.id ORDER BY {D}, s.id) AS r FROM {duck('places')} p, {duck('sites')} s) WHERE r <= 3")
def knn_ring_retry(spark, sf):
    """JOIN30: the radius grows for those that found too few."""
    p, s = sides(spark, sf)
    return spatial.nearest_ring(p, s, 3, spatial.ring_for(s, 3, 15_000, ("x2", "y2")), "place", "site", cell=250_000).select("place", "site", F.col("rank").cast("int").alias("rank"))


@query(f"SELECT s.id AS site, round(sum(p.population / (({D} + 1000) * ({D} + 1000))), 6) AS populate, count(*) AS n FROM {duck('places')} p JOIN {duck('sites')} s ON {D} <= 20000 GROUP BY s.id")
def gravity_sum(spark, sf):
    """AGG07, AGG10."""
    from ..operators.enrich import gravity

    p, s = sides(spark, sf)
    pairs = spatial.within_distance(p, s, F.lit(20_000.0), 125_000)
    return gravity(pairs, "site", "distance", "population", F.lit(1.0), F.count("*").alias("n")).select("site", F.round("populate_factor", 6).alias("populate"), "n")


@query(f"SELECT CAST(floor((ilon - 188000000) / 100000.0) * 10 + floor((ilat - 139000000) / 100000.0) + 1 AS BIGINT) AS id, count(*) AS n, CAST(sum(population) AS BIGINT) AS population FROM {duck('places')} GROUP BY 1")
def grid_density(spark, sf):
    """AGG11, UDF04, WIN01."""
    cells = spatial.grid(spark, 188_000_000, 139_000_000, 189_000_000, 140_000_000, 100_000)
    p = view(spark, sf, "places").drop("id").withColumns({"x": F.floor(F.col("ilon") / 100_000) * 100_000, "y": F.floor(F.col("ilat") / 100_000) * 100_000})
    return p.join(cells, ["x", "y"]).groupBy("id").agg(F.count("*").alias("n"), F.sum("population").cast("bigint").alias("population"))


@query(f"SELECT way_id, part, count(*) AS pieces, round(sum(least(1.0, (piece + 1) * 20.0 / metres) - piece * 20.0 / metres), 6) AS whole FROM (SELECT way_id, part, metres, unnest(range(CAST(greatest(1, ceil(metres / 20.0)) AS BIGINT))) AS piece FROM (SELECT way_id, part, max(metres) AS metres FROM {duck('ways')} WHERE metres > 0 GROUP BY ALL)) GROUP BY ALL")
def lateral_pieces(spark, sf):
    """JOIN28."""
    w = view(spark, sf, "ways").where("metres > 0").groupBy("way_id", "part").agg(F.max("metres").alias("metres"))
    return spatial.pieces(w, "metres").groupBy("way_id", "part").agg(F.count("*").alias("pieces"), F.round(F.sum(F.col("end") - F.col("begin")), 6).alias("whole"))


_KX, _KY = scales_sql("p.ilat")
_DX, _DY, _VX, _VY = f"((s.ilon - q.ilon) * {_KX})", f"((s.ilat - q.ilat) * {_KY})", f"((p.ilon - q.ilon) * {_KX})", f"((p.ilat - q.ilat) * {_KY})"
_T = f"CASE WHEN {_DX} * {_DX} + {_DY} * {_DY} > 0 THEN greatest(0.0, least(1.0, ({_VX} * {_DX} + {_VY} * {_DY}) / ({_DX} * {_DX} + {_DY} * {_DY}))) ELSE 0.0 END"


@query(f"SELECT p.id AS place, q.id AS seg, round({_T}, 6) AS share, round(sqrt(({_VX} - {_T} * {_DX}) * ({_VX} - {_T} * {_DX}) + ({_VY} - {_T} * {_DY}) * ({_VY} - {_T} * {_DY})), 3) AS metres FROM {duck('places')} p JOIN {duck('sites')} q ON q.id = p.id % ((SELECT max(s_suppkey) FROM supplier) - 1) + 1 JOIN {duck('sites')} s ON s.id = q.id + 1")
def segment_foot(spark, sf):
    """GEO13, GRF18, of places and the segments between neighbouring sites."""
    p, s = sides(spark, sf)
    q = s.select(F.col("site").alias("seg"), F.col("x2").alias("qx"), F.col("y2").alias("qy"))
    last = view(spark, sf, "sites").agg(F.max("id")).first()[0]
    j = p.join(q, F.col("seg") == F.col("place") % (last - 1) + 1).join(s, F.col("site") == F.col("seg") + 1)
    share, metres = geo.foot("x1", "y1", "qx", "qy", "x2", "y2")
    return j.select("place", "seg", F.round(share, 6).alias("share"), F.round(metres, 3).alias("metres"))
