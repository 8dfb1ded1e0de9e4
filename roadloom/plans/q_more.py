"""Turn commands, shapes, no-go areas, rasters, speeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import turns
from ..operators import etl, graph, shape, spatial
from ..operators import track as K
from ..sources.files import with_fallback
from .q_relational import LINKS, _refs, table
from .q_track import LAGGED, ORDER
from .registry import query
from .views import distance_sql, duck, scales_sql, turn_sql, view

_A = "floor(event_id * 37 % 723) / 2 - 180.5"
_LO, _HI = "(CASE WHEN event_id % 4 = 0 THEN -181.0 ELSE event_id * 13 % 180 - 179.0 END)", "(CASE WHEN event_id % 4 = 0 THEN 181.0 ELSE event_id * 29 % 180 + 0.5 END)"
_EXIT, _BEFORE = "CASE WHEN event_id % 50 = 1 THEN 2 WHEN event_id % 50 = 2 THEN -1 ELSE 0 END", "CASE WHEN event_id % 5 = 3 THEN 9 WHEN event_id % 70 = 4 THEN 16 ELSE 0 END"


@query(f"""SELECT event_id, CASE WHEN b = 16 THEN 16 WHEN x > 0 THEN 13 WHEN x < 0 THEN 14 WHEN abs(a) <= 180 AND a <= -179 AND hi = 181 AND lo = -181 THEN 15 WHEN a < -159 THEN 10 WHEN a < -135 THEN 4
WHEN a < -45 THEN CASE WHEN a < -95 AND hi < -30 AND lo < -180 THEN 4 WHEN a > -85 AND lo > -180 AND hi > -10 THEN 3 WHEN a < -110 THEN 4 WHEN a > -60 THEN 3 ELSE 2 END
WHEN a < -21 THEN CASE WHEN b = 9 THEN 9 ELSE 3 END
WHEN a < -5 THEN CASE WHEN lo < -100 AND hi < 45 THEN 3 WHEN lo >= -100 AND hi < 45 THEN 8 WHEN lo > -35 AND hi > 55 THEN 9 ELSE 1 END
WHEN a < 5 THEN CASE WHEN lo > -30 THEN 9 WHEN hi < 30 THEN 8 ELSE 1 END
WHEN a < 21 THEN CASE WHEN lo > -45 AND hi > 100 THEN 6 WHEN lo > -45 THEN 9 WHEN lo < -55 AND hi < 35 THEN 8 ELSE 1 END WHEN a < 45 THEN 6
WHEN a < 135 THEN CASE WHEN a < 85 AND hi < 180 AND lo < 10 THEN 6 WHEN a > 95 AND lo > 30 AND hi > 180 THEN 7 WHEN a > 110 THEN 7 WHEN a < 60 THEN 6 ELSE 5 END WHEN a < 159 THEN 7 WHEN a >= 179 AND a <= 180 AND hi = 181 AND lo = -181 THEN 15 ELSE 11 END AS command
FROM (SELECT event_id, {_A} AS a, {_LO} AS lo, {_HI} AS hi, {_EXIT} AS x, {_BEFORE} AS b FROM events)""")
def turn_command(spark, sf):
    """WIN12."""
    e = table(spark, sf, "events").withColumns({"a": F.expr(_A), "lo": F.expr(_LO.replace("-181.0", "NULL")), "hi": F.expr(_HI.replace("181.0", "NULL")), "x": F.expr(_EXIT), "b": F.expr(_BEFORE)})
    return e.select("event_id", turns.command("a", F.col("lo").cast("double"), F.col("hi").cast("double"), "x", "b").alias("command"))


@query(f"SELECT event_id, CASE WHEN a IS NULL THEN 0 WHEN abs(a) >= 179 AND a <= 180 THEN 15 WHEN a < -159 THEN 10 WHEN a < -110 THEN 4 WHEN a <= -60 THEN 2 WHEN a < -21 THEN 3 WHEN a < 21 THEN 1 WHEN a < 60 THEN 6 WHEN a <= 110 THEN 5 WHEN a < 159 THEN 7 ELSE 11 END AS command FROM (SELECT event_id, CASE WHEN px IS NOT NULL AND nx IS NOT NULL THEN {turn_sql('px', 'py', 'ilon', 'ilat', 'nx', 'ny')} END AS a FROM {LAGGED})")
def track_commands(spark, sf):
    """WIN10: commands along tracks without other ways."""
    s = K.steps(view(spark, sf, "track"), "track_id", ORDER)
    return s.select("event_id", F.when(F.col("angle").isNotNull(), turns.command("angle")).otherwise(0).alias("command"))


@query(f"SELECT track_id, min(ilon) AS x0, min(ilat) AS y0, max(ilon) AS x1, max(ilat) AS y1 FROM {duck('track')} GROUP BY track_id")
def bounding_boxes(spark, sf):
    """AGG26."""
    return shape.bounds(view(spark, sf, "track"), "track_id")


@query(f"SELECT CAST(sum(ilon) AS BIGINT) AS sum_x, CAST(sum(ilat) AS BIGINT) AS sum_y, CAST(sum(nation * 100) AS BIGINT) AS sum_r FROM {duck('sites')}")
def nogo_checksum(spark, sf):
    """AGG24."""
    return shape.nogo_checksum(view(spark, sf, "sites").withColumn("radius", F.col("nation") * 10.0))


_KX, _KY = scales_sql("n.ilat")
_DX, _DY, _VX, _VY = f"((b.ilon - a.ilon) * {_KX})", f"((b.ilat - a.ilat) * {_KY})", f"((a.ilon - n.ilon) * {_KX})", f"((a.ilat - n.ilat) * {_KY})"


@query(f"""WITH s AS (SELECT a.id, {_DX} * {_DX} + {_DY} * {_DY} AS qa, {_VX} * {_DX} + {_VY} * {_DY} AS qb, {_VX} * {_VX} + {_VY} * {_VY} - 16000000.0 AS qc, CASE WHEN n.id % 5 = 0 THEN NULL ELSE n.id * 0.5 END AS weight
FROM {duck('sites')} a JOIN {duck('sites')} b ON b.id = a.id + 1  JOIN {duck('sites')} n ON true),
l AS (SELECT id, weight, CASE WHEN qb * qb - qa * qc > 0 THEN (least(1.0, (-qb + sqrt(qb * qb - qa * qc)) / qa) - greatest(0.0, (-qb - sqrt(qb * qb - qa * qc)) / qa)) * sqrt(qa) ELSE 0 END AS inside FROM s)
SELECT id, CASE WHEN count(weight) = count(*) THEN round(sum(inside * weight), 3) END AS cost, count(*) AS areas FROM l WHERE inside > 0 GROUP BY id""")
def nogo_costs(spark, sf):
    """JOIN31, GEO12: lengths inside circles times weights; null where one forbids."""
    s = view(spark, sf, "sites")
    a = s.select("id", F.col("ilon").alias("x1"), F.col("ilat").alias("y1"))
    b = s.select((F.col("id") - 1).alias("id"), F.col("ilon").alias("x2"), F.col("ilat").alias("y2"))
    n = s.select(F.col("id").alias("nogo"), F.col("ilon").alias("cx"), F.col("ilat").alias("cy"), F.lit(4000.0).alias("radius"), F.when(F.col("id") % 5 != 0, F.col("id") * 0.5).alias("weight"))
    return shape.nogo_costs(a.join(b, "id"), n, ["id"]).withColumn("cost", F.round("cost", 3))


@query(f"SELECT s.id AS site, count(*) AS n, arg_min(p.id, {distance_sql('p.ilon', 'p.ilat', 's.ilon', 's.ilat')}) AS closest FROM {duck('places')} p JOIN {duck('sites')} s ON {distance_sql('p.ilon', 'p.ilat', 's.ilon', 's.ilat')} <= 4000 GROUP BY s.id")
def recent_near(spark, sf):
    """JOIN36."""
    p = view(spark, sf, "places").select(F.col("id").alias("place"), F.col("ilon").alias("x1"), F.col("ilat").alias("y1"))
    s = view(spark, sf, "sites").select(F.col("id").alias("site"), F.col("ilon").alias("x2"), F.col("ilat").alias("y2"))
    return spatial.within_distance(p, s, F.lit(4000.0), 62_500).groupBy("site").agg(F.count("*").alias("n"), F.min_by("place", "distance").alias("closest"))


@query(f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM {LINKS} GROUP BY ALL HAVING count(*) > 1")
def duplicate_targets(spark, sf):
    """JOIN38."""
    return etl.links(*_refs(spark, sf)).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n")).where("n > 1")


_RASTER = "(SELECT CAST(p_partkey // 40 AS INT) AS r, CAST(p_partkey % 40 AS INT) AS c, p_size AS ele FROM part WHERE p_partkey % 11 <> 0)"


@query(f"WITH n AS (SELECT c_custkey AS nid, c_custkey * 7919 % 3900 AS x, c_custkey * 104729 % 400 AS y FROM customer), k AS (SELECT nid, (CASE WHEN dc = 1 THEN x / 100.0 - x // 100 ELSE 1 - (x / 100.0 - x // 100) END) * (CASE WHEN dr = 1 THEN y / 100.0 - y // 100 ELSE 1 - (y / 100.0 - y // 100) END) AS w, y // 100 + dr AS r, x // 100 + dc AS c FROM n, (SELECT unnest([0, 1]) AS dr), (SELECT unnest([0, 1]) AS dc)) SELECT nid, CASE WHEN count(ele) = 4 THEN round(sum(w * ele), 6) END AS ele FROM k LEFT JOIN {_RASTER} USING (r, c) GROUP BY nid")
def node_elevation(spark, sf):
    """JOIN09, GEO15."""
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("nid"), (F.col("c_custkey") * 7919 % 3900).alias("ilon"), (F.col("c_custkey") * 104729 % 400).alias("ilat"))
    raster = table(spark, sf, "part").where("p_partkey % 11 <> 0").select(F.floor(F.col("p_partkey") / 40).cast("int").alias("row"), (F.col("p_partkey") % 40).cast("int").alias("col"), F.col("p_size").alias("ele"))
    return etl.with_elevation(n, raster, 100).withColumn("ele", F.round("ele", 6))


@query("SELECT o_custkey % 10 AS tile, o_orderkey FROM orders WHERE o_custkey % 10 < 6 AND o_orderstatus = 'F' UNION ALL SELECT o_custkey % 10, o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 10 NOT IN (SELECT o_custkey % 10 FROM orders WHERE o_custkey % 10 < 6 AND o_orderstatus = 'F')")
def tile_fallback(spark, sf):
    """SRC17, JOIN39."""
    o = table(spark, sf, "orders").withColumn("tile", F.col("o_custkey") % 10)
    return with_fallback(o.where("tile < 6 and o_orderstatus = 'F'").select("tile", "o_orderkey"), o.where("o_orderstatus = 'O'").select("tile", "o_orderkey"), "tile")


@query("SELECT event_id, round(6.0 * exp(-3.5 * abs((event_id % 41 - 20) / 100.0 + 0.05)), 6) AS kmh FROM events")
def hiking_speed(spark, sf):
    """GEO21."""
    return table(spark, sf, "events").select("event_id", F.round(graph.hiking_speed((F.col("event_id") % 41 - 20) / 100.0), 6).alias("kmh"))


@query("""WITH RECURSIVE i AS (SELECT event_id, 9.81 * 90.0 * (0.01 + (event_id % 21 - 10) / 100.0) AS f FROM events),
r AS (SELECT event_id, f::DOUBLE AS f, 0 AS k, 8.0::DOUBLE AS v, true AS starting, false AS done FROM i
UNION ALL SELECT event_id, f, k + 1, CASE WHEN done THEN v WHEN y < 0.1 AND starting THEN v * 2 WHEN y < 0.1 THEN v ELSE v - y / (3 * 0.225 * v * v + f) END, starting AND y < 0.1, done OR (y < 0.1 AND NOT starting) FROM (SELECT *, (0.225 * v * v + f) * v - 100.0 AS y FROM r) WHERE k < 10)
SELECT event_id, round(least(v, 45.0 / 3.6), 4) AS speed FROM r WHERE k = 10""")
def bike_speed(spark, sf):
    """GEO20, GRF25."""
    return table(spark, sf, "events").select("event_id", F.round(graph.bike_speed((F.col("event_id") % 21 - 10) / 100.0), 4).alias("speed"))


_ROUND = scales_sql("ilat")


@query(f"WITH c AS (SELECT id, ilon + CAST(floor(5000.0 * sin(30.0 * (pi() / 180)) / {_ROUND[0]} + 0.5) AS BIGINT) AS ilon, ilat + CAST(floor(5000.0 * cos(30.0 * (pi() / 180)) / {_ROUND[1]} + 0.5) AS BIGINT) AS ilat FROM {duck('sites')}) SELECT id, CAST(seq AS INT) AS seq, ilon + CAST(floor(5000.0 * sin((210.0 + seq * 72.0) * (pi() / 180)) / {_ROUND[0]} + 0.5) AS BIGINT) AS wx, ilat + CAST(floor(5000.0 * cos((210.0 + seq * 72.0) * (pi() / 180)) / {_ROUND[1]} + 0.5) AS BIGINT) AS wy FROM c, (SELECT unnest(range(5)) AS seq)")
def round_trip_points(spark, sf):
    """GEO16, GEO04, GRF17."""
    return shape.round_trip(view(spark, sf, "sites"), 5000, 30, 5).select("id", "seq", "wx", "wy")


@query()
def simplified_tracks(spark, sf):
    """GEO14."""
    return shape.simplify(view(spark, sf, "track").select("track_id", "ts", "event_id", "ilon", "ilat"), "track_id", ORDER, 50.0)


@query()
def kinematic_times(spark, sf):
    """GRF22."""
    s = K.steps(view(spark, sf, "track"), "track_id", ORDER).withColumn("limit", F.when(F.col("way_tags") == "click", 8.0).otherwise(14.0))
    line = s.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, F.col("step").alias("metres"), "limit"))).alias("p"))
    return line.select("track_id", shape.kinematic(F.col("p")).alias("seconds"))


@query(f"SELECT event_id, CAST(floor((1 - cos(a * pi() / 180)) * 90 + 0.2) AS INT) AS cost FROM (SELECT event_id, round({turn_sql('px', 'py', 'ilon', 'ilat', 'nx', 'ny')}, 6) AS a FROM {LAGGED} WHERE px IS NOT NULL AND nx IS NOT NULL)")
def turn_costs(spark, sf):
    """GRF03: the cost of turning."""
    s = K.steps(view(spark, sf, "track"), "track_id", ORDER).where("angle is not null")
    return s.select("event_id", graph.turn_cost(F.cos(F.round("angle", 6) * F.pi() / 180), 90).alias("cost"))


@query(f"SELECT track_id, way_tags, CAST(floor(max(m)) AS BIGINT) AS most FROM (SELECT track_id, way_tags, CASE WHEN px IS NULL THEN 0.0 ELSE {distance_sql('px', 'py', 'ilon', 'ilat')} END AS m FROM {LAGGED}) GROUP BY ALL")
def longest_step(spark, sf):
    """AGG15, WIN17."""
    return K.steps(view(spark, sf, "track"), "track_id", ORDER).groupBy("track_id", "way_tags").agg(F.floor(F.max("step")).alias("most"))
