"""Folds and windows over tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import track as K
from ..sources import formats
from .registry import query
from .views import distance_sql, duck, turn_sql, view

ORDER = ["ts", "event_id"]
W = "OVER (PARTITION BY track_id ORDER BY ts, event_id)"
LAGGED = f"(SELECT *, lag(ilon) {W} AS px, lag(ilat) {W} AS py, lead(ilon) {W} AS nx, lead(ilat) {W} AS ny, row_number() {W} AS r FROM {duck('track')})"
STEP = f"CASE WHEN px IS NULL THEN 0.0 ELSE {distance_sql('px', 'py', 'ilon', 'ilat')} END"


@query(f"SELECT event_id, round({STEP}, 3) AS metres FROM {LAGGED}")
def step_distance(spark, sf):
    """WIN02, GEO02."""
    return K.steps(view(spark, sf, "track"), "track_id", ORDER).select("event_id", F.round("step", 3).alias("metres"))


@query(f"SELECT event_id, round({turn_sql('px', 'py', 'ilon', 'ilat', 'nx', 'ny')}, 4) AS angle FROM {LAGGED} WHERE px IS NOT NULL AND nx IS NOT NULL")
def turn_angle(spark, sf):
    """GEO05, WIN02."""
    return K.steps(view(spark, sf, "track"), "track_id", ORDER).where("angle is not null").select("event_id", F.round("angle", 4).alias("angle"))


@query(f"SELECT event_id, CAST(sum(floor(metres)) OVER (PARTITION BY track_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS metres FROM (SELECT event_id, track_id, ts, {STEP} AS metres FROM {LAGGED})")
def running_totals(spark, sf):
    """WIN03, AGG25."""
    s = K.steps(view(spark, sf, "track"), "track_id", ORDER).withColumn("whole", F.floor("step"))
    return K.running(s, "track_id", ORDER, {"metres": "whole"}).select("event_id", F.col("metres").cast("bigint").alias("metres"))


@query(f"WITH l AS (SELECT *, lag(way_tags) {W} AS t, lag(node_tags) {W} AS nt, row_number() {W} AS r FROM {duck('track')}), m AS (SELECT *, sum(CASE WHEN r = 1 OR way_tags <> t OR nt <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT track_id, CAST(run AS BIGINT) AS run, min(way_tags) AS way_tags, max(node_tags) AS node_tags, count(*) AS n, CAST(sum(selev) AS BIGINT) AS selev FROM m GROUP BY track_id, run")
def runlength_messages(spark, sf):
    """AGG21."""
    return K.merged_messages(view(spark, sf, "track"), "track_id", ORDER, "way_tags", "node_tags", ["selev"]).select("track_id", F.col("run").cast("bigint").alias("run"), "way_tags", "node_tags", "n", F.col("selev").cast("bigint").alias("selev"))


@query(f"SELECT event_id, way_tags FROM (SELECT *, lag(way_tags) {W} AS t FROM {duck('track')}) WHERE t IS NULL OR t <> way_tags")
def speed_change_points(spark, sf):
    """AGG22."""
    return K.changes(view(spark, sf, "track"), "track_id", ORDER, "way_tags").select("event_id", "way_tags")


@query(f"SELECT event_id FROM {LAGGED} WHERE px IS NULL OR px <> ilon OR py <> ilat")
def double_points(spark, sf):
    """WIN16."""
    return K.without_repeats(view(spark, sf, "track"), "track_id", ORDER).select("event_id")


@query(f"""WITH t AS (SELECT track_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE selev END AS v, CAST(row_number() {W} AS DOUBLE) AS x FROM {duck('track')}),
g AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, first_value(v IGNORE NULLS) OVER f AS z, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER b AS xa, first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER f AS xz FROM t
WINDOW b AS (PARTITION BY track_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY track_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(CAST(v AS DOUBLE), a + (z - a) * CASE WHEN xz > xa THEN (x - xa) / (xz - xa) ELSE 0.0 END, CAST(a AS DOUBLE), CAST(z AS DOUBLE)), 6) AS filled FROM g""")
def gap_fill(spark, sf):
    """WIN06."""
    t = view(spark, sf, "track").withColumns({"v": F.when(F.col("event_id") % 3 != 0, F.col("selev")), "x": F.row_number().over(Window.partitionBy("track_id").orderBy(*ORDER)).cast("double")})
    return K.gaps_filled(t, "track_id", ORDER, "v", "x").select("event_id", F.round("filled", 6).alias("filled"))


@query(f"SELECT track_id, count(*) AS points, round(sum({STEP}), 2) AS metres, CAST(floor((arg_max(selev, r) - arg_min(selev, r)) / 4.0 + 0.5) AS INT) AS plain_ascent FROM {LAGGED} GROUP BY track_id")
def plain_ascent(spark, sf):
    """WIN05, AGG25."""
    return K.totals(view(spark, sf, "track"), "track_id", ORDER).select("track_id", "points", F.round("metres", 2).alias("metres"), "plain_ascent")


@query(f"""WITH RECURSIVE t AS (SELECT track_id, selev, row_number() {W} AS r FROM {duck('track')} WHERE selev IS NOT NULL),
f AS (SELECT track_id, r, CAST(selev AS DOUBLE) AS e, 0.0::DOUBLE AS b, 0.0::DOUBLE AS up FROM t WHERE r = 1
UNION ALL SELECT t.track_id, t.r, t.selev, CASE WHEN f.b + (t.selev - f.e) / 4.0 > 0 THEN 0.0 ELSE greatest(f.b + (t.selev - f.e) / 4.0, -10.0) END, f.up + greatest(f.b + (t.selev - f.e) / 4.0, 0.0) FROM f JOIN t ON t.track_id = f.track_id AND t.r = f.r + 1)
SELECT track_id, round(max(up), 6) AS ascent FROM f GROUP BY track_id""")
def filtered_ascent(spark, sf):
    """WIN04."""
    return K.totals(view(spark, sf, "track"), "track_id", ORDER).select("track_id", F.round("ascent", 6).alias("ascent"))


@query()
def decay_incline(spark, sf):
    """WIN15, WIN18: an exponentially decaying fold."""
    s = K.steps(view(spark, sf, "track"), "track_id", ORDER)
    rise = (F.col("selev") - F.lag("selev").over(Window.partitionBy("track_id").orderBy(*ORDER))) / 4.0
    line = s.withColumn("rise", F.coalesce(rise, F.lit(0.0))).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "rise", F.col("step").alias("distance")))).alias("p"))
    return line.select("track_id", K.decayed(F.transform("p", lambda x: F.struct(x["rise"].alias("rise"), x["distance"].alias("distance")))).alias("incline"))


_LON = "concat(CAST((ilon - 180000000) // 1000000 AS VARCHAR), '.', lpad(CAST((ilon - 180000000) % 1000000 AS VARCHAR), 6, '0'))"
_LAT = "concat(CAST((ilat - 90000000) // 1000000 AS VARCHAR), '.', lpad(CAST((ilat - 90000000) % 1000000 AS VARCHAR), 6, '0'))"


@query(f"""SELECT track_id, concat('{{"type":"FeatureCollection","features":[{{"type":"Feature","properties":{{"name":"', track_id, '"}},"geometry":{{"type":"LineString","coordinates":[', string_agg(concat('[', {_LON}, ',', {_LAT}, ',', CAST(selev / 4.0 AS VARCHAR), ']'), ',' ORDER BY ts, event_id), ']}}}}]}}') AS text FROM {duck('track')} GROUP BY track_id""")
def geojson_track(spark, sf):
    """SRC31."""
    return formats.geojson(view(spark, sf, "track"), "track_id", ORDER)


@query(f"""SELECT track_id, concat('<?xml version="1.0" encoding="UTF-8"?>', chr(10), '<gpx version="1.1"><trk><name>', track_id, '</name><trkseg>', chr(10), string_agg(concat('<trkpt lon="', {_LON}, '" lat="', {_LAT}, '"><ele>', CAST(selev / 4.0 AS VARCHAR), '</ele></trkpt>'), chr(10) ORDER BY ts, event_id), chr(10), '</trkseg></trk></gpx>') AS text FROM {duck('track')} GROUP BY track_id""")
def gpx_track(spark, sf):
    """SRC28."""
    return formats.gpx(view(spark, sf, "track"), "track_id", ORDER)


@query(f"""SELECT track_id, concat('<?xml version="1.0" encoding="UTF-8"?>', chr(10), '<kml><Document><Placemark><name>', track_id, '</name><LineString><coordinates>', string_agg(concat({_LON}, ',', {_LAT}), chr(10) ORDER BY ts, event_id), '</coordinates></LineString></Placemark></Document></kml>') AS text FROM {duck('track')} GROUP BY track_id""")
def kml_track(spark, sf):
    """SRC30."""
    return formats.kml(view(spark, sf, "track"), "track_id", ORDER)


def _segments(spark, sf):
    """The track's points as segments with costs, numbered in their order."""
    w = Window.partitionBy("track_id").orderBy(*ORDER)
    e = F.col("event_id")
    t = view(spark, sf, "track").withColumn("seq", F.row_number().over(w))
    return t.withColumns({"metres": e % 90 + 1, "costfactor": F.when(e % 6 != 0, (e % 7 + 4) / 4.0), "elevcost": e % 5, "turncost": e % 3, "nodecost": F.when(F.col("node_tags") != "", 20).otherwise(0), "initcost": F.lit(0), "time": F.col("seq") * 3, "energy": F.col("seq") * 70})


_RUNS = f"""(SELECT *, sum(CASE WHEN lw IS NULL OR lw <> way_tags OR ln <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq) AS run FROM (SELECT *, lag(way_tags) OVER (PARTITION BY track_id ORDER BY seq) AS lw, lag(node_tags) OVER (PARTITION BY track_id ORDER BY seq) AS ln FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts, event_id) AS seq FROM {duck('track')})))"""


@query(f"""SELECT track_id, concat('Longitude	Latitude	Elevation	Distance	CostPerKm	ElevCost	TurnCost	NodeCost	InitialCost	WayTags	NodeTags	Time	Energy', chr(10), string_agg(line, chr(10) ORDER BY run), chr(10)) AS text FROM (SELECT track_id, run, array_to_string([max_by({_LON}, seq), max_by({_LAT}, seq), CAST(CAST(floor(max_by(selev, seq) / 4.0) AS BIGINT) AS VARCHAR), CAST(sum(event_id % 90 + 1) AS VARCHAR),
coalesce(CAST(CAST(floor(1000 * max_by((event_id % 7 + 4) / 4.0, seq) FILTER (event_id % 6 <> 0) + 0.5) AS BIGINT) AS VARCHAR), ''), CAST(sum(event_id % 5) AS VARCHAR), CAST(sum(event_id % 3) AS VARCHAR), CAST(sum(CASE WHEN node_tags <> '' THEN 20 ELSE 0 END) AS VARCHAR), '0', max_by(way_tags, seq), max_by(node_tags, seq), CAST(max(seq) * 3 AS VARCHAR), CAST(max(seq) * 70 AS VARCHAR)], '	') AS line FROM {_RUNS} GROUP BY track_id, run) GROUP BY track_id""")
def message_table(spark, sf):
    """PRJ15, AGG21, SRC32: the thirteen columns of runs with the same way tags, as text."""
    return formats.message_lines(formats.message_rows(_segments(spark, sf), "track_id", "seq"), "track_id")


@query(f"""SELECT nation, concat('{{"type":"FeatureCollection","features":[', string_agg(concat('{{"type":"Feature","properties":{{"name":"w', id, '","type":"', CASE id % 3 WHEN 0 THEN 'shaping' WHEN 1 THEN 'via' ELSE 'beeline' END, '"}},"geometry":{{"type":"Point","coordinates":[', {_LON}, ',', {_LAT}, CASE WHEN id % 4 > 0 THEN concat(',', CAST(id % 50 / 4.0 AS VARCHAR)) ELSE '' END, ']}}}}'), ',' ORDER BY id), ']}}') AS text FROM {duck('places')} GROUP BY nation""")
def waypoint_info(spark, sf):
    """SRC33."""
    p = view(spark, sf, "places").select("nation", F.col("id").alias("seq"), "ilon", "ilat", F.when(F.col("id") % 4 > 0, F.col("id") % 50).alias("selev"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("name"), (F.col("id") % 3).cast("int").alias("wpttype"))
    return formats.waypoint_info(p, "nation")
