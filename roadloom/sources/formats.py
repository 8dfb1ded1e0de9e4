"""Tracks as texts: one row for each track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import degrees_text
from ..functions.tags import json_escaped, xml_escaped

#: The columns of the message table, in order; fixed values.
MESSAGES = ["Longitude", "Latitude", "Elevation", "Distance", "CostPerKm", "ElevCost", "TurnCost", "NodeCost", "InitialCost", "WayTags", "NodeTags", "Time", "Energy"]


def _line(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    return points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "ilon", "ilat", "selev"))).alias("p"))


def _lon(p: Column) -> Column:
    return degrees_text(p["ilon"], 180)


def _lat(p: Column) -> Column:
    return degrees_text(p["ilat"], 90)


def _height(p: Column) -> Column:
    return (p["selev"] / 4.0).cast("string")


def geojson(points: DataFrame, key: str, order: list[str], name: Column | None = None, totals: DataFrame | None = None, hints: DataFrame | None = None, messages: DataFrame | None = None, times: str | None = None) -> DataFrame:
    """(key, text): a feature collection with one line of each track.

    Its properties are the name and, of each track, the columns of ``totals``, the lists of ``hints`` (seq and numbers), the rows of
    ``messages`` (seq and texts) under their header, and the column ``times`` of the points in seconds.
    """
    label = name if name is not None else F.col(key).cast("string")
    more = [times] if times else []
    lines = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "ilon", "ilat", "selev", *more))).alias("p"))
    parts = [F.concat(F.lit('"name":"'), json_escaped(label), F.lit('"'))]
    if totals is not None:
        lines = lines.join(totals, key, "left")
        parts += [F.concat(F.lit(f'"{c}":"'), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"')) for c in totals.columns if c != key]
    if hints is not None:
        row = F.concat(F.lit("["), F.array_join(F.array(*[F.col(c).cast("string") for c in hints.columns if c not in (key, "seq")]), ","), F.lit("]"))
        lines = lines.join(_listed(hints, key, row, "_hints"), key, "left")
        parts.append(F.when(F.col("_hints").isNotNull(), F.concat(F.lit('"voicehints":['), F.array_join("_hints", ","), F.lit("]"))))
    if messages is not None:
        texts = [c for c in messages.columns if c not in (key, "seq")]
        quoted = lambda xs: F.concat(F.lit('["'), F.array_join(F.array(*xs), '","'), F.lit('"]'))
        row = quoted([json_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in texts])
        lines = lines.join(_listed(messages, key, row, "_messages"), key, "left")
        parts.append(F.concat(F.lit('"messages":['), F.array_join(F.concat(F.array(quoted([F.lit(c) for c in texts])), F.coalesce("_messages", F.array())), ","), F.lit("]")))
    if times:
        parts.append(F.concat(F.lit('"times":['), F.array_join(F.transform("p", lambda p: F.rtrim(F.rtrim(F.format_string("%.3f", p[times].cast("double")), F.lit("0")), F.lit("."))), ","), F.lit("]")))
    at = F.transform("p", lambda p: F.concat(F.lit("["), _lon(p), F.lit(","), _lat(p), F.when(p["selev"].isNotNull(), F.concat(F.lit(","), _height(p))).otherwise(""), F.lit("]")))
    head, middle = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{', '},"geometry":{"type":"LineString","coordinates":['
    return lines.select(key, F.concat(F.lit(head), F.concat_ws(",", *parts), F.lit(middle), F.array_join(at, ","), F.lit("]}}]}")).alias("text"))


def _listed(rows: DataFrame, key: str, text: Column, name: str) -> DataFrame:
    """The rows' texts in the order of ``seq``, as one array of each track."""
    return rows.select(key, F.struct("seq", text.alias("text")).alias("r")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"]).alias(name))


def message_rows(segments: DataFrame, key: str, order: str) -> DataFrame:
    """The message table: one row for each run of segments with the same way tags, its sums and the position of its last segment.

    Segments hold ``ilon, ilat, selev, metres, costfactor`` (null where a segment has none), ``elevcost, turncost, nodecost, initcost,
    way_tags, node_tags, time, energy``; a node's tags end a run too.
    """
    w = Window.partitionBy(key).orderBy(order)
    new = (F.lag("way_tags").over(w).isNull()) | (F.lag("way_tags").over(w) != F.col("way_tags")) | (F.coalesce(F.lag("node_tags").over(w), F.lit("")) != "")
    runs = segments.withColumn("_run", F.sum(new.cast("int")).over(w))
    last = lambda c: F.max_by(c, order)
    total = lambda c: F.sum(c).cast("long")
    rows = runs.groupBy(key, F.col("_run").alias("seq")).agg(
        degrees_text(last("ilon"), 180).alias("Longitude"), degrees_text(last("ilat"), 90).alias("Latitude"), F.floor(last("selev") / 4.0).cast("string").alias("Elevation"), total("metres").alias("Distance"),
        F.floor(1000 * F.max_by("costfactor", F.when(F.col("costfactor").isNotNull(), F.col(order))) + 0.5).cast("long").alias("CostPerKm"), total("elevcost").alias("ElevCost"), total("turncost").alias("TurnCost"),
        total("nodecost").alias("NodeCost"), total("initcost").alias("InitialCost"), last("way_tags").alias("WayTags"), last("node_tags").alias("NodeTags"), last("time").cast("long").alias("Time"), last("energy").cast("long").alias("Energy"),
    )
    return rows.select(key, "seq", *MESSAGES)


def message_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, text): the message table of each track, tab separated, with its header."""
    row = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in MESSAGES]), "\t")
    listed = _listed(rows, key, row, "_rows")
    return listed.select(key, F.concat(F.lit("\t".join(MESSAGES) + "\n"), F.array_join("_rows", "\n"), F.lit("\n")).alias("text"))


#: Kinds of way-points: shaping, meeting, direct; fixed values.
POINT_KINDS = ("shaping", "via", "beeline")


def waypoint_info(points: DataFrame, key: str, kind: str = "json") -> DataFrame:
    """(key, text): way-points (seq, ilon, ilat, selev, name, wpttype) as a GeoJSON of points or as GPX."""
    type_ = F.element_at(F.array(*[F.lit(x) for x in POINT_KINDS]), F.col("wpttype") + 1)
    lon, lat, up = degrees_text("ilon", 180), degrees_text("ilat", 90), (F.col("selev") / 4.0).cast("string")
    if kind == "json":
        row = F.concat(F.lit('{"type":"Feature","properties":{"name":"'), json_escaped("name"), F.lit('","type":"'), type_, F.lit('"},"geometry":{"type":"Point","coordinates":['), F.concat_ws(",", lon, lat, up), F.lit("]}}"))
        head, tail, mark = '{"type":"FeatureCollection","features":[', "]}", ","
    else:
        row = F.concat(F.lit('<wpt lon="'), lon, F.lit('" lat="'), lat, F.lit('">'), F.coalesce(F.concat(F.lit("<ele>"), up, F.lit("</ele>")), F.lit("")), F.lit("<name>"), xml_escaped("name"), F.lit("</name><type>"), type_, F.lit("</type></wpt>"))
        head, tail, mark = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1">\n', "\n</gpx>", "\n"
    return _listed(points, key, row, "_points").select(key, F.concat(F.lit(head), F.array_join("_points", mark), F.lit(tail)).alias("text"))


def gpx(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, text): a GPX document of each track."""
    at = F.transform("p", lambda p: F.concat(F.lit('<trkpt lon="'), _lon(p), F.lit('" lat="'), _lat(p), F.lit('">'), F.when(p["selev"].isNotNull(), F.concat(F.lit("<ele>"), _height(p), F.lit("</ele>"))).otherwise(""), F.lit("</trkpt>")))
    return _line(points, key, order).select(key, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1"><trk><name>'), xml_escaped(F.col(key).cast("string")), F.lit("</name><trkseg>\n"), F.array_join(at, "\n"), F.lit("\n</trkseg></trk></gpx>")).alias("text"))


def kml(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, text): a KML document of each track."""
    at = F.transform("p", lambda p: F.concat(_lon(p), F.lit(","), _lat(p)))
    return _line(points, key, order).select(key, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<kml><Document><Placemark><name>'), xml_escaped(F.col(key).cast("string")), F.lit("</name><LineString><coordinates>"), F.array_join(at, "\n"), F.lit("</coordinates></LineString></Placemark></Document></kml>")).alias("text"))


def csv_messages(messages: DataFrame, folder: str) -> None:
    """Writes the message columns, tab separated, with a header."""
    messages.select(*MESSAGES).write.csv(folder, sep="\t", header=True)
