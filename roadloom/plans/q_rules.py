"""Turn restrictions, access rules, no-go areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as T
from ..operators import etl, nogos
from ..sources import codecs, tiles
from . import dsl
from .q_relational import _refs
from .q_scalar import tagged
from .registry import query
from .views import distance_sql, duck, turn_sql, view

#: Relations made of parts: each order's neighbouring lines are a rule at the part that they share.
_RULES = "SELECT o_orderkey AS rid, o_orderkey AS from_wid, 1 + o_orderkey % (SELECT max(o_orderkey) FROM {orders}) AS to_wid, nid AS via_nid, CASE o_orderkey % 5 WHEN 0 THEN 'no_left_turn' WHEN 1 THEN 'only_right_turn' WHEN 2 THEN 'no_u_turn' WHEN 3 THEN 'only_straight_on' ELSE 'no_right_turn_on_red' END AS value, CASE WHEN o_orderkey % 7 = 0 THEN 'restriction:conditional' ELSE 'restriction' END AS key FROM {orders} JOIN (SELECT wid, max(nid) AS nid FROM ({refs}) GROUP BY wid) ON wid = o_orderkey"


def rules(spark, sf):
    refs = view(spark, sf, "refs").groupBy("wid").agg(F.max("nid").alias("via_nid"))
    o = spark.read.parquet(f"{sf}/orders.parquet")
    last = o.agg(F.max("o_orderkey")).first()[0]
    kind = F.element_at(F.array(*[F.lit(x) for x in ("no_left_turn", "only_right_turn", "no_u_turn", "only_straight_on", "no_right_turn_on_red")]), (F.col("rid") % 5 + 1).cast("int"))
    made = o.select(F.col("o_orderkey").alias("rid"), F.col("o_orderkey").alias("from_wid"), (1 + F.col("o_orderkey") % last).alias("to_wid"))
    return made.join(refs, F.col("wid") == F.col("rid")).select("rid", "from_wid", "to_wid", "via_nid", kind.alias("value"), F.when(F.col("rid") % 7 == 0, "restriction:conditional").otherwise("restriction").alias("key"))


_SQL_RULES = "(" + _RULES.replace("{refs}", duck("refs")[1:-1]).replace("{orders}", "orders") + ")"
_AT = f"(SELECT r.wid, r.pos, r.nid, n.ilon, n.ilat, row_number() OVER (PARTITION BY wid ORDER BY pos) - 1 AS p, count(*) OVER (PARTITION BY wid) AS n FROM {duck('refs')} r JOIN {duck('nodes')} n ON n.nid = r.nid)"


@query(f"""WITH a AS {_AT}, legs AS (SELECT v.wid, v.nid AS via, coalesce(max_by(struct_pack(x := b.ilon, y := b.ilat), b.p) FILTER (b.p < v.p), min_by(struct_pack(x := b.ilon, y := b.ilat), b.p) FILTER (b.p > v.p)) AS s,
coalesce(max_by(struct_pack(x := b.ilon, y := b.ilat), b.p) FILTER (b.p > v.p), min_by(struct_pack(x := b.ilon, y := b.ilat), b.p) FILTER (b.p < v.p)) AS g, bool_or(v.p > 0 AND v.p < v.n - 1) AS through FROM a v JOIN a b ON b.wid = v.wid AND abs(b.p - v.p) = 1 GROUP BY ALL),
j AS (SELECT r.*, f.s, t.g, f.through OR t.through AS through, {turn_sql('f.s.x', 'f.s.y', 'n.ilon', 'n.ilat', 't.g.x', 't.g.y')} AS angle FROM {_SQL_RULES} r JOIN {duck('nodes')} n ON n.nid = r.via_nid LEFT JOIN legs f ON f.wid = r.from_wid AND f.via = r.via_nid LEFT JOIN legs t ON t.wid = r.to_wid AND t.via = r.via_nid)
SELECT rid, via_nid, s IS NOT NULL AND g IS NOT NULL AND rid % 5 < 4 AND rid % 7 > 0 AS valid, coalesce(s IS NOT NULL AND g IS NOT NULL AND NOT through AND CASE rid % 5 WHEN 0 THEN angle < -5 AND angle > -175 WHEN 1 THEN angle > 5 AND angle < 175 WHEN 2 THEN abs(angle) > 95 WHEN 3 THEN abs(angle) < 85 ELSE false END, false) AS sound FROM j""")
def restriction_legs(spark, sf):
    """JOIN03, JOIN07, FLT04: rules at known nodes, their legs by the ways' members, and whether the geometry fits."""
    ways, nodes = _refs(spark, sf)
    return etl.restriction_legs(rules(spark, sf), ways, nodes).select("rid", "via_nid", "valid", "sound")


@query("SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE f END AS from_wid, t AS to_wid, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS via_nid FROM orders, (SELECT unnest([1, 2]) AS f), (SELECT unnest([3, 4]) AS t) WHERE o_orderkey % 3 > 0 OR f = 1")
def restriction_pairs(spark, sf):
    """PRJ17: each from member with each to member of a restriction; a null where a role is missing."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    member = lambda kind, role, ref: F.struct(F.lit(kind).alias("type"), F.lit(role).alias("role"), ref.cast("long").alias("ref"))
    way = lambda role, *refs: F.array(*[member("way", role, F.lit(r)) for r in refs])
    members = F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.array().cast(_MEMBERS)).otherwise(way("from", 1, 2)), way("to", 3, 4), F.when(F.col("o_orderkey") % 4 == 0, F.array().cast(_MEMBERS)).otherwise(F.array(member("node", "via", F.col("o_custkey")))))
    return etl.restriction_pairs(o.select(F.col("o_orderkey").alias("rid"), members.alias("members")))


_MEMBERS = "array<struct<type:string,role:string,ref:bigint>>"


@query("SELECT o_orderkey AS rid, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END | CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END | CASE WHEN o_orderkey % 5 IN (0, 1) THEN 4 ELSE 0 END | CASE WHEN o_orderkey % 7 = 0 THEN 8 ELSE 0 END | CASE WHEN o_orderkey % 11 = 0 THEN 16 ELSE 0 END) AS exceptions FROM orders")
def restriction_exceptions(spark, sf):
    """PRJ16: the mask of excepted modes; agricultural and forestry share a bit."""
    k = F.col("o_orderkey")
    named = F.concat_ws(";", F.when(k % 2 == 0, "bicycle"), F.when(k % 3 == 0, "motorcar"), F.when(k % 5 == 0, "agricultural"), F.when(k % 5 <= 1, "forestry"), F.when(k % 7 == 0, "psv"), F.when(k % 11 == 0, "hgv"))
    r = spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("rid"), F.create_map(F.lit("restriction"), F.lit("no_left_turn"), F.lit("except"), named).alias("tags"))
    return etl.restrictions(r).select("rid", "exceptions")


ACCESS = """
---context:way   # noStartWay=highway,motorway;surface,A
assign costfactor = if highway=motorway then ( if reversedirection=yes then 9999 else 10000 ) else if and oneway=yes reversedirection=yes then 10000 else if highway=track then 10001 else 1.5
"""


@query(f"SELECT way_id, part, CASE highway WHEN 'motorway' THEN 1 WHEN 'track' THEN 0 ELSE 2 END AS access, NOT (highway = 'motorway' OR surface = 'A') AS may_start FROM {duck('ways')}")
def access_types(spark, sf):
    """FLT02, FLT11: whether a way can be used, and whether a route may start on it."""
    profile = dsl.compile_profile(ACCESS)
    ways = dsl.access_type(profile, tagged(spark, sf))
    return ways.select("way_id", "part", "access", dsl.may_start(F.col("tags"), dsl.start_exclusions(ACCESS)).alias("may_start"))


#: Requests: a nation's places in order are its way-points, its sites its areas.
_INSIDE = f"(SELECT p.nation AS req, p.id AS seq, s.id AS nogo, s.id % 3 = 0 AS forbids FROM {duck('places')} p JOIN {duck('sites')} s ON s.nation = p.nation AND floor({distance_sql('p.ilon', 'p.ilat', 's.ilon', 's.ilat')} + 0.5) < 9000)"


def _areas(spark, sf):
    s = view(spark, sf, "sites")
    none = F.lit(None).cast("array<struct<x:bigint,y:bigint>>")
    return s.select(F.col("nation").alias("req"), F.col("id").alias("nogo"), F.lit("circle").alias("kind"), F.col("ilon").alias("cx"), F.col("ilat").alias("cy"), F.lit(9000.0).alias("radius"), F.when(F.col("id") % 3 != 0, 2.0).alias("weight"), none.alias("points"))


def _waypoints(spark, sf):
    p = view(spark, sf, "places")
    return p.select(F.col("nation").alias("req"), F.col("id").alias("seq"), F.col("ilon").alias("x"), F.col("ilat").alias("y"), (F.col("id") % 10 == 0).alias("direct"))


@query(f"SELECT s.nation AS req, s.id AS nogo FROM {duck('sites')} s WHERE s.id NOT IN (SELECT nogo FROM {_INSIDE})")
def nogos_cleaned(spark, sf):
    """FLT12."""
    return nogos.cleaned(_areas(spark, sf), _waypoints(spark, sf)).select("req", "nogo")


@query(f"WITH RECURSIVE w AS (SELECT nation AS req, id AS seq, id % 10 = 0 AS direct, row_number() OVER (PARTITION BY nation ORDER BY id) AS k, EXISTS (SELECT 1 FROM {_INSIDE} i WHERE i.req = nation AND i.seq = id AND i.forbids) AS inside FROM {duck('places')}), r AS (SELECT req, seq, k, direct, inside, true AS kept FROM w WHERE k = 1 UNION ALL SELECT w.req, w.seq, w.k, w.direct, w.inside, NOT w.inside OR w.direct OR r.direct OR (r.inside AND r.kept) FROM r JOIN w ON w.req = r.req AND w.k = r.k + 1) SELECT req, seq, inside, kept FROM r")
def waypoints_usable(spark, sf):
    """FLT13: way-points in forbidden areas go, by the rules on their neighbours."""
    return nogos.usable(_waypoints(spark, sf), _areas(spark, sf)).select("req", "seq", "inside", "kept")


@query(f"SELECT w.req, coalesce(max(h.n) = any_value(w.n), false) AS all_in FROM (SELECT nation AS req, count(*) AS n FROM {duck('places')}  GROUP BY 1) w LEFT JOIN (SELECT req, nogo, count(*) AS n FROM {_INSIDE} WHERE forbids GROUP BY ALL) h ON h.req = w.req GROUP BY w.req")
def nogo_all_in_one(spark, sf):
    """FLT14."""
    return nogos.all_in_one(_areas(spark, sf), _waypoints(spark, sf))


DICTIONARY = [("highway", ["motorway", "primary", "secondary", "tertiary", "track"]), ("lanes", ["1", "2", "3", "4", "5"]), ("oneway", ["yes", "no"]), ("surface", ["A", "N"])]


@query(f"SELECT highway, surface, lanes, oneway, concat('highway=', CASE WHEN highway = 'residential' THEN 'unknown' ELSE highway END, ' lanes=', lanes, ' oneway=', oneway, ' surface=', CASE WHEN surface = 'R' THEN 'unknown' ELSE surface END) AS text, count(*) AS n FROM {duck('ways')} GROUP BY ALL")
def tag_codes(spark, sf):
    """BIN01, BIN05, PRJ02: tags by dictionary numbers in bits and back; unlisted values are unknown."""
    coded = codecs.decoded_tags(codecs.encoded_tags(tagged(spark, sf), DICTIONARY), DICTIONARY)
    return coded.groupBy("highway", "surface", "lanes", "oneway", T.description(F.col("decoded")).alias("text")).agg(F.count("*").alias("n"))


@query(f"SELECT concat('highway=', highway, ' lanes=', lanes, ' maxspeed=', maxspeed, ' oneway=', oneway, ' surface=', surface) AS text, count(*) AS n FROM {duck('ways')} GROUP BY 1")
def tag_set_counts(spark, sf):
    """AGG27: how often tag sets occur."""
    return codecs.tag_set_counts(tagged(spark, sf), T.description(F.col("tags")))


@query(f"SELECT concat('E', CAST(ilon // 5000000 * 5 - 180 AS VARCHAR), '_N', CAST(ilat // 5000000 * 5 - 90 AS VARCHAR)) AS tile, CAST(ilon % 5000000 // 1000000 * 5 + ilat % 5000000 // 1000000 AS INT) AS square, CAST(ilat % 1000000 // 31250 * 32 + ilon % 1000000 // 31250 AS INT) AS cell, count(*) AS n, min(nid) AS first_node FROM {duck('nodes')} GROUP BY ALL")
def tile_cells(spark, sf):
    """SRC14, SRT03: the tile, square and cell of each node."""
    return tiles.placed(view(spark, sf, "nodes")).groupBy("tile", "square", "cell").agg(F.count("*").alias("n"), F.min("nid").alias("first_node"))
