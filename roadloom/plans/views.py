"""Routing-shaped views over the driver's tables, with the same text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "places": "SELECT c_custkey AS id, 188000000 + (c_custkey * 7919) % 1000000 AS ilon, 139000000 + (c_custkey * 104729) % 1000000 AS ilat, CAST(floor(abs(c_acctbal) * 100) AS BIGINT) AS population, c_nationkey AS nation FROM {customer}",
    "sites": "SELECT s_suppkey AS id, 188000000 + (s_suppkey * 15485863) % 1000000 AS ilon, 139000000 + (s_suppkey * 32452843) % 1000000 AS ilat, s_nationkey AS nation FROM {supplier}",
    "track": "SELECT user_id AS track_id, ts, event_id, 188000000 + (event_id * 7919) % 100000 AS ilon, 139000000 + (event_id * 104729) % 100000 AS ilat, CAST(floor(value * 4) AS INT) AS selev, event_type AS way_tags, CASE WHEN event_id % 10 = 0 THEN 'highway=crossing' ELSE '' END AS node_tags FROM {events}",
    "net": "SELECT src, dst, min(1.0 + link % 97) AS weight FROM (SELECT o_orderkey AS link, o_custkey AS src, 1 + (o_orderkey * 7919 + o_custkey) % (SELECT max(c_custkey) FROM {customer}) AS dst FROM {orders}) WHERE src <> dst GROUP BY src, dst",
    "ways": "SELECT l_orderkey AS way_id, l_linenumber AS part, CASE p_size % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'tertiary' WHEN 4 THEN 'residential' ELSE 'track' END AS highway, l_returnflag AS surface, CASE WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS oneway, concat(CAST(CAST(l_quantity AS INT) * 3 AS VARCHAR(10)), CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN ' mph' ELSE '' END) AS maxspeed, CAST(p_size % 5 + 1 AS VARCHAR(5)) AS lanes, CAST(floor(l_extendedprice / 100) AS BIGINT) AS metres FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "members": "SELECT o_orderkey AS rid, o_orderpriority AS route, o_orderstatus AS network, l_partkey AS wid, CASE WHEN l_returnflag = 'R' THEN 3 ELSE 2 END AS state FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey",
    "suspects": "SELECT l_partkey AS id, CAST(l_quantity AS INT) % 31 AS prio, CAST(l_suppkey % 512 AS INT) AS triggers FROM {lineitem}",
    "samples": "SELECT user_id AS k, event_id, floor(value * 4) AS v, CAST(event_id % 5 + 1 AS DOUBLE) AS w FROM {events}",
    "nodes": "SELECT p_partkey AS nid, CAST(188000000 + (p_partkey * 7919) % 10000000 AS INT) AS ilon, CAST(139000000 + (p_partkey * 104729) % 10000000 AS INT) AS ilat FROM {part}",
    "refs": "SELECT o_orderkey AS wid, l_linenumber AS pos, min(l_partkey) AS nid FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey, l_linenumber",
    "roads": "SELECT link, src, dst, 188000000 + (src * 7919) % 1000000 AS x1, 139000000 + (src * 104729) % 1000000 AS y1, 188000000 + (dst * 7919) % 1000000 AS x2, 139000000 + (dst * 104729) % 1000000 AS y2, 1 + link % 3 * 0.25 AS costfactor, link % 4 * 30.0 AS turncost, 1.0 + link % 3 AS classifier, (1.0 + link % 3) * 10 AS initial, CASE WHEN dst % 7 = 0 THEN 15.0 WHEN dst % 97 = 1 THEN 1000000.0 ELSE 0.0 END AS node_cost FROM (SELECT o_orderkey AS link, o_custkey AS src, 1 + (o_orderkey * 7919 + o_custkey) % (SELECT max(c_custkey) FROM {customer}) AS dst FROM {orders}) WHERE src <> dst",
    "trips": "SELECT c_nationkey AS req, min(c_custkey) AS src, max(c_custkey) AS dst FROM {customer} GROUP BY c_nationkey",
    "segments": "SELECT seg, x1, y1, x2, y2 FROM (SELECT id AS seg, ilon AS x1, ilat AS y1, lead(ilon) OVER (PARTITION BY id % 3 ORDER BY id) AS x2, lead(ilat) OVER (PARTITION BY id % 3 ORDER BY id) AS y2 FROM (SELECT s_suppkey AS id, 188000000 + (s_suppkey * 15485863) % 1000000 AS ilon, 139000000 + (s_suppkey * 32452843) % 1000000 AS ilat FROM {supplier})) WHERE x2 IS NOT NULL",
    "areas": "SELECT n_nationkey AS area_id, n_name AS name, 188000000 + n_nationkey * 40000 AS x0, 139000000 + (n_nationkey * 7 % 25) * 40000 AS y0 FROM {nation}",
}


def tables_of(text: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", text))


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement whose ``{names}`` are driver's tables."""
    text = text.replace("VARCHAR(10)", "STRING").replace("VARCHAR(5)", "STRING")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(text)})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, VIEWS[name])


def duck(name: str) -> str:
    """The view as a DuckDB subquery."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]) + ")"


# --- geometry in DuckDB, as the column functions have it ---


def scales_sql(lat: str) -> tuple[str, str]:
    r = f"((floor({lat} / 100000.0) * 0.1 + 0.05 - 90.0) * (pi() / 180))"
    return f"((111.41513 * cos({r}) - 0.09455 * cos(3 * {r}) + 0.00012 * cos(5 * {r})) / 1000)", f"((111.13209 - 0.56605 * cos(2 * {r}) + 0.0012 * cos(4 * {r})) / 1000)"


def distance_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    kx, ky = scales_sql(f"floor(({y1} + {y2}) / 2.0)")
    return f"sqrt((({x1} - {x2}) * {kx}) * (({x1} - {x2}) * {kx}) + (({y1} - {y2}) * {ky}) * (({y1} - {y2}) * {ky}))"


def turn_sql(x0, y0, x1, y1, x2, y2) -> str:
    kx, ky = scales_sql(y1)
    dx1, dy1, dx2, dy2 = f"(({x1} - {x0}) * {kx})", f"(({y1} - {y0}) * {ky})", f"(({x2} - {x1}) * {kx})", f"(({y2} - {y1}) * {ky})"
    return f"CASE WHEN ({dx1} * {dx1} + {dy1} * {dy1}) * ({dx2} * {dx2} + {dy2} * {dy2}) > 0 THEN atan2({dy1} * {dx2} - {dx1} * {dy2}, {dx1} * {dx2} + {dy1} * {dy2}) * (180 / pi()) ELSE 0.0 END"


def foot_sql(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> tuple[str, str]:
    """The share of the way at the foot of a position, and the distance to it."""
    kx, ky = scales_sql(py)
    dx, dy, vx, vy = f"(({bx} - {ax}) * {kx})", f"(({by} - {ay}) * {ky})", f"(({px} - {ax}) * {kx})", f"(({py} - {ay}) * {ky})"
    share = f"(CASE WHEN {dx} * {dx} + {dy} * {dy} > 0 THEN greatest(0.0, least(1.0, ({vx} * {dx} + {vy} * {dy}) / ({dx} * {dx} + {dy} * {dy}))) ELSE 0.0 END)"
    return share, f"sqrt(({vx} - {share} * {dx}) * ({vx} - {share} * {dx}) + ({vy} - {share} * {dy}) * ({vy} - {share} * {dy}))"


def bearing_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    kx, ky = scales_sql(f"floor(({y1} + {y2}) / 2.0)")
    return f"((atan2(({x2} - {x1}) * {kx}, ({y2} - {y1}) * {ky}) * (180 / pi()) + 360.0) % 360.0)"
