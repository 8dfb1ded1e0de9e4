"""Profile scripts and scalar functions on ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions.geo import degrees_text, distance_int, node_id, tile_name, zorder
from ..operators import enrich
from . import dsl
from .registry import query
from .views import distance_sql, duck, view

PROFILE = """
---context:global
assign base = 1.2
---context:way
assign bad = surface=R
assign costfactor = if highway=motorway then 10000
  else switch or highway=primary highway=secondary 1.5
  switch and highway=track bad 3.0
  max 1.0 ( multiply base ( add 0.5 bad ) )
assign oneway_cost = if and oneway=yes reversedirection=yes then 20 else 0
"""


def tagged(spark, sf):
    """Ways with their tags as a map."""
    return view(spark, sf, "ways").withColumn("tags", F.map_filter(F.create_map(*[x for c in ("highway", "surface", "oneway", "maxspeed", "lanes") for x in (F.lit(c), F.col(c))]), lambda k, v: v != ""))


COST = "CASE WHEN highway = 'motorway' THEN 10000.0 WHEN highway IN ('primary', 'secondary') THEN 1.5 WHEN highway = 'track' AND surface = 'R' THEN 3.0 ELSE greatest(1.0, CAST(CAST(1.2 AS FLOAT) * CAST(0.5 + CASE WHEN surface = 'R' THEN 1 ELSE 0 END AS FLOAT) AS DOUBLE)) END"


@query(f"SELECT highway, reverse, CAST(sum(round(metres * ({COST} + CASE WHEN oneway = 'yes' AND reverse THEN 20 ELSE 0 END), 2)) AS DOUBLE) AS cost, count(*) AS n FROM {duck('ways')}, (SELECT unnest([false, true]) AS reverse) WHERE {COST} < 10000 GROUP BY ALL")
def way_cost_by_class(spark, sf):
    """A profile script compiled and applied in both directions; inaccessible ways go (SRC26, UDF01, FLT01, EXP22)."""
    both = tagged(spark, sf).withColumn("reverse", F.explode(F.array(F.lit(False), F.lit(True))))
    costs = dsl.compile_profile(PROFILE).apply(both, ["costfactor", "oneway_cost"], reverse=F.col("reverse"))
    total = F.round(F.col("metres") * (F.col("costfactor").cast("double") + F.col("oneway_cost")), 2)
    return costs.where("costfactor < 10000").groupBy("highway", "reverse").agg(F.sum(total).alias("cost"), F.count("*").alias("n"))


#: Expressions of the language with what SQL has for them.
EXPRESSIONS = {
    "exp_or": ("or highway=primary surface=R", "highway = 'primary' OR surface = 'R'"),
    "exp_and": ("and highway=primary surface=R", "highway = 'primary' AND surface = 'R'"),
    "exp_xor": ("xor highway=primary surface=R", "(highway = 'primary') <> (surface = 'R')"),
    "exp_not": ("not surface=R", "NOT surface = 'R'"),
    "exp_add": ("add v:lanes 0.5", "CAST(lanes AS DOUBLE) + 0.5"),
    "exp_sub": ("sub v:lanes 2", "CAST(lanes AS DOUBLE) - 2"),
    "exp_multiply": ("multiply v:lanes 1.5", "CAST(lanes AS DOUBLE) * 1.5"),
    "exp_divide": ("divide v:lanes 4", "CAST(lanes AS DOUBLE) / 4"),
    "exp_max": ("max v:lanes 3", "greatest(CAST(lanes AS DOUBLE), 3)"),
    "exp_min": ("min v:lanes 3", "least(CAST(lanes AS DOUBLE), 3)"),
    "exp_equal": ("equal v:lanes 3", "CAST(lanes AS DOUBLE) = 3"),
    "exp_greater": ("greater v:lanes 3", "CAST(lanes AS DOUBLE) > 3"),
    "exp_lesser": ("lesser v:lanes 3", "CAST(lanes AS DOUBLE) < 3"),
    "exp_switch": ("switch highway=track 4 if surface=R then 2 else 1", "CASE WHEN highway = 'track' THEN 4 WHEN surface = 'R' THEN 2 ELSE 1 END"),
    "exp_lookup_multi": ("highway=primary|secondary|tertiary", "highway IN ('primary', 'secondary', 'tertiary')"),
    "exp_lookup_empty": ("bridge=", "true"),
    "exp_raw_value": ("v:maxspeed", "coalesce(TRY_CAST(maxspeed AS DOUBLE), 0)"),
    "exp_unset_null": ("greater v:maxheight 2", "false"),
    "exp_constant": ("add 1.5 true", "2.5"),
}


def _expression(name: str, script: str, sql: str) -> None:
    @query(f"SELECT highway, surface, lanes, CAST({sql} AS DOUBLE) AS x, count(*) AS n FROM {duck('ways')} GROUP BY ALL", name)
    def run(spark, sf):
        profile = dsl.compile_profile(f"---context:way\nassign x = {script}")
        return profile.apply(tagged(spark, sf), ["x"]).groupBy("highway", "surface", "lanes", F.col("x").cast("double").alias("x")).agg(F.count("*").alias("n"))


for _name, (_script, _sql) in EXPRESSIONS.items():
    _expression(_name, _script, _sql)


@query(f"SELECT highway, count(*) AS n, CAST(sum(CASE WHEN highway = 'track' THEN 7 ELSE 5 END) AS DOUBLE) AS total FROM {duck('ways')} GROUP BY highway")
def exp_inject(spark, sf):
    """A parameter replaces the first assignment of its variable only; node context reads way variables (EXP18, EXP19, EXP24)."""
    script = "---context:global\nassign a = 1\n---context:way\nassign b = 2\nassign b = add b a\nassign c = switch highway=track 2 0\nassign total = add b c"
    out = dsl.compile_profile(script, {"a": 4, "b": 1}).apply(tagged(spark, sf), ["total"])
    return out.groupBy("highway").agg(F.count("*").alias("n"), F.sum(F.col("total").cast("double")).alias("total"))


SPEED = r"CASE WHEN regexp_matches(maxspeed, '^[0-9]+ mph$') THEN CAST(CAST(floor(CAST(regexp_extract(maxspeed, '^([0-9]+)', 1) AS DOUBLE) * 1.61 + 0.5) AS INT) AS VARCHAR) ELSE maxspeed END"


@query(f"SELECT {SPEED} AS speed, count(*) AS n FROM {duck('ways')} GROUP BY 1")
def mph_to_kmh(spark, sf):
    """PRJ06."""
    return view(spark, sf, "ways").groupBy(T.mph_to_kmh("maxspeed").alias("speed")).agg(F.count("*").alias("n"))


@query(f"SELECT highway, count(*) FILTER (WHERE regexp_matches(maxspeed, '^[0-9]+$')) AS numeric_n, count(*) AS n, sum(TRY_CAST(maxspeed AS BIGINT)) AS total FROM {duck('ways')} GROUP BY highway")
def numeric_text_filter(spark, sf):
    """FLT06, STR-11, UDF03."""
    return view(spark, sf, "ways").groupBy("highway").agg(F.count_if(T.is_numeric("maxspeed")).alias("numeric_n"), F.count("*").alias("n"), F.sum(T.try_number("maxspeed", "bigint")).alias("total"))


@query(f"SELECT maxspeed, CASE WHEN contains(maxspeed, 'mph') THEN round(CAST(regexp_extract(maxspeed, '^([0-9]+)', 1) AS DOUBLE) * 1.609344, 6) ELSE CAST(maxspeed AS DOUBLE) END AS base, count(*) AS n FROM {duck('ways')} GROUP BY ALL")
def unit_convert(spark, sf):
    """STR-02."""
    return view(spark, sf, "ways").groupBy("maxspeed", F.round(T.to_base_unit("maxspeed"), 6).alias("base")).agg(F.count("*").alias("n"))


def _noise_sql() -> str:
    def by(fast, both, one, second):
        return f"CASE WHEN highway = 'motorway' THEN {fast} WHEN highway = 'primary' AND oneway <> 'yes' THEN {both} WHEN highway = 'primary' THEN {one} WHEN highway = 'secondary' THEN {second} ELSE 0.0 END"

    v = "CASE WHEN regexp_matches(maxspeed, '^[0-9]+$') THEN CAST(maxspeed AS DOUBLE) END"
    return f"CASE WHEN ({v}) IS NULL OR ({v}) > 105 THEN {by(0.6, 0.66, 0.45, 0.33)} WHEN ({v}) > 75 THEN {by(0.55, 0.66, 0.45, 0.33)} ELSE {by(0.4, 0.4, 0.3, 0.2)} END"


_V = _noise_sql().replace("CAST(maxspeed AS DOUBLE)", "TRY_CAST(maxspeed AS DOUBLE)")


@query(f"SELECT highway, oneway, maxspeed, CAST({_V} AS DOUBLE) AS factor, count(*) AS n FROM {duck('ways')} GROUP BY ALL")
def noise_factor(spark, sf):
    """PRJ08, FLT05."""
    return view(spark, sf, "ways").groupBy("highway", "oneway", "maxspeed", enrich.noise_factor("highway", "maxspeed", "oneway").alias("factor")).agg(F.count("*").alias("n"))


@query(f"SELECT highway, round(sum(CASE WHEN metres < 2000 THEN CAST({_V} AS DOUBLE) * metres / 2000 ELSE CAST({_V} AS DOUBLE) END), 6) AS factor FROM {duck('ways')} GROUP BY highway")
def noise_short_rescaled(spark, sf):
    """PRJ09, at a hundredfold scale of length."""
    w = view(spark, sf, "ways").withColumns({"f": enrich.noise_factor("highway", "maxspeed", "oneway"), "m": F.col("metres") / 100})
    return w.groupBy("highway").agg(F.round(F.sum(enrich.short_rescaled("f", "m")), 6).alias("factor"))


def _ladder_sql(x: str, limits, names=None) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {v} THEN '{n}'" for v, n in zip(limits, names or "12345", strict=True)) + " ELSE '6' END"


def _class(kind: str) -> None:
    @query(f"SELECT {_ladder_sql('x', T.CLASSES[kind])} AS class, count(*) AS n FROM (SELECT metres / 600.0 AS x FROM {duck('ways')}) GROUP BY 1", f"class_ladder_{kind}")
    def run(spark, sf):
        return view(spark, sf, "ways").groupBy(T.environment_class(kind, F.col("metres") / 600.0).alias("class")).agg(F.count("*").alias("n"))


for _kind in T.CLASSES:
    _class(_kind)

TRAFFIC = "((metres * 1200.0 / 1000 * (1 + p)) + i) / ((30 + m) * (50 + h))"
TRAFFIC_COLUMNS = "CASE WHEN part = 1 THEN NULL ELSE part / 10.0 END AS p, way_id % 100 AS i, CASE WHEN highway = 'motorway' THEN -15 ELSE 0 END AS m, CASE WHEN highway = 'primary' THEN 20 ELSE 0 END AS h"


@query(f"SELECT {_ladder_sql('t', (6, 10, 19, 35, 70))} AS class, count(*) AS n FROM (SELECT {TRAFFIC} AS t FROM (SELECT metres, {TRAFFIC_COLUMNS} FROM {duck('ways')})) GROUP BY 1")
def class_ladder_traffic(spark, sf):
    """PRJ12: a null operand falls to the last class."""
    w = view(spark, sf, "ways")
    p = F.when(F.col("part") != 1, F.col("part") / 10.0)
    t = enrich.traffic_value(F.col("metres") / 1000, p, F.col("way_id") % 100, F.when(F.col("highway") == "motorway", -15).otherwise(0), F.when(F.col("highway") == "primary", 20).otherwise(0))
    return w.groupBy(enrich.traffic_class(t).alias("class")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE x WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4' WHEN 4 THEN '5' ELSE '6' END AS class, count(*) AS n FROM (SELECT metres % 6 AS x FROM {duck('ways')}) GROUP BY 1")
def class_ladder_town(spark, sf):
    f = F.element_at(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.4, 0.6, 0.8, 1.0)]), (F.col("metres") % 6 + 1).cast("int"))
    return view(spark, sf, "ways").groupBy(enrich.town_class(f).alias("class")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN x = 0 THEN '0' ELSE {_ladder_sql('x', (0.056, 0.11, 0.185, 0.37, 0.65))} END AS class, count(*) AS n FROM (SELECT (metres % 100) / 100.0 AS x FROM {duck('ways')}) GROUP BY 1")
def class_ladder_crossing(spark, sf):
    return view(spark, sf, "ways").groupBy(enrich.crossing_class((F.col("metres") % 100) / 100.0).alias("class")).agg(F.count("*").alias("n"))


@query(f"""SELECT oneway, lanes, maxspeed, CASE WHEN v IS NULL OR v > 105 THEN 0.9 WHEN v > 85 THEN 1 WHEN v >= 55 THEN 0.8 WHEN v >= 35 THEN 0.65 ELSE 0.5 END::DOUBLE AS speed_factor,
CASE WHEN oneway = 'yes' THEN CASE lanes WHEN '1' THEN 0.5 WHEN '2' THEN 0.75 WHEN '3' THEN 0.85 WHEN '4' THEN 0.95 ELSE 1.0 END ELSE CASE lanes WHEN '1' THEN 0.6 WHEN '2' THEN 1.0 WHEN '3' THEN 1.2 WHEN '4' THEN 1.5 WHEN '5' THEN 1.7 ELSE 2.0 END END::DOUBLE AS lanes_factor, count(*) AS n
FROM (SELECT *, TRY_CAST(maxspeed AS DOUBLE) AS v FROM {duck('ways')}) GROUP BY ALL""")
def crossing_factors(spark, sf):
    """PRJ10."""
    return view(spark, sf, "ways").groupBy("oneway", "lanes", "maxspeed", enrich.speed_factor("maxspeed").alias("speed_factor"), enrich.lanes_factor("lanes", "oneway").alias("lanes_factor")).agg(F.count("*").alias("n"))


@query(f"SELECT id, ilon * 4294967296 + ilat AS node_id, concat(CAST((ilon - 180000000) // 1000000 AS VARCHAR), '.', lpad(CAST((ilon - 180000000) % 1000000 AS VARCHAR), 6, '0')) AS lon, concat('E', CAST(ilon // 5000000 * 5 - 180 AS VARCHAR), '_N', CAST(ilat // 5000000 * 5 - 90 AS VARCHAR)) AS tile FROM {duck('places')}")
def position_keys(spark, sf):
    """Position ids, degree texts and tile names (PRJ14, STR-09)."""
    return view(spark, sf, "places").select("id", node_id("ilon", "ilat").alias("node_id"), degrees_text(F.col("ilon"), 180).alias("lon"), tile_name("ilon", "ilat").alias("tile"))


@query("SELECT s_suppkey AS id, " + " + ".join(f"((s_suppkey >> {i}) & 1) * {1 << 2 * i} + (((s_suppkey * 7) >> {i}) & 1) * {1 << 2 * i + 1}" for i in range(15)) + " AS z FROM supplier")
def zorder_key(spark, sf):
    """GEO17."""
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), zorder("s_suppkey", F.col("s_suppkey") * 7).alias("z"))


@query(f"SELECT highway, surface, oneway, array_to_string(['highway=' || highway, 'lanes=' || lanes, 'oneway=' || oneway, 'surface=' || surface], ' ') AS text, count(*) AS n FROM (SELECT * FROM {duck('ways')}) GROUP BY ALL")
def tag_description(spark, sf):
    """PRJ03."""
    text = T.description(F.map_filter("tags", lambda k, v: k != "maxspeed"))
    return tagged(spark, sf).groupBy("highway", "surface", "oneway", text.alias("text")).agg(F.count("*").alias("n"))


@query("SELECT user_id, concat(CASE WHEN s >= 3600 THEN concat(CAST(s // 3600 AS VARCHAR), 'h ') ELSE '' END, CASE WHEN s % 3600 >= 60 THEN concat(CAST(s % 3600 // 60 AS VARCHAR), 'm ') ELSE '' END, CASE WHEN s % 60 > 0 THEN concat(CAST(s % 60 AS VARCHAR), 's') ELSE '' END) AS text FROM (SELECT user_id, CAST(sum(floor(value)) AS BIGINT) // 10 * 30 AS s FROM events GROUP BY user_id)")
def duration_text(spark, sf):
    """STR-06."""
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg((F.floor(F.sum(F.floor("value")) / 10) * 30).alias("s")).select("user_id", T.duration("s").alias("text"))


@query("SELECT event_id, regexp_replace(props, '[^a-zA-Z0-9 ._\\-]+', '', 'g') AS name, replace(props, '\"', '&quot;') AS xml FROM events")
def text_escaping(spark, sf):
    """STR-01, STR-05."""
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", T.track_name("props").alias("name"), T.xml_escaped("props").alias("xml"))


@query(f"SELECT a.id, CAST(greatest(1, floor({distance_sql('a.ilon', 'a.ilat', 'b.ilon', 'b.ilat')} + 0.5)) AS INT) AS metres FROM {duck('places')} a JOIN {duck('sites')} b ON b.id = 1 + a.id % (SELECT max(s_suppkey) FROM supplier)")
def whole_metres(spark, sf):
    """GEO02, GEO03."""
    a = view(spark, sf, "places").select("id", "nation", F.col("ilon").alias("x1"), F.col("ilat").alias("y1"))
    b = view(spark, sf, "sites").select(F.col("id").alias("sid"), F.col("nation").alias("n2"), F.col("ilon").alias("x2"), F.col("ilat").alias("y2"))
    last = view(spark, sf, "sites").agg(F.max("id")).first()[0]
    return a.join(b, F.col("sid") == 1 + F.col("id") % last).select("id", distance_int("x1", "y1", "x2", "y2").alias("metres"))


@query(f"SELECT (prio + 1) // 2 * 2 AS level, CASE (prio + 1) // 2 * 2 WHEN 30 THEN 'motorway' WHEN 28 THEN 'trunk' WHEN 26 THEN 'primary' WHEN 24 THEN 'secondary' WHEN 22 THEN 'tertiary' ELSE 'none' END AS name, count(*) AS n FROM {duck('suspects')} GROUP BY ALL")
def suspect_levels(spark, sf):
    """STR-13."""
    level = T.suspect_level("prio")
    return view(spark, sf, "suspects").groupBy(level.alias("level")).agg(F.count("*").alias("n")).select("level", T.level_name("level").alias("name"), "n")


@query(f"""SELECT triggers, concat_ws(',', CASE WHEN triggers & 1 > 0 THEN 'dead-end' END, CASE WHEN triggers & 2 > 0 THEN 'dead-start' END, CASE WHEN triggers & 4 > 0 THEN 'node-block' END, CASE WHEN triggers & 8 > 0 THEN 'bad-access' END,
CASE WHEN triggers & 16 > 0 THEN 'unkown-access' END, CASE WHEN triggers & 32 > 0 THEN 'sharp-exit' END, CASE WHEN triggers & 64 > 0 THEN 'sharp-entry' END, CASE WHEN triggers & 128 > 0 THEN 'sharp-link' END, CASE WHEN triggers & 256 > 0 THEN 'bad-tr' END) AS text, count(*) AS n FROM {duck('suspects')} GROUP BY ALL""")
def trigger_texts(spark, sf):
    """STR-12."""
    return view(spark, sf, "suspects").groupBy("triggers", T.trigger_text("triggers").alias("text")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN m < 60 THEN concat(CAST(m AS VARCHAR), ' minutes') WHEN m < 1440 THEN concat(CAST(m // 60 AS VARCHAR), ' hours') ELSE concat(CAST(m // 1440 AS VARCHAR), ' days') END AS text FROM (SELECT event_id, event_id % 5000 AS m FROM events)")
def age_texts(spark, sf):
    """STR-07."""
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", T.age_text(F.col("event_id") % 5000).alias("text"))


_INCLINE = "CASE event_id % 6 WHEN 0 THEN '5%' WHEN 1 THEN '-3 %' WHEN 2 THEN '7\u00b0' WHEN 3 THEN 'up' WHEN 4 THEN concat(CAST(event_id % 40 AS {text}), '.5%') END"


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 1 THEN -x ELSE x END AS incline FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 5.0 WHEN 1 THEN -3.0 WHEN 2 THEN 7.0 WHEN 4 THEN event_id % 40 + 0.5 ELSE 0.0 END::DOUBLE AS x FROM events)")
def incline_texts(spark, sf):
    """STR-10: percent or degrees as they stand, turned round against the way."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("t", F.expr(_INCLINE.format(text="string")))
    return e.select("event_id", T.incline("t", F.col("event_id") % 2 == 1).alias("incline"))


NODE_PROFILE = """
---context:global
assign limit = 20
---context:way
assign fast = or highway=motorway highway=primary
assign cost = if reversedirection=yes then add fast 2 else fast
---context:node
assign busy = and way:fast greater v:lanes 2
assign initialcost = if nodeaccessgranted=yes then way:cost else add way:cost ( multiply limit busy )
"""


@query(f"""SELECT way_id, part, CAST(fast AND try_cast(lanes AS DOUBLE) > 2 AS INT)::DOUBLE AS busy, (fast::INT + CASE WHEN part % 2 = 1 THEN 2 ELSE 0 END + CASE WHEN part % 3 = 0 THEN 0 WHEN fast AND try_cast(lanes AS DOUBLE) > 2 THEN 20 ELSE 0 END)::DOUBLE AS cost
FROM (SELECT *, highway IN ('motorway', 'primary') AS fast FROM {duck('ways')})""")
def exp_foreign(spark, sf):
    """EXP19, JOIN37, EXP22: a node's expressions read the variables of the way it was reached by."""
    nodes = tagged(spark, sf).select("way_id", "part", F.col("tags").alias("way_tags"), F.create_map(F.lit("lanes"), F.col("tags")["lanes"]).alias("tags"))
    costs = dsl.compile_profile(NODE_PROFILE).apply_nodes(nodes, ["busy", "initialcost"], reverse=F.col("part") % 2 == 1, granted=F.col("part") % 3 == 0)
    return costs.select("way_id", "part", F.col("busy").cast("double").alias("busy"), F.col("initialcost").cast("double").alias("cost"))
