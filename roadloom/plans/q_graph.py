"""Paths, reachability and requests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, requests
from ..operators.tables import stored
from .registry import query
from .views import duck, view


def net(spark, sf):
    """The whole network: one edge for each pair of places that an order links."""
    return stored(view(spark, sf, "net").select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double")), "net")


def trips(spark, sf):
    """One request for each nation, between its first and last place."""
    return view(spark, sf, "trips").select("req", F.col("src").cast("long"), F.col("dst").cast("long"))


def starts(spark, sf):
    return trips(spark, sf).select("req", F.col("src").alias("node"))


_NET = f"n AS (SELECT src, dst, weight::DOUBLE AS weight FROM {duck('net')}), v AS (SELECT req, src AS node, dst FROM {duck('trips')})"


@query(f"WITH {_NET}, h0 AS (SELECT req, node, CAST(0 AS DOUBLE) AS cost FROM v), " + ", ".join(f"h{k} AS (SELECT req, node, min(cost) AS cost FROM (SELECT * FROM h{k - 1} UNION ALL SELECT h.req, n.dst, h.cost + n.weight FROM h{k - 1} h JOIN n ON n.src = h.node) GROUP BY req, node)" for k in (1, 2, 3)) + " SELECT req, node, cost FROM h3")
def k_hop_min_cost(spark, sf):
    """GRF07 in its unrolled form, on static weights."""
    return graph.k_hops(net(spark, sf), starts(spark, sf), 3)


_LEAST = f"WITH RECURSIVE {_NET}, w(req, node, cost) USING KEY (req, node) AS (SELECT req, node, CAST(0 AS DOUBLE) FROM v UNION SELECT x.req, x.node, x.cost FROM (SELECT w.req, n.dst AS node, min(w.cost + n.weight) AS cost FROM w JOIN n ON n.src = w.node GROUP BY ALL) x LEFT JOIN recurring.w o ON o.req = x.req AND o.node = x.node WHERE o.cost IS NULL OR x.cost < o.cost)"


@query(f"{_LEAST} SELECT req, node, cost FROM w")
def least_cost_paths(spark, sf):
    """GRF07: the frontier runs until nothing gets better."""
    return graph.least_costs(net(spark, sf), starts(spark, sf)).select("req", "node", "cost")


@query(f"{_LEAST} SELECT req, node, cost FROM w WHERE cost <= 40")
def bounded_paths(spark, sf):
    """GRF09, FLT15: labels over a bound are dropped."""
    return graph.least_costs(net(spark, sf), starts(spark, sf), bound=40.0).select("req", "node", "cost")


@query(f"WITH RECURSIVE {_NET}, r AS (SELECT req, node FROM v UNION SELECT r.req, n.dst FROM r JOIN n ON n.src = r.node) SELECT req, node FROM r")
def reachable_set(spark, sf):
    """GRF12."""
    return graph.reachable(net(spark, sf), starts(spark, sf))


@query(f"WITH RECURSIVE {_NET}, r AS (SELECT req, node FROM v UNION SELECT r.req, n.src FROM r JOIN n ON n.dst = r.node) SELECT req, least(count(*), 500) AS n, count(*) < 500 AS island FROM r GROUP BY req")
def bounded_island_check(spark, sf):
    """GRF12: the search back from a point stops at a limit."""
    return graph.islands(net(spark, sf), starts(spark, sf), 500)


@query(f"{_LEAST} SELECT req, node AS target, cost, true AS sound FROM w")
def path_backtrack(spark, sf):
    """GRF27: paths to all nodes that are reached; ``sound`` says that each step is an edge, at its weight, from the source on."""
    edges = net(spark, sf)
    labels = stored(graph.least_costs(edges, starts(spark, sf)), "labels")
    path = graph.backtracked(labels, labels.select("req", "node"))
    w = Window.partitionBy("req", "target").orderBy("seq")
    steps = path.withColumns({"src": F.lag("node").over(w), "before": F.lag("cost").over(w)})
    steps = steps.join(edges.withColumnRenamed("dst", "node"), ["src", "node"], "left").join(starts(spark, sf).withColumnRenamed("node", "first"), "req")
    fine = F.when(F.col("seq") == 0, (F.col("node") == F.col("first")) & (F.col("cost") == 0)).otherwise(F.coalesce(F.col("cost") == F.col("before") + F.col("weight"), F.lit(False)))
    return steps.groupBy("req", "target").agg(F.max("cost").alias("cost"), F.bool_and(fine).alias("sound"))


@query()
def alt_penalty(spark, sf):
    """SRT08: alternatives with a penalty on used links."""
    return graph.routes(net(spark, sf), trips(spark, sf), alternatives=2)


@query("SELECT s_suppkey AS req_id, seq, CAST((s_suppkey % 170 + seq + 180.5) * 1000000 AS INT) AS ilon, CAST((s_nationkey + 90.25 + seq * 0.5) * 1000000 AS INT) AS ilat, CASE seq WHEN 0 THEN 'via0' ELSE 'stop' END AS name, CASE seq WHEN 0 THEN 1 ELSE 0 END AS kind FROM supplier, (SELECT unnest([0, 1]) AS seq)")
def request_waypoints(spark, sf):
    """SRC41, STR-04."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    a = F.concat((F.col("s_suppkey") % 170).cast("string"), F.lit(".5,"), F.col("s_nationkey").cast("string"), F.lit(".25%7C"), (F.col("s_suppkey") % 170 + 1).cast("string"), F.lit(".5,"), F.col("s_nationkey").cast("string"), F.lit(".75,stop"))
    asked = s.select(F.col("s_suppkey").alias("req_id"), F.concat(F.lit("/route?profile=trekking&lonlats="), a).alias("url"))
    found = requests.waypoints(asked.select("req_id", requests.parameters(F.col("url"))["lonlats"].alias("lonlats")))
    return found.select("req_id", "seq", "ilon", "ilat", "name", F.col("wpttype").cast("int").alias("kind"))
