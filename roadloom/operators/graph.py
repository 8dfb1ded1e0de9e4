"""Least-cost paths as joins: a frontier that is relaxed until nothing gets better."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import meeting
from .tables import discard, stored


def k_hops(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(req, node, cost): least cost with at most so many edges, as one plan of unrolled joins."""
    best = sources.select("req", "node", F.lit(0.0).alias("cost"))
    for _ in range(hops):
        more = best.join(edges, F.col("node") == F.col("src")).select("req", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"))
        best = best.union(more).groupBy("req", "node").agg(F.min("cost").alias("cost"))
    return best


def least_costs(edges: DataFrame, sources: DataFrame, bound: float | None = None, penalties: DataFrame | None = None, every: int = 8) -> DataFrame:
    """(req, node, cost, hops, prev): least costs from each request's sources, by relaxing a frontier of improved labels.

    Ties go to fewer hops, then the smaller predecessor.  ``bound`` drops labels that cost more.  ``penalties`` (req, src, dst, times)
    add an edge's weight so many times for a request.  Edges are read in every round, so they should be a stored table.
    """
    labels = stored(sources.select("req", "node", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("prev")), "labels")
    frontier, number = labels, 0
    while True:
        step = frontier.join(edges, F.col("node") == F.col("src"))
        weight = F.col("weight")
        if penalties is not None:
            step = step.join(penalties.select("req", "src", "dst", "times"), ["req", "src", "dst"], "left")
            weight = weight * (1.0 + F.coalesce("times", F.lit(0)))
        step = step.select("req", F.col("dst").cast("long").alias("node"), (F.col("cost") + weight).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("src").cast("long").alias("prev"))
        if bound is not None:
            step = step.where(F.col("cost") <= bound)
        rows = step.withColumn("new", F.lit(True)).unionByName(labels.withColumn("new", F.lit(False)))
        # a node's labels meet once: the best of them, older ones first, goes on if it is new
        best = rows.groupBy("req", "node").agg(F.min(F.struct("cost", "hops", F.coalesce("prev", F.lit(-1)).alias("prev"), "new")).alias("n")).where("n.new")
        frontier = stored(best.select("req", "node", "n.cost", "n.hops", F.nullif("n.prev", F.lit(-1)).alias("prev")), "frontier")
        if frontier.isEmpty():
            return _least(labels)
        number += 1
        labels = labels.unionByName(frontier)
        if number % every == 0:
            labels = stored(_least(labels), "labels")


def _least(labels: DataFrame) -> DataFrame:
    """Of each node the label that was found last, which is its best."""
    best = labels.groupBy("req", "node").agg(F.min(F.struct("cost", "hops", F.coalesce("prev", F.lit(-1)).alias("prev"))).alias("n"))
    return best.select("req", "node", "n.cost", "n.hops", F.nullif("n.prev", F.lit(-1)).alias("prev"))


def backtracked(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(req, target, seq, node, cost): the paths to the targets, seq 0 at the source."""
    at = labels.join(targets.select("req", F.col("node").alias("target")), "req").where("node = target")
    path, now = None, at.select("req", "target", F.col("hops").alias("seq"), "node", "cost", "prev")
    l = labels.select(F.col("req").alias("_q"), F.col("node").alias("_n"), F.col("cost").alias("_c"), F.col("prev").alias("_p"))  # noqa: E741
    while True:
        now = stored(now, "path")
        part = now.select("req", "target", "seq", "node", "cost")
        path = part if path is None else path.unionByName(part)
        rest = now.where("prev is not null")
        if rest.isEmpty():
            return path
        now = rest.join(l, (F.col("req") == F.col("_q")) & (F.col("prev") == F.col("_n"))).select("req", "target", (F.col("seq") - 1).alias("seq"), F.col("_n").alias("node"), F.col("_c").alias("cost"), F.col("_p").alias("prev"))


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(req, node) of all that can be reached."""
    return least_costs(edges.select("src", "dst", F.lit(1.0).alias("weight")), sources).select("req", "node")


def islands(edges: DataFrame, points: DataFrame, limit: int = 500) -> DataFrame:
    """(req, n, island): whether fewer than ``limit`` nodes lead to a point; the count stops growing there."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    seen = stored(points.select("req", "node"), "seen")
    frontier = seen
    while True:
        small = seen.groupBy("req").count().where(F.col("count") < limit).select("req")
        step = frontier.join(small, "req", "left_semi").join(back, F.col("node") == F.col("src")).select("req", F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(seen, ["req", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen.groupBy("req").agg(F.least(F.count("*"), F.lit(limit)).alias("n")).withColumn("island", F.col("n") < limit)
        former, seen = seen, stored(seen.unionByName(frontier), "seen")
        if former is not frontier:
            discard(former)


def routes(edges: DataFrame, requests: DataFrame, alternatives: int = 0) -> DataFrame:
    """(alternative, req, seq, node, cost): paths of requests (req, src, dst), looked for from both ends.

    Ties go to fewer hops, then, from the end back, the smaller predecessor.
    Each alternative is searched with the links of earlier results at their double weight.
    """
    found = used = None
    weights = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "weight")
    if not hasattr(edges, "_stored_at"):
        weights = stored(weights, "edges")
    sources = requests.select("req", F.col("src").cast("long").alias("node"), F.lit(0.0).alias("cost"))
    targets = requests.select("req", F.col("dst").cast("long").alias("node"))

    def along(here: str, there: str, used: DataFrame | None):
        def step(rows: DataFrame, count: int) -> DataFrame:
            on = meeting.small(rows, count).join(weights, F.col("node") == F.col(here))
            if used is None:
                return on.selectExpr(*rows.columns, f"{there} AS to", "weight AS step")
            on = on.join(used, ["req", "src", "dst"], "left")
            return on.selectExpr(*rows.columns, f"{there} AS to", "weight * (1.0D + coalesce(times, 0)) AS step")

        return step

    for number in range(alternatives + 1):
        path = meeting.paths(sources, targets, along("src", "dst", used), along("dst", "src", used))
        path = stored(path.withColumn("alternative", F.lit(number)), "routes")
        found = path if found is None else found.unionByName(path)
        w = Window.partitionBy("alternative", "req").orderBy("seq")
        pairs = found.select("req", F.lag("node").over(w).alias("src"), F.col("node").alias("dst")).where("src is not null")
        if number < alternatives:
            used = stored(pairs.groupBy("req", "src", "dst").agg(F.count("*").alias("times")), "penalties")
    return found


def elevation_cost(up, down, distance, cut_up: float = 1.5, cut_down: float = 1.5):
    """Elevation that counts after the free slope (percent of the distance) is taken off, upwards and downwards."""
    return F.greatest(up - distance * cut_up / 100, F.lit(0.0)), F.greatest(down - distance * cut_down / 100, F.lit(0.0))


def turn_cost(cosine, cost):
    return F.floor((1 - cosine) * cost + 0.2).cast("int")


def bike_speed(incline, power: float = 100.0, mass: float = 90.0, scx: float = 0.225, roll: float = 0.01, most: float = 45.0):
    """Speed in m/s at which power meets air and rolling resistance and slope, and at most ``most`` km/h.

    Newton's method in ten steps from 8 m/s: a start from which the resistance is too small is doubled, and it ends once the resistance is
    met to a tenth of a watt.
    """
    force = 9.81 * mass * (roll + incline)

    def step(s, _):
        v = s["v"]
        short = (scx * v * v + force) * v - power < 0.1
        return F.struct(
            F.when(s["done"], v).when(short & s["starting"], 2 * v).when(short, v).otherwise(v - ((scx * v * v + force) * v - power) / (3 * scx * v * v + force)).alias("v"),
            (s["starting"] & short).alias("starting"),
            (s["done"] | (short & ~s["starting"])).alias("done"),
        )

    start = F.struct(F.lit(8.0).alias("v"), F.lit(True).alias("starting"), F.lit(False).alias("done"))
    return F.least(F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, step, lambda s: s["v"]), F.lit(most / 3.6))


def hiking_speed(incline):
    """Tobler's speed in km/h."""
    return 6.0 * F.exp(-3.5 * F.abs(incline + 0.05))
