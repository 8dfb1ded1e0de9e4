"""Spatial joins on few bytes and many pairs: tasks, rings, boxes at high latitudes."""

import pytest
from pyspark.sql import functions as F

from roadloom.functions import geo
from roadloom.operators import lines, spatial


def sides(spark, lat=139_000_000, step=40_000):
    p = spark.range(120).selectExpr("id AS a", f"188000000 + (id * 7919) % 20 * {step} AS x1", f"{lat} + (id * 104729) % 19 * {step} AS y1")
    s = spark.range(90).selectExpr("id AS b", f"188000000 + (id * 31) % 23 * {step} AS x2", f"{lat} + (id * 17) % 21 * {step} AS y2")
    return p.coalesce(1), s.coalesce(1)


def brute(p, s, metres):
    return {(r.a, r.b) for r in p.crossJoin(s).where(geo.distance("x1", "y1", "x2", "y2") <= metres).collect()}


def test_one_file_is_joined_in_many_tasks(spark):
    """F9, F16"""
    p, s = sides(spark)
    assert spatial.within_distance(p, s, F.lit(9000.0)).rdd.getNumPartitions() >= 16


def test_no_pair_is_lost_at_high_latitudes(spark):
    p, s = sides(spark, 164_000_000, 300_000)
    got = spatial.within_distance(p, s, F.lit(250_000.0), 10_000).select("a", "b").collect()
    assert len(got) == len({*map(tuple, got)}) and {*map(tuple, got)} == brute(p, s, 250_000)


def test_left_join_moves_no_pairs(spark):
    """F5"""
    p, s = sides(spark)
    out = spatial.within_distance(p, s, F.lit(5000.0), how="left")
    assert "LeftOuter" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = brute(p, s, 5000)
    assert sorted((r.a, r.b) for r in out.collect() if r.b is not None) == sorted(want)
    assert {r.a for r in out.collect() if r.b is None} == set(range(120)) - {a for a, _ in want} != set()


@pytest.mark.parametrize("most", [30_000.0, 400_000.0])
def test_nearest_starts_with_a_small_ring(spark, monkeypatch, most):
    """F6, F14"""
    p, s = sides(spark)
    radii, real = [], spatial.within_distance
    monkeypatch.setattr(spatial, "within_distance", lambda a, b, m, *rest: (radii.append(m._jc.toString()), real(a, b, m, *rest))[1])
    got = {(r.a, r["rank"]): r.b for r in spatial.nearest(p, s, 2, most, "a", "b").collect()}
    assert float(radii[0]) < most
    pairs = p.crossJoin(s).withColumn("d", geo.distance("x1", "y1", "x2", "y2")).where(F.col("d") <= most).collect()
    for a in range(120):
        near = sorted((r.d, r.b) for r in pairs if r.a == a)[:2]
        assert [got.get((a, n + 1)) for n in range(len(near))] == [b for _, b in near]


def test_a_pairs_columns_are_worked_out_once(spark):
    """F3, F8, F12, F15: the join's own condition has no distances, and segments take the cells along them, not those of their box."""
    points = spark.range(200).selectExpr("id AS place", "188000000 + (id * 7919) % 1000000 AS x", "139000000 + (id * 104729) % 1000000 AS y")
    segments = spark.createDataFrame([(1, 188_000_000, 139_000_000, 188_900_000, 139_900_000), (2, 188_100_000, 139_800_000, 188_100_000, 139_800_000)], "seg long, x1 long, y1 long, x2 long, y2 long")
    out = lines.near(points, segments, 8000.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("SQRT" in line.upper() for line in plan.splitlines() if "Join" in line)
    assert lines.along(segments, F.lit(8000.0), 31_250, ("x1", "y1", "x2", "y2")).where("seg = 1").count() < 500  # of over 1,000 in its box
    share, distance = geo.foot("x", "y", "x1", "y1", "x2", "y2")
    want = points.crossJoin(segments).withColumn("distance", distance).where("distance <= 8000").collect()
    assert sorted((r.place, r.seg, r.distance) for r in out.collect()) == sorted((r.place, r.seg, r.distance) for r in want)


@pytest.mark.parametrize("lat, step", [(139_000_000, 40_000), (164_000_000, 300_000), (179_300_000, 30_000), (89_900_000, 25_000)])
def test_pairs_by_own_radius(spark, lat, step):
    """strips of cells, in places of all latitudes, with radii of nothing to 250 km."""
    p, s = sides(spark, lat, step)
    p = p.withColumn("r", F.when(F.col("a") % 11 == 3, F.lit(None)).otherwise(F.col("a") * F.col("a") * 17.5 - 500))
    got = [(r.a, r.b, r.d) for r in spatial.within_own_radius(p, s, F.col("r")).select("a", "b", F.col("distance").alias("d")).collect()]
    both = p.crossJoin(s).withColumn("d", geo.distance("x1", "y1", "x2", "y2"))
    assert sorted(got) == sorted((r.a, r.b, r.d) for r in both.where("d <= r").collect()) != []


def test_strips_hold_all_rows(spark):
    _, s = sides(spark)
    got = spatial.strips(s, "x2", "y2", 250_000, 4).selectExpr("_cell", "_strip", "size(_strip) AS n").collect()
    assert sorted(r.b for g in got for r in g["_strip"]) == list(range(90)) and max(g.n for g in got) == 4


def test_pairs_by_own_radius_take_little_disk(spark, tmp_path):
    """one strip's pairs follow each other, so files hold them in far less than a byte each."""
    from roadloom.plans import registry

    spark.read.parquet("/root/testdata/sf0.1/customer.parquet").where("c_custkey % 4 = 0").write.parquet(f"{tmp_path}/customer.parquet")
    more = spark.read.parquet("/root/testdata/sf0.1/supplier.parquet").crossJoin(spark.range(8).withColumnRenamed("id", "k"))
    more.withColumn("s_suppkey", F.expr("s_suppkey + 1000 * k")).drop("k").write.parquet(f"{tmp_path}/supplier.parquet")
    registry.QUERIES["range_join_row_radius"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/pairs")
    size, n = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")), spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n > 4_000_000 and size < 0.6 * n
