"""F8, F11, F12, F14: lines are put into the cells along them only, and rings end after few rounds."""

import math

import pytest
from pyspark.sql import functions as F

from roadloom.operators import lines, spatial

SEGMENTS = "seg long, x1 long, y1 long, x2 long, y2 long"
ENDS = ("x1", "y1", "x2", "y2")


def test_cells_along_a_long_segment(spark):
    # its box has 400 million cells
    df = spark.createDataFrame([(1, 188_000_000, 139_000_000, 190_000_000, 141_000_000)], SEGMENTS)
    got = {r["_cell"] for r in lines.along(df, F.lit(2.0), 100, ENDS).collect()}
    for k in range(0, 2_000_001, 997):
        for dx, dy in ((0, 0), (20, 0), (-20, 0), (0, 17), (0, -17)):
            assert ((188_000_000 + k + dx) // 100 << 32) + (139_000_000 + k + dy) // 100 in got
    assert len(got) < 200_000


@pytest.mark.parametrize("ends", [(0, 0, 900, 0), (0, 0, 0, 900), (900, 40, 0, 700), (5, 5, 5, 5), (0, 900, 31, 0)])
def test_cells_along_hold_all_positions_near(spark, ends):
    x0, y0 = 188_000_000, 139_000_000
    df = spark.createDataFrame([(1, x0 + ends[0], y0 + ends[1], x0 + ends[2], y0 + ends[3])], SEGMENTS)
    points = spark.range(0, 1300 * 1300, 7).select((F.lit(x0 - 200) + F.col("id") % 1300).alias("x"), (F.lit(y0 - 200) + F.floor(F.col("id") / 1300)).alias("y"))
    from roadloom.functions import geo

    plain = points.crossJoin(df).where(geo.foot("x", "y", *ENDS)[1] <= 9.0).count()
    assert plain > 0 and lines.near(points, df, 9.0, 64).count() == plain


def test_far_segments_are_found_in_few_rings(spark, monkeypatch):
    rounds, stored = [], lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: (rounds.append(name), stored(df, name))[1])
    x, y = 188_000_000, 139_000_000
    rows = [(i, x + 10 * i, y, x + 10 * i, y + 1000) for i in range(40)]
    points = spark.createDataFrame([(1, x, y), (2, x + 150_000, y)], "place long, x long, y long")
    got = lines.matched(points, spark.createDataFrame(rows, SEGMENTS), 15_000.0, "place", "seg").collect()
    assert rounds.count("matched") <= math.ceil(math.log(15_000, lines.GROWTH)) + 1
    assert sorted((r.place, r.seg) for r in got if r["rank"] == 1) == [(1, 0), (2, 39)] and len(got) == 10


def test_rings_mark_what_is_full_without_another_join(spark):
    sites = spark.createDataFrame([(i, 188_000_000 + 100 * i, 139_000_000) for i in range(30)], "site long, x2 long, y2 long")
    places = spark.createDataFrame([(1, 188_000_000, 139_000_000), (2, 188_500_000, 139_000_000)], "place long, x1 long, y1 long")
    got = spatial.nearest_ring(places, sites, 3, 20.0, "place", "site", 60_000.0)
    assert sorted((r.place, r["rank"], r.site) for r in got.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 29), (2, 2, 28), (2, 3, 27)]
    assert "LeftSemi" not in got._jdf.queryExecution().toString()
