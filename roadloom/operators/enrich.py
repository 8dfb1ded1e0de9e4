"""Environment classes of ways and crossings: noise, river, forest, town, traffic, crossing risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import col
from ..functions.tags import environment_class, is_numeric, ladder

FAST = ("motorway", "motorway_link", "trunk", "trunk_link")
MAIN = ("primary", "primary_link")


def one_way(oneway) -> Column:
    return F.coalesce(col(oneway).isin("yes", "true", "1"), F.lit(False))


def noise_factor(highway, maxspeed, oneway) -> Column:
    """How loud a road is by its class, speed and whether it carries both directions."""
    speed, h, single = F.when(is_numeric(maxspeed), col(maxspeed).try_cast("double")), col(highway), one_way(oneway)

    def by_class(fast: float, both: float, one: float, second: float) -> Column:
        return F.when(h.isin(*FAST), fast).when(h.isin(*MAIN) & ~single, both).when(h.isin(*MAIN), one).when(h == "secondary", second).otherwise(0.0)

    # fixed values: unknown or over 105 km/h, over 75, and the rest
    return F.when(speed.isNull() | (speed > 105), by_class(0.6, 0.66, 0.45, 0.33)).when(speed > 75, by_class(0.55, 0.66, 0.45, 0.33)).otherwise(by_class(0.4, 0.4, 0.3, 0.2))


def short_rescaled(factor, metres) -> Column:
    """Pieces under 20 m count by their length."""
    return F.when(col(metres) < 20, col(factor) * col(metres) / 20).otherwise(col(factor))


def proximity(pairs: DataFrame, keys: list[str], metres: str, distance: str, scale: float, weight: Column | None = None) -> DataFrame:
    """``factor`` of each way: what its pieces collect from sources by distance, over the number of 20 m pieces."""
    share = (weight if weight is not None else F.lit(1.0)) / ((F.col(distance) + scale) / scale)
    return pairs.groupBy(*keys, metres).agg((F.sum(share) / (F.first(F.rint(F.col(metres) / 20)) + 1)).alias("factor"))


def classes(factors: DataFrame, kind: str, least: float) -> DataFrame:
    """(…, class) of factors over ``least``."""
    return factors.where(F.col("factor") > least).withColumn("class", environment_class(kind, "factor"))


def town_class(factor) -> Column:
    f = col(factor)
    out = None
    for value, name in ((0.1, "1"), (0.2, "2"), (0.4, "3"), (0.6, "4"), (0.8, "5")):
        out = F.when(f == value, name) if out is None else out.when(f == value, name)
    return out.otherwise("6")


def traffic_value(populate, peaks, industry, motorways, highways) -> Column:
    """Estimated traffic; null if an operand is."""
    return (col(populate) * 1200 * (1 + col(peaks)) + col(industry)) / ((30 + col(motorways)) * (50 + col(highways)))


def traffic_class(value) -> Column:
    return ladder(value, (6, "1"), (10, "2"), (19, "3"), (35, "4"), (70, "5"), last="6")


def crossing_class(penalty) -> Column:
    p = col(penalty)
    return F.when(p == 0, "0").otherwise(ladder(p, (0.056, "1"), (0.11, "2"), (0.185, "3"), (0.37, "4"), (0.65, "5"), last="6"))


def speed_factor(maxspeed) -> Column:
    v = F.when(is_numeric(maxspeed), col(maxspeed).try_cast("double"))
    return F.when(v.isNull() | (v > 105), 0.9).when(v > 85, 1.0).when(v >= 55, 0.8).when(v >= 35, 0.65).otherwise(0.5)


#: Lane factors of one-way roads and others; fixed values.
LANES_ONE = {"1": 0.5, "1.5": 0.62, "2": 0.75, "3": 0.85, "4": 0.95}
LANES_BOTH = {"1": 0.6, "1.5": 0.8, "2": 1.0, "3": 1.2, "4": 1.5, "5": 1.7, "6": 1.7}


def lanes_factor(lanes, oneway) -> Column:
    n = col(lanes)

    def of(values: dict[str, float], unknown: float, more: float) -> Column:
        out = F.when(n.isNull() | ~is_numeric(n), unknown)
        for k, v in values.items():
            out = out.when(n == k, v)
        return out.otherwise(more)

    return F.when(one_way(oneway), of(LANES_ONE, 0.5, 1.0)).otherwise(of(LANES_BOTH, 1.0, 2.0))


def gravity(pairs: DataFrame, key: str, distance: str, population: str, weight: Column, *more: Column) -> DataFrame:
    """``populate_factor``: population over squared distance, weighted by road class; and ``more`` aggregates of the same pairs."""
    return pairs.groupBy(key).agg(F.sum(weight * F.col(population) / ((F.col(distance) + 1000) * (F.col(distance) + 1000))).alias("populate_factor"), *more)


def plausible_population(place, population) -> Column:
    """Population as a number, 0 where it doesn't fit the kind of place; fixed limits."""
    n, p = F.coalesce(col(population).try_cast("bigint"), F.lit(0)), col(place)
    return F.when((p == "village") & (n > 90_000), 0).when((p == "town") & (n > 1_500_000), 0).when((p == "suburb") & (n > 1_000_000), 0).otherwise(n)


def all_tags(tables: list[DataFrame], key: str) -> DataFrame:
    """Natural full outer join of tag tables by id."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)
