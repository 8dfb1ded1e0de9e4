"""Planar geometry on fixed-point degrees, as column expressions.

Positions are integers: (longitude + 180) * 10^6 and (latitude + 90) * 10^6.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def fixed(degrees: Column, half: int) -> Column:
    """Fixed point of degrees; ``half`` is 180 for a longitude, 90 for a latitude."""
    return F.floor((degrees + half) * 1_000_000 + 0.5).cast("int")


def degrees_text(fixed_point: Column, half: int) -> Column:
    """Degrees with six decimals, by integer arithmetic."""
    d = col(fixed_point).cast("bigint") - half * 1_000_000
    a = F.abs(d)
    return F.concat(F.when(d < 0, "-").otherwise(""), F.floor(a / 1_000_000).cast("bigint").cast("string"), F.lit("."), F.lpad((a % 1_000_000).cast("string"), 6, "0"))


def node_id(ilon, ilat) -> Column:
    """The position as a key."""
    return F.shiftleft(col(ilon).cast("bigint"), 32).bitwiseOR(col(ilat).cast("bigint"))


def scales(ilat) -> tuple[Column, Column]:
    """Metres in 10^-6 degrees of longitude and latitude, at the middle of the 0.1 degree band."""
    return band_scales(F.floor(col(ilat) / 100_000))


def band_scales(band: Column) -> tuple[Column, Column]:
    lat = (band * 0.1 + 0.05 - 90.0) * (math.pi / 180)
    # fixed values: the usual Fourier terms of the ellipsoid, in metres
    kx = (111.41513 * F.cos(lat) - 0.09455 * F.cos(3 * lat) + 0.00012 * F.cos(5 * lat)) / 1000
    ky = (111.13209 - 0.56605 * F.cos(2 * lat) + 0.0012 * F.cos(4 * lat)) / 1000
    return kx, ky


def distance(lon1, lat1, lon2, lat2) -> Column:
    """Metres between two positions."""
    kx, ky = scales(F.floor((col(lat1) + col(lat2)) / 2))
    dx, dy = (col(lon1) - col(lon2)) * kx, (col(lat1) - col(lat2)) * ky
    return F.sqrt(dx * dx + dy * dy)


def distance_int(lon1, lat1, lon2, lat2) -> Column:
    """Whole metres, at least one."""
    return F.greatest(F.lit(1), F.floor(distance(lon1, lat1, lon2, lat2) + 0.5).cast("int"))


def destination(lon, lat, metres, bearing) -> tuple[Column, Column]:
    """The position so many metres off in a direction, in degrees clockwise from north."""
    kx, ky = scales(lat)
    angle = col(bearing) * (math.pi / 180)
    return col(lon) + F.floor(col(metres) * F.sin(angle) / kx + 0.5).cast("bigint"), col(lat) + F.floor(col(metres) * F.cos(angle) / ky + 0.5).cast("bigint")


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Degrees clockwise from north, from 0 to 360."""
    kx, ky = scales(F.floor((col(lat1) + col(lat2)) / 2))
    return F.pmod(F.atan2((col(lon2) - col(lon1)) * kx, (col(lat2) - col(lat1)) * ky) * (180 / math.pi) + 360.0, F.lit(360.0))


def bearing_difference(a, b) -> Column:
    """The smaller angle between two directions."""
    d = F.pmod(col(a) - col(b) + 360.0, F.lit(360.0))
    return F.least(d, 360.0 - d)


def turn(lon0, lat0, lon1, lat1, lon2, lat2) -> tuple[Column, Column]:
    """Signed turn at the second position, in degrees (right is positive), and its cosine."""
    kx, ky = scales(lat1)
    dx1, dy1 = (col(lon1) - col(lon0)) * kx, (col(lat1) - col(lat0)) * ky
    dx2, dy2 = (col(lon2) - col(lon1)) * kx, (col(lat2) - col(lat1)) * ky
    cross, dot = dy1 * dx2 - dx1 * dy2, dx1 * dx2 + dy1 * dy2
    size = F.sqrt((dx1 * dx1 + dy1 * dy1) * (dx2 * dx2 + dy2 * dy2))
    return F.when(size > 0, F.atan2(cross, dot) * (180 / math.pi)).otherwise(0.0), F.when(size > 0, dot / size).otherwise(1.0)


def foot(px, py, ax, ay, bx, by, scale: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """Share of the way from a to b at the foot of p, clamped to the segment, and the distance to it in metres.

    ``scale`` are the scales at p, where they are known.
    """
    kx, ky = scale or scales(py)
    dx, dy = (col(bx) - col(ax)) * kx, (col(by) - col(ay)) * ky
    vx, vy = (col(px) - col(ax)) * kx, (col(py) - col(ay)) * ky
    square = dx * dx + dy * dy
    share = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (vx * dx + vy * dy) / square))).otherwise(0.0)
    ex, ey = vx - share * dx, vy - share * dy
    return share, F.sqrt(ex * ex + ey * ey)


def edges_of(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring of structs x, y."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(ring[i].alias("a"), ring[F.pmod(i + 1, n)].alias("b")))


def within(x, y, ring: Column) -> Column:
    """Whether a position lies in a ring, its boundary included: winding number by exact integer products."""
    x, y = col(x).cast("bigint"), col(y).cast("bigint")

    def side(e):
        a, b = e["a"], e["b"]
        return (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])

    def between(e):
        a, b = e["a"], e["b"]
        return (x >= F.least(a["x"], b["x"])) & (x <= F.greatest(a["x"], b["x"])) & (y >= F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"]))

    edges = edges_of(ring)
    on = F.exists(edges, lambda e: (side(e) == 0) & between(e))
    wind = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when((e["a"]["y"] <= y) & (e["b"]["y"] > y) & (side(e) > 0), 1).when((e["a"]["y"] > y) & (e["b"]["y"] <= y) & (side(e) < 0), -1).otherwise(0))
    return on | (wind != 0)


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two segments of integer positions have a point in common."""
    ax, ay, bx, by, cx, cy, dx, dy = (col(c).cast("bigint") for c in (ax, ay, bx, by, cx, cy, dx, dy))

    def side(px, py, qx, qy, rx, ry):
        return F.signum((col(qx) - col(px)) * (col(ry) - col(py)) - (col(rx) - col(px)) * (col(qy) - col(py)))

    def inside(px, py, qx, qy, rx, ry):
        return (col(rx) >= F.least(col(px), col(qx))) & (col(rx) <= F.greatest(col(px), col(qx))) & (col(ry) >= F.least(col(py), col(qy))) & (col(ry) <= F.greatest(col(py), col(qy)))

    s1, s2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    s3, s4 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    return ((s1 * s2 < 0) & (s3 * s4 < 0)) | ((s1 == 0) & inside(ax, ay, bx, by, cx, cy)) | ((s2 == 0) & inside(ax, ay, bx, by, dx, dy)) | ((s3 == 0) & inside(cx, cy, dx, dy, ax, ay)) | ((s4 == 0) & inside(cx, cy, dx, dy, bx, by))


def meetings(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """How two segments meet: 0 not at all, 1 in one point, 2 along a stretch.  Exact on integers."""
    ax, ay, bx, by, cx, cy, dx, dy = (col(c).cast("bigint") for c in (ax, ay, bx, by, cx, cy, dx, dy))
    parallel = (bx - ax) * (dy - cy) == (by - ay) * (dx - cx)
    # along a common line the shared box is the shared stretch
    wide = F.least(F.greatest(ax, bx), F.greatest(cx, dx)) - F.greatest(F.least(ax, bx), F.least(cx, dx))
    high = F.least(F.greatest(ay, by), F.greatest(cy, dy)) - F.greatest(F.least(ay, by), F.least(cy, dy))
    meet = segments_meet(ax, ay, bx, by, cx, cy, dx, dy)
    return F.when(~meet, 0).when(parallel & ((wide > 0) | (high > 0)), 2).otherwise(1)


def on_segment(x, y, ax, ay, bx, by) -> Column:
    """Whether a position lies on a segment, its ends included; exact on integers."""
    x, y, ax, ay, bx, by = (col(c).cast("bigint") for c in (x, y, ax, ay, bx, by))
    box = (x >= F.least(ax, bx)) & (x <= F.greatest(ax, bx)) & (y >= F.least(ay, by)) & (y <= F.greatest(ay, by))
    return box & ((bx - ax) * (y - ay) == (by - ay) * (x - ax))


def sides_of(points: Column, closed: bool) -> Column:
    """Consecutive vertex pairs of a ring or of a line of structs x, y."""
    if closed:
        return edges_of(points)
    return F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.struct(points[i - 1].alias("a"), points[i].alias("b")))


def on_polyline(x, y, points: Column) -> Column:
    return F.exists(sides_of(points, False), lambda e: on_segment(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


def crosses(ax, ay, bx, by, points: Column, closed: bool) -> Column:
    """Whether a segment meets a side of a ring or a line."""
    return F.exists(sides_of(points, closed), lambda e: segments_meet(ax, ay, bx, by, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


def length_in_ring(ax, ay, bx, by, ring: Column) -> Column:
    """Metres of a segment that lie in a ring, the boundary included.

    The segment is cut where it meets a side; of each piece the middle tells whether it lies inside.
    """
    ax, ay, bx, by = (col(c).cast("double") for c in (ax, ay, bx, by))
    ux, uy = bx - ax, by - ay
    square = ux * ux + uy * uy

    def cuts(e):
        vx, vy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        wx, wy = e["a"]["x"] - ax, e["a"]["y"] - ay
        cross = ux * vy - uy * vx
        along = lambda p: ((p["x"] - ax) * ux + (p["y"] - ay) * uy) / F.nullif(square, F.lit(0.0))
        return F.when(cross != 0, F.array((wx * vy - wy * vx) / cross)).otherwise(F.array(along(e["a"]), along(e["b"])))

    at = F.flatten(F.transform(edges_of(ring), cuts))
    at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(at, lambda t: (t > 0) & (t < 1)))))
    inside = lambda t: _within_exact(ax + t * ux, ay + t * uy, ring)
    share = F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), F.lit(0.0), lambda s, i: s + F.when(inside((at[i - 1] + at[i]) / 2), at[i] - at[i - 1]).otherwise(0.0))
    return share * distance(ax, ay, bx, by)


def _within_exact(x, y, ring: Column) -> Column:
    """``within`` for positions that are no integers: even-odd by the sides to the right, and the sides themselves."""
    near = 1e-6

    def side(e):
        a, b = e["a"], e["b"]
        return (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])

    box = lambda e: (x >= F.least(e["a"]["x"], e["b"]["x"]) - near) & (x <= F.greatest(e["a"]["x"], e["b"]["x"]) + near) & (y >= F.least(e["a"]["y"], e["b"]["y"]) - near) & (y <= F.greatest(e["a"]["y"], e["b"]["y"]) + near)
    edges = edges_of(ring)
    on = F.exists(edges, lambda e: (F.abs(side(e)) <= near * (F.abs(e["b"]["x"] - e["a"]["x"]) + F.abs(e["b"]["y"] - e["a"]["y"]))) & box(e))
    wind = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when((e["a"]["y"] <= y) & (e["b"]["y"] > y) & (side(e) > 0), 1).when((e["a"]["y"] > y) & (e["b"]["y"] <= y) & (side(e) < 0), -1).otherwise(0))
    return on | (wind != 0)


def elevation_between(first, second, share) -> Column:
    """Elevation (quarter metres) at a share of the way; null where an end has none."""
    return (col(first) * (1.0 - col(share)) + col(second) * col(share)).cast("smallint")


def braking_speed(limit, power: float = 6584.3621399176955, roll: float = 232.0, air: float = 0.4, recovery: float = 0.7) -> Column:
    """The speed from which a vehicle at constant power coasts towards a limit (m/s), by five steps of Newton's method.

    The power is that of the default car at its balance speed, with the stand-by power.
    """
    v0 = col(limit).cast("double")
    goal = F.lit(power) / v0 + air * recovery * v0 * v0 + (1 - recovery) * roll
    return F.aggregate(F.sequence(F.lit(1), F.lit(5)), v0 * 0.8, lambda v, _: v - (power / v + air * recovery * v * v - goal) / (2 * recovery * air * v - power / (v * v)))


def length_in_circle(ax, ay, bx, by, cx, cy, radius, scale: tuple[Column, Column] | None = None) -> Column:
    """Metres of a segment that lie in a circle; ``scale`` are the scales at its centre, where they are known."""
    kx, ky = scale or scales(cy)
    dx, dy = (col(bx) - col(ax)) * kx, (col(by) - col(ay)) * ky
    vx, vy = (col(ax) - col(cx)) * kx, (col(ay) - col(cy)) * ky
    a, b, c = dx * dx + dy * dy, vx * dx + vy * dy, vx * vx + vy * vy - col(radius) * col(radius)
    root = b * b - a * c
    low = F.greatest(F.lit(0.0), (-b - F.sqrt(F.greatest(root, F.lit(0.0)))) / F.nullif(a, F.lit(0.0)))
    high = F.least(F.lit(1.0), (-b + F.sqrt(F.greatest(root, F.lit(0.0)))) / F.nullif(a, F.lit(0.0)))
    return F.coalesce(F.when((root > 0) & (high > low), (high - low) * F.sqrt(a)), F.lit(0.0))


def zorder(x, y, bits: int = 15) -> Column:
    """Bits of x and y interleaved, x lowest."""
    out = F.lit(0).cast("bigint")
    for i in range(bits):
        out = out + F.shiftleft(F.shiftright(col(x).cast("bigint"), i).bitwiseAND(F.lit(1)), 2 * i) + F.shiftleft(F.shiftright(col(y).cast("bigint"), i).bitwiseAND(F.lit(1)), 2 * i + 1)
    return out


def tile(ilon, ilat, size: int = 5_000_000) -> tuple[Column, Column]:
    """Column and row of the tile that holds a position."""
    return F.floor(col(ilon) / size).cast("int"), F.floor(col(ilat) / size).cast("int")


def tile_name(ilon, ilat, size: int = 5) -> Column:
    """Names such as E5_N45, by the south-west corner."""
    lon, lat = (F.floor(col(ilon) / (size * 1_000_000)) * size - 180).cast("int"), (F.floor(col(ilat) / (size * 1_000_000)) * size - 90).cast("int")
    return F.concat(F.when(lon < 0, F.concat(F.lit("W"), (-lon).cast("string"))).otherwise(F.concat(F.lit("E"), lon.cast("string"))), F.lit("_"), F.when(lat < 0, F.concat(F.lit("S"), (-lat).cast("string"))).otherwise(F.concat(F.lit("N"), lat.cast("string"))))


def bilinear(v00, v01, v10, v11, wx, wy) -> Column:
    """Weighted mean of four raster values; null where one is missing."""
    wx, wy = col(wx), col(wy)
    return (1 - wy) * ((1 - wx) * col(v00) + wx * col(v01)) + wy * ((1 - wx) * col(v10) + wx * col(v11))
