"""Operators against plain Python on small inputs."""

import heapq
import io
import math
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import geo, tags
from roadloom.operators import diff, enrich, etl, graph, requests, track
from roadloom.plans import dsl
from roadloom.sources import files
from roadloom.streaming import sessions

SCRIPT = """
---context:global  # settings
assign validForBikes = true
assign w = 0.75
---context:way
assign a = or highway=primary|secondary not surface=
assign b = if greater v:maxspeed 50 then multiply w 3 else sub 1 v:lanes
assign c = switch and a xor surface=R surface=N ( max b 2.5 ) ( min b -0.25 )
assign c = add c divide b 4
assign d = equal v:width v:lanes
assign f = lesser v:maxspeed v:width
---context:node
assign initialcost = if way:a then 10 else 0
"""


def test_compiled_profile_equals_interpreter(spark):
    rng = random.Random(17464)
    rows = []
    for i in range(2000):
        t = {}
        for k, values in {"highway": ["primary", "secondary", "track"], "surface": ["R", "N", ""], "maxspeed": ["30", "70", "fast"], "lanes": ["1", "2", "2.5"], "width": ["2", "40", "?"]}.items():
            if rng.random() < 0.75:
                t[k] = rng.choice(values)
        rows.append((i, t))
    script, profile = dsl.parse(SCRIPT), dsl.compile_profile(SCRIPT)
    assert profile.settings["validForBikes"] == 1 and profile.used_tags("way") == ["highway", "lanes", "maxspeed", "surface", "width"]
    names = ["a", "b", "c", "d", "f", "missing"]
    got = {r.id: r for r in profile.apply(spark.createDataFrame(rows, "id int, tags map<string,string>"), names).collect()}
    for i, t in rows:
        v = {}
        for context in ("global", "way"):
            for name, node in script.contexts[context]:
                v[(context, name)] = dsl.evaluate(node, v, t)
        for n in names[:-1]:
            want = v[("way", n)]
            assert (got[i][n] is None) == (want is None) and (want is None or math.isclose(got[i][n], want, rel_tol=1e-4, abs_tol=1e-4)), (n, t)
        assert got[i]["missing"] == 0


@pytest.mark.parametrize("text", ["assign a = foo", "assign a = ( add 1 2", "assign a = if true 1 else 2", "assign a add 1", "---context:x", "1", "---context:global assign a = 1 ---context:way assign a = 2"])
def test_bad_scripts_are_told(text):
    with pytest.raises(dsl.ScriptError):
        dsl.compile_profile(text)


def test_division_by_zero_is_an_error():
    with pytest.raises(ZeroDivisionError):
        dsl.compile_profile("assign a = divide 1 0")


def test_folding():
    p = dsl.compile_profile("assign g = 1 ---context:way assign a = switch g highway=x surface=y assign b = and 0 highway=x assign c = or 5 highway=x")
    assert p.used_tags("way") == ["highway"] and p.chains["way"][1][1] == ("number", 0.0) and p.chains["way"][2][1] == ("number", 1.0)


def test_turn_angles(spark):
    rows = [(a, b) for a in range(0, 360, 45) for b in range(-170, 180, 35)]
    x, y = 188_000_000, 139_000_000
    kx, ky = (spark.range(1).select(*geo.scales(F.lit(y))).first())
    points = []
    for a, b in rows:
        p = [math.sin(math.radians(a)), math.cos(math.radians(a))]
        q = [math.sin(math.radians(a + b)), math.cos(math.radians(a + b))]
        points.append((b, int(x - 200 * p[0] / kx), int(y - 200 * p[1] / ky), int(x + 200 * q[0] / kx), int(y + 200 * q[1] / ky)))
    df = spark.createDataFrame(points, "want int, x0 long, y0 long, x2 long, y2 long")
    angle, cosine = geo.turn("x0", "y0", F.lit(x), F.lit(y), "x2", "y2")
    for r in df.select("want", angle.alias("a"), cosine.alias("c")).collect():
        assert abs(r.a - r.want) < 0.5 and abs(r.c - math.cos(math.radians(r.want))) < 0.01


def test_points_in_rings(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)]
    df = spark.createDataFrame([(x, y) for x in range(-2, 13) for y in range(-2, 13)], "x int, y int")
    shape = F.array(*[F.struct(F.lit(a).cast("bigint").alias("x"), F.lit(b).cast("bigint").alias("y")) for a, b in ring])

    def inside(x, y):
        return 0 <= x <= 10 and 0 <= y <= 10 and y <= max(10 - x, x)

    for r in df.select("x", "y", geo.within("x", "y", shape).alias("w")).collect():
        assert r.w == inside(r.x, r.y), (r.x, r.y)


def test_segments_and_circles(spark):
    one = spark.range(1)
    meet = lambda *p: one.select(geo.segments_meet(*[F.lit(v) for v in p])).first()[0]
    assert meet(0, 0, 10, 10, 0, 10, 10, 0) and meet(0, 0, 10, 0, 5, 0, 20, 0) and meet(0, 0, 5, 5, 5, 5, 9, 1)
    assert not meet(0, 0, 10, 0, 0, 1, 10, 1) and not meet(0, 0, 4, 0, 5, 0, 9, 0)
    x, y = 188_000_000, 139_000_000
    whole = one.select(geo.length_in_circle(F.lit(x - 5000), F.lit(y), F.lit(x + 5000), F.lit(y), F.lit(x), F.lit(y), F.lit(30.0))).first()[0]
    assert abs(whole - 60) < 1e-6
    assert one.select(geo.length_in_circle(F.lit(x), F.lit(y + 5000), F.lit(x + 9), F.lit(y + 5000), F.lit(x), F.lit(y), F.lit(30.0))).first()[0] == 0


def test_units(spark):
    want = {"30 mph": 48.28032, "1'6\"": 0.4572, "5000 lbs": 2.26796, "3 ft": 0.9144, "2,5 m": 2.5, "7": 7.0, "none": None, "400 kg": 0.4, "5 knots": 9.26}
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in want], "t string").select("t", tags.to_base_unit("t").alias("v")).collect()}
    assert all(got[t] == w or abs(got[t] - w) < 1e-5 for t, w in want.items())


def test_filtered_ascent(spark):
    df = spark.createDataFrame([([0, 12, -8, 32, 36, 4, 48],), ([],), ([5],)], "e array<int>")
    assert [r[0] for r in df.select(track.filtered_ascent(F.col("e"), -5.0)).collect()] == [15.0, 0.0, 0.0]


def test_trimmed_median(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 10.0, 2.0), (1, 1000.0, 1.0)], "k int, v double, w double")
    assert track.trimmed_median(df, ["k"], "v", "w", 0.5).first().median == 10.0


def dijkstra(edges, start):
    best, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        c, n = heapq.heappop(queue)
        if c > best[n]:
            continue
        for a, b, w in edges:
            if a == n and c + w < best.get(b, math.inf):
                best[b] = c + w
                heapq.heappush(queue, (c + w, b))
    return best


def test_least_costs_equal_dijkstra(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(25), rng.randrange(25), float(rng.randrange(1, 9))) for _ in range(60)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    sources = spark.createDataFrame([(s, s) for s in (0, 7)], "req long, node long")
    labels = graph.least_costs(df, sources)
    for s in (0, 7):
        assert {r.node: r.cost for r in labels.where(f"req = {s}").collect()} == dijkstra(edges, s)
    paths = graph.backtracked(labels, labels.select("req", "node")).collect()
    known = {(a, b): min(w for x, y, w in edges if (x, y) == (a, b)) for a, b, _ in edges}
    for r in labels.collect():
        line = sorted((p.seq, p.node, p.cost) for p in paths if (p.req, p.target) == (r.req, r.node))
        assert line[0][1] == r.req and line[-1][1] == r.node and [x[0] for x in line] == list(range(len(line)))
        assert all(known[a[1], b[1]] == b[2] - a[2] for a, b in zip(line, line[1:], strict=False))
    found = graph.routes(df, spark.createDataFrame([(0, 0, max(dijkstra(edges, 0)))], "req long, src long, dst long"), 1)
    assert {r.alternative for r in found.collect()} == {0, 1}


def test_path_queries_take_every_request_and_target(spark):
    from roadloom.plans import q_graph

    sf = "/root/testdata/sf0.001"
    edges = [(r.src, r.dst, r.weight) for r in q_graph.net(spark, sf).collect()]
    asked = {r.req: (r.src, r.dst) for r in q_graph.trips(spark, sf).collect()}
    want = {q: dijkstra(edges, s) for q, (s, _) in asked.items()}
    rows = q_graph.path_backtrack(spark, sf).collect()
    assert {(r.req, r.target): r.cost for r in rows} == {(q, t): c for q, found in want.items() for t, c in found.items()} and all(r.sound for r in rows)
    rows = q_graph.alt_penalty(spark, sf).collect()
    for number in (0, 1, 2):
        ends = {r.req: r.cost for r in rows if r.alternative == number and r.node == asked[r.req][1]}
        assert ends.keys() == {q for q, (_, t) in asked.items() if t in want[q]}
        assert all(ends[q] >= want[q][asked[q][1]] for q in ends) and (number or all(ends[q] == want[q][asked[q][1]] for q in ends))


def test_graph_build(spark):
    nodes = spark.createDataFrame([(i, 188_000_000 + i * 1000, 139_000_000) for i in range(1, 9)], "nid long, ilon int, ilat int")
    ways = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [3, 5, 6]), (3, [7, 99, 8])], "wid long, nodes array<long>")
    vertices, links = etl.graph(ways, nodes)
    assert sorted((r.wid, r.src, r.dst, len(r.geometry)) for r in links.collect()) == [(1, 1, 3, 1), (1, 3, 4, 0), (2, 3, 6, 1)]
    assert sorted(r.nid for r in vertices.collect()) == [1, 3, 4, 6]


def test_unique_positions(spark):
    nodes = spark.createDataFrame([(i, 5, 5) for i in range(30)] + [(40, 6, 5)], "nid long, ilon int, ilat int")
    found = etl.unique_positions(nodes).collect()
    assert len({(r.ilon, r.ilat) for r in found}) == 31 and next(r for r in found if r.nid == 0).ilon == 5


def test_elevation(spark):
    raster = spark.createDataFrame([(r, c, r * 10 + c) for r in range(3) for c in range(3) if (r, c) != (2, 2)], "row int, col int, ele int")
    nodes = spark.createDataFrame([(1, 50, 150), (2, 150, 150), (3, 900, 0)], "nid long, ilon int, ilat int")
    got = {r.nid: r.ele for r in etl.with_elevation(nodes, raster, 100).collect()}
    assert got == {1: 15.5, 2: None, 3: None}


def test_tag_dictionary(spark):
    lines = ["---lookupversion:10", "---context:way", "highway;100 primary", "highway;50 track farm path", "surface;1 paved", "---context:node", "barrier;3 gate"]
    d = etl.tag_dictionary(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))
    assert sorted((r.context, r.tag, r.idx, r.name, r.cnt) for r in d.collect()) == [("node", "barrier", 2, "gate", 3), ("way", "highway", 2, "primary", 100), ("way", "highway", 3, "track", 50), ("way", "surface", 2, "paved", 1)]
    t = spark.createDataFrame([("highway", "farm"), ("highway", "x"), ("name", "y"), ("surface", "paved")], "k string, v string")
    assert sorted((r.k, r.idx) for r in etl.encoded_tags(t, d).collect()) == [("highway", 1), ("highway", 3), ("surface", 2)]


def test_delta_round_trip(spark):
    a = spark.createDataFrame([(i, i * 2) for i in range(20)], "k int, v int")
    b = spark.createDataFrame([(i, i * 2 if i % 3 else None) for i in range(5, 25)], "k int, v int")
    c = b.where("k % 2 = 0").withColumn("v", F.col("k"))
    same = lambda x, y: sorted(map(tuple, x.collect()), key=repr) == sorted(map(tuple, y.collect()), key=repr)
    d1, d2 = diff.diff(a, b, ["k"]), diff.diff(b, c, ["k"])
    assert same(diff.applied(a, d1, ["k"]), b) and same(diff.applied(a, diff.merged(d1, d2, ["k"]), ["k"]), c)


def test_requests(spark):
    df = spark.createDataFrame([(1, "8.5,49.25|8.6,49.3,home;8.7,49.4,d", "8.5,49.25,100|8.6,49.3")], "req_id long, lonlats string, nogos string")
    got = [(r.seq, r.ilon, r.ilat, r.name, r.wpttype) for r in requests.waypoints(df).orderBy("seq").collect()]
    assert got == [(0, 188500000, 139250000, "via0", 1), (1, 188600000, 139300000, "home", 0), (2, 188700000, 139400000, "via2", 3)]


def test_noise_and_classes(spark):
    df = spark.createDataFrame([("motorway", "none", "no"), ("primary", "50", "yes"), ("track", None, None)], "h string, m string, o string")
    assert [r[0] for r in df.select(enrich.noise_factor("h", "m", "o")).collect()] == [0.6, 0.3, 0.0]


def _varint(n):
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _field(number, value):
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def _zig(*values):
    return b"".join(_varint(v << 1 if v >= 0 else (-v << 1) - 1) for v in values)


def test_map_extract(spark, tmp_path):
    strings = [b"", b"highway", b"crossing", b"primary", b"from", b"type", b"restriction"]
    dense = _field(1, _zig(10, 1, -5)) + _field(8, _zig(495_000_000, 1000, 1000)) + _field(9, _zig(85_000_000, 0, -2000)) + _field(10, b"".join(map(_varint, [1, 2, 0, 0, 0])))
    way = _field(1, 7) + _field(2, _varint(1)) + _field(3, _varint(3)) + _field(8, _zig(10, 1, -5))
    relation = _field(1, 9) + _field(2, _varint(5)) + _field(3, _varint(6)) + _field(8, _varint(4)) + _field(9, _zig(7)) + _field(10, _varint(1))
    raw = _field(1, b"".join(_field(1, s) for s in strings)) + _field(2, _field(2, dense)) + _field(2, _field(3, way) + _field(4, relation))
    data = b""
    for kind, body in ((b"OSMHeader", _field(1, b"")), (b"OSMData", _field(2, len(raw)) + _field(3, zlib.compress(raw))), (b"OSMData", _field(1, raw))):
        head = _field(1, kind) + _field(3, len(body))
        data += len(head).to_bytes(4, "big") + head + body
    path = tmp_path / "x.pbf"
    path.write_bytes(data)
    nodes, ways, relations = files.read_osm(spark, str(path))
    got = sorted((r.nid, r.ilon, r.ilat, r.tags.get("highway")) for r in nodes.collect())
    assert got == [(6, 188499800, 139500200, None)] * 2 + [(10, 188500000, 139500000, "crossing")] * 2 + [(11, 188500000, 139500100, None)] * 2
    assert [(r.wid, r.nodes) for r in ways.collect()] == [(7, [10, 11, 6])] * 2
    assert [tuple(r.members[0]) for r in relations.collect()] == [("way", "from", 7)] * 2


def test_rasters_and_lists(spark, tmp_path):
    grid = np.arange(9, dtype=">i2").reshape(3, 3)
    grid[0, 0] = -32768
    with zipfile.ZipFile(tmp_path / "a.hgt.zip", "w") as z:
        z.writestr("a.hgt", grid.tobytes())
    got = {(r.row, r.col): r.ele for r in files.read_hgt(spark, str(tmp_path / "a.hgt.zip")).collect()}
    assert got[2, 0] is None and got[2, 1] == 1 and got[0, 2] == 8
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n1 2\n-9999 4\n")
    assert {(r.row, r.col): r.ele for r in files.read_ascii_grid(spark, str(tmp_path / "g.asc")).collect()} == {(1, 0): 1, (1, 1): 2, (0, 0): None, (0, 1): 4}
    (tmp_path / "p.csv").write_text("#####nodetags#####\nlosmid;a;b\n5;1;\n#####waytags#####\nlosmid;c\n6;x\n")
    assert sorted((r.section, r.id, dict(r.tags)) for r in files.read_pseudo_tags(spark, str(tmp_path / "p.csv")).collect()) == [("nodetags", 5, {"a": "1"}), ("waytags", 6, {"c": "x"})]
    (tmp_path / "r.poly").write_text("name\n1\n   0.0 0.0\n   1.0E0 0.0\n   1.0 1.0\nEND\n!2\n   0.1 0.1\n   0.2 0.1\n   0.2 0.2\nEND\nEND\n")
    assert [(r.negative, len(r.ring)) for r in files.read_poly(spark, str(tmp_path / "r.poly")).orderBy("ring_no").collect()] == [(False, 3), (True, 3)]
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lon="8.5" lat="49.5"><ele>1.5</ele></trkpt>\n<trkpt lat="49.6" lon="8.6"/></trkseg></trk></gpx>')
    assert [(r.lon, r.lat, r.ele) for r in files.read_gpx(spark, str(tmp_path / "t.gpx")).orderBy("seq").collect()] == [(8.5, 49.5, 1.5), (8.6, 49.6, None)]
    (tmp_path / "s.txt").write_text("12 5\n13 6 3\n")
    assert sorted(map(tuple, files.read_suspects(spark, str(tmp_path / "s.txt")).collect())) == [(12, 5, 0), (13, 6, 3)]
    assert io


def test_published_deltas(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "a", "insert"), (2, 2, "x", "delete"), (2, 3, "b", "insert")], "k int, n int, v string, change string").coalesce(1).write.parquet(src)
    stream = sessions.tail(spark, src, spark.read.parquet(src).schema)
    sessions.published(stream, ["k"], str(tmp_path / "state"), str(tmp_path / "ckpt"), "n").awaitTermination()
    spark.createDataFrame([(3, 5, "c", "insert"), (1, 4, "", "delete"), (3, 1, "old", "insert")], "k int, n int, v string, change string").coalesce(1).write.mode("append").parquet(src)
    stream = sessions.tail(spark, src, spark.read.parquet(src).schema)
    sessions.published(stream, ["k"], str(tmp_path / "state"), str(tmp_path / "ckpt"), "n").awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "state/version=1")).collect()) == [(2, "b"), (3, "c")]
