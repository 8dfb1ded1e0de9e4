"""routes are looked for from both ends, and don't go on where no better path can be."""

import heapq
import random
import sys

import pytest
from pyspark.sql import functions as F

from roadloom.operators import graph, search

EDGES, ASKED = "src long, dst long, weight double", "req long, src long, dst long"


def plain(edges, source, target, times):
    """The path of least (cost, hops), of these the one whose nodes, from the target back, are smaller."""
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w * (1 + times.get((a, b), 0))))
    best, heap = {}, [(0.0, 0, (source,), (0.0,))]
    while heap:
        cost, hops, nodes, costs = heapq.heappop(heap)
        if nodes[0] in best:
            continue
        best[nodes[0]] = nodes, costs
        for b, w in out.get(nodes[0], []):
            heapq.heappush(heap, (cost + w, hops + 1, (b, *nodes), (cost + w, *costs)))
    return [(n, c) for n, c in zip(*(x[::-1] for x in best[target]), strict=True)] if target in best else []


def stores(monkeypatch):
    """The names of all tables that operators store from here on."""
    names = []
    for module in [m for n, m in sys.modules.items() if n.startswith("roadloom.operators.") and not n.endswith(".tables") and hasattr(m, "stored")]:
        monkeypatch.setattr(module, "stored", lambda df, name="table", old=module.stored: (names.append(name), old(df, name))[1])
    return names


@pytest.mark.parametrize("seed", [3, 4])
def test_routes_and_alternatives_against_dijkstra(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(40), rng.randrange(40)): float(rng.randrange(1, 5)) for _ in range(110)}.items())
    edges = [(a, b, w) for (a, b), w in edges if a != b]
    asked = [(1, 0, 39), (2, 5, 6), (3, 7, 7), (4, 8, 99), (5, 98, 3), (6, 20, 21)]
    got = {}
    for r in graph.routes(spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, ASKED), 2).orderBy("seq").collect():
        got.setdefault((r.alternative, r.req), []).append((r.node, r.cost))
    for q, a, b in asked:
        times = {}
        for number in range(3):
            want = plain(edges, a, b, times)
            assert got.get((number, q), []) == want
            for (x, _), (y, _) in zip(want, want[1:], strict=False):
                times[x, y] = times.get((x, y), 0) + 1


def test_a_search_stays_near_its_ends(spark, monkeypatch):
    # behind the target and before the source are long ways that no route needs
    edges = [(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0)] + [(i, i + 1, 1.0) for i in range(2, 40)] + [(i + 1, i, 1.0) for i in range(100, 140)] + [(100, 0, 1.0)]
    edges, asked = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(1, 0, 1)], ASKED)
    names = stores(monkeypatch)
    got = graph.routes(edges, asked).orderBy("seq").collect()
    assert [(r.node, r.cost) for r in got] == [(0, 0.0), (2, 1.0), (1, 3.0)]
    assert len(names) <= 10


LINKS = "link long, src long, dst long, x1 long, y1 long, x2 long, y2 long, costfactor double, turncost double, classifier double, initial double, node_cost double"


def test_links_from_both_ends_against_the_whole_search(spark):
    rng = random.Random(5)
    at = [(188_000_000 + rng.randrange(40_000), 139_000_000 + rng.randrange(40_000)) for _ in range(20)]
    rows = []
    for link in range(70):
        a, b = rng.sample(range(20), 2)
        rows.append((link, a, b, *at[a], *at[b], rng.choice([1.0, 1.25, 9999.0]), rng.choice([0.0, 60.0]), float(rng.randrange(3)), 40.0, rng.choice([0.0, 0.0, 15.0, 1e6])))
    banned = [(a[0], b[0]) for a in rows for b in rows if a[2] == b[1] and rng.random() < 0.15]
    links, turns = spark.createDataFrame(rows, LINKS), spark.createDataFrame(banned, "from_link long, to_link long")
    asked = [(20 * s + t, s, t) for s in (0, 1, 2) for t in (0, 3, 4, 5, 6, 99)]
    asked = spark.createDataFrame(asked, ASKED)
    times = spark.createDataFrame([(q, link, 2) for q in (3, 24, 45) for link in range(0, 70, 3)], "req long, link long, times long")
    for penalties in (times,):
        got = {}
        for r in search.between(links, asked, turns, penalties).orderBy("req", "seq").collect():
            got.setdefault(r.req, []).append(r)
        whole = search.search(links, asked, turns, penalties=penalties).where("node = target").groupBy("req").agg(F.min("cost").alias("cost"))
        assert {q: p[-1].cost for q, p in got.items()} == {r.req: r.cost for r in whole.collect()}
        for q, path in got.items():
            assert [r.seq for r in path] == list(range(1, len(path) + 1)) and path[-1].node == q % 20
            assert [rows[r.link][1] for r in path] == [q // 20, *(r.node for r in path[:-1])]
            assert not {(a.link, b.link) for a, b in zip(path, path[1:], strict=False)} & set(banned)


def test_legs_take_half_the_rounds(spark, monkeypatch):
    place = [(188_000_000 + 1000 * n, 139_000_000) for n in range(13)]
    links = spark.createDataFrame([(n, n, n + 1, *place[n], *place[n + 1], 1.0, 0.0, 0.0, 0.0, 0.0) for n in range(12)], LINKS)
    points = spark.createDataFrame([(1, 0, 0, False), (1, 1, 12, False)], "req long, seq int, node long, direct boolean")
    names = stores(monkeypatch)
    assert [(r.seq, r.link) for r in search.legs(links, points).orderBy("seq").collect()] == [(n + 1, n) for n in range(12)]
    assert len(names) <= 16
