"""Codes of single values, tag sets, tiles, turn hints, and searches that end early."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadloom.functions import turns
from roadloom.operators import search
from roadloom.plans import dsl
from roadloom.sources import codecs, tiles


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("nbzds"), st.integers(0, 10**6))), st.integers(0, 13))
def test_bits_round_trip(values, bits):
    out = codecs.BitWriter()
    for kind, v in values:
        {"n": out.number, "b": lambda v: out.bounded(10**6, v), "z": lambda v: out.noisy(v, bits), "d": lambda v: out.difference(v - 500_000, bits), "s": lambda v: out.sorted_numbers([v // 3, v // 3, v])}[kind](v)
    source = codecs.BitReader(out.close())
    for kind, v in values:
        got = {"n": source.number, "b": lambda: source.bounded(10**6), "z": lambda: source.noisy(bits), "d": lambda: source.difference(bits) + 500_000, "s": source.sorted_numbers}[kind]()
        assert got == ([v // 3, v // 3, v] if kind == "s" else v)


@given(st.integers(-(2**40), 2**40))
def test_varints_round_trip(v):
    assert codecs.read_signed(codecs.write_signed(v)) == (v, len(codecs.write_signed(v)))


def test_known_codes():
    # by hand: 4 is octave 2 (two zero bits, a one), rest 1 of 0 to 3 in two bits, the lowest first
    out = codecs.BitWriter()
    out.number(4)
    assert (out.close(), out.size) == (bytes([0b01100]), 5)
    assert codecs.write_signed(-1) == b"\x03" and codecs.write_varint(300) == b"\xac\x02"
    assert codecs.noisy_bits([]) == 0 and codecs.noisy_bits([8, 9, 0, 1]) == 4 and codecs.noisy_bits([0, 0, 0, 1]) == 0


def test_tag_set_code_is_shortest():
    rng = random.Random(3)
    counts = {f"k={i}": rng.randrange(1, 500) for i in range(40)}
    sets = codecs.TagSets(counts)
    words = rng.choices([*counts], k=300)
    out = codecs.BitWriter()
    for w in words:
        sets.write(out, w)
    source = codecs.BitReader(out.close())
    assert [sets.read(source) for _ in words] == words
    total = sum(counts.values())
    import math

    entropy = -sum(n * math.log2(n / total) for n in counts.values())
    assert entropy <= sets.bits(counts) <= entropy + total
    assert codecs.TagSets({"only": 3}).read(codecs.BitReader(b"")) == "only"


def test_tags_survive_their_code(spark):
    dictionary = [("highway", ["primary", "track"]), ("surface", ["paved"]), ("oneway", ["yes", "no", "-1"])]
    rows = [(1, {"highway": "track", "oneway": "-1"}), (2, {}), (3, {"surface": "gravel", "other": "x"}), (4, None), (5, {"highway": ""})]
    df = spark.createDataFrame(rows, "id int, tags map<string,string>")
    got = {r.id: r.decoded for r in codecs.decoded_tags(codecs.encoded_tags(df, dictionary), dictionary).collect()}
    assert got == {1: {"highway": "track", "oneway": "-1"}, 2: {}, 3: {"surface": "unknown"}, 4: {}, 5: {}}


def test_digests(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"some bytes")
    r = codecs.file_digests(spark, str(tmp_path / "a.bin")).first()
    assert (r.size, r.md5, r.crc) == (10, hashlib.md5(b"some bytes").hexdigest(), zlib.crc32(b"some bytes"))


def test_tiles(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, 183_000_000 + rng.randrange(9_000_000), 138_000_000 + rng.randrange(9_000_000), f"v{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "nid long, ilon long, ilat long, v string")
    folder = str(tmp_path / "t")
    tiles.write(df, folder, (11, 2))
    assert sorted((r.nid, r.v) for r in tiles.read(spark, folder, (11, 5)).collect()) == sorted((r[0], r[3]) for r in rows)
    box = (184_000_000, 139_000_000, 187_500_000, 141_000_000)
    assert {r.nid for r in tiles.read(spark, folder, (11, 2), box).collect()} == {i for i, x, y, _ in rows if box[0] <= x <= box[2] and box[1] <= y <= box[3]}
    assert tiles.check(spark, folder).count() == 0
    with pytest.raises(tiles.VersionError):
        tiles.read(spark, folder, (10, 2))
    spoilt = tiles.placed(df.withColumn("v", F.when(F.col("nid") == 7, "other").otherwise(F.col("v"))).where("nid != 9"))
    spoilt.write.mode("overwrite").partitionBy("tile").parquet(f"{folder}/tiles")
    at = {r.nid: r.tile for r in tiles.placed(df).collect()}
    assert {r.tile for r in tiles.check(spark, folder).collect()} == {at[7], at[9]}


def test_turn_hints(spark):
    way = lambda angle, prio=22, link=False, oneway=False, cost=1.0: (float(angle), prio, link, oneway, cost)
    rows = [
        (1, [way(-90)], 80.0, 22, 22, None),  # a real turn beside another way
        (2, [], 80.0, 22, 22, None),  # nowhere else to go
        (3, [way(-90, 28)], 2.0, 22, 22, None),  # a better road leads off
        (4, [way(80, 10)], 0.0, 22, 22, None),  # a lesser way leads off
        (5, [way(80, 22)], 0.0, 22, 22, None),  # an equal one: a hint only for a real turn
        (6, [way(30, 22)], -10.0, 22, 22, None),  # forks: keep left
    ]
    df = spark.createDataFrame(rows, "id int, bad array<struct<angle:double,priority:int,link:boolean,oneway:boolean,costfactor:double>>, angle double, priority int, old int, none string")
    got = {r.id: r.h for r in df.select("id", turns.hint(F.col("bad"), "angle", "priority", "old", F.lit(False), F.lit(False)).alias("h")).collect()}
    assert got[2] is None and got[4] is None
    assert got[1].command == turns.COMMANDS["TR"] and got[1].always and got[3].always
    assert not got[5].always and got[6].command == turns.COMMANDS["KL"]


def test_searches_end_early_and_crossings_cost(spark):
    place = lambda x, y: (180_000_000 + x, 90_000_000 + y)
    links = spark.createDataFrame([(0, 0, 1, *place(0, 0), *place(0, 1000), 1.0, 28.0, 0.0), (1, 1, 2, *place(0, 1000), *place(-1000, 1000), 1.0, 10.0, 3.0), (2, 1, 3, *place(0, 1000), *place(1000, 1000), 1.0, 10.0, 3.0)], "link long, src long, dst long, x1 long, y1 long, x2 long, y2 long, costfactor double, priority double, crossing double")
    asked = spark.createDataFrame([(1, 0, 2), (2, 0, 3)], "req long, src long, dst long")
    cost = lambda **k: {r.req: r.cost for r in search.traced(search.search(links, asked, **k)).where("node in (2, 3)").collect()}
    plain, dear = cost(), cost(crossings=search.Crossings(26, 12, {3: 500}, {3: 70}))
    assert {q: dear[q] - plain[q] for q in plain} == {1: 500, 2: 70}
    seen = []
    with pytest.raises(search.Cancelled):
        search.search(links, asked, watch=lambda number, labels: seen.append(labels) or number == 1)
    assert seen == [2]
    with pytest.raises(search.Cancelled):
        search.search(links, asked, seconds=0.0)


def test_profile_upload():
    assert dsl.checked_upload("---context:way\nassign costfactor = 1") is None
    assert "unknown variable" in dsl.checked_upload("---context:way\nassign costfactor = nothing")
    assert "too large" in dsl.checked_upload("# " + "x" * 200_000)
