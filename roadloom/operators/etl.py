"""From map objects to a routable graph: joins on ids, tiles and tags.

Schemas: nodes (nid, ilon, ilat, tags, selev), ways (wid, tags, nodes), relations (rid, tags, ways).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def tag_dictionary(lines: DataFrame, value: str = "value") -> DataFrame:
    """(context, tag, idx, name, aliases, cnt) of lookup lines ``tag;count name alias*``; index 2 is a tag's first value."""
    numbered = lines.withColumn("_at", F.monotonically_increasing_id())
    w = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)  # the dictionary is a few thousand lines at most
    marked = numbered.withColumn("context", F.last(F.nullif(F.regexp_extract(value, "^---context:(\\w+)", 1), F.lit("")), True).over(w))
    parts = F.split(F.trim(F.col(value)), "\\s+")
    head = F.split(parts[0], ";")
    rows = marked.where(F.col(value).rlike("^[^;#-][^;]*;[0-9]+ \\S")).select("context", "_at", head[0].alias("tag"), head[1].cast("long").alias("cnt"), parts[1].alias("name"), F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))).alias("aliases"))
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("context", "tag").orderBy("_at")) + 1).drop("_at")


def encoded_tags(tags: DataFrame, dictionary: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """``idx`` of each tag row: that of the value or of one of its aliases, 1 if the tag is known and the value isn't; unknown tags go."""
    names = dictionary.select("tag", "idx", F.explode(F.concat(F.array("name"), "aliases")).alias("name")).groupBy("tag", "name").agg(F.min("idx").alias("idx"))
    known = dictionary.select("tag").distinct()
    held = tags.join(known, F.col(key) == F.col("tag"), "left_semi")
    return held.join(names, (F.col(key) == F.col("tag")) & (F.col(value) == F.col("name")), "left").withColumn("idx", F.coalesce("idx", F.lit(1))).drop("tag", "name")


def used_nodes(nodes: DataFrame, ways: DataFrame, nid: str = "nid", refs: str = "nodes") -> DataFrame:
    """Nodes that some way uses."""
    return nodes.join(ways.select(F.explode(refs).alias(nid)), nid, "left_semi")


def way_tiles(ways: DataFrame, nodes: DataFrame, size: int = 5_000_000) -> DataFrame:
    """(wid, tile_x, tile_y): each tile that a way touches, once."""
    refs = ways.select("wid", F.explode("nodes").alias("nid"))
    x, y = geo.tile("ilon", "ilat", size)
    return refs.join(nodes, "nid").select("wid", x.alias("tile_x"), y.alias("tile_y")).distinct()


def border_nodes(ways: DataFrame, nodes: DataFrame, size: int = 5_000_000) -> DataFrame:
    """Nodes whose tile differs from that of a neighbour in a way."""
    refs = ways.select("wid", F.posexplode("nodes").alias("pos", "nid")).join(nodes, "nid")
    x, y = geo.tile("ilon", "ilat", size)
    w = Window.partitionBy("wid").orderBy("pos")
    t = refs.withColumn("tile", F.struct(x.alias("x"), y.alias("y")))
    t = t.withColumns({"before": F.lag("tile").over(w), "after": F.lead("tile").over(w)})
    return t.where((F.col("before").isNotNull() & (F.col("before") != F.col("tile"))) | (F.col("after").isNotNull() & (F.col("after") != F.col("tile")))).select("nid").distinct()


def with_pseudo_tags(objects: DataFrame, extra: DataFrame, key: str, tags: str = "tags", needs: str | None = None) -> DataFrame:
    """Tags of the right side added to those of the left by id; the right side wins; with ``needs``, only where that tag is present."""
    joined = objects.join(extra.withColumnRenamed(tags, "_more"), key, "left")
    more = F.coalesce("_more", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.col(tags), lambda k, v: ~F.array_contains(F.map_keys(more), k))
    merged = F.when(F.col(tags)[needs].isNotNull(), F.map_concat(kept, more)).otherwise(F.col(tags)) if needs else F.map_concat(kept, more)
    return joined.withColumn(tags, merged).drop("_more")


def with_routes(ways: DataFrame, relations: DataFrame, state: str = "state", route: str = "route", network: str = "network") -> DataFrame:
    """Membership of ways in route relations: a tag ``route_<route>_<network>`` of ``yes`` or, if all are proposed, ``proposed``."""
    member = relations.where(F.col(route).isNotNull()).select(F.explode("ways").alias("wid"), F.concat_ws("_", F.lit("route"), route, F.col(network)).alias("k"), F.when(F.col(state) == "proposed", 3).otherwise(2).alias("v"))
    best = member.groupBy("wid", "k").agg(F.min("v").alias("v"))
    tags = best.groupBy("wid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("v") == 2, "yes").otherwise("proposed").alias("v"))))).alias("tags"))
    return with_pseudo_tags(ways, tags, "wid")


#: Bits of modes that a restriction excepts; fixed values.
EXCEPTIONS = (("bicycle", 1), ("motorcar", 2), ("agricultural", 4), ("forestry", 4), ("psv", 8), ("hgv", 16))


def restrictions(relations: DataFrame) -> DataFrame:
    """One row for each restriction tag: key, value, and the mask of excepted modes."""
    rows = relations.select("rid", "tags", F.explode(F.map_entries("tags")).alias("e")).where((F.col("e.key") == "restriction") | F.col("e.key").startswith("restriction:"))
    named = F.coalesce(F.col("tags")["except"], F.lit(""))
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.contains(named, F.lit(mode)), bit).otherwise(0) for mode, bit in EXCEPTIONS])
    return rows.where(F.col("e.value").rlike("^(no|only)_") & (F.col("e.value") != "no_on_red")).select("rid", F.col("e.key").alias("key"), F.col("e.value").alias("value"), mask.alias("exceptions"))


def links(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Consecutive pairs of known nodes of each way; a missing node breaks the chain."""
    refs = ways.select("wid", F.posexplode("nodes").alias("pos", "nid")).join(nodes.select("nid", "ilon", "ilat"), "nid")
    w = Window.partitionBy("wid").orderBy("pos")
    nxt = refs.withColumns({c: F.lead(o).over(w) for c, o in (("_p", "pos"), ("dst", "nid"), ("ilon2", "ilon"), ("ilat2", "ilat"))})
    return nxt.where(F.col("_p") == F.col("pos") + 1).select("wid", "pos", F.col("nid").alias("src"), "dst", "ilon", "ilat", "ilon2", "ilat2")


def junctions(edges: DataFrame) -> DataFrame:
    """Nodes that stay in the graph: used by several ways, or not with exactly two links."""
    ends = edges.select("wid", F.explode(F.array("src", "dst")).alias("nid"))
    return ends.groupBy("nid").agg(F.countDistinct("wid").alias("n_ways"), F.count("*").alias("n_links")).where("n_ways > 1 or n_links != 2")


def graph(ways: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, links): nodes between junctions become the geometry of the link that passes them."""
    edges = links(ways, nodes)
    kept = junctions(edges).select(F.col("nid").alias("src"), F.lit(1).alias("is_kept"))
    w = Window.partitionBy("wid").orderBy("pos")
    cut = F.when(F.col("is_kept").isNotNull() | (F.coalesce(F.lag("dst").over(w), F.lit(-1)) != F.col("src")), 1).otherwise(0)
    marked = edges.join(kept, "src", "left").withColumn("_cut", cut).withColumn("part", F.sum("_cut").over(w))
    points = F.array_sort(F.collect_list(F.struct("pos", "src", "dst", "ilon", "ilat", "ilon2", "ilat2")))
    made = marked.groupBy("wid", "part").agg(points.alias("p"), F.sum(geo.distance("ilon", "ilat", "ilon2", "ilat2")).alias("metres"))
    out = made.select("wid", "part", F.col("p")[0]["src"].alias("src"), F.element_at("p", -1)["dst"].alias("dst"), "metres", F.slice(F.transform("p", lambda x: F.struct(x["ilon"].alias("ilon"), x["ilat"].alias("ilat"))), F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))).alias("geometry"))
    ends = out.select(F.explode(F.array("src", "dst")).alias("nid")).distinct()
    return nodes.join(ends, "nid", "left_semi"), out


def unique_positions(nodes: DataFrame, rounds: int = 20) -> DataFrame:
    """Positions made unique: of nodes at one place the one with the smallest id stays, the others move along a growing triangle."""
    free = nodes
    for step in range(1, rounds + 1):
        rank = F.row_number().over(Window.partitionBy("ilon", "ilat").orderBy("nid"))
        free = free.withColumn("_r", rank)
        moved = F.col("_r") > 1
        off = F.col("_r") - 1
        free = free.withColumns({"ilon": F.when(moved, F.col("ilon") + F.pmod(off, F.lit(step + 1))).otherwise(F.col("ilon")), "ilat": F.when(moved, F.col("ilat") + F.ceil(off / (step + 1))).otherwise(F.col("ilat"))}).drop("_r")
        if step % 4 == 0 and not free.groupBy("ilon", "ilat").count().where("count > 1").limit(1).count():
            return free
    return free


def with_elevation(nodes: DataFrame, raster: DataFrame, cell: int, fallback: DataFrame | None = None) -> DataFrame:
    """``ele`` by bilinear interpolation in a raster of (row, col, ele) with cells of so many units; null where a corner is missing."""
    grid = raster if fallback is None else raster.join(fallback.withColumnRenamed("ele", "_f"), ["row", "col"], "full").withColumn("ele", F.coalesce("ele", "_f")).drop("_f")
    at = nodes.withColumns({"_c": F.floor(F.col("ilon") / cell).cast("int"), "_r": F.floor(F.col("ilat") / cell).cast("int")})
    corners = at.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (0, 1) for dc in (0, 1)])))
    wx, wy = F.col("ilon") / cell - F.col("_c"), F.col("ilat") / cell - F.col("_r")
    weight = F.when(F.col("_k.dc") == 1, wx).otherwise(1 - wx) * F.when(F.col("_k.dr") == 1, wy).otherwise(1 - wy)
    joined = corners.withColumn("_w", weight).join(grid.select(F.col("row").alias("_row"), F.col("col").alias("_col"), "ele"), (F.col("_row") == F.col("_r") + F.col("_k.dr")) & (F.col("_col") == F.col("_c") + F.col("_k.dc")), "left")
    return joined.groupBy("nid").agg(F.when(F.count("ele") == 4, F.sum(F.col("_w") * F.col("ele"))).alias("ele"))


def restriction_pairs(relations: DataFrame) -> DataFrame:
    """(rid, from_wid, to_wid, via_nid) of all from and to members of a restriction with its via node; null members where a role is missing."""
    role = lambda kind, name: F.transform(F.filter("members", lambda m: (m["type"] == kind) & (m["role"] == name)), lambda m: m["ref"])
    return relations.select("rid", F.element_at(F.concat(role("node", "via"), F.array(F.lit(None).cast("long"))), 1).alias("via_nid"), F.explode_outer(role("way", "from")).alias("from_wid"), role("way", "to").alias("_to")).select("rid", "from_wid", F.explode_outer("_to").alias("to_wid"), "via_nid")


def restriction_legs(rules: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rules (rid, key, value, from_wid, to_wid, via_nid) at a known via node, with the position before it and behind it.

    A way is followed as it is mapped: towards the via node for ``from``, away from it for ``to``, the other way only where it
    ends there.  ``valid`` says that both legs are found, that the kind is known and that the key is plain; ``sound`` that the ways end at
    the via node too and that the turn's angle fits its name.
    """
    via = rules.join(nodes.select(F.col("nid").alias("via_nid"), F.col("ilon").alias("vx"), F.col("ilat").alias("vy")), "via_nid")
    refs = ways.select("wid", F.size("nodes").alias("n"), F.posexplode("nodes").alias("pos", "nid")).join(nodes.select("nid", "ilon", "ilat"), "nid")
    beside = refs.select("wid", F.col("pos").alias("p"), F.struct("ilon", "ilat").alias("at"))
    sides = refs.select("wid", F.col("nid").alias("via_nid"), "pos", "n").join(beside, "wid").where(F.abs(F.col("p") - F.col("pos")) == 1)
    ahead, order = F.col("p") < F.col("pos"), F.col("p")
    # the way before the via node and the way behind it, the last of each, and for want of them the first on the other side
    legs = sides.groupBy("wid", "via_nid").agg(
        F.coalesce(F.max_by("at", F.when(ahead, order)), F.min_by("at", F.when(~ahead, order))).alias("source"),
        F.coalesce(F.max_by("at", F.when(~ahead, order)), F.min_by("at", F.when(ahead, order))).alias("goal"),
        F.bool_or((F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1)).alias("through"),
    )
    from_, to = (legs.select(F.col("wid").alias(f"{n}_wid"), "via_nid", F.col(c).alias(n), F.col("through").alias(f"_{n}")) for n, c in (("from", "source"), ("to", "goal")))
    found = via.join(from_, ["from_wid", "via_nid"], "left").join(to, ["to_wid", "via_nid"], "left")
    known = F.col("value").rlike("^(no|only)_") & ~F.contains("value", F.lit("on_red"))
    angle, _ = geo.turn("from.ilon", "from.ilat", "vx", "vy", "to.ilon", "to.ilat")
    kind = F.trim(F.split(F.regexp_replace("value", "^(no|only)_", ""), "@")[0])
    # angles in degrees that fit a kind of turn; fixed values
    fits = F.when(kind == "left_turn", (angle < -5) & (angle > -175)).when(kind == "right_turn", (angle > 5) & (angle < 175)).when(kind == "straight_on", F.abs(angle) < 85).when(kind == "u_turn", F.abs(angle) > 95).otherwise(kind.isin("entry", "exit"))
    there = F.col("from").isNotNull() & F.col("to").isNotNull()
    return found.withColumns({"valid": there & known & (F.col("key") == "restriction"), "sound": F.coalesce(there & known & ~F.col("_from") & ~F.col("_to") & fits, F.lit(False))}).drop("_from", "_to")


def turn_forbidden(turns: DataFrame, rules: DataFrame, mode: str | None = None) -> DataFrame:
    """``forbidden`` of turns (via, from_id, to_id): an ``only`` rule for another way beats a ``no`` rule.

    With a ``mode`` rules that except it (column ``exceptions``) don't count.
    """
    if mode is not None:
        rules = rules.where(F.col("exceptions").bitwiseAND(F.lit(dict(EXCEPTIONS)[mode])) == 0)
    r = rules.select(F.col("via").alias("_v"), F.col("from_id").alias("_f"), F.col("to_id").alias("_t"), "positive")
    j = turns.join(r, (F.col("via") == F.col("_v")) & (F.col("from_id") == F.col("_f")), "left")
    same = F.col("to_id") == F.col("_t")
    flags = j.groupBy("via", "from_id", "to_id").agg(F.bool_or(F.col("positive") & same).alias("a"), F.bool_or(F.col("positive") & ~same).alias("b"), F.bool_or(~F.col("positive") & same).alias("c"))
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    return flags.select("via", "from_id", "to_id", (~t("a") & (t("b") | t("c"))).alias("forbidden"))
