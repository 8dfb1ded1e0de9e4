"""Joins, aggregates, set operations and sorts in the shapes that map building and enrichment use."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import diff, enrich, etl, suspects
from ..operators.track import trimmed_median
from ..streaming import sessions as S
from .registry import query
from .views import duck, view


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT p_partkey AS nid, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def semi_used_parts(spark, sf):
    """Nodes that kept ways use (JOIN01, JOIN22)."""
    ways = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("nodes"))
    return etl.used_nodes(table(spark, sf, "part").select(F.col("p_partkey").alias("nid"), "p_size"), ways)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_not_in(spark, sf):
    """JOIN21."""
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def _refs(spark, sf):
    """Ways with their node lists, and the nodes."""
    refs = view(spark, sf, "refs")
    ways = refs.groupBy("wid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nid"))), lambda x: x["nid"]).alias("nodes"))
    return ways, view(spark, sf, "nodes")


@query(f"SELECT DISTINCT wid, CAST(ilon // 5000000 AS INT) AS tile_x, CAST(ilat // 5000000 AS INT) AS tile_y FROM {duck('refs')} JOIN {duck('nodes')} USING (nid)")
def tile_replicate(spark, sf):
    """Each tile that a way touches (JOIN02, SET05)."""
    return etl.way_tiles(*_refs(spark, sf))


@query(f"WITH r AS (SELECT wid, pos, nid, ilon // 5000000 * 100 + ilat // 5000000 AS t FROM {duck('refs')} JOIN {duck('nodes')} USING (nid)), w AS (SELECT *, lag(t) OVER (PARTITION BY wid ORDER BY pos) AS a, lead(t) OVER (PARTITION BY wid ORDER BY pos) AS b FROM r) SELECT DISTINCT nid FROM w WHERE a <> t OR b <> t")
def border_nodes(spark, sf):
    """WIN08."""
    return etl.border_nodes(*_refs(spark, sf))


LINKS = f"(SELECT * FROM (SELECT wid, rn, nid AS src, lead(nid) OVER (PARTITION BY wid ORDER BY rn) AS dst FROM (SELECT wid, nid, row_number() OVER (PARTITION BY wid ORDER BY pos) AS rn FROM {duck('refs')} r)) WHERE dst IS NOT NULL)"


@query(f"SELECT wid, CAST(rn - 1 AS INT) AS pos, src, dst FROM {LINKS}")
def way_links(spark, sf):
    """Consecutive pairs of nodes (JOIN06)."""
    return etl.links(*_refs(spark, sf)).select("wid", "pos", "src", "dst")


@query(f"SELECT nid, count(DISTINCT wid) AS n_ways, count(*) AS n_links FROM (SELECT wid, src AS nid FROM {LINKS} UNION ALL SELECT wid, dst FROM {LINKS}) GROUP BY nid HAVING count(DISTINCT wid) > 1 OR count(*) <> 2")
def graph_junctions(spark, sf):
    """GRF01: the nodes that stay."""
    return etl.junctions(etl.links(*_refs(spark, sf)))


@query(f"SELECT wid, route || '_' || network AS k, min(state) AS v FROM {duck('members')} GROUP BY ALL")
def relation_merge_min(spark, sf):
    """JOIN04."""
    m = view(spark, sf, "members")
    relations = m.groupBy("rid", "route", "network", "state").agg(F.collect_list("wid").alias("ways")).withColumn("state", F.when(F.col("state") == 3, "proposed"))
    ways = m.select("wid").distinct().withColumn("tags", F.create_map().cast("map<string,string>"))
    out = etl.with_routes(ways, relations).select("wid", F.explode("tags").alias("k", "v"))
    return out.select("wid", F.regexp_replace("k", "^route_", "").alias("k"), F.when(F.col("v") == "yes", 2).otherwise(3).alias("v"))


@query("SELECT o_orderkey AS id, coalesce(e.event_type, o_orderpriority) AS kind, o_orderstatus AS status, e.event_type IS NOT NULL AS found FROM orders LEFT JOIN (SELECT event_id * 3 AS id, event_type FROM events) e ON e.id = o_orderkey")
def pseudo_tag_left_join(spark, sf):
    """JOIN05: the right side wins."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.create_map(F.lit("kind"), "o_orderpriority", F.lit("status"), "o_orderstatus").alias("tags"))
    e = table(spark, sf, "events").select((F.col("event_id") * 3).alias("id"), F.create_map(F.lit("kind"), F.col("event_type"), F.lit("found"), F.lit("yes")).alias("tags"))
    return etl.with_pseudo_tags(o, e, "id").select("id", F.col("tags")["kind"].alias("kind"), F.col("tags")["status"].alias("status"), F.col("tags")["found"].isNotNull().alias("found"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_size < 30) a FULL OUTER JOIN (SELECT p_partkey AS k, p_size * 10 AS v FROM part WHERE p_size > 20) b USING (k)")
def border_override(spark, sf):
    """JOIN08: border rows take precedence."""
    p = table(spark, sf, "part")
    a = p.where("p_size < 30").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("a"))
    b = p.where("p_size > 20").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 10).alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("b", "a").alias("v"))


@query("SELECT via, from_id, to_id, NOT bool_or(positive AND to_id = t) AND (bool_or(positive AND to_id <> t) OR bool_or(NOT positive AND to_id = t)) AS forbidden FROM (SELECT DISTINCT l_suppkey AS via, l_orderkey % 7 AS from_id, l_partkey % 7 AS to_id FROM lineitem) JOIN (SELECT DISTINCT s_suppkey AS v, s_suppkey % 7 AS f, s_nationkey % 7 AS t, s_nationkey % 3 = 0 AS positive FROM supplier) ON via = v AND from_id = f GROUP BY via, from_id, to_id")
def turn_forbidden(spark, sf):
    """JOIN32, AGG29, of turns that a rule names."""
    turns = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("via"), (F.col("l_orderkey") % 7).alias("from_id"), (F.col("l_partkey") % 7).alias("to_id")).distinct()
    rules = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("via"), (F.col("s_suppkey") % 7).alias("from_id"), (F.col("s_nationkey") % 7).alias("to_id"), (F.col("s_nationkey") % 3 == 0).alias("positive")).distinct()
    named = turns.join(rules.select("via", "from_id"), ["via", "from_id"], "left_semi")
    return etl.turn_forbidden(named, rules)


@query("SELECT k, a, b, c FROM (SELECT o_custkey AS k, max(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) NATURAL FULL OUTER JOIN (SELECT o_custkey AS k, min(o_totalprice) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) NATURAL FULL OUTER JOIN (SELECT c_custkey AS k, c_mktsegment AS c FROM customer WHERE c_acctbal < 0)")
def natural_full_chain(spark, sf):
    """JOIN20: the tag tables as one."""
    o = table(spark, sf, "orders")
    return enrich.all_tags([
        o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("a")),
        o.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("b")),
        table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("c")),
    ], "k")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, min(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice = m")
def argmin_self(spark, sf):
    """Rows at their group's minimum, ties kept (JOIN26)."""
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice")
    return table(spark, sf, "orders").withColumn("r", F.rank().over(w)).where("r = 1").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END, o_orderkey) AS r FROM orders) WHERE r = 1")
def priority_pick(spark, sf):
    """One row by an order of preferences (JOIN23, SRT07)."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).when(F.col("o_orderpriority") == "3-MEDIUM", 3).otherwise(4)
    best = F.min_by("o_orderkey", F.struct(rank, F.col("o_orderkey")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(best.alias("o_orderkey"))


@query("SELECT c_custkey, m FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE c_acctbal > 0")
def correlated_max(spark, sf):
    """JOIN24, JOIN19."""
    top = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    return table(spark, sf, "customer").where("c_acctbal > 0").join(top, "c_custkey").select("c_custkey", "m")


@query(f"SELECT wid, nid FROM (SELECT wid, nid, row_number() OVER (PARTITION BY wid ORDER BY pos) AS r FROM {duck('refs')}) WHERE r = 2")
def array_element_pick(spark, sf):
    """The node at a place in a way's list (JOIN25)."""
    return _refs(spark, sf)[0].select("wid", F.try_element_at("nodes", F.lit(2)).alias("nid")).where("nid is not null")


@query("SELECT DISTINCT l_orderkey, l_linenumber, s_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey OR l_partkey = s_suppkey")
def or_join_union(spark, sf):
    """An OR condition as the union of two equi joins (JOIN27)."""
    l, s = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), table(spark, sf, "supplier").select("s_suppkey")  # noqa: E741
    parts = [l.join(s, F.col(c) == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "s_suppkey") for c in ("l_suppkey", "l_partkey")]
    return parts[0].union(parts[1]).distinct()


@query("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def union_distinct_sources(spark, sf):
    """SET01 to SET05, AGG05."""
    c = table(spark, sf, "customer")
    return table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).union(c.where("c_acctbal < 0").select("c_custkey")).union(c.where("c_nationkey = 3").select("c_custkey")).distinct()


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def pair_set_undirected(spark, sf):
    """SET07."""
    return table(spark, sf, "lineitem").where("l_partkey != l_suppkey").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_order(spark, sf):
    """SRT06, as a report of 25."""
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT direction, pct FROM (SELECT n_regionkey AS direction, CAST(floor(100.0 * count(*) FILTER (WHERE c_acctbal > 5000) / count(*)) AS BIGINT) AS pct FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) ORDER BY pct DESC, direction LIMIT 1")
def best_direction(spark, sf):
    """SRT04, AGG18."""
    n = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("direction"))
    return n.agg(F.floor(100.0 * F.count_if(F.col("c_acctbal") > 5000) / F.count("*")).alias("pct")).orderBy(F.desc("pct"), "direction").limit(1)


@query("SELECT n_regionkey AS sector, count(*) AS n, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_river, CAST(floor(100.0 * count(*) FILTER (WHERE c_mktsegment = 'BUILDING') / count(*)) AS BIGINT) AS river FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def area_percent(spark, sf):
    """AGG18, GRF28."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("sector"))
    river = F.count_if(F.col("c_mktsegment") == "BUILDING")
    return rows.agg(F.count("*").alias("n"), river.alias("n_river"), F.floor(100.0 * river / F.count("*")).alias("river"))


@query(f"SELECT highway, surface, oneway, count(*) AS n, sum(metres) AS metres FROM {duck('ways')} GROUP BY ALL ORDER BY n DESC")
def tag_histogram(spark, sf):
    """AGG06, AGG16."""
    return view(spark, sf, "ways").groupBy("highway", "surface", "oneway").agg(F.count("*").alias("n"), F.sum("metres").alias("metres"))


@query(f"SELECT network, count(DISTINCT rid) AS relations, count(*) AS ways FROM {duck('members')} GROUP BY network")
def relation_stats(spark, sf):
    """AGG17."""
    r = view(spark, sf, "members").groupBy("rid", "network").agg(F.collect_list("wid").alias("ways"))
    return r.groupBy("network").agg(F.count("*").alias("relations"), F.sum(F.size("ways")).alias("ways"))


@query(f"SELECT id, max(prio) AS prio, bit_or(triggers) AS triggers FROM {duck('suspects')} GROUP BY id")
def bit_or_triggers(spark, sf):
    """AGG19."""
    return suspects.merged(view(spark, sf, "suspects"))


@query(f"SELECT prio, count(*) AS n, CAST(coalesce(sum(count(*)) OVER (ORDER BY prio DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM {duck('suspects')} GROUP BY prio")
def priority_offsets(spark, sf):
    """AGG20, SRT10."""
    return suspects.priority_offsets(view(spark, sf, "suspects"))


@query(f"SELECT id, prio, triggers, (prio + 1) // 2 * 2 AS level FROM (SELECT id, max(prio) AS prio, bit_or(triggers) AS triggers FROM {duck('suspects')} GROUP BY id) WHERE (prio + 1) // 2 * 2 >= 24 AND id NOT IN (SELECT event_id FROM events WHERE event_type = 'click' OR (event_type = 'view' AND ts > TIMESTAMP '2024-01-15'))")
def suspects_listed(spark, sf):
    """FLT16, JOIN35, STM04: with events as the states of places."""
    status = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "false positive").when(F.col("event_type") == "view", "deferred").alias("status"), "ts")
    return suspects.listed(suspects.merged(view(spark, sf, "suspects")), status, 24, F.lit("2024-01-15").cast("timestamp"))


@query(f"WITH s AS (SELECT k, v, w, coalesce(sum(w) OVER (PARTITION BY k ORDER BY v, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(w) OVER (PARTITION BY k) AS total FROM {duck('samples')}), h AS (SELECT k, v, greatest(0, least(low + w, total - total * 0.5 / 2) - greatest(low, total * 0.5 / 2)) AS held FROM s) SELECT k, round(sum(held * v) / sum(held), 6) AS median FROM h GROUP BY k")
def edge_reduced_median(spark, sf):
    """AGG23."""
    return trimmed_median(view(spark, sf, "samples"), ["k"], "v", "w", 0.5).withColumn("median", F.round("median", 6))


@query("SELECT k, round(avg(m), 6) AS mean, max(s) AS most FROM (SELECT o_custkey AS k, o_orderstatus, max(o_totalprice) AS m, count(*) AS s FROM orders GROUP BY ALL) GROUP BY k")
def avg_after_max(spark, sf):
    """AGG12 to AGG15."""
    inner = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), "o_orderstatus").agg(F.max("o_totalprice").alias("m"), F.count("*").alias("s"))
    return inner.groupBy("k").agg(F.round(F.avg("m"), 6).alias("mean"), F.max("s").alias("most"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' ELSE 'update' END AS change FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 10 < 8) a FULL OUTER JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 10 > 1) b USING (k) WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v")
def tile_diff(spark, sf):
    """SRC46: the delta of two states."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.where("k % 10 > 1").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return diff.diff(o.where("k % 10 < 8"), new, ["k"])


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 10 > 1")
def tile_diff_applied(spark, sf):
    """SRC46: a state and a delta give the other state."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    old, new = o.where("k % 10 < 8"), o.where("k % 10 > 1").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return diff.applied(old, diff.diff(old, new, ["k"]), ["k"])


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 15 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 15 MINUTES AS \"end\", count(*) AS n FROM s GROUP BY user_id, no")
def sessions_15min(spark, sf):
    """STM03."""
    return S.sessions(table(spark, sf, "events"), "user_id", "ts")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20")
def recent_kept(spark, sf):
    """STM02, with 20 for 2000."""
    return S.recent(table(spark, sf, "events"), "user_id", "event_id", "event_id", 20).select("event_id", "user_id")


@query("SELECT l_orderkey AS id, l_partkey AS wid, k, v FROM (SELECT l_orderkey, l_partkey, unnest(['no_' || l_returnflag, 'only_' || l_linestatus]) AS v, unnest(['restriction', 'restriction:hgv']) AS k FROM lineitem)")
def restriction_explode(spark, sf):
    """PRJ16: one row for each restriction tag."""
    rel = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_partkey").alias("rid"), F.create_map(F.lit("restriction"), F.concat(F.lit("no_"), "l_returnflag"), F.lit("restriction:hgv"), F.concat(F.lit("only_"), "l_linestatus"), F.lit("type"), F.lit("restriction")).alias("tags"))
    return etl.restrictions(rel).select(F.col("rid.l_orderkey").alias("id"), F.col("rid.l_partkey").alias("wid"), F.col("key").alias("k"), F.col("value").alias("v"))
