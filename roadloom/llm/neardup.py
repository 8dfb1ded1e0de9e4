"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets.

A document's set holds its distinct shingles of ``SHINGLE`` words.  Documents with equal sets are one node, so copies
cost one row.  A node's signature has ``SLOTS`` slots of 16 bits, each the low bits of a minimum hash.  The first
``chunks`` x ``width`` of them are indexed: signatures that differ in fewer than ``chunks`` x (errors + 1) of these agree, by
pigeonhole, in some chunk up to ``errors`` slots; so each chunk is indexed once for every choice of slots that
may be wrong, and all pairs under that distance share a key.  A pair at the similarity asked for differs in a share 1 - similarity of
its slots on average; ``plan`` picks chunks, and a distance over all slots, such that the chance to exceed them is under one in 10^4
and 10^5.  Pairs that share a key and are under the distance over all slots are compared in full: shingles (64-bit hashes) are
counted in both sets.

Pairs of a key are not listed.  First every node is compared with one pivot, of the smallest and the largest node of each of
its keys the one that it shares most keys with, and what is confirmed is joined into components.  Keys whose nodes are not
all in one component stay open; components that open keys chain together are an area.  An area's nodes come together once,
with their signatures and sets, whatever number of keys they share, and a task compares those of different components by
signature and then in full, joining components as it goes; only links that join two components leave it.  An area
of more than ``BLOCK_BYTES`` is dealt into parts, and two parts meet where an open key has nodes in both; while there are such areas and
pivots still join a fair share, further rounds with other pivots come first.  No pair that shares a key goes
unexamined unless its components are joined already, there is no cap, and no task holds more than two parts.

Defined results: texts without words, null or empty, have an empty set and are linked with nothing; texts of fewer
words than a shingle have one shingle, the whole sequence; rows without an id are linked with nothing and kept; rows
with the same id are judged by their texts; an empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_bytes, discard, fresh_name, mix64, settle, slices, stored, tidied

SHINGLE = 5
_RNG = np.random.default_rng(20240229)
_WORDS = _RNG.integers(0, 2**63, 2 * SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RNG.integers(0, 2**63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, 1024, np.uint64)
SLOTS = 252
BLOCK_BYTES = 8 << 20
BLOOM_BITS = 26


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a document, given its words' hashes."""
    if len(words) < SHINGLE:
        return mix64((words * _WORDS[SHINGLE : SHINGLE + len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words))) if len(words) else words
    n = len(words) - SHINGLE + 1
    acc = words[:n] * _WORDS[0]
    for k in range(1, SHINGLE):
        acc += words[k : n + k] * _WORDS[k]
    return np.unique(mix64(acc))


class Shingler:
    def __init__(self):
        self.memo = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        self.memo.trim()
        return shingles(np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words)))


def signature(found: np.ndarray, slots: int) -> np.ndarray:
    """16 bits of the minimum of each hash."""
    low = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        low = np.minimum(low, (found[at : at + 4096, None] * _MULTIPLY[:slots] + _ADD[:slots]).min(axis=0))
    return mix64(low).astype(np.uint16)


class Plan:
    """Chunks of ``width`` slots with up to ``errors`` wrong ones."""

    def __init__(self, chunks: int, width: int, errors: int = 1):
        self.chunks, self.width, self.errors = chunks, width, errors
        self.slots, self.distance = chunks * width, chunks * (errors + 1) - 1
        self.choices = np.array([*combinations(range(width), width - errors)])

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """For each signature one key for each chunk and choice of its right slots."""
        parts = signatures[:, : self.slots].reshape(len(signatures), self.chunks, self.width).astype(np.uint64)
        acc = np.arange(self.chunks, dtype=np.uint64)[None, :, None] * np.uint64(len(self.choices)) + np.arange(len(self.choices), dtype=np.uint64)[None, None, :] + np.zeros((len(signatures), 1, 1), np.uint64)
        for k in range(self.choices.shape[1]):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, self.choices[:, k]] + np.uint64(k + 1))
        return acc.reshape(len(signatures), -1).view(np.int64)


def _over(slots: int, wrong: float, distance: int) -> float:
    """The chance that more than ``distance`` of the slots differ."""
    return sum(math.comb(slots, k) * wrong**k * (1 - wrong) ** (slots - k) for k in range(distance + 1, slots + 1))


def plan(percent: int, miss: float = 1e-4, errors: int = 1, slots: int = SLOTS // 2) -> Plan:
    """The widest chunks of half the slots that miss a pair at the similarity with a smaller chance than ``miss``."""
    for width in range(12, errors, -1):
        p = Plan(slots // width, width, errors)
        if _over(p.slots, 1 - percent / 100, p.distance) < miss:
            return p
    raise ValueError("the similarity is too low for this index")


def farthest(percent: int, miss: float = 1e-5) -> int:
    """The distance over all slots that a pair at the similarity exceeds with a smaller chance than ``miss``."""
    return next(d for d in range(SLOTS + 1) if _over(SLOTS, 1 - percent / 100, d) < miss)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b): hooking to the smallest grandparent and shortcutting, in few rounds."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parents = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("parent")), "parents")
    while True:
        grand = parents.select("node", "parent").join(parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent")
        near = both.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("low"))
        seen = grand.join(near, "node")
        hooks = seen.select("node", F.least("low", "grand").alias("to")).union(seen.select("parent", "low"))
        found = hooks.groupBy("node").agg(F.min("to").alias("to")).join(parents.select("node", "parent"), "node").select("node", F.least("to", "parent").alias("parent"), (F.col("to") < F.col("parent")).alias("moved"))
        former, parents = parents, stored(found, "parents")
        discard(former)
        if parents.where("moved").isEmpty():
            discard(both)
            return parents.select("node", F.col("parent").alias("component"))


class Index:
    """The nodes of some documents, and what they share."""

    def __init__(self, docs: DataFrame, percent: int, id_col: str, text_col: str):
        self.percent, self.plan = percent, plan(percent)
        self.docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
        self.distance = farthest(percent)

        def sign(batches):
            shingler = Shingler()
            for batch in slices(batches):
                sets = [shingler(t) for t in as_bytes(batch["text"])]
                yield pa.RecordBatch.from_pydict({
                    "id": batch["id"],
                    "tie": batch["tie"],
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "set": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    "sig": pa.array([signature(s, SLOTS).tobytes() for s in sets], pa.binary()),
                })

        self.id_type = self.docs.schema["id"].dataType.simpleString()
        self.signed = stored(self.docs.mapInArrow(tidied(sign), f"id {self.id_type}, tie long, n long, set binary, sig binary"), "signatures")
        grouped = self.signed.where("n > 0 and id is not null").groupBy("set").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        # numbered in order of the smallest id, so that the smallest node of a group is its earliest document
        self.nodes = stored(grouped.repartitionByRange("rep", "set").sortWithinPartitions("rep", "set").withColumn("node", F.monotonically_increasing_id()), "nodes")

    def keyed(self) -> DataFrame:
        return self.nodes.select("node", "sig").mapInArrow(tidied(_keying(self.plan)), "node long, keys array<long>").select("node", F.explode("keys").alias("key"))

    def members(self) -> DataFrame:
        """(key, node, first, last) of the keys that several nodes share."""
        keyed = self.keyed()
        shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
        return stored(keyed.join(shared, "key"), "members")

    def sets(self, members: DataFrame) -> DataFrame:
        """(node, n, sig, shingles) of the members, made again from the texts that can hold them."""
        wanted = stored(members.select("node").distinct().join(self.nodes, "node"), "wanted")
        # documents that can't be wanted are left out by a bit table of fixed size; the join is exact
        bit = F.pmod(F.xxhash64("rep"), F.lit(1 << BLOOM_BITS)) + 1  # Spark's bitmaps count from 1
        maps = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        table = np.zeros(1 << BLOOM_BITS >> 3, np.uint8)
        for r in maps.toLocalIterator():
            table[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
        held = self.docs.sparkSession.sparkContext.broadcast(table)
        source = self.docs.select("id", F.pmod(F.xxhash64("id"), F.lit(1 << BLOOM_BITS)).alias("bit"), "text").where("id is not null")
        sets = source.mapInArrow(tidied(_sets(held)), f"id {self.id_type}, set binary, shingles binary")
        # rows repeated with id and text are the same set
        joined = wanted.join(sets.withColumnRenamed("id", "rep"), ["rep", "set"]).dropDuplicates(["node"]).select("node", "n", "sig", "shingles")
        found = stored(joined, "sets")
        held.destroy()
        discard(wanted)
        return found

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of the pairs (node, pivot) those that are near by signature and similar enough by their full sets, as links (a, b).

        Nodes meet their pivot in groups of about ``BLOCK_BYTES``: small ones share a group with other pivots, a large one is
        dealt into parts, each with the pivot.
        """
        held = stored(pairs.join(sets.select("node", (8 * F.col("n") + 2 * SLOTS).alias("bytes")), "node"), "pairs")
        sizes = held.groupBy("pivot").agg(F.sum("bytes").alias("bytes")).withColumn("parts", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int"))
        sizes = stored(sizes, "pivots")
        total = sizes.where("parts <= 1").agg(F.sum("bytes")).first()[0] or 0
        buckets = 1 + total // BLOCK_BYTES
        small = F.col("parts") <= 1
        group = [F.when(small, F.pmod(F.xxhash64("pivot"), F.lit(buckets))).otherwise(F.col("pivot")).alias("bucket"), small.alias("small")]
        nodes = held.join(sizes.select("pivot", "parts"), "pivot").select("node", "pivot", *group, F.when(small, 0).otherwise(F.pmod(F.hash("node"), "parts")).alias("part"), F.lit(False).alias("own"))
        own = sizes.select(F.col("pivot").alias("node"), "pivot", *group, F.explode(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1)).alias("part"), F.lit(True).alias("own"))
        rows = nodes.unionByName(own).join(sets, "node")
        return rows.groupBy("bucket", "small", "part").applyInArrow(_stars(self.distance, self.percent), "a long, b long")

    def pivots(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) of nodes and the smallest or largest node that they share most keys with."""
        pairs = members.select("node", F.explode(F.array("first", "last")).alias("pivot")).where("node != pivot")
        return self.confirmed(_likeliest(pairs), sets)

    def more_pivots(self, placed: DataFrame, sets: DataFrame, seed: int) -> DataFrame:
        """Links of nodes of open keys and other pivots, of another component."""
        order, one = F.xxhash64("node", F.lit(seed)), F.struct("node", "component")
        ends = placed.groupBy("key").agg(F.array(F.min_by(one, order), F.max_by(one, order)).alias("ends"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        pairs = placed.join(ends, "key").select("node", "component", F.explode("ends").alias("end")).where("component != end.component")
        return self.confirmed(_likeliest(pairs.select("node", F.col("end.node").alias("pivot"))), sets)

    def placed(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """(key, node, component) of the members; a node without a link is its own component."""
        return stored(members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "placed")

    def open_sides(self, placed: DataFrame) -> DataFrame:
        """(key, node, component, low) of the keys whose nodes are not all in one component; ``low`` is the key's smallest."""
        open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        return stored(placed.join(open_.select("key", "low"), "key"), "open")

    def areas(self, sides: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(node, component, area) of the nodes of open keys, and (component, area, parts) of their components."""
        area = components(sides.where("component != low").select(F.col("component").alias("a"), F.col("low").alias("b")))
        nodes = sides.select("node", "component").distinct().join(area.select(F.col("node").alias("component"), F.col("component").alias("area")), "component")
        nodes = stored(nodes, "areas")
        sizes = nodes.join(sets.select("node", (8 * F.col("n") + 2 * SLOTS).alias("bytes")), "node").groupBy("area").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("parts"))
        return nodes, stored(nodes.select("component", "area").distinct().join(sizes, "area"), "parts")

    def across(self, sides: DataFrame, nodes: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) of components, by the nodes of each area."""
        alone = parts.where("parts = 1").select("area").distinct()
        small = nodes.join(alone, "area", "left_semi").select("node", "component", "area", *[F.lit(0).alias(c) for c in ("part", "i", "j")])
        # of larger areas the parts that a key has nodes in
        keys = sides.select("key", F.col("low").alias("component")).distinct().join(parts.where("parts > 1"), "component").select("key", "area", "parts")
        held = sides.select("key", "node", "component").join(keys, "key").withColumn("part", F.pmod(F.hash("node"), "parts"))
        met = held.select("key", F.col("part").alias("other")).distinct()
        met = held.join(met, "key").select("node", "component", "area", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).distinct()
        blocks = small.union(met).join(sets, "node")
        return blocks.groupBy("area", "i", "j").applyInArrow(_across(self.distance, self.percent), "a long, b long")

    def classes(self) -> DataFrame:
        """(node, component) of all nodes that share a key with another."""
        spark = self.docs.sparkSession
        members = self.members()
        sets = self.sets(members)
        settle(spark)  # the many plans from here on stay in the driver's memory until it is collected
        links = stored(self.pivots(members, sets), "links")
        seed = 0
        while True:
            found = components(links)
            settle(spark)
            placed = self.placed(members, found)
            sides = self.open_sides(placed)
            nodes, parts = self.areas(sides, sets)
            if (parts.agg(F.max("parts")).first()[0] or 0) <= 1:
                break
            seed += 1
            more = stored(links.union(self.more_pivots(placed, sets, seed)), "links")
            gained = more.count() - links.count()
            links = more
            if gained < 0.05 * nodes.count():
                break
            discard(placed, sides, nodes, parts)
        settle(spark)
        last = components(stored(self.across(sides, nodes, parts, sets), "area-links"))
        settle(spark)
        of = placed.select("node", "component").distinct().join(last.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
        return of.select("node", F.coalesce("to", "component").alias("component"))


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of each node the pair with the pivot that it is listed with most often."""
    return pairs.groupBy("node", "pivot").count().groupBy("node").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))


def _keying(plan: Plan):
    def run(batches):
        for batch in slices(batches, 2048):
            keys = plan.keys(_signatures(batch["sig"]))
            ends = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_pydict({"node": batch["node"], "keys": pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))})

    return run


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


class Sets:
    """Signatures and full sets of the rows of a table, for comparing one row with many."""

    def __init__(self, table: pa.Table, distance: int, percent: int):
        self.distance, self.percent = distance, percent
        self.n, self.sigs = table["n"].to_numpy(), _signatures(table["sig"])
        flat = np.frombuffer(b"".join(table["shingles"].to_pylist()), np.uint64)
        self.ids = np.unique(flat, return_inverse=True)[1]
        self.begin = np.cumsum(self.n) - self.n
        self.marked = np.zeros(len(flat), bool)

    def similar(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Of the rows ys those that are near row x by signature and similar enough in full."""
        n, begin, ids = self.n, self.begin, self.ids
        ys = ys[100 * np.minimum(n[x], n[ys]) >= self.percent * np.maximum(n[x], n[ys])]
        ys = np.concatenate([ys[:0], *(some[(self.sigs[some] != self.sigs[x]).sum(axis=1) <= self.distance] for some in np.split(ys, range(1 << 14, len(ys), 1 << 14)))])
        if not len(ys):
            return ys
        mine = ids[begin[x] : begin[x] + n[x]]
        self.marked[mine] = True
        both = np.empty(len(ys), np.int64)
        at = 0
        for cut in [*(np.flatnonzero(np.diff(np.cumsum(n[ys]) >> 20)) + 1).tolist(), len(ys)]:
            some = ys[at:cut]
            ends = np.cumsum(n[some])
            of = np.repeat(begin[some] - (ends - n[some]), n[some]) + np.arange(ends[-1])
            both[at:cut] = np.add.reduceat(self.marked[ids[of]], ends - n[some], dtype=np.int64)
            at = cut
        self.marked[mine] = False
        return ys[100 * both >= self.percent * (n[x] + n[ys] - both)]


def _links(links: list) -> pa.Table:
    ends = np.sort(np.array(links, np.int64).reshape(-1, 2), axis=1)
    return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})


def _stars(distance: int, percent: int):
    """Links of pivots and the nodes that came with them."""

    def run(table: pa.Table) -> pa.Table:
        pivot, own, node = (table[c].to_numpy() for c in ("pivot", "own", "node"))
        sets = Sets(table, distance, percent)
        links = []
        order = np.lexsort((~own, pivot))  # each pivot, then its nodes
        for run_ in np.split(order, np.flatnonzero(np.diff(pivot[order])) + 1):
            links += [(node[run_[0]], node[y]) for y in sets.similar(int(run_[0]), run_[1:])]
        return _links(links)

    return run


def _across(distance: int, percent: int):
    """Of two parts' nodes the links that join two components, each pair compared by signature and then in full."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, i, j = (k.as_py() for k in key)
        table = table.sort_by("node")
        part, component = (table[c].to_numpy() for c in ("part", "component"))
        sets = Sets(table, distance, percent)
        label = np.unique(component, return_inverse=True)[1]
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        links = []
        for x in left.tolist():
            ys = right[label[right] != label[x]]  # what isn't joined yet
            good = sets.similar(x, ys[ys > x] if i == j else ys)
            if len(good):
                labels, first = np.unique(label[good], return_index=True)
                links += [(component[x], component[good[k]]) for k in first]
                label[np.isin(label, labels)] = label[x]
        return _links(links)

    return run


def _sets(held):
    def run(batches):
        shingler = Shingler()
        for batch in slices(batches):
            bits = batch["bit"].to_numpy()
            batch = batch.filter(pa.array(held.value[bits >> 3] >> (bits & 7) & 1 == 1))
            sets = [shingler(t) for t in as_bytes(batch["text"])]
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "set": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _grouped(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, tie, n_shingles, component_id) of each row; ``tie`` is a hash of its text."""
    index = Index(docs, percent, id_col, text_col)
    classes = index.nodes.select("node", "set", "rep").join(index.classes(), "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = stored(classes, "classes")
    lowest = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = classes.join(lowest, "component").select(F.col("set").alias("its"), "component_id")
    found = index.signed.join(of_set, (F.col("set") == F.col("its")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    return found.select("id", "tie", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document: id, ``n_shingles``, ``component_id`` (smallest id of its group) and ``kept`` (it is that id)."""
    found = _grouped(docs, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; all columns stay."""
    gone, tie = fresh_name(docs, "_gone"), fresh_name(docs, "_tie")
    out = _grouped(docs, percent, id_col, text_col).where("id != component_id").select(F.col("id").alias(gone), F.col("tie").alias(tie)).distinct()
    return docs.join(out, (F.col(id_col) == F.col(gone)) & (F.xxhash64(F.col(text_col)) == F.col(tie)), "left_anti")
