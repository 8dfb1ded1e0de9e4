"""Approximate nearest neighbours: an inverted-list index scanned adaptively by blocks of dimensions.

Vectors are scaled to length 1, so that the nearest by cosine are the nearest by distance, and turned by a random
rotation, so that the first dimensions are a fair sample of all.  k-means on a bounded sample of ``sample`` vectors
gives the lists; every vector is in one list, stored by columns.  A query probes its nearest lists, as many as on the
sample hold the share ``recall`` of the true neighbours (sparse, so farther than in the whole) of 200 of its vectors.  In a
list, the distances over the first block of dimensions are summed for all candidates at once, then over the next block
for those left: a candidate goes as soon as its partial distance, scaled to all dimensions, is beyond the
k-th best distance so far by more than a hypothesis test with ``confidence`` allows.  That distance is of the list's own
candidates, brought down after each block; lists are scanned side by side, so none knows another's.  The survivors are scored exactly,
in double precision on the vectors as they came.

Lists longer than ``list_rows`` are split, so no task gathers a list that holds a large share of all rows; of each
piece a query keeps its k best, and the pieces' results are merged.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do those of
another length than most (ties: the longer); a query isn't its own neighbour, but rows with the same id are (each row
is a candidate of queries with another id); query rows that share an id but not the vector are answered each by itself, and
equal rows once; ties go to the smaller id; with fewer than k candidates all are returned; an empty table
gives no rows.  Rows without an id take no part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

BLOCK = 16


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vector) of the vectors that take part, as doubles, and their length."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    top = fine.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = top.size if top else 0
    return fine.where(F.size("v") == size), size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, size)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no cosine, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow or underflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centres of the unit vectors x; fewer where x has fewer distinct rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """How many nearest lists hold this share of the k nearest within x of some of its rows."""
    near = np.argmax(x @ centres.T, axis=1)
    asked = x[:: max(1, len(x) // queries)][:queries]
    best = np.argsort(-(asked @ x.T), axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, near[best], axis=1).ravel() + 1
    return int(np.quantile(needed, recall, method="higher")) if len(needed) else len(centres)


class Index:
    """Centres, rotation and the table of (list, piece, id, vector)."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, sample: int = 20_000, list_rows: int = 4096, recall: float = 0.98, seed: int = 0):
        rows, self.size = usable(vectors, id_col, vector_col)
        self.rows, self.id_type = rows, rows.schema["id"].dataType.simpleString()
        self.count = rows.count() if self.size else 0
        if not self.count:
            return
        lists = lists or max(1, min(1024, int(self.count**0.5)))
        share = min(1.0, sample / self.count)
        chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").limit(2 * sample).toArrow()
        x = matrix(chosen["v"], self.size) if chosen.num_rows else matrix(rows.limit(sample).select("v").toArrow()["v"], self.size)
        x = unit(x)
        self.centres = kmeans(x, lists, seed=seed)
        self.probes = probes_for(x, self.centres, 5, recall)
        self.rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.size, self.size)))[0]
        centres, size = self.centres, self.size

        def place(batches):
            for batch in slices(batches, 2048):
                near = np.argmax(unit(matrix(batch["v"], size)) @ centres.T, axis=1)
                yield pa.RecordBatch.from_pydict({"id": batch["id"], "v": batch["v"], "list": pa.array(near, pa.int32())})

        placed = stored(rows.mapInArrow(place, f"id {self.id_type}, v array<double>, list int"), "vectors")
        sizes = placed.groupBy("list").count().collect()  # one row for each list
        self.sizes = {r["list"]: r["count"] for r in sizes}
        self.pieces = {k: -(-n // list_rows) for k, n in self.sizes.items()}
        pieces = F.element_at(F.create_map(*[F.lit(x) for kv in self.pieces.items() for x in kv]), F.col("list"))
        self.table = placed.withColumn("piece", F.pmod(F.xxhash64("id", F.lit("piece")), pieces).cast("int"))

    def search(self, queries: Column, k: int = 5, probes: int | None = None, confidence: float = 2.1) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k nearest that the scan finds for the rows, called ``id``, that ``queries`` selects."""
        schema = f"query_id {self.id_type}, rank int, vec_id {self.id_type}, score double"
        if not self.count:
            return self.rows.sparkSession.createDataFrame([], schema)
        probes = probes or self.probes
        centres, size, sizes, pieces = self.centres, self.size, self.sizes, self.pieces
        counts = np.array([sizes.get(i, 0) for i in range(len(centres))])

        def probe(batches):
            for batch in slices(batches, 1024):
                order = np.argsort(-(unit(matrix(batch["v"], size)) @ centres.T), axis=1, kind="stable")
                # more lists where the first hold too few candidates
                held = np.cumsum(counts[order], axis=1)
                enough = np.maximum(probes, (held < k + batch["own"].to_numpy()[:, None]).sum(axis=1) + 1)
                at, of, part = [], [], []
                for i, (row, n) in enumerate(zip(order, enough, strict=True)):
                    for number in row[:n].tolist():
                        for piece in range(pieces.get(number, 0)):
                            at.append(i)
                            of.append(number)
                            part.append(piece)
                chosen = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_pydict({"list": pa.array(of, pa.int32()), "piece": pa.array(part, pa.int32()), "id": chosen["id"], "v": chosen["v"], "key": chosen["key"]})

        # equal rows are one query; ``own`` counts the rows that are no candidates, ``key`` tells an id's vectors apart
        told = self.rows.where(queries).groupBy("id", "v").agg(F.count("*").alias("n"))
        told = told.select("id", "v", F.sum("n").over(Window.partitionBy("id")).alias("own"), F.xxhash64("v").alias("key"))
        asked = told.mapInArrow(probe, f"list int, piece int, id {self.id_type}, v array<double>, key long")
        found = asked.groupBy("list", "piece").cogroup(self.table.groupBy("list", "piece")).applyInArrow(_scan(self.size, self.rotation, k, confidence), f"query_id {self.id_type}, key long, vec_id {self.id_type}, score double")
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k)
        ranked = found.groupBy("query_id", "key").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "b"))
        return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))


def scan(x: np.ndarray, q: np.ndarray, limit: float, k: int, confidence: float) -> np.ndarray:
    """The columns of x (dimensions x candidates) that may be among the k nearest to q, by blocks of dimensions."""
    size = len(q)
    left = np.arange(x.shape[1])
    part = np.zeros(len(left))
    for at in range(0, size, BLOCK):
        block = x[at : at + BLOCK] if len(left) == x.shape[1] else x[at : at + BLOCK, left]
        part += ((block - q[at : at + BLOCK, None]) ** 2).sum(axis=0)
        done = min(size, at + BLOCK)
        if done < size:
            if len(left) > k:  # the nearest so far, taken in full, bring the limit down after each block
                near = left[np.argpartition(part, k - 1)[:k]]
                limit = min(limit, ((x[:, near] - q[:, None]) ** 2).sum(axis=0).max())
            held = part * (size / done) <= limit * (1 + confidence / np.sqrt(done)) ** 2 + 1e-9
        else:
            held = part <= limit * (1 + 1e-9) + 1e-9
        left, part = left[held], part[held]
    return left


def _scan(size: int, rotation: np.ndarray, k: int, confidence: float):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out_q, out_k, out_v, out_s = [], [], [], []
        if asked.num_rows and held.num_rows:
            v = scaled(matrix(held["v"], size))
            turned = np.ascontiguousarray((unit(v) @ rotation).T)
            norms = np.sqrt((v * v).sum(axis=1))
            ids = held["id"].to_pylist()
            order = np.array(ids)
            rows_of = Counter(ids)
            for qid, key, q in zip(asked["id"].to_pylist(), asked["key"].to_pylist(), scaled(matrix(asked["v"], size)), strict=True):
                left = scan(turned, unit(q[None])[0] @ rotation, np.inf, k + max(1, rows_of[qid]), confidence)
                scores = (v[left] @ q) / (norms[left] * np.sqrt((q * q).sum()))
                rank = np.lexsort((order[left], -scores))
                taken = 0
                for j in rank:
                    if ids[left[j]] != qid:
                        out_q.append(qid)
                        out_k.append(key)
                        out_v.append(ids[left[j]])
                        out_s.append(float(scores[j]))
                        taken += 1
                        if taken == k:
                            break
        kind = (asked if asked.num_rows else held).schema.field("id").type
        return pa.table({"query_id": pa.array(out_q, kind), "key": pa.array(out_k, pa.int64()), "vec_id": pa.array(out_v, kind), "score": pa.array(out_s, pa.float64())})

    return run
