"""Benchmark decontamination by n-gram windows.

The word windows of the benchmark items go to every executor as a hash set.  The size of the benchmark is
checked first: beyond ``block_bytes`` of text the items are dealt into blocks, the documents are scanned once
for each block and the hits of a document are merged.  Driver and executors hold one block at a time: a scan's hits are written
before the next block is made.

A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window.  Words are
compared after lower-casing A-Z.  Candidates found by hash are verified word by word.

Defined results: null or empty documents have no words and no hits; null or empty items have no windows; an item
without an id still marks hits but is not listed; an id that occurs in several rows is listed once; empty tables
give no rows, or rows without hits; rows repeated in the documents give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import WORD, Memo, as_bytes, fresh_name, row_key, slices, stored, tidied, words_of

P = np.uint64(0x9E3779B97F4A7C15)
FOUND = "n_words long, n_hit long, spans array<struct<start:long,stop:long>>, items array<string>"


def _keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n words."""
    acc = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        acc *= P
        acc += hashes[k : len(hashes) - n + 1 + k]
    return acc ^ (acc >> np.uint64(29))


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Windows:
    """The windows of some benchmark items by length, with a bit table in front of the exact look-up."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int):
        self.by_length: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(n, len(words))
            if size:
                table = self.by_length.setdefault(size, {})
                for i in range(len(words) - size + 1):
                    table.setdefault(tuple(words[i : i + size]), set()).add(item)
        self.tables = []
        for size, table in sorted(self.by_length.items()):
            flat = np.fromiter((_word_hash(w) for window in table for w in window), np.uint64, len(table) * size).reshape(-1, size)
            keys = np.concatenate([_keys(row, size) for row in flat])
            bits = max(16, int(len(keys)).bit_length() + 6)
            seen = np.zeros(1 << bits, bool)
            seen[mix_top(keys, bits)] = True
            self.tables.append((size, bits, seen, np.unique(keys)))

    def scan(self, texts: list[bytes | None], memo: Memo):
        """For each text: its words' count, the hit spans and the items found."""
        docs = [words_of(t) for t in texts]
        ends = np.cumsum([len(d) for d in docs])
        words = [w for d in docs for w in d]
        memo.trim()
        hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        hits: dict[int, tuple[list, set]] = {}
        for size, bits, seen, keys in self.tables:
            if len(words) < size:
                continue
            got = _keys(hashes, size)
            at = np.flatnonzero(seen[mix_top(got, bits)])
            at = at[np.isin(got[at], keys)]
            for p in at.tolist():
                doc = int(np.searchsorted(ends, p, "right"))
                items = self.by_length[size].get(tuple(words[p : p + size])) if p + size <= ends[doc] else None
                if items:
                    spans, ids = hits.setdefault(doc, ([], set()))
                    begin = p - (int(ends[doc]) - len(docs[doc]))
                    spans.append((begin, begin + size))
                    ids.update(items)
        for i, d in enumerate(docs):
            spans, ids = hits.get(i, ([], set()))
            yield len(d), merged(spans), sorted(x for x in ids if x is not None)


def mix_top(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def merged(spans) -> list[tuple[int, int]]:
    """The union of spans as maximal runs in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _dealt(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, DataFrame]:
    """The number of blocks of at most about ``block_bytes`` of item text, and the items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-total // block_bytes)), items


def _block(items: DataFrame, number: int, count: int, n: int):
    """A broadcast of the ``Windows`` of one block."""
    part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == number) if count > 1 else items
    return items.sparkSession.sparkContext.broadcast(Windows([(r.item, bytes(r.text)) for r in part.collect()], n))


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """Of each document: id, ``n_words``, ``n_hit`` (words inside a window's occurrence), ``spans`` of hit words and ``items``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = source.schema["id"].dataType.simpleString()
    count, items = _dealt(benchmark, item_col, "text", block_bytes)
    if count > 1:
        source = source.withColumn("row", row_key("id", "text"))

    def scanning(windows):
        def run(batches):
            memo = Memo(_word_hash)
            for batch in slices(batches):
                found = list(windows.value.scan(as_bytes(batch["text"]), memo))
                names = [f for f in batch.schema.names if f != "text"]
                out = {f: batch[f] for f in names}
                out["n_words"] = pa.array([x[0] for x in found], pa.int64())
                out["n_hit"] = pa.array([sum(b - a for a, b in x[1]) for x in found], pa.int64())
                out["spans"] = pa.array([[{"start": a, "stop": b} for a, b in x[1]] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                out["items"] = pa.array([x[2] for x in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(out)

        return run

    if count == 1:
        return source.mapInArrow(tidied(scanning(_block(items, 0, 1, n))), f"id {ids}, {FOUND}").withColumnRenamed("id", id_col)
    parts = None
    for number in range(count):
        windows = _block(items, number, count, n)
        part = source.mapInArrow(tidied(scanning(windows)), f"id {ids}, row long, {FOUND}").withColumn("block", F.lit(number))
        part = stored(part, "hits")
        windows.destroy()
        parts = part if parts is None else parts.unionByName(part)
    # A document has one row a block; equal rows have as many as they are, so their count is kept.
    hit = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.expr("cast(array() as array<struct<start:long,stop:long>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["stop"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(x))),
    )
    grouped = parts.groupBy("id", "row").agg(F.max("n_words").alias("n_words"), F.count(F.when(F.col("block") == 0, 1)).alias("copies"), hit.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["stop"] - x["start"])
    return grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(F.col("id").alias(id_col), "n_words", total.alias("n_hit"), "spans", "items")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    places = [m.span() for m in WORD.finditer(text.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", text_col: str = "text", item_col: str = "item_id", n: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` without the documents that hold a window (``mode='document'``), or with the hit spans cut from their texts (``'span'``).

    All columns are kept, whatever their names.  Beyond one block, a document's spans are gathered block after block and cut once.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"mode {mode}")
    place = docs.columns.index(text_col)
    count, items = _dealt(benchmark, item_col, "text", block_bytes)
    marks = fresh_name(docs, "_marks")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def marking(windows, first):
        def run(batches):
            memo = Memo(_word_hash)
            for batch in slices(batches):
                found = [x[1] for x in windows.value.scan(as_bytes(batch.column(place)), memo)]
                if mode == "document":
                    yield batch.filter(pa.array([not x for x in found], pa.bool_()))
                    continue
                if not first:
                    found = [merged([*x, *((y["start"], y["stop"]) for y in before)]) for x, before in zip(found, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
                    batch = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema([*batch.schema][:-1]))
                column = pa.array([[{"start": a, "stop": b} for a, b in x] for x in found], spans)
                yield pa.RecordBatch.from_arrays([*batch.columns, column], schema=pa.schema([*batch.schema, pa.field(marks, spans)]))

        return run

    def cutting(batches):
        for batch in slices(batches):
            texts = as_bytes(batch.column(place))
            new = [cut(t, [(y["start"], y["stop"]) for y in x]) if x else t for t, x in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns, fields = batch.columns[:-1], [*batch.schema][:-1]
            columns[place] = pa.array(new, pa.large_binary()).cast(fields[place].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    whole = docs.schema
    wide = StructType([*whole.fields, StructField(marks, ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())])))])
    for number in range(count):
        windows = _block(items, number, count, n)
        docs = docs.mapInArrow(tidied(marking(windows, number == 0)), whole if mode == "document" else wide)
        if count > 1:
            docs = stored(docs, "marked")
            windows.destroy()
    return docs if mode == "document" else docs.mapInArrow(cutting, whole)
