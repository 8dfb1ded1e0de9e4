"""Repeated byte windows across documents, by a depth-limited radix sort of sampled suffixes.

A byte is removed if a window of ``depth`` bytes that covers it also starts in a document with a smaller id.  Suffixes are
ordered only as far as that depth, by digits from the most significant on, and an ordering pass ends for a group as soon
as it lies in one document:

1. In every window the smallest hash of its ``DIGIT``-byte pieces (leftmost, on ties) names an anchor.  Equal windows
   have equal anchors at equal places, so it is enough to sort the suffixes at anchors, about one in 16.  The first
   pass deals them by their first digit, the anchor's piece.  An anchor's context is the run of all windows it stands for; equal
   contexts need no further pass: in all but the smallest document the whole run is removed.
2. Of pieces with several contexts in several documents, the windows themselves go on to the second pass, which sorts
   them through the full depth (128 bits of hash); equal groups are exactly the repeated windows.

Each pass deals fixed-size blocks of digits to groups by their leading bits.  Before that, every task keeps of equal
contexts or windows only those of its smallest document and removes the others at once, so a passage
that a third of all documents share comes to a group once for each block of input, not once for each document.
Groups are worked off in ``ROUNDS`` rounds, so that only a round's share of the digits is on disk at a time, in
blocks that are larger by as much; tables and shuffled files go as soon as the next table is written.
Texts longer than a block are cut into pieces that overlap by a window less one byte, so memory is bounded.

Defined results: null and empty texts have no bytes; documents without an id neither lose bytes nor cause a loss;
documents with the same id cause each other no loss; an empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, mix64, release, slices, stored

DIGIT = 20
BLOCK = 1 << 18
GROUP_BYTES = 8 << 20
ROUNDS = 2
BLOOM_BITS = 26
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_BASES = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5], np.uint64)
ROWS = "id long, tie int, open boolean, spans binary"
BLOCKS = f"dest long, digits binary, {ROWS}"


class Powers:
    """Powers of an odd base and of its inverse, modulo 2^64."""

    def __init__(self, base: np.uint64):
        self.base, self.size = base, 0
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > self.size:
            self.size = n
            inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)


class Hasher:
    """Hashes of any stretches of a buffer."""

    def __init__(self, buffer: np.ndarray, powers: Powers):
        powers.grow(len(buffer))
        self.powers = powers
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers.up[: len(buffer)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.powers.down[start])


def anchors(buffer: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with the same anchor: first start, last start, the anchor's place, the hash of its piece.

    ``bounds`` are the ends of the pieces of text that the buffer holds, each of at least ``depth`` bytes.
    """
    n = len(buffer)
    raw = buffer.tobytes() + b"\0" * 8
    eight = np.ndarray((n,), "<u8", raw, 0, (1,))
    m = n - DIGIT + 1
    low = mix64(eight[:m] * _C[0] + (eight[8 : 8 + m] ^ _C[1]) * _C[1] + (eight[DIGIT - 8 : DIGIT - 8 + m] ^ _C[2]) * _C[2])
    digits = low
    at = np.arange(m, dtype=np.int32)
    width, span = 1, depth - DIGIT + 1
    while width < span:
        step = min(width, span - width)
        right = low[step:] < low[: len(low) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        low = np.minimum(low[step:], low[: len(low) - step])
        width += step
    valid = np.ones(n - depth + 1, np.int8)
    for end in bounds[:-1].tolist():
        valid[max(0, end - depth + 1) : end] = 0
    starts = np.flatnonzero(valid)
    of = at[starts]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    count = np.diff(np.append(new, len(starts)))
    first = starts[new]
    # anchors are minima, so their hashes are small: scrambled again, they deal evenly
    return first, first + count - 1, of[new], mix64(digits[of[new]] ^ _C[0])


def pieces(batches, depth: int, most: int = BLOCK):
    """Blocks of text: buffer, ends, and for each piece its document's id, tie and the piece's place in its text."""
    held, size = [], 0
    for batch in slices(batches):
        for key, tie, text in zip(batch["id"].to_pylist(), batch["tie"].to_pylist(), as_bytes(batch["text"]), strict=True):
            for at in range(0, len(text or b"") - depth + 1, most):
                part = text[at : at + most + depth - 1]
                held.append((key, tie, at, part))
                size += len(part)
                if size >= most:
                    yield _joined(held)
                    held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    buffer = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
    ends = np.cumsum([len(x[3]) for x in held])
    return buffer, ends, np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int32), np.array([x[2] for x in held], np.int64)


SPAN = np.dtype([("at", "<u4"), ("size", "u1")])


def _spans(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), SPAN)
    out["at"], out["size"] = at, size
    return out


def _by_document(ids, ties, spans, opened) -> dict[str, list]:
    """Rows with all spans of a document."""
    out: dict[str, list] = {"id": [], "tie": [], "open": [], "spans": []}
    if len(ids):
        order = np.lexsort((ties, ids))
        ids, ties, spans = ids[order], ties[order], spans[order]
        new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])]))
        raw, width = spans.tobytes(), SPAN.itemsize
        ends = [*(new[1:] * width).tolist(), len(raw)]
        out["id"], out["tie"] = ids[new].tolist(), ties[new].tolist()
        out["spans"] = [raw[a:b] for a, b in zip((new * width).tolist(), ends, strict=True)]
        out["open"] = [opened] * len(new)
    return out


def _first_of(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts by keys and then ids; where in it a new group starts; whether a member's id is its group's smallest."""
    order = np.lexsort((ids, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    lowest = ids[order][new] if len(order) else ids
    return order, new, ids[order] == lowest[group] if len(order) else new


ENTRY = np.dtype([("lead", "<u4"), ("rest", "<u8"), ("doc", "<u2"), ("at", "<u4"), ("size", "u1")])


def _dest(lead, groups: int) -> np.ndarray:
    return (lead >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)


def _mine(lead, groups: int, turn: int) -> np.ndarray:
    """Which digits belong to a round's groups."""
    return _dest(lead, groups) % np.uint64(ROUNDS) == turn


def _deal(lead, rest, ids, ties, spans, groups: int, out: dict):
    """Blocks of entries by the leading bits of their first digit, each with a table of its documents."""
    dest = _dest(lead, groups)
    order = np.argsort(dest, kind="stable")
    cuts = np.flatnonzero(np.diff(dest[order])) + 1
    for part in np.split(order, cuts):
        for some in np.array_split(part, max(1, -(-len(part) // 60_000))):  # document numbers of a block are 16 bits
            if len(some):
                both = np.empty(len(some), [("id", "<i8"), ("tie", "<i4")])
                both["id"], both["tie"] = ids[some], ties[some]
                table, number = np.unique(both, return_inverse=True)
                entry = np.empty(len(some), ENTRY)
                entry["lead"], entry["rest"] = lead[some] & np.uint64(0xFFFFFFFF), rest[some]
                entry["doc"], entry["at"], entry["size"] = number, spans["at"][some], spans["size"][some]
                out["dest"].append(int(dest[some[0]]))
                out["digits"].append(np.array([len(table)], "<u4").tobytes() + table.tobytes() + entry.tobytes())


def _entries(digits: list[bytes]):
    lead, rest, ids, ties, spans = [], [], [], [], []
    for raw in digits:
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        table = np.frombuffer(raw, [("id", "<i8"), ("tie", "<i4")], n, 4)
        entry = np.frombuffer(raw, ENTRY, offset=4 + n * table.itemsize)
        lead.append(entry["lead"])
        rest.append(entry["rest"])
        ids.append(table["id"][entry["doc"]])
        ties.append(table["tie"][entry["doc"]])
        spans.append(_spans(entry["at"], entry["size"]))
    return [np.concatenate(x) for x in (lead, rest, ids, ties, spans)]


def _emit(out: dict, rows: dict[str, list], groups: int) -> pa.RecordBatch:
    """Blocks and finished rows in one record batch."""
    a, b = len(out["dest"]), len(rows["id"])
    # finished rows go to groups too, more of them as the corpus grows: any will do
    spread = max(4096, 4 * groups)
    return pa.RecordBatch.from_pydict({
        "dest": pa.array(out["dest"] + [-1 - x % spread for x in rows["id"]], pa.int64()),
        "digits": pa.array(out["digits"] + [None] * b, pa.binary()),
        "id": pa.array([None] * a + rows["id"], pa.int64()),
        "tie": pa.array([None] * a + rows["tie"], pa.int32()),
        "open": pa.array([None] * a + rows["open"], pa.bool_()),
        "spans": pa.array([None] * a + rows["spans"], pa.binary()),
    })


def _first_pass(depth: int, groups: int, turn: int):
    def run(batches):
        powers = Powers(_BASES[0])
        waiting, size = [], 0

        def flush():
            lead, rest, ids, ties, spans = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            order, _, lowest = _first_of([lead, rest], ids)
            keep, gone = order[lowest], order[~lowest]
            out = {"dest": [], "digits": []}
            _deal(lead[keep], rest[keep], ids[keep], ties[keep], spans[keep], groups, out)
            return _emit(out, _by_document(ids[gone], ties[gone], spans[gone], False), groups)

        for buffer, ends, ids, ties, places in pieces(batches, depth):
            first, last, anchor, digit = anchors(buffer, ends, depth)
            mine = _mine(digit, groups, turn)
            if not mine.any():
                continue
            first, last, anchor, digit = first[mine], last[mine], anchor[mine], digit[mine]
            piece = np.searchsorted(ends, first, "right")
            size_of = last - first + depth
            context = mix64(Hasher(buffer, powers)(first, first + size_of) + (anchor - first).astype(np.uint64) * _C[0] + size_of.astype(np.uint64) * _C[1])
            begin = np.concatenate([[0], ends[:-1]])[piece]
            waiting.append((digit, context, ids[piece], ties[piece], _spans(places[piece] + first - begin, size_of)))
            size += len(first)
            if size >= 150_000:
                yield flush()
                waiting, size = [], 0
        if waiting:
            yield flush()

    return run


def _first_groups(table: pa.Table) -> pa.Table:
    """Equal contexts are decided; windows of pieces with several contexts in several documents stay open."""
    done = table.filter(pa.compute.is_null(table["digits"]))
    rows = {k: done[k].to_pylist() for k in ("id", "tie", "open", "spans")}
    digits = [x for x in table["digits"].to_pylist() if x is not None]
    if digits:
        lead, rest, ids, ties, spans = _entries(digits)
        order, new, lowest = _first_of([lead, rest], ids)
        gone = order[~lowest]
        mine = order[lowest]
        # by piece: the smallest and largest of its contexts' smallest documents
        pieces_ = lead[mine]
        start = np.flatnonzero(np.concatenate([[True], pieces_[1:] != pieces_[:-1]]))
        low, high = np.minimum.reduceat(ids[mine], start), np.maximum.reduceat(ids[mine], start)
        several = np.repeat(low < high, np.diff(np.append(start, len(mine))))
        for part, opened in ((gone, False), (mine[several], True)):
            for k, v in _by_document(ids[part], ties[part], spans[part], opened).items():
                rows[k] += v
    return pa.table({"id": pa.array(rows["id"], pa.int64()), "tie": pa.array(rows["tie"], pa.int32()), "open": pa.array(rows["open"], pa.bool_()), "spans": pa.array(rows["spans"], pa.binary())})


def _second_pass(depth: int, groups: int, turn: int):
    def run(batches):
        powers = [Powers(b) for b in _BASES]
        waiting, size = [], 0

        def flush():
            lead, rest, ids, ties, at = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            order, _, lowest = _first_of([lead, rest], ids)
            keep, gone = order[lowest], order[~lowest]
            spans = _spans(at, np.full(len(at), depth))
            out = {"dest": [], "digits": []}
            _deal(lead[keep], rest[keep], ids[keep], ties[keep], spans[keep], groups, out)
            return _emit(out, _by_document(ids[gone], ties[gone], spans[gone], False), groups)

        for batch in slices(batches, 64):
            for key, tie, text, found in zip(batch["id"].to_pylist(), batch["tie"].to_pylist(), as_bytes(batch["text"]), batch["found"].to_pylist(), strict=True):
                spans = np.unique(np.frombuffer(b"".join(found), SPAN))
                starts = np.unique(np.concatenate([np.arange(a, a + n - depth + 1) for a, n in zip(spans["at"].tolist(), spans["size"].tolist(), strict=True)]))
                for block in range(0, len(text), BLOCK):
                    some = starts[(starts >= block) & (starts < block + BLOCK)]
                    if len(some):
                        buffer = np.frombuffer(text, np.uint8)[block : block + BLOCK + depth]
                        lead = Hasher(buffer, powers[0])(some - block, some - block + depth)
                        mine = _mine(lead, groups, turn)
                        lead, some = lead[mine], some[mine]
                        if not len(some):
                            continue
                        rest = Hasher(buffer, powers[1])(some - block, some - block + depth)
                        waiting.append((lead, rest, np.full(len(some), key, np.int64), np.full(len(some), tie, np.int32), some))
                        size += len(some)
                if size >= 150_000:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    return run


def _second_groups(table: pa.Table) -> pa.Table:
    """Of equal windows all but those of the smallest document go."""
    done = table.filter(pa.compute.is_null(table["digits"]))
    rows = {k: done[k].to_pylist() for k in ("id", "tie", "open", "spans")}
    digits = [x for x in table["digits"].to_pylist() if x is not None]
    if digits:
        lead, rest, ids, ties, spans = _entries(digits)
        order, _, lowest = _first_of([lead, rest], ids)
        gone = order[~lowest]
        for k, v in _by_document(ids[gone], ties[gone], spans[gone], False).items():
            rows[k] += v
    return pa.table({"id": pa.array(rows["id"], pa.int64()), "tie": pa.array(rows["tie"], pa.int32()), "open": pa.array(rows["open"], pa.bool_()), "spans": pa.array(rows["spans"], pa.binary())})


def _bit():
    return F.pmod(F.xxhash64("id", "tie"), F.lit(1 << BLOOM_BITS)) + 1  # Spark's bitmaps count from 1


def _may_be_in(source: DataFrame, table: DataFrame):
    """A column, and a broadcast bit table of fixed size, that tell which documents can't be in the table."""
    maps = table.select(_bit().alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros(1 << BLOOM_BITS >> 3, np.uint8)
    for r in maps.collect():
        bits[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return source.sparkSession.sparkContext.broadcast(bits)


def _held(batch, bits) -> np.ndarray:
    at = batch["bit"].to_numpy() - 1
    return bits[at >> 3] >> (at & 7) & 1 == 1


def runs_of(found: list[bytes] | None, size: int) -> list[tuple[int, int]]:
    """The union of spans as maximal runs."""
    spans = np.frombuffer(b"".join(found or []), SPAN)
    if not len(spans):
        return []
    marks = np.zeros(size + 1, np.int64)
    at = spans["at"].astype(np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + spans["size"], -1)
    covered = np.cumsum(marks[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [*zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


RESULT = "text binary, spans array<struct<start:long,stop:long>>"


def _removed(texts, found):
    kept, spans = [], []
    for text, f in zip(texts, found, strict=True):
        runs = runs_of(f, len(text or b""))
        at, parts = 0, []
        for a, b in runs:
            parts.append(text[at:a])
            at = b
        kept.append(b"".join([*parts, text[at:]]) if runs else text)
        spans.append([{"start": a, "stop": b} for a, b in runs])
    return {"text": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))}


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def _in_rounds(df: DataFrame, make, decide, name: str) -> list[DataFrame]:
    """What ``decide`` says of the groups, one stored table a round."""
    found = []
    for turn in range(ROUNDS):
        found.append(stored(df.mapInArrow(make(turn), BLOCKS).groupBy("dest").applyInArrow(decide, ROWS), name))
        release(df.sparkSession)
    return found


def removed(docs: DataFrame, depth: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document: id, ``text`` as the bytes that stay (null for null) and the removed ``spans`` (bytes, from 0)."""
    if not DIGIT <= depth <= 140:
        raise ValueError("the depth must be from 20 to 140 bytes")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    source = rows.select("id", F.expr("cast(xxhash64(text) & 2147483647 as int)").alias("tie"), "text")
    usable = source.where("id is not null and text is not null")
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    found = _in_rounds(usable, lambda turn: _first_pass(depth, groups, turn), _first_groups, "first-pass")
    decided = [df.where("not open") for df in found]
    wide = _all(found).where("open").groupBy("id", "tie").agg(F.collect_list("spans").alias("found"))
    wide = stored(wide, "open-windows")
    release(spark)
    bits = _may_be_in(source, wide)
    some = usable.withColumn("bit", _bit()).mapInArrow(_filtering(bits, True), "id long, tie int, bit long, text string")
    # joined once for all rounds
    opened = stored(wide.join(some, ["id", "tie"]).select("id", "tie", "text", "found"), "open-texts")
    discard(wide)
    release(spark)
    more = _in_rounds(opened, lambda turn: _second_pass(depth, groups, turn), _second_groups, "second-pass")
    discard(opened)
    every = stored(_all([*decided, *more]).groupBy("id", "tie").agg(F.collect_list("spans").alias("found")), "spans")
    discard(*found, *more)
    release(spark)
    bits = _may_be_in(source, every)
    marked = source.withColumn("bit", F.when(F.col("id").isNotNull(), _bit()).otherwise(F.lit(0)))
    schema = f"id long, {RESULT}"

    def whole(batches):
        for batch in slices(batches):
            batch = batch.filter(pa.array(~_held_or_null(batch, bits.value)))
            yield pa.RecordBatch.from_pydict({"id": batch["id"], **_removed(as_bytes(batch["text"]), [None] * batch.num_rows)})

    def cut(batches):
        for batch in slices(batches, 64):
            yield pa.RecordBatch.from_pydict({"id": batch["id"], **_removed(as_bytes(batch["text"]), batch["found"].to_pylist())})

    untouched = marked.mapInArrow(whole, schema)
    touched = marked.where("id is not null").mapInArrow(_filtering(bits, True), "id long, tie int, bit long, text string").join(every, ["id", "tie"], "left").select("id", "text", "found").mapInArrow(cut, schema)
    return untouched.union(touched).withColumnRenamed("id", id_col)


def _held_or_null(batch, bits) -> np.ndarray:
    at = batch["bit"].to_numpy()
    return (at > 0) & (bits[np.maximum(at - 1, 0) >> 3] >> (np.maximum(at - 1, 0) & 7) & 1 == 1)


def _filtering(bits, inside: bool):
    def run(batches):
        for batch in slices(batches):
            yield batch.select(["id", "tie", "bit", "text"]).filter(pa.array(_held(batch, bits.value) == inside))

    return run
