"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

Ids are renumbered by their rank in the corpus, most frequent first, so that most take one byte.  Four numbers share a
control byte that holds their lengths (1 to 4 bytes, two bits each, the first number lowest); the numbers' bytes, little
end first, follow in a stream of their own.  Reading is a numpy look-up of whole control bytes: lengths, then places,
then values.

A file is a run of blocks, each: magic ``RLTK``, documents (u32), ids (u64), data bytes (u64), then for each
document a null flag (u8), its doc_id (i64) and count of ids (u32), then the control bytes and the data bytes.  Beside
the files, ``ranks.bin`` holds the token id (u32) of each rank.  Files are written under another name and renamed, so a
task that is lost or runs twice does no harm.  Each file holds one range of doc_id, in ascending order.

Texts are encoded piece by piece at ASCII white space, and printable ASCII words by runs of letters, digits and runs of other
symbols, with the pieces' ids remembered for the task.  This equals encoding the whole text for tokenizers that
drop white space and split letters, digits and punctuation, such as ``word_bpe_49k.json``; with others pass ``pieces=False``.

Defined results: null and empty texts hold the end id only; null ids sort first; rows with the same doc_id stand side by
side; an empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, give_back, new_folder, slices, stored, tidied

MAGIC = b"RLTK"
#: For each control byte the lengths of its four numbers, and where each starts after the first.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
TOTALS = LENGTHS.sum(axis=1)
STARTS = np.cumsum(LENGTHS, axis=1) - LENGTHS
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
BLOCK_IDS = 1 << 20
#: Pieces that a worker remembers from one task to the next.
KEPT = 60_000


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    values = np.ascontiguousarray(values, "<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    quads = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    quads[: len(values)] = extra
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4) <= extra[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers again."""
    marks = np.frombuffer(control, np.uint8)
    totals = TOTALS[marks]
    begins = np.cumsum(totals) - totals
    at = (begins[:, None] + STARTS[marks]).reshape(-1)[:count]
    masks = MASKS[(LENGTHS[marks].reshape(-1)[:count]) - 1]
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    return (padded[at] | padded[at + 1] << 8 | padded[at + 2] << 16 | padded[at + 3] << 24) & masks if count else np.zeros(0, np.uint32)


#: Words that fall apart into runs of letters, digits and runs of symbols; apostrophes and special tokens have rules of their own.
PLAIN = re.compile(rb"[!-&(-~]+")
PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
ENDS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: The same with the letters of Latin-1, which are composed already and have one lower case each.
LATIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
LATIN_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Byte-level models name bytes by characters: printable ones by themselves, the others from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*_SEEN}))}


class Encoder:
    """Encodes texts with a tokenizer file, with a bounded memory of pieces."""

    def __init__(self, path: str, pieces: bool = True, most: int = 400_000):
        # a task is one thread's work; the library's thread pool only spins beside it.  The library reads this at each call
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.packs = [struct.Struct(f"<{n}{self.kind.char}").pack for n in range(32)]
        self.pieces, self.most, self.known, self.former = pieces, most, {}, {}
        suffix = getattr(self.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        # whether the model alone does for ASCII pieces: what comes before it must leave them as they are
        probes = [*map(chr, [*range(33, 65), *range(91, 127)]), "the", "zqxjkv", "...", "--", "$$$", "!?)"]
        self.direct = all(self.model_ids(p.encode()) == self._encode([p])[0] for p in probes)
        letters = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
        probes = [*letters, "".join(letters[:31]), "".join(letters[31:]), "straße", "Éa", "zqÿxj"]
        self.latin = self.direct and all(self.latin_ids(p.lower()) == self._encode([p])[0] for p in probes)

    def model_ids(self, piece: bytes) -> bytes:
        """The ids of one ASCII piece by the tokenizer's model alone."""
        return self._ids(piece.decode())

    def latin_ids(self, piece: str) -> bytes:
        """The same for one piece of lower-case Latin-1 letters."""
        return self._ids(piece.encode().decode("latin-1").translate(BYTE_NAMES))

    def _ids(self, piece: str) -> bytes:
        found = self.model.tokenize(piece)
        return self.packs[len(found)](*[t.id for t in found]) if len(found) < len(self.packs) else np.array([t.id for t in found], self.kind).tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters only, encoded as one text: each has one end-of-word id, its last."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._encode(words)
        raw, width = ids.tobytes(), self.kind.itemsize
        ends = (ends * width).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _split(text: bytes) -> list[bytes]:
        # ASCII capitals are the same to the tokenizer, but for the names of special tokens
        return (text if b"<|" in text else text.lower()).split()

    def _learn(self, fresh: set[bytes]) -> None:
        """Adds the ids of words that are not known yet."""
        known, ids = self.known, self.model_ids
        words, others = [], []
        for w in fresh:
            core = w.rstrip(ENDS) if self.direct else b""
            if core.isalpha() and core.islower():
                if core not in known:
                    known[core] = ids(core)
                if len(core) < len(w):
                    end = w[len(core) :]
                    if end not in known:
                        known[end] = ids(end)
                    known[w] = known[core] + known[end]
            elif self.direct and PLAIN.fullmatch(w) and b"<|" not in w and w == w.lower():
                parts = PARTS.findall(w)
                for p in parts:
                    if p not in known:
                        known[p] = ids(p)
                known[w] = b"".join([known[p] for p in parts])
            else:
                text = w.decode()
                if self.latin and LATIN.fullmatch(text) and "<|" not in text:
                    parts = LATIN_PARTS.findall(text.lower())
                    for p in parts:
                        if (key := p.encode()) not in known:
                            known[key] = self.latin_ids(p)
                    known[w] = b"".join([known[p.encode()] for p in parts])
                else:
                    (words if text.isalpha() else others).append(text)
        for some, encode in ((words, self._words), (others, self._encode)):
            for at in range(0, len(some), 256):
                known.update(zip([w.encode() for w in some[at : at + 256]], encode(some[at : at + 256]), strict=True))

    def batch(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian numbers."""
        if not self.pieces:
            return self._encode([(t or b"").decode() for t in texts])
        if len(self.known) > self.most:  # what was used since the last time is kept, the rest forgotten
            self.former, self.known = self.known, {}
        known, former = self.known, self.former
        docs = [self._split(t) if t else [] for t in texts]
        fresh = set().union(*docs) - known.keys()
        again = fresh & former.keys()
        known.update(zip(again, map(former.__getitem__, again), strict=True))
        self._learn(fresh - again)
        return [b"".join(map(known.__getitem__, d)) for d in docs]

    def forget(self, keep: int = 0) -> None:
        """Gives the memory of pieces back but for the first ones met, which are the frequent ones: a worker that waits for another task should hold little."""
        self.known, self.former = dict(islice(self.known.items(), keep)), {}


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def shared_encoder(path: str, pieces: bool) -> Encoder:
    """This process's encoder of the file."""
    if (path, pieces) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, pieces] = Encoder(path, pieces)
    return _ENCODERS[path, pieces]


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str, pieces: bool) -> DataFrame:
    """Of each document: ``id``, a hash of the text to order equal ids, and the ids, as a table in the shared folder."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))

    def run(batches):
        encoder = shared_encoder(tokenizer, pieces)
        end = b"" if end_id is None else np.array([end_id], encoder.kind).tobytes()
        try:
            for batch in slices(batches):
                ids = [x + end for x in encoder.batch(as_bytes(batch["text"]))]
                yield pa.RecordBatch.from_pydict({"id": batch["id"], "tie": batch["tie"], "width": pa.array([encoder.kind.itemsize] * len(ids), pa.int32()), "ids": pa.array(ids, pa.binary())})
        finally:
            encoder.forget(KEPT)
            give_back()

    return stored(source.mapInArrow(run, "id long, tie long, width int, ids binary"), "token-ids")


def _arrays(batch) -> Iterator[np.ndarray]:
    for width, ids in zip(batch["width"].to_pylist(), batch["ids"].to_pylist(), strict=True):
        yield np.frombuffer(ids, f"<u{width}")


def ranks(table: DataFrame) -> np.ndarray:
    """The token ids in order of falling frequency over all documents (ties: smaller id); as many as the vocabulary at most."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in slices(batches):
            found = [*_arrays(batch)]
            counts = np.bincount(np.concatenate(found)) if found else total
            total, counts = (total, counts) if len(total) >= len(counts) else (counts, total)
            total[: len(counts)] += counts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    counts = table.select("width", "ids").mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r.id for r in sorted(counts.collect(), key=lambda r: (-r.n, r.id))], np.uint32)


def _block(ids: list[int | None], arrays: list[np.ndarray], rank: np.ndarray) -> bytes:
    values = rank[np.concatenate(arrays)] if arrays else np.zeros(0, np.uint32)
    control, data = pack(values)
    head = [np.array([len(ids)], "<u4"), np.array([len(values), len(data)], "<u8"), np.array([x is None for x in ids], "u1"), np.array([x or 0 for x in ids], "<i8"), np.array([len(a) for a in arrays], "<u4")]
    return b"".join([MAGIC, *(x.tobytes() for x in head), control, data])


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", pieces: bool = True) -> tuple[str, list[dict]]:
    """Encodes all documents into files of ``folder``; returns the folder and, in order of doc_id, each file's name, documents, ids and first position."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    table = encoded(docs, tokenizer, end_id, id_col, text_col, pieces)
    order = ranks(table)
    rank = np.zeros(int(order.max()) + 1 if len(order) else 0, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    held = spark.sparkContext.broadcast(rank)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/ranks.bin") as out:
        out.write(order.astype("<u4").tobytes())

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        number = TaskContext.get().partitionId()
        name, draft = f"part-{number:06d}.rltk", f"{path}/.draft-{uuid.uuid4().hex}"
        n_docs = n_ids = waiting = 0
        ids, arrays, out = [], [], None
        for batch in slices(batches):
            for key, array in zip(batch["id"].to_pylist(), _arrays(batch), strict=True):
                ids.append(key)
                arrays.append(array)
                n_docs, n_ids, waiting = n_docs + 1, n_ids + len(array), waiting + len(array)
                if waiting >= BLOCK_IDS:
                    out = out or store.open_output_stream(draft)
                    out.write(_block(ids, arrays, held.value))
                    ids, arrays, waiting = [], [], 0
        if ids:
            out = out or store.open_output_stream(draft)
            out.write(_block(ids, arrays, held.value))
        if out:
            out.close()
            store.move(draft, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"number": [number], "name": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    made = table.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "width", "ids").mapInArrow(tidied(run), "number long, name string, n_docs long, n_ids long").collect()
    files, start = [], 0
    for r in sorted(made, key=lambda r: r.number):
        files.append({"name": r.name, "n_docs": r.n_docs, "n_ids": r.n_ids, "start": start})
        start += r.n_ids
    return folder, files


def blocks(stream, order: np.ndarray):
    """(doc_ids, counts, token ids) of each block of an open file."""
    while stream.read(4) == MAGIC:
        n_docs = int(np.frombuffer(stream.read(4), "<u4")[0])
        n_ids, n_data = map(int, np.frombuffer(stream.read(16), "<u8"))
        nulls = np.frombuffer(stream.read(n_docs), "u1")
        ids = np.frombuffer(stream.read(8 * n_docs), "<i8")
        counts = np.frombuffer(stream.read(4 * n_docs), "<u4")
        control = stream.read(-(-n_ids // 4))
        yield [None if z else int(x) for z, x in zip(nulls, ids, strict=True)], counts, order[unpack(control, stream.read(n_data), n_ids)]


def read(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """The files' documents: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids``, little-endian unsigned 32-bit numbers."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{path}/ranks.bin") as source:
            order = np.frombuffer(source.read(), "<u4")
        for batch in batches:
            for name, start in zip(batch["name"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with store.open_input_stream(f"{path}/{name}") as stream:
                    for ids, counts, tokens in blocks(stream, order):
                        ends = np.cumsum(counts, dtype=np.int64)
                        raw = tokens.astype("<u4").tobytes()
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(ids, pa.int64()),
                            "start": pa.array(start + ends - counts, pa.int64()),
                            "n_tokens": pa.array(counts, pa.int64()),
                            "ids": pa.array([raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary()),
                        })
                        start += len(tokens)

    listed = spark.createDataFrame([(f["name"], f["start"]) for f in files], "name string, start long")
    return listed.repartition(len(files)).mapInArrow(tidied(run), schema)
