"""Bit and byte codes of the tile files, for reading and writing single values, and tag sets as Arrow batches.

Bits run from the lowest of each byte.  A bounded number takes a bit for each power of two that may still be in it; a number without
bound is its octave in zero bits, a one bit, and the bounded rest.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, MapType, StringType, StructField, StructType


class BitWriter:
    def __init__(self):
        self.word = self.size = 0

    def bit(self, value: bool) -> None:
        self.word |= bool(value) << self.size
        self.size += 1

    def bounded(self, most: int, value: int) -> None:
        """A number from 0 to ``most``."""
        step = 1
        while step <= most:
            if value & step:
                most -= step
            self.bit(value & step)
            step <<= 1

    def number(self, value: int) -> None:
        """Any number from 0."""
        octave = (value + 1).bit_length() - 1
        self.size += octave
        self.bit(True)
        self.bounded((1 << octave) - 1, value + 1 - (1 << octave))

    def noisy(self, value: int, bits: int) -> None:
        """A number whose lowest bits are noise."""
        self.bounded((1 << bits) - 1, value & ((1 << bits) - 1))
        self.number(value >> bits)

    def difference(self, value: int, bits: int) -> None:
        """A signed number with noisy bits around 0; its sign comes last, unless it is 0."""
        if bits > 0:
            value += 1 << (bits - 1)
            self.bounded((1 << bits) - 1, value & ((1 << bits) - 1))
            value >>= bits
        self.number(abs(value))
        if value:
            self.bit(value < 0)

    def sorted_numbers(self, values: list[int]) -> None:
        """How many ascending numbers, and their steps."""
        self.number(len(values))
        last = 0
        for v in values:
            self.number(v - last)
            last = v

    def close(self) -> bytes:
        return self.word.to_bytes(-(-self.size // 8), "little")


class BitReader:
    def __init__(self, raw: bytes):
        self.word, self.at = int.from_bytes(raw, "little"), 0

    def bit(self) -> int:
        self.at += 1
        return self.word >> (self.at - 1) & 1

    def bounded(self, most: int) -> int:
        value, step = 0, 1
        while value | step <= most:
            if self.bit():
                value |= step
            step <<= 1
        return value

    def number(self) -> int:
        most = 0
        while not self.bit():
            most = 2 * most + 1
        return most + self.bounded(most)

    def noisy(self, bits: int) -> int:
        low = self.bounded((1 << bits) - 1)
        return self.number() << bits | low

    def difference(self, bits: int) -> int:
        low = self.bounded((1 << bits) - 1) if bits > 0 else 0
        value = self.number()
        if value and self.bit():
            value = -value
        return (value << bits) + low - (1 << (bits - 1)) if bits > 0 else value

    def sorted_numbers(self) -> list[int]:
        out, last = [], 0
        for _ in range(self.number()):
            last += self.number()
            out.append(last)
        return out


def noisy_bits(values: list[int], most: int = 14) -> int:
    """How many low bits of these differences are noise: those that at least half of the numbers fill."""
    bits = 0
    while bits < most and values and 2 * sum(abs(v) >= 1 << bits for v in values) >= len(values) - len(values) % 2:
        bits += 1
    return bits


def write_varint(value: int) -> bytes:
    """An unsigned number in groups of seven bits, lowest first."""
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def write_signed(value: int) -> bytes:
    """A signed number as twice its amount, plus one below zero."""
    return write_varint(-value << 1 | 1 if value < 0 else value << 1)


def read_varint(raw: bytes, at: int = 0) -> tuple[int, int]:
    """The number and the place behind it."""
    value = shift = 0
    while True:
        value |= (raw[at] & 0x7F) << shift
        shift += 7
        at += 1
        if raw[at - 1] < 0x80:
            return value, at


def read_signed(raw: bytes, at: int = 0) -> tuple[int, int]:
    value, at = read_varint(raw, at)
    return (-(value >> 1) if value & 1 else value >> 1), at


class TagSets:
    """A Huffman code of tag sets by how often they occur (ties: their text)."""

    def __init__(self, counts: dict[str, int]):
        heap = [(n, text, None) for text, n in counts.items()]
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), (a, b)))
        self.codes: dict[str, list[int]] = {}
        walk = [(heap[0], [])] if heap else []
        while walk:
            (_, text, children), code = walk.pop()
            if children is None:
                self.codes[text] = code
            else:
                walk += [(children[0], [*code, 0]), (children[1], [*code, 1])]
        self.texts = {tuple(code): text for text, code in self.codes.items()}

    def write(self, out: BitWriter, text: str) -> None:
        for bit in self.codes[text]:
            out.bit(bit)

    def read(self, source: BitReader) -> str:
        code: tuple = ()
        while code not in self.texts:
            code += (source.bit(),)
        return self.texts[code]

    def bits(self, counts: dict[str, int]) -> int:
        return sum(n * len(self.codes[text]) for text, n in counts.items())


def tag_set_counts(ways: DataFrame, text: Column) -> DataFrame:
    """(text, n): how often each tag set occurs, for a code of its own."""
    return ways.groupBy(text.alias("text")).agg(F.count("*").alias("n"))


def encoded_tags(df: DataFrame, tags: list[tuple[str, list[str]]], column: str = "tags") -> DataFrame:
    """``df`` with ``code``: for each tag of the dictionary that is set, how many were skipped, and its value's number (1: an unknown value).

    Each row's code is read back at once; one that doesn't give its tags again is an error.
    """
    order = [(k, {v: i + 2 for i, v in enumerate(values)}) for k, values in tags]
    schema = StructType([*df.schema.fields, StructField("code", BinaryType())])

    def run(batches):
        for batch in batches:
            codes = []
            for row in batch.column(batch.schema.get_field_index(column)).to_pylist():
                held = dict(row or [])
                numbers = [(i, values.get(held[k], 1)) for i, (k, values) in enumerate(order) if held.get(k)]
                out, last = BitWriter(), -1
                for i, number in numbers:
                    out.number(i - last)
                    out.bounded(len(order[i][1]) + 1, number)
                    last = i
                out.number(0)
                code = out.close()
                if _numbers(code, order) != numbers:
                    raise ValueError(f"tags don't survive their code: {held}")
                codes.append(code)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], names=[*batch.schema.names, "code"])

    return df.mapInArrow(run, schema)


def _numbers(code: bytes, order) -> list[tuple[int, int]]:
    source, at, out = BitReader(code), -1, []
    while step := source.number():
        at += step
        out.append((at, source.bounded(len(order[at][1]) + 1)))
    return out


def decoded_tags(df: DataFrame, tags: list[tuple[str, list[str]]], name: str = "decoded") -> DataFrame:
    """``df`` with the tags of its ``code`` as a map; values that weren't known are ``unknown``."""
    order = [(k, {v: i + 2 for i, v in enumerate(values)}) for k, values in tags]
    schema = StructType([*df.schema.fields, StructField(name, MapType(StringType(), StringType()))])

    def run(batches):
        for batch in batches:
            found = [[(tags[i][0], "unknown" if n < 2 else tags[i][1][n - 2]) for i, n in _numbers(code, order)] for code in batch.column(batch.schema.get_field_index("code")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.map_(pa.string(), pa.string()))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def file_digests(spark, path: str) -> DataFrame:
    """(path, size, md5, crc) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.md5("content").alias("md5"), F.crc32("content").alias("crc"))
