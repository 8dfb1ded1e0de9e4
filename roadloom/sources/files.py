"""Readers of map, raster and list files as DataFrames."""

from __future__ import annotations

import io
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NODES = "nid bigint, ilon int, ilat int, tags map<string,string>"
WAYS = "wid bigint, tags map<string,string>, nodes array<bigint>"
RELATIONS = "rid bigint, tags map<string,string>, members array<struct<type:string,role:string,ref:bigint>>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of a protocol buffer message; value is an int or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _packed(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = _varint(data, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def _running(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def block(raw: bytes):
    """('node' | 'way' | 'relation', row) of a primitive block."""
    parts: dict[int, list] = {}
    for n, v in _fields(raw):
        parts.setdefault(n, []).append(v)
    strings = [v.decode() for n, v in _fields(parts[1][0]) if n == 1]
    step, lat0, lon0 = (parts.get(n, [d])[0] for n, d in ((17, 100), (19, 0), (20, 0)))
    to_lon = lambda v: int(((lon0 + step * v) * 1e-9 + 180) * 1e6 + 0.5)
    to_lat = lambda v: int(((lat0 + step * v) * 1e-9 + 90) * 1e6 + 0.5)
    zig = lambda v: (v >> 1) ^ -(v & 1)
    tags_of = lambda f: dict(zip([strings[i] for i in _packed(f.get(2, b""))], [strings[i] for i in _packed(f.get(3, b""))], strict=True))
    for group in parts.get(2, []):
        for n, v in _fields(group):
            if n not in (1, 2, 3, 4):
                continue
            f = dict(_fields(v))
            if n == 1:
                yield "node", (zig(f[1]), to_lon(zig(f[9])), to_lat(zig(f[8])), tags_of(f))
            elif n == 2:
                ids, lats, lons = (_running(_packed(f[k], True)) for k in (1, 8, 9))
                keys, at = _packed(f.get(10, b"")), 0
                for i, nid in enumerate(ids):
                    tags = {}
                    while at < len(keys) and keys[at]:
                        tags[strings[keys[at]]] = strings[keys[at + 1]]
                        at += 2
                    at += 1
                    yield "node", (nid, to_lon(lons[i]), to_lat(lats[i]), tags)
            elif n == 3:
                yield "way", (f[1], tags_of(f), _running(_packed(f.get(8, b""), True)))
            else:
                roles, refs, kinds = _packed(f.get(8, b"")), _running(_packed(f.get(9, b""), True)), _packed(f.get(10, b""))
                yield "relation", (f[1], tags_of(f), [(("node", "way", "relation")[k], strings[r], i) for r, i, k in zip(roles, refs, kinds, strict=True)])


def blobs(path: str):
    """(offset, size) of the data blobs of a file."""
    with open(path, "rb") as f:
        while head := f.read(4):
            fields = dict(_fields(f.read(int.from_bytes(head, "big"))))
            if fields[1] == b"OSMData":
                yield f.tell(), fields[3]
            f.seek(fields[3], 1)


def blob(path: str, offset: int, size: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(offset)
        fields = dict(_fields(f.read(size)))
    return fields[1] if 1 in fields else zlib.decompress(fields[3])


class OsmPbf(DataSource):
    """Map extracts, one partition for each blob: ``spark.read.format('osm_pbf').option('kind', 'node').load(path)``.

    The path must be one that all executors can open.
    """

    @classmethod
    def name(cls):
        return "osm_pbf"

    def schema(self):
        return {"node": NODES, "way": WAYS, "relation": RELATIONS}[self.options.get("kind", "node")]

    def reader(self, schema):
        return _PbfReader(self.options["path"], self.options.get("kind", "node"))


class _PbfReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path.removeprefix("file://"), kind

    def partitions(self):
        return [InputPartition(x) for x in blobs(self.path)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value:
            for kind, row in block(blob(self.path, *partition.value)):
                if kind == self.kind:
                    yield row


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of a map extract."""
    spark.dataSource.register(OsmPbf)
    return tuple(spark.read.format("osm_pbf").option("kind", k).load(path) for k in ("node", "way", "relation"))


def read_hgt(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, ele) of ``.hgt`` rasters, zipped or not; row 0 is in the south; missing heights are null."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content, strict=True):
                if name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        data = z.read(next(n for n in z.namelist() if n.lower().endswith(".hgt")))
                raw = np.frombuffer(data, ">i2")
                size = int(len(raw) ** 0.5)
                for at, line in enumerate(raw.reshape(size, size)):
                    v = line.astype("float64")
                    v[line == -32768] = np.nan
                    yield pd.DataFrame({"path": name, "row": size - 1 - at, "col": np.arange(size), "ele": pd.array(np.where(np.isnan(v), None, v), dtype="Int16")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, col int, ele smallint")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, ele) of ASCII grids; row 0 is in the south; the file's missing value is null."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    head = lambda k: F.regexp_extract("value", rf"(?i){k}\s+(-?[0-9.]+)", 1)
    rows = text.select("path", head("nrows").cast("int").alias("n"), head("nodata_value").cast("double").alias("none"), F.posexplode(F.filter(F.split("value", "\n"), lambda x: x.rlike("^\\s*-?[0-9]"))).alias("at", "line"))
    cells = rows.select("path", (F.col("n") - 1 - F.col("at")).alias("row"), "none", F.posexplode(F.split(F.trim("line"), "\\s+")).alias("col", "v"))
    value = F.col("v").cast("double")
    return cells.select("path", "row", "col", F.when(~value.eqNullSafe(F.col("none")), value).cast("smallint").alias("ele"))


def read_pseudo_tags(spark: SparkSession, path: str) -> DataFrame:
    """(section, id, tags) of a file with ``#####nodetags#####`` and ``#####waytags#####`` sections of ``;`` separated lines; empty is absent.

    A line's section follows from its place among the few section and header lines, so that no window over the whole file is needed.
    Plain files are read in splits; a compressed one is one split.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    marks = lines.where(F.col("value").startswith("#####")).orderBy("at").collect()
    heads = {r["at"]: r["value"] for r in lines.where(F.col("value").rlike("^(losmid|id);")).collect()}
    out = None
    for number, mark in enumerate(marks):
        end = marks[number + 1]["at"] if number + 1 < len(marks) else None
        names = next((v.split(";") for at, v in sorted(heads.items()) if at > mark["at"] and (end is None or at < end)), None)
        if names is None:
            continue
        mine = lines.where((F.col("at") > mark["at"]) & (F.col("at") < end if end is not None else F.lit(True)) & F.col("value").rlike("^[0-9]+;"))
        v = F.split("value", ";", -1)
        tags = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names[1:]]), F.slice(v, F.lit(2), F.lit(len(names) - 1))), lambda k, x: x != "")
        rows = mine.select(F.lit(mark["value"].strip("#")).alias("section"), v[0].cast("bigint").alias("id"), tags.alias("tags"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "section string, id bigint, tags map<string,string>")


def read_poly(spark: SparkSession, path: str) -> DataFrame:
    """(path, ring_no, negative, ring) of region files."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    body = F.regexp_replace("value", r"^[^\n]*\n", "")
    rings = text.select("path", F.posexplode(F.filter(F.split(body, r"\nEND"), lambda r: r.rlike(r"[0-9]\s+-?[0-9]"))).alias("ring_no", "r"))
    lines = F.filter(F.split("r", "\n"), lambda x: x.rlike(r"^\s+-?[0-9.]+(E[+-]?[0-9]+)?\s+-?[0-9.]+"))
    ring = F.transform(lines, lambda x: F.struct(F.split(F.trim(x), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(x), r"\s+")[1].cast("double").alias("y")))
    return rings.select("path", "ring_no", F.col("r").rlike(r"^\s*!").alias("negative"), ring.alias("ring"))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, lon, lat, ele) of track points."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    points = F.regexp_extract_all("value", F.lit(r"(?s)(<trkpt.*?(?:</trkpt>|/>))"), F.lit(1))
    rows = text.select("path", F.posexplode(points).alias("seq", "p"))
    get = lambda rx: F.regexp_extract("p", rx, 1).try_cast("double")
    return rows.select("path", "seq", get(r'lon="([^"]*)"').alias("lon"), get(r'lat="([^"]*)"').alias("lat"), get(r"<ele>([^<]*)</ele>").alias("ele"))


def read_suspects(spark: SparkSession, path: str) -> DataFrame:
    """(id, prio, triggers) of lines ``id prio [triggers]``."""
    p = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where(F.col("value").rlike("^\\s*[0-9]+\\s+[0-9]+")).select(p[0].cast("bigint").alias("id"), p[1].cast("int").alias("prio"), F.when(F.size(p) > 2, p[2].cast("int")).otherwise(0).alias("triggers"))


def with_fallback(primary: DataFrame, secondary: DataFrame, tile: str) -> DataFrame:
    """The primary table, and of the secondary the tiles that the primary hasn't."""
    return primary.unionByName(secondary.join(primary.select(tile).distinct(), tile, "left_anti"))
