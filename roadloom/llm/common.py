"""Helpers shared by the text operators: words, hashes, shared storage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of lower-cased UTF-8: digits, a-z and every byte of a non-ASCII character.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same words for Java and DuckDB regular expressions.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="roadloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and reads it back: no lineage to recompute, and no copy on one executor only."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored_at = path
    trim(df.sparkSession)
    return found


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has Spark remove the shuffled files of plans that are done with: it does so when the driver's collector finds the plans."""
    gc.collect()
    spark._jvm.System.gc()


def trim(spark: SparkSession) -> None:
    """Returns what the driver's Python and JVM have freed outside the JVM's heap to the system: plans and small jobs leave it scattered, and it adds up over a session."""
    give_back()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        lang, kinds, values = jvm.java.lang, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"), gateway.new_array(jvm.java.lang.Object, 4)
        classes = gateway.new_array(lang.Class, 4)
        for i, kind in enumerate(kinds):
            classes[i] = lang.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface's method, as the server's own class is not open to reflection
        lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", classes).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # only HotSpot on glibc has it
        pass


def settle(spark: SparkSession) -> None:
    """Has the driver collect what it is done with, on both sides, and return it to the system."""
    release(spark)
    trim(spark)


def give_back() -> None:
    """Returns a Python process's freed memory to the system: a worker waits for other tasks, whose own workers need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def tidied(run):
    """A function over record batches that gives its memory back when a task's batches are done with."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words after lower-casing A-Z; none for null."""
    return WORD.findall(text.lower()) if text else []


def slices(batches, rows: int = 512):
    """Record batches of at most so many rows, so that a task's memory doesn't follow the batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Memo(dict):
    """Remembers ``make(key)``, and forgets all when it holds too many keys."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def row_key(*columns: str):
    """A 64-bit identity of a row by the values of these columns; rows equal in them are interchangeable."""
    return F.xxhash64(*[F.col(c) for c in columns], F.lit("row"))
