"""Shared pieces of the corpus operators: reading, cutting lineage, packed exchanges, words and their hashes."""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a maximal run of characters outside this class.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, which the driver and all executors share: under
    spark.checkpoint.dir. Where that is unset, a local master has the machine's temporary folder; a cluster has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/lorewell-{spark.sparkContext.applicationId}"


#: Folders made so far, so that whoever runs operators one after another can tell which are whose.
MADE: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the scratch folder."""
    MADE.append(f"{scratch(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders wherever Spark can write."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bucketed tables made so far and not dropped.
TABLES: set[str] = set()


def remove_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, those in the catalogue too; call it when no result is read any
    more."""
    for table in sorted(TABLES):
        spark.sql(f"drop table if exists {table}")
    TABLES.clear()
    remove(spark, scratch(spark))


class Stored:
    """Tables of one run by name: written once as Parquet, read back, and deleted when the run has no use for them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.buckets = spark, {}, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Store df; an older table of the name is deleted after df is written, which may read it."""
        path = shared_dir(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def put_buckets(self, df: DataFrame, name: str, by: str | list[str], n: int) -> DataFrame:
        """Store df in n buckets by one column or more: what is grouped or joined by those meets it without its being
        shuffled again. df should be partitioned by them already, or have few rows a task."""
        path, table = shared_dir(self.spark, name), f"lorewell_{uuid.uuid4().hex}"
        df.write.bucketBy(n, *([by] if isinstance(by, str) else by)).option("path", path).format("parquet").saveAsTable(table)
        self.drop(name)
        self.paths[name], self.buckets[name] = path, table
        TABLES.add(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.buckets:
                TABLES.discard(self.buckets[name])
                self.spark.sql(f"drop table if exists {self.buckets.pop(name)}")
            if name in self.paths:
                remove(self.spark, self.paths.pop(name))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, and lost executors lose nothing."""
    return Stored(df.sparkSession).put(df, name)


def give_back() -> None:
    """Python workers serve task after task: hand memory that a step has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library


def tidy(step):
    """An Arrow map step that gives its memory back when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def partitions(spark: SparkSession) -> int:
    """How many parts the packed exchanges deal out to. The user sizes spark.sql.shuffle.partitions to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, lower: bool, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end of every word of UTF-8 data. Words take in eight bytes at a time, all words of a
    text together, each step mixed before the next; long words go through BLAKE2b one by one. So no pattern of letters
    (as there is for polynomials modulo 2**64) makes two words equal. Another salt gives other hashes."""
    b = np.zeros(len(data) + 8, np.uint8)
    b[: len(data)] = np.frombuffer(data, np.uint8)
    if lower:
        b = TO_LOWER[b]
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(IS_SPACE[b[: len(data)]], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    size = end - start
    eight = np.ndarray((len(data) + 1,), "<u8", b, strides=(1,))  # eight bytes from every place on
    h = size.astype(np.uint64) * _SPREAD + np.uint64(salt)
    on, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(on):
        left = (size[on] - at).astype(np.uint64)
        piece = eight[start[on] + at]
        short = left < 8
        piece[short] &= (np.uint64(1) << (left[short] << np.uint64(3))) - np.uint64(1)
        h[on] = mix(h[on] ^ piece)
        at += 8
        on = on[size[on] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(b[start[i] : end[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    return h, start, end


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive words; none if there are fewer. Runs of 1, 2, 4 words and so on are
    mixed from two halves, and n is put together from those."""
    m = len(words) - n + 1
    if m < 1 or n < 1:
        return np.empty(0, np.uint64)
    out, run, size, at = None, words, 1, 0
    while size <= n:
        if n & size:
            piece = run[at : at + m]
            out = piece if out is None else mix(out * _SPREAD + piece)
            at += size
        run = mix(run[:-size] * _SPREAD + run[size:]) if 2 * size <= n else run
        size *= 2
    return out


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit integers as differences of the fewest whole bytes that hold the largest; width first."""
    if not len(x):
        return b""
    step = np.diff(x, prepend=np.uint64(0))
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bytes([width]) + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    part = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    full = np.zeros((len(part), 8), np.uint8)
    full[:, : data[0]] = part
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)
