"""Helpers that several operators of this subpackage use: written intermediate tables, Arrow text
access in tasks, word hashing with numpy, and connected components as DataFrame joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- written tables


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where
    the session has none and runs on this machine alone (tests and local runs)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again. A lost executor
    then costs only the tasks that read from here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def drop_saved(*tables: DataFrame) -> None:
    """Delete the files of tables that saved() returned and that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- text in Arrow batches


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or binary) column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary()).fill_null(b"")
    buffers = wide.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = 512 << 10) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, so that numpy work arrays stay small; one longer row
    is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


# --------------------------------------------------------------------------- hashing

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = _U(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(max(n, 1 << 16), _R if kind == "up" else _R_INVERSE, np.uint64)
        base[0] = 1
        _powers[kind] = np.cumprod(base)
    return _powers[kind][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span data[start:end], equal for equal bytes wherever they stand.
    It is a polynomial over random byte values taken from prefix sums, then mixed."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE if table is None else table)[data] * _power("up", n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in data, and for each row of offsets the
    number of words before it (n + 1 values). Offsets count from the first byte of data."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~space[1:-1]
    starts = np.flatnonzero(inside & (space[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (space[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the A-Z-lower-cased words, and the number of words before each row (n + 1)."""
    starts, ends, rows = word_spans(data, offsets)
    return (span_hashes(data, starts, ends, _LOWER_BYTE) if len(starts) else np.zeros(0, np.uint64)), rows


# --------------------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every id that occurs in edges (a, b): the smallest id reachable.

    Alternating large-star and small-star steps; minima are partial aggregates and edges meet them
    in plain joins of written tables, so a hub with very many links is split by AQE and never
    gathered in one task. Every step's edges are written to the shared folder."""
    current = saved(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    while True:
        both = current.select("u", "v").union(current.select(F.col("v"), F.col("u")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc")
        # large star: every larger neighbour v of u now points to the least neighbour of u
        large = both.toDF("u", "v").where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        step = saved(large.distinct(), "cc")
        # small star: u and its smaller neighbours point to the least of them
        least2 = saved(step.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = step.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = saved(small.union(least2.select("u", F.col("m").alias("v"))).distinct(), "cc")
        drop_saved(least, step, least2, current)
        current = after
        # a forest of stars: every u has one v, and no v is a u
        marks = current.select("u", F.lit(0).alias("root")).union(current.select("v", F.lit(1)).distinct())
        if marks.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            roots = current.select(F.col("v").alias("id")).distinct()
            return current.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
                roots.select("id", F.col("id").alias("component_id"))
            )
