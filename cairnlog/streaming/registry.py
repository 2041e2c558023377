"""Registries that a stream keeps as files: rows by key, dealt into buckets by a hash of it.

A micro-batch reads and writes the buckets of its own keys only, so what it writes follows the batch and
not the registry. Each write is a version under the batch's number; of every bucket the newest version
below the running batch is kept, so that a batch that is replayed merges with the same rows again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _store(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of each bucket, oldest first; writes that were not completed do not count."""
    store, at = _store(spark, path)
    found: dict[int, list[int]] = {}
    if store.exists(at(path)):
        for version in store.listStatus(at(path)):
            name = version.getPath().getName()
            if name.startswith("v=") and store.exists(at(version.getPath(), "_SUCCESS")):
                for bucket in store.listStatus(version.getPath()):
                    if bucket.getPath().getName().startswith("bucket="):
                        found.setdefault(int(bucket.getPath().getName()[7:]), []).append(int(name[2:]))
    return {k: sorted(v) for k, v in found.items()}


def _read(spark: SparkSession, path: str, chosen: dict[int, int]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*(f"{path}/v={v}/bucket={k}" for k, v in sorted(chosen.items()))).drop("v", "bucket")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """All rows: of each bucket the newest version."""
    return _read(spark, path, {k: v[-1] for k, v in versions(spark, path).items()})


def merge_batch(spark: SparkSession, path: str, delta: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int, buckets: int = BUCKETS) -> None:
    """Merge a batch's rows into the registry. merge(old rows, new rows) is given the rows of the batch's
    buckets; it must keep one row a key."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    delta = delta.persist()  # read twice: what it is made from is gone through once
    try:
        touched = [r.bucket for r in delta.select(bucket.alias("bucket")).distinct().collect()]  # at most `buckets`
        if not touched:
            return
        known = versions(spark, path)
        below = {k: [v for v in known.get(k, []) if v < batch] for k in touched}
        chosen = {k: v[-1] for k, v in below.items() if v}
        rows = merge(_read(spark, path, chosen), delta) if chosen else delta
        rows.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={batch}")
    finally:
        delta.unpersist()
    store, at = _store(spark, path)
    for k, older in below.items():
        for v in older[:-1]:
            store.delete(at(f"{path}/v={v}/bucket={k}"), True)
            if not any(s.getPath().getName().startswith("bucket=") for s in store.listStatus(at(f"{path}/v={v}"))):
                store.delete(at(f"{path}/v={v}"), True)
