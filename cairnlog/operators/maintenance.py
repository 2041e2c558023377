"""Retention, and bulk changes to the small tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.predicates import week_start
from .outbox import latest_per_key


BLOOM = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("source", "program")}


def _at(when: datetime):
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def write_weeks(events: DataFrame, path: str) -> None:
    """Append to the weekly partitions; within a file rows are sorted so that statistics skip, and Bloom
    filters tell which files have a source or program at all."""
    rows = events.withColumn("week_start", week_start(F.col("ts")))
    rows.repartition("week_start", F.pmod(F.hash("source"), F.lit(16))).sortWithinPartitions("week_start", "source", "ts").write.mode("append").options(**BLOOM).partitionBy("week_start").parquet(path)


def expired_weeks(weeks: DataFrame, as_of: datetime, keep_days: int = 90) -> DataFrame:
    """Weeks (week_start) that ended before the kept days began."""
    return weeks.where(F.date_add("week_start", 7).cast("timestamp_ntz") <= _at(as_of) - F.expr(f"interval {keep_days} days"))


def kept_events(events: DataFrame, as_of: datetime, keep_days: int = 90) -> DataFrame:
    ended = F.date_add(week_start(F.col("ts")), 7).cast("timestamp_ntz")
    return events.where(ended > _at(as_of) - F.expr(f"interval {keep_days} days"))


def drop_expired(spark: SparkSession, path: str, as_of: datetime, keep_days: int = 90) -> list[str]:
    """Delete the expired partitions of a table written by write_weeks; 0 days keeps all. A second
    call finds nothing left to do."""
    if not keep_days:
        return []
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(root) if s.getPath().getName().startswith("week_start=")]
    if not names:
        return []
    weeks = spark.createDataFrame([(n.partition("=")[2],) for n in names], "w string").select(F.col("w").cast("date").alias("week_start"))
    gone = sorted(str(r.week_start) for r in expired_weeks(weeks, as_of, keep_days).collect())
    for w in gone:
        store.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/week_start={w}"), True)
    return gone


def start_retention(spark: SparkSession, path: str, keep_days: int = 90, every: str = "1 day", now: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None)) -> StreamingQuery:
    """A job that drops expired partitions of a table written by write_weeks, now and then every so often,
    until it is stopped. A pass that fails is tried again with the next one."""

    def sweep(_: DataFrame, n: int) -> None:
        try:
            drop_expired(spark, path, now(), keep_days)
        except Exception as error:  # the store may be away for a while
            warnings.warn(f"retention pass {n} failed: {error}", stacklevel=2)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(sweep).trigger(processingTime=every).start()


def deactivate_quiet(sources: DataFrame, as_of: datetime, quiet_days: int) -> DataFrame:
    quiet = F.col("last_seen") < _at(as_of) - F.expr(f"interval {quiet_days} days")
    return sources.withColumn("active", F.col("active") & ~quiet)


def prune(rows: DataFrame, column: str, as_of: datetime, keep_days: int) -> DataFrame:
    return rows.where(F.col(column) >= _at(as_of) - F.expr(f"interval {keep_days} days"))


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A new snapshot: changes (seq, op, and the table's columns) replace or delete rows by key; the
    last change of a key counts."""
    last = latest_per_key(changes, keys)
    kept = table.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.where("op = 'upsert'").select(*table.columns))


def cascade(table: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """table without the rows whose parent was removed."""
    return table.join(removed.select(key).distinct(), key, "left_anti")
