"""The incremental pipeline: raw lines to events, firings, incidents, ledger and outbox.

Rows keep their arrival order (id); event time is a label, so nothing is dropped as late. Rules are
read again at the start of every micro-batch. State is one small row per incident key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.decode import decode_lines
from ..functions.predicates import week_start
from ..functions.templates import merge_sources, merge_templates, source_delta, template_delta
from ..operators import incidents, outbox, routing, semantic
from ..sources.tables import number_lines
from .registry import merge_batch

BATCH_LINES = 1 << 40  # ids of one micro-batch
STATE = "last long, fed long, incident long"
IDLE = 7 * 86_400.0  # seconds without a firing after which a key is forgotten


def decode_stream(lines: DataFrame) -> DataFrame:
    """A stream of (id, raw, received_at, peer) decoded; one stateless projection per format."""
    return decode_lines(lines)


def live_tail(events: DataFrame, test) -> DataFrame:
    """New events that pass a feed's filters, as they arrive."""
    return events.where(test)


def feed(spark: SparkSession, path: str, schema: T.StructType, test, deliver: Callable[[DataFrame, int], None], checkpoint: str, backfill: int = 200, **trigger) -> StreamingQuery:
    """A live feed: the newest `backfill` events of the table at `path` that pass the test, then new ones
    as they are written.

    The highest id at the start is where one hands over to the other: the backfill takes events up to
    it, the stream those above, so none is missing or comes twice while the table is written to; ids
    grow in order of arrival. The place is kept beside the checkpoint, so a feed that starts again goes
    on from it. deliver gets the backfill as batch -1."""
    store = spark._jvm.org.apache.hadoop.fs
    mark = store.Path(f"{checkpoint}-handover")
    if store.Path(str(mark)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(store.Path(mark, "_SUCCESS")):
        top = spark.read.parquet(mark.toString()).first().top
    else:
        events = spark.read.schema(schema).parquet(path)
        top = events.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        deliver(events.where(test & (F.col("id") <= top)).orderBy(F.col("id").desc()).limit(backfill).orderBy("id"), -1)
        spark.createDataFrame([(top,)], "top long").write.mode("overwrite").parquet(mark.toString())
    fresh = live_tail(spark.readStream.schema(schema).parquet(path), test & (F.col("id") > top))
    return fresh.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def window_counts(events: DataFrame, size: str, slide: str | None = None, spike: int = 1, late: str = "10 minutes") -> DataFrame:
    """Event-time windows per source with at least `spike` events; ts must be a timestamp."""
    at = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(at.alias("w"), "source").agg(F.count("*").alias("n")).where(F.col("n") >= spike).select("source", F.col("w.start").alias("start"), "n")


def stream_dispositions(firings: DataFrame, ttl: float = incidents.TTL, feed: float = incidents.FEED_INTERVAL, idle: float | None = None) -> DataFrame:
    """The incident fold of operators.incidents over a stream of firings (key, id, ts, ...): rows of
    one micro-batch are taken in order of (ts, id), and state carries over to the next. With `idle`, a
    key without firings for so many seconds of processing time, and never less than the TTL, is
    forgotten: its next firing opens an incident anyway, and numbers begin again. Such a stream never
    ends by itself, so runs over what is available take no `idle`."""
    ttl_us, feed_us = int(ttl * 1e6), int(feed * 1e6)
    names, wait = firings.columns, int(max(idle or 0, ttl) * 1000)
    out = T.StructType([*firings.schema.fields, T.StructField("incident", T.LongType()), T.StructField("disposition", T.StringType())])

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, fed, incident = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(pdfs)).sort_values(["ts", "id"])
        numbers, kinds = [], []
        for us in rows.ts.astype("datetime64[us]").astype("int64"):
            if last is None or us - last >= ttl_us:
                incident, fed, kind = incident + 1, us, "opened"
            elif us - fed >= feed_us:
                fed, kind = us, "fed"
            else:
                kind = "throttled"
            last = us
            numbers.append(incident)
            kinds.append(kind)
        state.update((int(last), int(fed), int(incident)))
        if idle:
            state.setTimeoutDuration(wait)
        yield rows[names].assign(incident=numbers, disposition=kinds)

    return firings.groupBy("key").applyInPandasWithState(fold, out, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def stream_gate(ticks: DataFrame, window_seconds: int = 3600, spike_lines: int = 100) -> DataFrame:
    """semantic.gate() over a stream of (rule_id, tick, new_rows), one row for each rule and tick; rules'
    own settings come as columns window_seconds and spike_lines. State is two numbers for each rule."""
    own = lambda k, default: F.coalesce(F.col(k).cast("long"), F.lit(default)) if k in ticks.columns else F.lit(default).cast("long")
    rows = ticks.select("rule_id", "tick", "new_rows", own("window_seconds", window_seconds).alias("window"), own("spike_lines", spike_lines).alias("spike"))

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pending = state.get if state.exists else (None, 0)
        out = []
        for tick, new, window, spike in pd.concat(list(pdfs)).sort_values("tick")[["tick", "new_rows", "window", "spike"]].itertuples(index=False):
            if last is None:
                last = tick
                continue
            pending, elapsed = pending + new, tick - last
            if pending and elapsed >= semantic.FLOOR_SECONDS and (elapsed >= window or pending >= spike):
                out.append((key[0], tick, pending, elapsed, "spike" if pending >= spike else "interval"))
                last, pending = tick, 0
        state.update((int(last), int(pending)))
        yield pd.DataFrame(out, columns=["rule_id", "tick", "pending", "elapsed", "trigger"])

    return rows.groupBy("rule_id").applyInPandasWithState(fold, semantic.GATED, "last long, pending long", "append", GroupStateTimeout.NoTimeout)


def snapshot(spark: SparkSession, path: str, delta: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch_id: int) -> None:
    """Merge a batch's rows into a registry kept as numbered snapshots: the newest one below this
    batch is read, a new one written, and that newest one kept, so that a batch that is replayed
    writes the same snapshot again. Snapshots below it go."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    older = sorted(n for n in _snapshots(spark, path) if n < batch_id)
    new = merge(spark.read.parquet(f"{path}/v{older[-1]}"), delta) if older else delta
    new.write.mode("overwrite").parquet(f"{path}/v{batch_id}")
    for n in older[:-1]:
        store.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}"), True)


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots that are written whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    whole = lambda s: store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return [int(s.getPath().getName()[1:]) for s in store.listStatus(root) if whole(s)]


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v{max(_snapshots(spark, path))}")


def start(
    lines: DataFrame,
    out: str,
    rules: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    ttl: float = incidents.TTL,
    feed: float = incidents.FEED_INTERVAL,
    deliver: Callable[[DataFrame, int], None] | None = None,
    **trigger,
) -> tuple[StreamingQuery, Callable[[], StreamingQuery]]:
    """Run the pipeline on a stream of raw lines, or of events that are decoded already; returns the event query and a function that starts
    the incident query over the firings written so far.

    Under `out`: events by week, templates and sources as registries, firings, and after the second
    query decided, ledger, audit and outbox. Batches are written under their number, so a replayed
    batch replaces its own files. `rules` gives (rules, bindings, targets), asked anew each batch."""
    spark = lines.sparkSession
    trigger = trigger or {"processingTime": "1 second"}
    raw = "raw" in lines.columns

    def batch(df: DataFrame, n: int) -> None:
        if raw and "id" not in df.columns:  # lines of files, which are numbered within their batch
            df = decode_stream(number_lines(df, n * BATCH_LINES))
        df = df.persist()
        try:
            df.withColumn("week_start", week_start(F.col("ts"))).withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "week_start").parquet(f"{out}/events")
            merge_batch(spark, f"{out}/templates", template_delta(df), "fp", merge_templates, n)
            merge_batch(spark, f"{out}/sources", source_delta(df), "source", merge_sources, n)
            r, b, _ = rules()
            fired = routing.route_any(df.select("id", "ts", "source", "severity", "severity_text", "program", "body"), routing.compile_rules(r, b))
            fired.withColumn("key", incidents.dedup_key()).write.mode("overwrite").parquet(f"{out}/firings/batch={n}")
        finally:
            df.unpersist()

    events = (decode_stream(lines) if raw and "id" in lines.columns else lines).writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/_events").trigger(**trigger).start()

    def incident_query() -> StreamingQuery:
        schema = spark.read.parquet(f"{out}/firings").drop("batch").schema
        fired = spark.readStream.schema(schema).parquet(f"{out}/firings/*")

        def record(df: DataFrame, n: int) -> None:
            df = df.persist()
            try:
                r, _, t = rules()
                df.write.mode("overwrite").parquet(f"{out}/decided/batch={n}")
                incidents.ledger(df, r).write.mode("overwrite").parquet(f"{out}/ledger/batch={n}")
                incidents.audit(df).write.mode("overwrite").parquet(f"{out}/audit/batch={n}")
                messages = outbox.outbox(df, r, t)
                messages.write.mode("overwrite").parquet(f"{out}/outbox/batch={n}")
                if deliver:  # what was written, so that messages are rendered once
                    deliver(spark.read.schema(messages.schema).parquet(f"{out}/outbox/batch={n}"), n)
            finally:
                df.unpersist()

        idle = None if {"availableNow", "once"} & set(trigger) else IDLE
        return stream_dispositions(fired, ttl, feed, idle).writeStream.foreachBatch(record).option("checkpointLocation", f"{out}/_incidents").trigger(**trigger).start()

    return events, incident_query
