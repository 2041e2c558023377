"""Stateful operators of the stream: incidents whose deliveries may fail, the ceiling on opens, and window
rules on a clock. Each does to a stream, batch by batch, what its batch form does to a table.

State is kept in Spark's state store: a row for each incident key, a few numbers for each window rule.
Rows of one micro-batch are taken in order of (ts, id)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import clock, incidents, semantic

FOLD = "last long, fed long, n long"


def _ordered(chunks: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch; the trigger's options bound how many there are."""
    return pd.concat(list(chunks)).sort_values(["us_", "id"], kind="stable")


class DeliveryFold(StatefulProcessor):
    """incidents.delivered_dispositions() for one key. With `idle` (seconds) a key without firings for so
    long is forgotten by the store itself."""

    def __init__(self, ttl_us: int, names: list[str], idle: float | None):
        self.ttl_us, self.names, self.idle = ttl_us, names, idle

    def init(self, handle) -> None:
        self.fold = handle.getValueState("fold", FOLD, ttlDurationMs=int(self.idle * 1000)) if self.idle else handle.getValueState("fold", FOLD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, fed, n = self.fold.get() if self.fold.exists() else (-1, -1, 0)
        state = (None if last < 0 else last, None if fed < 0 else fed, n)
        pdf, out = _ordered(rows), []
        for us, wait, stateful, known, ok, gone in zip(pdf.us_, pdf.wait_, pdf.stateful_, pdf.known_type_, pdf.delivery_ok_, pdf.gone_, strict=True):
            state, *told = incidents.delivery_step(state, us, wait, self.ttl_us, stateful, known, ok, gone)
            out.append(told)
        self.fold.update(tuple(int(-1 if x is None else x) for x in state))
        added = pd.DataFrame(out, columns=["incident", "disposition", "counts_as_fed"], index=pdf.index).astype({"incident": "Int64"})
        yield pd.concat([pdf[self.names], added], axis=1)

    def close(self) -> None:
        pass


class CeilingFold(StatefulProcessor):
    """incidents.with_ceiling() over a stream: one state for all keys, read and written for the keys of
    the micro-batch only, and the opens of the last minute."""

    def __init__(self, ttl_us: int, feed_us: int, ceiling: int, names: list[str]):
        self.ttl_us, self.feed_us, self.ceiling, self.names = ttl_us, feed_us, ceiling, names

    def init(self, handle) -> None:
        self.keys = handle.getMapState("keys", "key string", FOLD)
        self.recent = handle.getValueState("recent", "opens string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us_", "id", "key"], kind="stable")
        recent = json.loads(self.recent.get()[0]) if self.recent.exists() else []
        known, numbers, kinds = {}, [], []
        for own, us in zip(pdf.key, pdf.us_, strict=True):
            if own not in known:
                known[own] = self.keys.getValue((own,)) if self.keys.containsKey((own,)) else None
            last, fed, n = known[own] or (None, 0, 0)
            if last is not None and us - last < self.ttl_us:
                what = "fed" if us - fed >= self.feed_us else "throttled"
                known[own] = (us, us if what == "fed" else fed, n)
            else:
                recent = [x for x in recent if us - x <= 60_000_000]
                what = "rate_limited" if len(recent) >= self.ceiling else "opened"
                if what == "opened":
                    recent.append(int(us))
                    n += 1
                    known[own] = (us, us, n)
            numbers.append(n)
            kinds.append(what)
        for own, fold in known.items():
            if fold:
                self.keys.updateValue((own,), tuple(map(int, fold)))
        self.recent.update((json.dumps(recent),))
        yield pdf[self.names].assign(incident=numbers, disposition=kinds)

    def close(self) -> None:
        pass


# names that a processor gets must not begin with an underscore
def _timed(firings: DataFrame, feed: float | str) -> DataFrame:
    wait = F.col(feed) if isinstance(feed, str) else F.lit(float(feed))
    return firings.withColumns({"us_": F.unix_micros(F.col("ts").cast("timestamp")), "wait_": (wait * 1_000_000).cast("long")})


def _with(firings: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*firings.schema.fields, *(T.StructField(k, t) for k, t in columns.items())])


def stream_deliveries(firings: DataFrame, ttl: float = incidents.TTL, feed: float | str = incidents.FEED_INTERVAL, idle: float | None = None) -> DataFrame:
    """incidents.delivered_dispositions() over a stream of firings with their deliveries' results."""
    given = {f"{k}_": F.coalesce(F.col(k), F.lit(v)) if k in firings.columns else F.lit(v) for k, v in incidents.DELIVERY.items()}
    fold = DeliveryFold(int(ttl * 1e6), firings.columns, max(idle, ttl) if idle else None)
    schema = _with(firings, incident=T.LongType(), disposition=T.StringType(), counts_as_fed=T.BooleanType())
    return _timed(firings, feed).withColumns(given).groupBy("key").transformWithStateInPandas(fold, schema, "Append", "ProcessingTime" if idle else "None")


def stream_ceiling(firings: DataFrame, ceiling: int, ttl: float = incidents.TTL, feed: float = incidents.FEED_INTERVAL) -> DataFrame:
    """incidents.with_ceiling() over a stream. The ceiling couples all keys, so one task takes a
    micro-batch's firings; history it never sees again."""
    fold = CeilingFold(int(ttl * 1e6), int(feed * 1e6), ceiling, firings.columns)
    schema = _with(firings, incident=T.LongType(), disposition=T.StringType())
    return _timed(firings, feed).withColumn("all_", F.lit(0)).groupBy("all_").transformWithStateInPandas(fold, schema, "Append", "None")


class ClockFold(StatefulProcessor):
    """clock.Clocks over a stream. A timer wakes the shard at the next tick at which something is due,
    when the watermark tells that all rows of the tick are here, so rules are evaluated whether or not
    rows arrive."""

    def __init__(self, every: int, ceiling: int):
        self.every, self.ceiling = every, ceiling

    def init(self, handle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("clocks", "state string")

    def _clocks(self) -> clock.Clocks:
        clocks = clock.Clocks(self.every, self.ceiling)
        return clocks.restore(json.loads(self.saved.get()[0])) if self.saved.exists() else clocks

    def _wait(self, clocks: clock.Clocks) -> None:
        self.saved.update((json.dumps(clocks.state()),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        tick = clocks.next()
        if tick is not None:
            self.handle.registerTimer((tick + self.every) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clocks = self._clocks()
        for pdf in rows:
            found = pdf.groupby(["rule_id", "tick"]).agg(n=("id", "size"), top=("id", "max"), window=("window_seconds", "max"), spike=("spike_lines", "max"))
            for (rule, tick), (n, top, window, spike) in zip(found.index, found.itertuples(index=False), strict=True):
                clocks.add(int(rule), int(tick), n, top, window, spike)
        self._wait(clocks)
        yield pd.DataFrame([], columns=[x.split()[0] for x in clock.EVALUATED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clocks = self._clocks()
        out = clocks.run(timerValues.getCurrentWatermarkInMs() // 1000 // self.every * self.every - self.every)
        self._wait(clocks)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in clock.EVALUATED.split(", ")])

    def close(self) -> None:
        pass


def stream_clocked_gate(rows: DataFrame, every: int = clock.EVERY, ceiling: int = 0, late: str = "0 seconds") -> DataFrame:
    """clock.clocked_gate() over a stream of rows (rule_id, tick, id, ts, window_seconds, spike_lines); tick
    is ts rounded down to the clock."""
    slim = rows.select(clock.shard(ceiling).alias("shard"), "rule_id", "tick", "id", "window_seconds", "spike_lines", F.col("ts").cast("timestamp").alias("at"))
    return slim.withWatermark("at", late).groupBy("shard").transformWithStateInPandas(ClockFold(every, ceiling), clock.EVALUATED, "Append", "EventTime")


def start_rules(
    rows: DataFrame, out: str, rules: Callable[[], DataFrame], every: int = clock.EVERY, ceiling: int = 0, scorer=semantic.keyword_scorer, late: str = "0 seconds", **trigger
) -> tuple[StreamingQuery, Callable[[], StreamingQuery]]:
    """Judge window rules over a stream of their rows (rule_id, tick, id, ts, source, severity, severity_text,
    program, body, window_seconds, spike_lines).

    The first query keeps the rows under `out`/rows; the function returned starts the second, which
    evaluates on the clock, judges each window from the rows kept and writes the trace under its batch's
    number, so that a batch that is replayed replaces its own trace and none is written twice."""
    spark: SparkSession = rows.sparkSession
    trigger = trigger or {"processingTime": "1 second"}
    kept = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/_rows").trigger(**trigger).start()

    def judging() -> StreamingQuery:
        schema = spark.read.parquet(f"{out}/rows").schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{out}/rows")

        def judge(evaluated: DataFrame, n: int) -> None:
            evaluated = evaluated.persist()
            try:
                since = evaluated.agg(F.min("since")).first()[0]
                if since is None:
                    return
                held = spark.read.schema(schema).parquet(f"{out}/rows").where(F.col("tick") > since)
                clock.trace(clock.windows(held, evaluated), evaluated, rules(), scorer).write.mode("overwrite").parquet(f"{out}/trace/batch={n}")
            finally:
                evaluated.unpersist()

        gated = stream_clocked_gate(stream, every, ceiling, late)
        return gated.writeStream.foreachBatch(judge).option("checkpointLocation", f"{out}/_trace").trigger(**trigger).start()

    return kept, judging
