"""Folding firings into incidents: open, feed, throttle, with a rate ceiling on opens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import written
from .ranges import ceiling_decisions, hot_dispositions

TTL = 7200.0
FEED_INTERVAL = 60.0
OPEN_CEILING = 120
#: Incidents of up to so many firings are folded in one array, whose result grows by copying.
ARRAY_ROWS = 1_000
#: Firings of a key beyond which it is folded in ranges of time.
HOT_ROWS = 1_000_000


def dedup_key(rule="rule_id", target="target_id", source="source"):
    return F.concat_ws(":", F.col(rule).cast("string"), F.col(target).cast("string"), F.col(source))


def number_incidents(firings: DataFrame, ttl: float = TTL) -> DataFrame:
    """firings (key, id, ts) with incident: a new one where ttl or more has passed since the key's
    last firing, throttled or not."""
    own = W.partitionBy("key").orderBy("ts", "id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(own)
    new = F.when(gap.isNull() | (gap >= int(ttl * 1e6)), 1).otherwise(0)
    return firings.withColumn("new", new).withColumn("incident", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def dispositions(firings: DataFrame, ttl: float = TTL, feed: float | str = FEED_INTERVAL) -> DataFrame:
    """firings with incident and disposition: opened, fed or throttled. A firing feeds when `feed`
    seconds (a number, or a column for a cooldown per rule) have passed since the last open or feed
    of its incident; the throttled ones between do not count, so the fold goes row by row.

    The fold runs within incidents, in Arrow batches sorted by incident: state is three numbers, so
    a key with any number of firings needs no more memory than one batch."""
    return folded_feeds(number_incidents(firings, ttl), feed)


def folded_feeds(numbered: DataFrame, feed: float | str = FEED_INTERVAL) -> DataFrame:
    """numbered firings (key, incident, id, ts) with their disposition."""
    wait = F.col(feed) if isinstance(feed, str) else F.lit(float(feed))
    rows = numbered.withColumns({"_us": F.unix_micros(F.col("ts").cast("timestamp")), "_wait": (wait * 1_000_000).cast("long")})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fed = None, 0
        for pdf in batches:
            out = []
            for k, n, us, wait in zip(pdf.key, pdf.incident, pdf._us, pdf._wait, strict=True):
                if (k, n) != key:
                    key, fed = (k, n), us
                    out.append("opened")
                elif us - fed >= wait:
                    fed = us
                    out.append("fed")
                else:
                    out.append("throttled")
            pdf["disposition"] = out
            yield pdf.drop(columns=["_us", "_wait"])

    schema = T.StructType([*numbered.schema.fields, T.StructField("disposition", T.StringType())])
    return rows.repartition("key").sortWithinPartitions("key", "ts", "id").mapInPandas(fold, schema)


def split_dispositions(firings: DataFrame, ttl: float = TTL, feed: float | str = FEED_INTERVAL, hot_rows: int = HOT_ROWS) -> DataFrame:
    """dispositions() where one key may hold any share of the firings: keys of more than hot_rows are
    folded in ranges of time, in as many tasks as they need, the others as ever. The firings are written
    first, as they are read again. A hot key whose rows have different cooldowns stays one task's work."""
    rows = written(firings, "firings")
    wait = F.col(feed) if isinstance(feed, str) else F.lit(float(feed))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct(wait).alias("waits"))
    hot = [r.key for r in counts.where((F.col("n") > hot_rows) & (F.col("waits") == 1)).select("key").collect()]  # at most one in hot_rows rows
    if not hot:
        return dispositions(rows, ttl, feed)
    keys = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], "key string"))
    timed = rows.join(keys, "key").select(*rows.columns).withColumns({"_us": F.unix_micros(F.col("ts").cast("timestamp")), "_wait": (wait * 1_000_000).cast("long")})
    rest = dispositions(rows.join(keys, "key", "left_anti"), ttl, feed)
    return rest.withColumn("incident", F.col("incident").cast("long")).unionByName(hot_dispositions(timed, int(ttl * 1e6)))


DELIVERY = {"stateful": True, "known_type": True, "delivery_ok": True, "gone": False}


def delivery_step(state: tuple, us: int, wait: int, ttl: int, stateful: bool, known: bool, ok: bool, gone: bool) -> tuple:
    """(state, incident, disposition, counts_as_fed) of a key's next firing; state is its last firing and
    last feed that touched an incident, and the number of that."""
    last, fed, n = state
    live = last is not None and us - last < ttl
    due = live and us - fed >= wait
    if not known:
        return state, None, "fallback", False
    if live and not due:
        return (us, fed, n), n, "throttled", False
    if due and not (stateful and gone):
        counts = bool(ok or not stateful)
        return (us, us if counts else fed, n), n, "fed" if ok else "fallback", counts
    if ok:
        return (us, us, n + 1), n + 1, "opened", True
    return state, None, "fallback", False


def delivered_dispositions(firings: DataFrame, ttl: float = TTL, feed: float | str = FEED_INTERVAL) -> DataFrame:
    """dispositions() where deliveries may fail: firings may have the columns of DELIVERY, null or missing
    being its default. Adds incident, disposition and counts_as_fed.

    A target of an unknown type, or an open that fails, is a fallback and makes or touches no incident
    (incident is null). A feed that fails is a fallback too: for a stateful target the incident is
    bumped without counting as fed, so that the next firing feeds again; for a stateless one it counts.
    A stateful feed whose handle is gone opens a new incident."""
    wait = F.col(feed) if isinstance(feed, str) else F.lit(float(feed))
    given = {k: F.coalesce(F.col(k), F.lit(v)) if k in firings.columns else F.lit(v) for k, v in DELIVERY.items()}
    rows = firings.withColumns({"_us": F.unix_micros(F.col("ts").cast("timestamp")), "_wait": (wait * 1_000_000).cast("long"), **{f"_{k}": c for k, c in given.items()}})
    ttl_us, names = int(ttl * 1e6), firings.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, (None, None, 0)
        for pdf in batches:
            out = []
            for k, us, wait, stateful, known, ok, gone in zip(pdf.key, pdf._us, pdf._wait, pdf._stateful, pdf._known_type, pdf._delivery_ok, pdf._gone, strict=True):
                if k != key:
                    key, state = k, (None, None, 0)
                state, *told = delivery_step(state, us, wait, ttl_us, stateful, known, ok, gone)
                out.append(told)
            added = pd.DataFrame(out, columns=["incident", "disposition", "counts_as_fed"], index=pdf.index).astype({"incident": "Int64"})
            yield pd.concat([pdf[names], added], axis=1)

    schema = T.StructType([*firings.schema.fields, T.StructField("incident", T.LongType()), T.StructField("disposition", T.StringType()), T.StructField("counts_as_fed", T.BooleanType())])
    return rows.repartition("key").sortWithinPartitions("key", "ts", "id").mapInPandas(fold, schema)


def array_dispositions(firings: DataFrame, ttl: float = TTL, feed: float = FEED_INTERVAL) -> DataFrame:
    """The same as one SQL fold over an array per incident, without Python, for incidents of up to
    ARRAY_ROWS firings; larger ones go through dispositions()."""
    own = W.partitionBy("key", "incident")
    numbered = number_incidents(firings, ttl).withColumn("size", F.count("*").over(own)).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    rest = [c for c in firings.columns if c not in ("key", "ts", "id")]
    listed = numbered.where(F.col("size") <= ARRAY_ROWS).groupBy("key", "incident").agg(F.array_sort(F.collect_list(F.struct("us", "id", "ts", *rest))).alias("m"))
    wait = int(feed * 1e6)
    fed_at = F.expr(f"""aggregate(m, named_struct('fed', m[0].us, 'out', cast(array() as array<string>)),
      (s, x) -> named_struct('fed', if(x.us - s.fed >= {wait}, x.us, s.fed),
        'out', concat(s.out, array(if(size(s.out) = 0, 'opened', if(x.us - s.fed >= {wait}, 'fed', 'throttled'))))), s -> s.out)""")
    rows = listed.withColumn("z", F.explode(F.arrays_zip(F.col("m").alias("m"), fed_at.alias("d"))))
    rows = rows.select("key", "z.m.id", "z.m.ts", *(f"z.m.{c}" for c in rest), "incident", F.col("z.d").alias("disposition"))
    large = numbered.where(F.col("size") > ARRAY_ROWS).select(*firings.columns, F.concat_ws("\0", "key", F.col("incident").cast("string")).alias("whole"), F.col("key").alias("own_key"), F.col("incident").alias("own_incident"))
    folded = dispositions(large.withColumn("key", F.col("whole")), ttl, feed).select(F.col("own_key").alias("key"), "id", "ts", *rest, F.col("own_incident").alias("incident"), "disposition")
    return rows.unionByName(folded)


def over_ceiling(opens: DataFrame, ceiling: int = OPEN_CEILING) -> DataFrame:
    """opens (id, ts) of stateful targets that stand in a trailing minute with more than `ceiling`
    of them, counted without a single global window: each open counts those of its own minute and
    the one before that are at most 60 s old, from counts per second."""
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = opens.withColumn("s", second)
    per = rows.groupBy("s").agg(F.count("*").alias("c"))
    reach = per.select(F.explode(F.sequence(F.col("s"), F.col("s") + 60)).alias("s"), "c").groupBy("s").agg(F.sum("c").alias("upto"))
    later = W.partitionBy("s").orderBy(F.col("ts").desc(), F.col("id").desc())
    rows = rows.join(reach, "s").withColumn("after", F.row_number().over(later) - 1)
    return rows.withColumn("trailing", F.col("upto") - F.col("after")).where(F.col("trailing") > ceiling).select("id", "ts", "trailing")


def with_ceiling(firings: DataFrame, ceiling: int, ttl: float = TTL, feed: float = FEED_INTERVAL, ranges: int | None = None) -> DataFrame:
    """Dispositions under a ceiling on opens per trailing 60 s over all keys; an open over it is
    rate_limited and makes no incident, so that the key's next firing tries again.

    Where no trailing minute of unconstrained opens exceeds the ceiling, the plain fold is exact. Else
    it is exact before the first such minute's last open; from there on ceiling_decisions() tells which
    firings open, in ranges of time that are folded in parallel. Feeds depend on the own key alone and
    are folded by key after that."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    names = firings.columns
    numbered = number_incidents(firings, ttl).withColumnRenamed("incident", "_session").withColumns({"_us": us, "_row": F.monotonically_increasing_id()})
    head = F.row_number().over(W.partitionBy("key", "_session").orderBy("_us", "id")) == 1
    plain = written(numbered.withColumn("_head", head), "ceiling-firings")
    first = over_ceiling(plain.where("_head").select("id", "ts"), ceiling).agg(F.min(us).alias("u")).first().u
    if first is None:
        return folded_feeds(plain.select(*names, F.col("_session").cast("long").alias("incident")), feed)
    before, later = plain.where(F.col("_us") < first), plain.where(F.col("_us") >= first)
    opens = before.where(F.col("_head") & (F.col("_us") >= first - 60_000_000)).select(F.lit(1).alias("kind"), F.lit("").alias("key"), F.col("_row").alias("session"), F.col("_us").alias("us"))
    live = later.select("key", "_session").distinct().join(before.select("key", "_session").distinct(), ["key", "_session"], "left_semi")
    state = opens.unionByName(live.select(F.lit(0).alias("kind"), "key", F.col("_session").cast("long").alias("session"), F.lit(-1).cast("long").alias("us")))
    rows = later.select(F.col("_row").alias("row"), "key", F.col("_session").cast("long").alias("session"), F.col("_us").alias("us"), "id")
    what, _, _ = ceiling_decisions(rows, state, ceiling, ranges)
    told = later.join(what.withColumnRenamed("row", "_row"), "_row").unionByName(before.withColumn("what", F.when(F.col("_head"), "opened").otherwise("on")))
    upto = W.partitionBy("key").orderBy("_us", "id").rowsBetween(W.unboundedPreceding, 0)
    told = told.withColumn("incident", F.sum(F.when(F.col("what") == "opened", 1).otherwise(0)).over(upto))
    limited = told.where("what = 'rate_limited'").select(*names, "incident", F.lit("rate_limited").alias("disposition"))
    return folded_feeds(told.where("what <> 'rate_limited'").select(*names, "incident"), feed).unionByName(limited)


def with_delivery(decided: DataFrame, known_types: tuple[str, ...] = ("push", "handoff")) -> DataFrame:
    """Final dispositions once delivery is known: decided has type and delivery_ok (default true).
    An unknown type or a failed delivery is a fallback; throttled firings deliver nothing."""
    failed = ~F.coalesce(F.col("type").isin(*known_types), F.lit(False)) | ~F.coalesce("delivery_ok", F.lit(True))
    return decided.withColumn("disposition", F.when(F.col("disposition").isin("opened", "fed") & failed, "fallback").otherwise(F.col("disposition")))


def current_incidents(decided: DataFrame) -> DataFrame:
    """The latest incident of each key: event_count, opened_at, last_event_at, last_fed_at. Firings that
    touched no incident (rate limited, or a failed open) count for none."""
    fed = F.col("counts_as_fed") if "counts_as_fed" in decided.columns else F.col("disposition").isin("opened", "fed")
    each = decided.where("disposition <> 'rate_limited' and incident is not null").groupBy("key", "incident").agg(
        F.count("*").alias("event_count"),
        F.min("ts").alias("opened_at"),
        F.max("ts").alias("last_event_at"),
        F.max(F.when(fed, F.col("ts"))).alias("last_fed_at"),
    )
    return each.groupBy("key").agg(F.max_by(F.struct("incident", "event_count", "opened_at", "last_event_at", "last_fed_at"), "incident").alias("x")).select("key", "x.*")


def last_fired(decided: DataFrame) -> DataFrame:
    return decided.where("disposition = 'opened'").groupBy("rule_id").agg(F.max("ts").alias("last_fired"))


def ledger(decided: DataFrame, rules: DataFrame) -> DataFrame:
    """The firing ledger: one row per firing with its summary, sample and whether anyone was told."""
    named = decided.join(rules.select("rule_id", "name"), "rule_id", "left")
    line = F.substring("body", 1, 500)
    return named.select(
        "id", "rule_id", "target_id", "source", F.col("ts").alias("fired_at"), F.col("key").alias("dedup_key"), "disposition",
        F.substring(F.concat(F.coalesce("name", F.lit("")), F.lit(": "), F.coalesce("body", F.lit(""))), 1, 500).alias("summary"),
        F.to_json(F.struct(F.col("disposition"), line.alias("line"))).alias("sample"),
        F.col("disposition").isin("opened", "fed").alias("notified"),
    )


def audit(decided: DataFrame) -> DataFrame:
    """One audit row per dispatch."""
    return decided.select(
        "id", F.lit("dispatcher").alias("actor"), F.concat(F.lit("dispatch."), F.col("disposition")).alias("action"),
        F.to_json(F.struct("rule_id", "target_id", "source")).alias("detail"),
        F.col("disposition").isin("opened", "fed", "throttled").alias("ok"),
    )


def audit_changes(changes: DataFrame, kind: str, key: str) -> DataFrame:
    """One audit row per change of a rule or target: changes has seq, op, actor, reason (of a refusal,
    else null) and the key column."""
    return changes.select(
        F.col("seq").alias("id"), "actor", F.concat(F.lit(f"{kind}."), F.col("op")).alias("action"),
        F.to_json(F.struct(key, "reason")).alias("detail"), F.col("reason").isNull().alias("ok"),
    )


def outages(evaluations: DataFrame, threshold_seconds: int = 86_400, bucket: str = "day") -> DataFrame:
    """evaluations (id, ts, ok, and scope if there are several): runs of failures that lasted the
    threshold, with the row at which each did (one notice) and the success that ends it.

    Runs are found within time buckets, in parallel. Only the first and the last run of a bucket can go
    on in another: these, two rows a bucket, are numbered together, and the rest are whole."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = evaluations if "scope" in evaluations.columns else evaluations.withColumn("scope", F.lit("all"))
    rows = rows.withColumn("bucket", F.date_trunc(bucket, "ts"))
    order = W.partitionBy("scope", "bucket").orderBy("ts", "id")
    turned = F.coalesce(F.col("ok") != F.lag("ok").over(order), F.lit(True)).cast("int")
    rows = rows.withColumn("turned", turned).withColumn("run", F.sum("turned").over(order.rowsBetween(W.unboundedPreceding, 0)))
    pieces = rows.groupBy("scope", "bucket", "run").agg(F.first("ok").alias("ok"), F.min("ts").alias("began"), F.max("ts").alias("last"), F.count("*").alias("failures"))
    own = W.partitionBy("scope", "bucket")
    pieces = pieces.withColumns({"next": F.lead("began").over(own.orderBy("run")), "edge": (F.col("run") == 1) | (F.col("run") == F.max("run").over(own))})
    whole = pieces.where("not edge and not ok").select("scope", "bucket", "run", "began", "last", "failures", F.col("next").alias("recovered_at"), F.struct("bucket", "run").alias("outage"))
    along = W.partitionBy("scope").orderBy("bucket", "run")
    edges = pieces.where("edge")
    goes_on = (F.col("ok") == F.lag("ok").over(along)) & ((F.col("bucket") != F.lag("bucket").over(along)))
    edges = edges.withColumns({"new": F.when(goes_on, 0).otherwise(1), "next": F.coalesce("next", F.lead("began").over(along))})
    edges = edges.withColumn("g", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    joint = W.partitionBy("scope", "g")
    edges = edges.select("scope", "bucket", "run", "ok", F.min("began").over(joint).alias("began"), F.max("last").over(joint).alias("last"), F.sum("failures").over(joint).alias("failures"), F.max_by("next", F.struct("bucket", "run")).over(joint).alias("recovered_at"), F.min(F.struct("bucket", "run")).over(joint).alias("outage"))
    found = whole.unionByName(edges.where("not ok").drop("ok")).where(us("last") - us("began") >= threshold_seconds * 1_000_000)
    late = rows.where("not ok").select("scope", "bucket", "run", "ts").join(found, ["scope", "bucket", "run"]).where(us("ts") - us("began") >= threshold_seconds * 1_000_000)
    return late.groupBy("scope", "outage").agg(F.first("began").alias("began"), F.first("failures").alias("failures"), F.min("ts").alias("notice_at"), F.first("recovered_at").alias("recovered_at")).drop("outage")
