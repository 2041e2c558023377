"""Registered queries that run the streaming services over the given tables: the events arrive in two
parts, the service runs after each and goes on from its checkpoint, and what it wrote is returned.

Importing this module adds them to the catalog. Their SQL is that of the batch: a service that stops
between the parts must end with what one run over everything gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as S
from ..streaming import pipeline, registry
from .catalog import _FIRST, DIMS, ORACLE_SQL, ROUTE_SQL, TEMPLATES_SQL, _route_sql, logs, register

CUT = "2024-01-15 00:00:00"  # the second part begins here
GONE = 2  # the rule that is taken away between the parts in o12_rule_refresh
_SECOND = f"coalesce(ts >= timestamp '{CUT}', true)"


def _serve(spark: SparkSession, d: str, decide: bool = False, deliver: Callable[[DataFrame, int], None] | None = None, gone: int | None = None) -> str:
    """Run the pipeline over the events in two parts and return its folder. With `decide` its incident
    query runs after each part too; rule `gone` is not there any more in the second part."""
    arrivals, out = S.shared_folder(spark, "arrivals"), S.shared_folder(spark, "service")
    rows, second = S.log_events(spark, d), F.coalesce(F.col("ts") >= F.lit(CUT).cast("timestamp_ntz"), F.lit(True))
    for part, left in ((~second, None), (second, gone)):
        rules = S.rules(spark).where(F.lit(True) if left is None else F.col("rule_id") != left)
        rows.where(part).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(rows.schema).parquet(arrivals)
        events, incident_query = pipeline.start(stream, out, lambda rules=rules: (rules, S.bindings(spark), S.targets(spark)), 7200, 3600, deliver, availableNow=True)
        events.awaitTermination()
        if decide:
            incident_query().awaitTermination()
    return out


@register("s02_stream_events", logs("select id, ts, source, program, severity, cast(date_trunc('week', ts) as date) as week_start from log_events"))
def s02(spark, d):
    """The weekly events table as micro-batches write it; events of any time land in their own week."""
    return spark.read.parquet(f"{_serve(spark, d)}/events").select("id", "ts", "source", "program", "severity", "week_start")


@register("s16_stream_templates", f"with {TEMPLATES_SQL} select fp, arg_min(template, id) as template, count(*) as hits, {_FIRST} from t group by fp")
def s16(spark, d):
    """The template registry that batches merge into."""
    return registry.registry(spark, f"{_serve(spark, d)}/templates").select("fp", "template", F.col("hits").cast("long").alias("hits"), "first_seen", "last_seen", "first_id")


@register("j10_stream_incidents", ORACLE_SQL["q13_incidents"])
def j10(spark, d):
    """Incidents from state by key, which the second run takes up where the first one left it."""
    return spark.read.parquet(f"{_serve(spark, d, decide=True)}/decided").select("id", "rule_id", "target_id", "key", "disposition")


@register("s21_stream_outbox", ORACLE_SQL["q15_outbox"])
def s21(spark, d):
    """What was handed to the delivery function, here one that writes each batch under its number."""
    box = S.shared_folder(spark, "delivered")
    _serve(spark, d, True, lambda messages, n: messages.write.mode("overwrite").parquet(f"{box}/batch={n}"))
    return spark.read.parquet(box).drop("options", "batch")


@register("o12_rule_refresh", f"""select id, rule_id, target_id from (with {ROUTE_SQL} select * from routed where not {_SECOND})
  union all select id, rule_id, target_id from (with {_route_sql(DIMS, f"(select * from rules where rule_id <> {GONE})", "binds")} select * from routed where {_SECOND})""")
def o12(spark, d):
    """Firings where a rule is taken away while the service runs."""
    return spark.read.parquet(f"{_serve(spark, d, gone=GONE)}/firings").select("id", "rule_id", "target_id")


_HALF = "(select max(id) // 2 from log_events)"


@register("q10_live_tail", logs(f"""select id, source, false as tail from (select * from log_events where id <= {_HALF} and severity >= 9 order by id desc limit 200)
  union all select id, source, true from log_events where id > {_HALF} and severity >= 9"""))
def q10(spark, d):
    """A feed's backfill of 200 events, and all that came after it."""
    arrivals, to, seat = (S.shared_folder(spark, k) for k in ("arrivals", "feed", "feed-checkpoint"))
    rows = S.log_events(spark, d)
    half = rows.agg(F.max("id")).first()[0] or 0
    for part in (F.col("id") <= half // 2, F.col("id") > half // 2):
        rows.where(part).write.mode("append").parquet(arrivals)
        pipeline.feed(spark, arrivals, rows.schema, F.col("severity") >= 9, lambda df, n: df.write.mode("overwrite").parquet(f"{to}/batch={n}"), seat, 200, availableNow=True).awaitTermination()
    return spark.read.parquet(to).select("id", "source", (F.col("batch") >= 0).alias("tail"))
