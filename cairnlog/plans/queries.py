"""The public queries: search, timeline, sources, rules, back-test, history, feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators.outbox import redacted


def search_logs(events: DataFrame, source=None, contains=None, regex=None, program=None, severity_min=None, since=None, until=None, limit: int = 200) -> DataFrame:
    """Newest first; every condition is optional and all must hold. limit is capped at 2000."""
    test = P.severity_at_least(F.col("severity"), severity_min)
    if source:
        test &= P.glob_query(F.col("source"), source)
    if program:
        test &= P.glob_query(F.col("program"), program)
    if contains is not None:
        test &= P.contains_all(F.col("body"), contains)
    if regex:
        test &= F.col("body").rlike(regex)
    week = F.col("week_start") if "week_start" in events.columns else None
    test &= P.between(F.col("ts"), since, until, week)
    return events.where(test).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(min(limit, 2000))


def _in_window(events, since, until, sources, severity_min):
    test = P.between(F.col("ts"), since, until, F.col("week_start") if "week_start" in events.columns else None)
    test &= P.severity_at_least(F.col("severity"), severity_min)
    globs = [g.strip() for g in (sources or "").split(",") if g.strip()]
    if globs:
        test &= P.any_of(globs, lambda g: P.glob_query(F.col("source"), g))
    return events.where(test)


def timeline(events: DataFrame, since: str, until: str, sources: str | None = None, severity_min: int | None = None, limit: int = 500) -> DataFrame:
    """Oldest first within a window."""
    return _in_window(events, since, until, sources, severity_min).orderBy("ts", "id").limit(min(limit, 2000))


def timeline_summary(events: DataFrame, since: str, until: str, sources: str | None = None, severity_min: int | None = None) -> DataFrame:
    rows = _in_window(events, since, until, sources, severity_min)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.max("severity").alias("worst")).orderBy(F.col("n").desc(), "source")


def list_sources(sources: DataFrame, glob: str | None = None, include_hidden: bool = False) -> DataFrame:
    rows = sources if include_hidden else sources.where("active")
    rows = rows.where(P.glob_query(F.col("source"), glob)) if glob else rows
    return rows.orderBy(F.col("active").desc(), F.col("last_seen").desc(), "source")


def list_rules(rules: DataFrame, bindings: DataFrame, include_disabled: bool = False, owner: tuple[str, str] | None = None) -> DataFrame:
    """Rules with their bound target ids, in rule order; owner is the pair (oid, bot) that made them."""
    ids = bindings.groupBy("rule_id").agg(F.array_sort(F.collect_list("target_id")).alias("target_ids"))
    rows = rules if include_disabled else rules.where("enabled")
    if owner:
        rows = rows.where((F.col("owner_oid") == owner[0]) & (F.col("owner_bot") == owner[1]))
    rows = rows.join(ids, "rule_id", "left").withColumn("target_ids", F.coalesce("target_ids", F.array().cast("array<bigint>")))
    return rows.orderBy("rule_order", "rule_id")


def list_targets(targets: DataFrame, viewer_oid: str, viewer_bot: str = "", operator: bool = False) -> DataFrame:
    """Targets with their config for the owner pair or an operator only."""
    return targets.withColumn("config", redacted(viewer_oid, viewer_bot, operator)).orderBy("target_id")


def evaluation_detail(evaluations: DataFrame, rules: DataFrame, evaluation_id: int | None = None) -> DataFrame:
    """Evaluations (one, if an id is given) with the name and condition of their rule, where it still is."""
    rows = evaluations if evaluation_id is None else evaluations.where(F.col("id") == evaluation_id)
    return rows.join(rules.select("rule_id", F.col("name").alias("rule"), F.col("pattern").alias("condition")), "rule_id", "left")


def backtest_scope(events: DataFrame, pattern: str, glob: str | None = None, severity_min: int | None = None, since: str | None = None) -> DataFrame:
    """Events whose body (only) a pattern matches."""
    rows = events.where(P.severity_at_least(F.col("severity"), severity_min) & P.between(F.col("ts"), since, None))
    rows = rows.where(P.glob_query(F.col("source"), glob)) if glob else rows
    return rows.where(F.col("body").rlike(pattern))


def alert_history(ledger: DataFrame, rules: DataFrame, rule_id: int | None = None, since: str | None = None, limit: int = 100) -> DataFrame:
    rows = ledger.where(F.col("rule_id") == rule_id) if rule_id is not None else ledger
    rows = rows.where(P.between(F.col("fired_at"), since, None)).join(rules.select("rule_id", F.col("name").alias("rule")), "rule_id", "left")
    return rows.orderBy(F.col("fired_at").desc(), F.col("id").desc(), "target_id").limit(min(limit, 2000))
