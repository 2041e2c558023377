"""Rules in plain language over windows of new events: gating, digest, judgement."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decode import verdict_severity
from ..functions.predicates import glob_window, severity_at_least
from ..functions.templates import with_template

WINDOW_ROWS = 5000
GROUPS = 50
DIGEST_CHARS = 8000
FLOOR_SECONDS = 300


def window_read(events: DataFrame, after_id: int = 0, glob: str | None = None, least: int | None = None, rows: int = WINDOW_ROWS) -> DataFrame:
    """The newest `rows` events after the cursor that a rule looks at."""
    scope = events.where(F.col("id") > after_id)
    if glob:
        scope = scope.where(glob_window(F.col("source"), glob))
    return scope.where(severity_at_least(F.col("severity"), least)).orderBy(F.col("id").desc()).limit(rows)


def digest_groups(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """By source, program and template (and the columns of `by`, not null): events, worst severity (null is 0), the severity word of
    the earliest worst event, first arrival, and the first three distinct bodies."""
    sev = F.coalesce("severity", F.lit(0))
    first = F.array_sort(F.collect_set(F.struct("first", "line")))
    rows = with_template(events).withColumns({"prog": F.coalesce("program", F.lit("?")), "line": F.substring(F.coalesce("body", F.lit("")), 1, 200)})
    # distinct bodies with their first arrival, three of which are kept before they are gathered
    own = [*by, "source", "prog", "fp"]
    lines = rows.groupBy(*own, "line").agg(F.min("id").alias("first"))
    top = lines.withColumn("k", F.row_number().over(W.partitionBy(*own).orderBy("first"))).where("k <= 3")
    bodies = top.groupBy(*own).agg(F.transform(first, lambda x: x["line"]).alias("bodies"))
    groups = rows.groupBy(*own).agg(
        F.count("*").alias("n"),
        F.max(sev).alias("worst"),
        F.max_by(F.coalesce("severity_text", F.lit("?")), F.struct(sev, -F.col("id"))).alias("sev_text"),
        F.min("id").alias("first_id"),
    )
    return groups.join(bodies, own)


def digest(events: DataFrame, groups: int = GROUPS, chars: int = DIGEST_CHARS) -> DataFrame:
    """One row with the digest text: a header, the worst and largest groups, what was left out."""
    found = digest_groups(events)
    order = [F.col("worst").desc(), F.col("n").desc(), F.col("first_id")]
    # the groups shown are picked by a top-n before they are numbered in one place
    ranked = found.orderBy(*order).limit(groups).withColumn("k", F.row_number().over(W.orderBy(*order)))
    head = F.concat(F.col("source"), F.lit(" ["), F.col("sev_text"), F.lit("] "), F.col("prog"), F.lit(": "))
    lines = F.transform(F.col("bodies"), lambda b, i: F.concat(F.lit("  "), F.when(i == 0, F.concat(F.col("n").cast("string"), F.lit("x "))).otherwise("   "), head, b))
    text = ranked.select("k", F.array_join(lines, "\n").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "\n").alias("parts"))
    clock = lambda c: F.date_format(c, "HH:mm:ss")
    facts = events.agg(F.count("*").alias("n"), F.min_by("ts", "id").alias("a"), F.max_by("ts", "id").alias("b")).crossJoin(found.agg(F.count("*").alias("g")))
    header = F.concat(F.col("n").cast("string"), F.lit(" events over "), clock("a"), F.lit("-"), clock("b"), F.lit("Z, "), F.col("g").cast("string"), F.lit(" message types, worst first:"))
    rest = F.when(F.col("g") > groups, F.concat(F.lit("\n  ...(+"), (F.col("g") - groups).cast("string"), F.lit(" more types)"))).otherwise("")
    # both sides are one row
    return facts.crossJoin(text).select(F.substring(F.concat(header, F.lit("\n"), F.coalesce("parts", F.lit("")), rest), 1, chars).alias("digest"), F.col("n").alias("event_count"))


def window_digests(events: DataFrame, by: tuple[str, ...] = ("rule_id", "window"), groups: int = GROUPS, chars: int = DIGEST_CHARS) -> DataFrame:
    """digest() of each window, from all of its rows: by, digest, event_count."""
    order = [F.col("worst").desc(), F.col("n").desc(), F.col("first_id")]
    found = digest_groups(events, by)
    ranked = found.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("k") <= groups)
    head = F.concat(F.col("source"), F.lit(" ["), F.col("sev_text"), F.lit("] "), F.col("prog"), F.lit(": "))
    lines = F.transform(F.col("bodies"), lambda b, i: F.concat(F.lit("  "), F.when(i == 0, F.concat(F.col("n").cast("string"), F.lit("x "))).otherwise("   "), head, b))
    parts = ranked.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.array_join(lines, "\n").alias("part")))), lambda x: x["part"]), "\n").alias("parts"))
    clock = lambda c: F.date_format(c, "HH:mm:ss")
    facts = events.groupBy(*by).agg(F.count("*").alias("n"), F.min_by("ts", "id").alias("a"), F.max_by("ts", "id").alias("b")).join(found.groupBy(*by).agg(F.count("*").alias("g")), list(by))
    header = F.concat(F.col("n").cast("string"), F.lit(" events over "), clock("a"), F.lit("-"), clock("b"), F.lit("Z, "), F.col("g").cast("string"), F.lit(" message types, worst first:"))
    rest = F.when(F.col("g") > groups, F.concat(F.lit("\n  ...(+"), (F.col("g") - groups).cast("string"), F.lit(" more types)"))).otherwise("")
    return facts.join(parts, list(by)).select(*by, F.substring(F.concat(header, F.lit("\n"), "parts", rest), 1, chars).alias("digest"), F.col("n").alias("event_count"))


def evaluated(rows: DataFrame, gated: DataFrame) -> DataFrame:
    """rows (rule_id, tick, ...) with window, the tick of gate()'s evaluation that takes them. Rows of
    a rule's first tick, the baseline, and rows that wait for an evaluation are in no window."""
    ticks = rows.select("rule_id", "tick").distinct().join(gated.select("rule_id", "tick", F.col("tick").alias("at")), ["rule_id", "tick"], "left")
    own = W.partitionBy("rule_id").orderBy("tick")
    ticks = ticks.select("rule_id", "tick", F.row_number().over(own).alias("k"), F.min("at").over(own.rowsBetween(0, W.unboundedFollowing)).alias("window"))
    return rows.join(ticks.where("k > 1 and window is not null").drop("k"), ["rule_id", "tick"])


def top_source(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).orderBy(F.col("n").desc(), "first_id").limit(1)


def extract_verdict(reply):
    """(fire, severity, why) from a reply: the last flat {...} that mentions "fire" and parses, else
    the widest {...}, else null."""
    flat = F.filter(F.regexp_extract_all(reply, F.lit(r"(?s)(\{[^{}]*\})"), 1), lambda x: F.contains(x, F.lit("fire")) & F.try_parse_json(x).isNotNull())
    wide = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    chosen = F.coalesce(F.try_element_at(flat, F.lit(-1)), F.when(F.try_parse_json(F.nullif(wide, F.lit(""))).isNotNull(), wide))
    return F.from_json(chosen, "fire boolean, severity string, why string")


GATED = "rule_id long, tick long, pending long, elapsed long, trigger string"
EVALUATIONS_PER_MINUTE = 20


def gate(ticks: DataFrame, window_seconds: int | None = None, spike_lines: int | None = None, ceiling: int = 0) -> DataFrame:
    """Which ticks of each rule evaluate: ticks has rule_id, tick (epoch seconds), new_rows (the rows that
    arrived since the tick before) and, for a rule's own settings, window_seconds and spike_lines. The
    first tick only sets the baseline; then one evaluates when there are new rows, 300 s have passed,
    and the window's time or the spike's number of rows is reached. Rows gather until an evaluation
    takes them. Adds the seconds since the rule's evaluation before and what triggered this one.

    With a ceiling, at most so many evaluations of all rules run in a trailing minute; more are
    deferred to the rule's next tick. Where the rules by themselves stay under it, the fold of each
    rule is exact; else one task folds the ticks (not the rows) of all rules in order."""
    own = {"window_seconds": window_seconds, "spike_lines": spike_lines}
    set_by = {k: F.coalesce(F.nullif(F.col(k).cast("long"), F.lit(0)) if k == "window_seconds" else F.col(k).cast("long"), F.lit(v)) if k in ticks.columns else F.lit(v) for k, v in own.items()}
    rows = ticks.select("rule_id", "tick", "new_rows", F.coalesce(set_by["window_seconds"], F.lit(3600)).cast("long").alias("window"), F.coalesce(set_by["spike_lines"], F.lit(100)).cast("long").alias("spike"))

    def folded(limit: int):
        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state: dict = {}
            recent: deque = deque()
            for pdf in batches:
                out = []
                for rule, tick, new, window, spike in pdf[["rule_id", "tick", "new_rows", "window", "spike"]].itertuples(index=False):
                    if rule not in state:
                        if not limit:
                            state.clear()  # rules come one after another
                        state[rule] = (tick, 0)
                        continue
                    last, pending = state[rule]
                    pending, elapsed = pending + new, tick - last
                    due = pending and elapsed >= FLOOR_SECONDS and (elapsed >= window or pending >= spike)
                    if due and limit:
                        while recent and tick - recent[0] > 60:
                            recent.popleft()
                        due = len(recent) < limit
                    if not due:
                        state[rule] = (last, pending)
                        continue
                    if limit:
                        recent.append(tick)
                    out.append((rule, tick, pending, elapsed, "spike" if pending >= spike else "interval"))
                    state[rule] = (tick, 0)
                yield pd.DataFrame(out, columns=["rule_id", "tick", "pending", "elapsed", "trigger"])

        return fold

    plain = rows.repartition("rule_id").sortWithinPartitions("rule_id", "tick").mapInPandas(folded(0), GATED)
    if ceiling <= 0:
        return plain
    per = plain.groupBy("tick").agg(F.count("*").alias("c"))
    trailing = F.sum("c").over(W.orderBy("tick").rangeBetween(-60, 0))  # a row for each tick
    if per.withColumn("n", trailing).where(F.col("n") > ceiling).isEmpty():
        return plain
    return rows.repartition(1).sortWithinPartitions("tick", "rule_id").mapInPandas(folded(ceiling), GATED)


def keyword_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A scorer for tests: fires when a word of the condition longer than 3 letters is in the digest."""
    hits = [[w for w in str(c).lower().split() if len(w) > 3 and w in str(d).lower()] for c, d in zip(pdf.condition, pdf.digest, strict=True)]
    return pdf.assign(fire=[bool(h) for h in hits], verdict=["error" if h else "info" for h in hits], why=[", ".join(h) for h in hits])


def judge(windows: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame] = keyword_scorer) -> DataFrame:
    """windows (rule_id, condition, digest, ...) with fire, verdict, why and the OTel severity. A
    scorer that fails leaves its windows unfired; they are not tried again."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield scorer(pdf)
            except Exception as error:  # a model that fails must not stop the others
                yield pdf.assign(fire=False, verdict=None, why=str(error)[:200])

    schema = T.StructType([*windows.schema.fields, T.StructField("fire", T.BooleanType()), T.StructField("verdict", T.StringType()), T.StructField("why", T.StringType())])
    return windows.mapInPandas(score, schema).withColumn("severity", verdict_severity(F.coalesce("verdict", F.lit(""))))


def evaluations(rows: DataFrame, gated: DataFrame, judged: DataFrame) -> DataFrame:
    """The trace of every evaluation, fired or not. rows are evaluated() rows with id, source and tick
    and those of each rule's first tick; gated is gate()'s result; judged has rule_id, window, fire,
    verdict, why and the digest that was judged. Texts are cut to 64,000 characters."""
    first = rows.groupBy("rule_id").agg(F.min_by(F.col("id"), F.struct(F.col("tick"), -F.col("id"))).alias("baseline"))
    taken = evaluated(rows, gated)
    top = taken.groupBy("rule_id", "window", "source").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    top = top.groupBy("rule_id", "window").agg(F.max_by("source", F.struct("n", -F.col("first_id"))).alias("source"))
    spans = taken.groupBy("rule_id", "window").agg(F.max("id").alias("window_to_id"), F.count("*").alias("event_count"))
    own = W.partitionBy("rule_id").orderBy("window")
    spans = spans.join(first, "rule_id").withColumn("window_from_id", F.coalesce(F.lag("window_to_id").over(own), F.col("baseline"))).drop("baseline")
    met = spans.join(top, ["rule_id", "window"]).join(gated.select("rule_id", F.col("tick").alias("window"), "elapsed", "trigger"), ["rule_id", "window"]).join(judged, ["rule_id", "window"])
    return trace_columns(met)


def evaluation_id() -> Column:
    """One number of window and rule: rules below ten million keep apart, and there is room for targets."""
    return F.col("window") * 10_000_000 + F.col("rule_id")


def trace_columns(met: DataFrame) -> DataFrame:
    fired = F.coalesce("fire", F.lit(False))
    return met.select(
        evaluation_id().alias("id"), "rule_id", "source", F.timestamp_seconds("window").cast("timestamp_ntz").alias("evaluated_at"),
        F.col("trigger").alias("trigger_kind"), "window_from_id", "window_to_id", "event_count", F.col("elapsed").cast("double").alias("elapsed_s"), fired.alias("fired"),
        F.when(fired, F.coalesce("verdict", F.lit("warn"))).alias("severity"), "why", F.col("fire").isNotNull().alias("llm_ok"), F.substring("digest", 1, 64_000).alias("summary_sent"),
    )


def semantic_firings(traced: DataFrame, rules: DataFrame, bindings: DataFrame) -> DataFrame:
    """Fired evaluations as firings, straight into the incident fold, one for each target of the rule:
    their source is the window's top source, their program the rule's name, their body the verdict's
    reason, and all sources of a rule share one key."""
    fired = traced.where("fired").join(rules.select("rule_id", "name"), "rule_id").join(bindings.select("rule_id", "target_id"), "rule_id")
    key = F.concat_ws(":", F.col("rule_id").cast("string"), F.col("target_id").cast("string"), F.lit("semantic"))
    return fired.select("id", "rule_id", "target_id", "source", verdict_severity(F.coalesce("severity", F.lit(""))).alias("severity"), F.col("severity").alias("severity_text"), F.col("name").alias("program"), F.coalesce("why", F.lit("(semantic match)")).alias("body"), F.col("evaluated_at").alias("ts"), key.alias("key"))
