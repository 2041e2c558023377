"""Event windows per rule, summed from panes that all rules share.

A pane is the greatest step that divides every window and slide. Events are counted once per pane, source
and severity; a rule's windows are sums of panes, tumbling ones of size, sliding ones one for each slide.
The same plan serves a table and, with a watermark, a stream."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import glob_window, severity_at_least

RULE = "rule_id long, window_kind string, window_seconds long, slide_seconds long, spike_lines long, source_glob string, min_severity int"


def pane_counts(events: DataFrame, step: int, late: str) -> DataFrame:
    """(pane, source, severity, n): events by pane of `step` seconds."""
    rows = events.select(F.col("ts").cast("timestamp").alias("at"), "source", "severity").withWatermark("at", late)
    return rows.groupBy(F.window("at", f"{step} seconds").alias("pane"), "source", "severity").agg(F.count("*").alias("n"))


def rule_windows(events: DataFrame, rules: list, late: str = "10 minutes") -> DataFrame:
    """(rule_id, source, start, n) of each rule's windows with at least its spike_lines events that pass
    its source glob (as windows use them) and severity floor.

    rules are rows of RULE; a null or zero slide is the pane, a tumbling rule slides by its size. A window
    of no whole number of slides is refused. Rules of equal window and slide share one sum, in which the
    rules themselves are columns: their number multiplies no rows but those that pass."""
    if not rules:
        return events.select(F.lit(0).cast("long").alias("rule_id"), "source", F.col("ts").cast("timestamp").alias("start"), F.lit(0).cast("long").alias("n")).where("false")
    step = reduce(math.gcd, [s for r in rules for s in (r.window_seconds, r.slide_seconds or 0) if s])
    panes = pane_counts(events, step, late)
    groups: dict[tuple[int, int], list] = {}
    for r in rules:
        slide = r.window_seconds if r.window_kind == "tumbling" else (r.slide_seconds or step)
        if r.window_seconds % slide:
            raise ValueError(f"rule {r.rule_id}: a window of {r.window_seconds} s has no whole number of slides of {slide} s")
        groups.setdefault((r.window_seconds, slide), []).append(r)
    found = []
    for (size, slide), own in sorted(groups.items()):
        passing = F.array_compact(F.array(*(F.when(severity_at_least(F.col("severity"), r.min_severity) & (glob_window(F.col("source"), r.source_glob) if r.source_glob else F.lit(True)), F.lit(r.rule_id).cast("long")) for r in own)))
        least = F.element_at(F.create_map(*(F.lit(x).cast("long") for r in own for x in (r.rule_id, r.spike_lines))), F.col("rule_id"))
        rows = panes.select(F.window_time("pane").alias("at"), "source", "n", F.explode(passing).alias("rule_id"))
        sums = rows.groupBy(F.window("at", f"{size} seconds", f"{slide} seconds").alias("w"), "rule_id", "source").agg(F.sum("n").alias("n"))
        found.append(sums.where(F.col("n") >= least).select("rule_id", "source", F.col("w.start").alias("start"), "n"))
    return reduce(DataFrame.unionByName, found)
