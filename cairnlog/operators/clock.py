"""Window rules on a clock: a rule is looked at at every tick of the clock, whether rows arrive or not.

The fold over one shard's rules is the same for tables and for streams. A shard is one rule, or all rules
where a budget of evaluations a minute couples them; it holds a few numbers for each rule, not its rows."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import semantic

EVERY = 30  # seconds between ticks
EVALUATED = "rule_id long, tick long, since long, pending long, elapsed long, trigger string, window_from_id long, window_to_id long"


class Clocks:
    """The rules of one shard: last evaluation, rows that wait, and the rows of ticks still to come."""

    def __init__(self, every: int, ceiling: int = 0):
        self.every, self.ceiling = every, ceiling
        self.rules: dict[int, dict] = {}
        self.arrivals: dict[int, list] = {}  # rule -> heap of (tick, rows, highest id)
        self.recent: deque = deque()
        self.done: int | None = None

    def state(self) -> dict:
        return {"rules": [[k, v] for k, v in self.rules.items()], "arrivals": [[k, v] for k, v in self.arrivals.items()], "recent": list(self.recent), "done": self.done}

    def restore(self, state: dict) -> Clocks:
        self.rules = {k: v for k, v in state["rules"]}
        self.arrivals = {k: [tuple(x) for x in v] for k, v in state["arrivals"]}
        self.recent, self.done = deque(state["recent"]), state["done"]
        return self

    def add(self, rule: int, tick: int, rows: int, top_id: int, window: int, spike: int) -> None:
        if self.done is not None:  # late rows count at the next tick
            tick = max(tick, self.done + self.every)
        heapq.heappush(self.arrivals.setdefault(rule, []), (int(tick), int(rows), int(top_id)))
        self.rules.setdefault(rule, {"last": None, "pending": 0, "row": 0, "from": 0, "to": 0, "wait": 0}).update(window=int(window), spike=int(spike))

    def due(self, rule: int) -> int | None:
        """The tick of the rule's next evaluation, if no more rows arrive."""
        r = self.rules[rule]
        if not r["pending"]:
            return None
        after = semantic.FLOOR_SECONDS if r["pending"] >= r["spike"] else max(semantic.FLOOR_SECONDS, r["window"])
        return -(-max(r["last"] + after, r["row"], r["wait"]) // self.every) * self.every

    def upcoming(self, rule: int) -> int | None:
        """The next tick at which something happens to the rule."""
        waiting = self.arrivals.get(rule)
        return min((t for t in (self.due(rule), waiting[0][0] if waiting else None) if t is not None), default=None)

    def next(self) -> int | None:
        return min((t for t in map(self.upcoming, self.rules) if t is not None), default=None)

    def run(self, until: int) -> list[tuple]:
        """All evaluations up to and with the tick `until`, in order of tick and rule."""
        out = []
        todo = [(t, rule) for rule in self.rules if (t := self.upcoming(rule)) is not None and t <= until]
        heapq.heapify(todo)
        while todo:
            tick, rule = heapq.heappop(todo)
            r, waiting = self.rules[rule], self.arrivals.get(rule, [])
            while waiting and waiting[0][0] == tick:
                _, rows, top = heapq.heappop(waiting)
                if r["last"] is None or r["row"] == tick == r["last"] and not r["to"]:  # the first tick is the baseline
                    r.update(last=tick, row=tick)
                    r["from"] = max(r["from"], top)
                else:
                    r["pending"] += rows
                    r.update(row=tick, to=max(r["to"], top))
            due = self.due(rule)
            if due is not None and due <= tick:
                while self.recent and tick - self.recent[0] > 60:
                    self.recent.popleft()
                if self.ceiling and len(self.recent) >= self.ceiling:
                    r["wait"] = tick + self.every
                else:
                    if self.ceiling:
                        self.recent.append(tick)
                    out.append((rule, tick, r["last"], r["pending"], tick - r["last"], "spike" if r["pending"] >= r["spike"] else "interval", r["from"], r["to"]))
                    r.update(last=tick, pending=0)
                    r["from"] = r["to"]
            later = self.upcoming(rule)
            if later is not None and later <= until:
                heapq.heappush(todo, (later, rule))
        self.done = until if self.done is None else max(self.done, until)
        return out


def arrivals(rows: DataFrame) -> DataFrame:
    """Rows (rule_id, tick, id, window_seconds, spike_lines) by rule and tick."""
    return rows.groupBy("rule_id", "tick").agg(F.count("*").alias("rows"), F.max("id").alias("top_id"), F.max(F.col("window_seconds").cast("long")).alias("window"), F.max(F.col("spike_lines").cast("long")).alias("spike"))


def shard(ceiling: int) -> Column:
    return F.lit(0).cast("long") if ceiling else F.col("rule_id").cast("long")


def clocked_gate(rows: DataFrame, until: int, every: int = EVERY, ceiling: int = 0) -> DataFrame:
    """The evaluations of rows' rules up to the tick `until`. The rules of a shard are folded in order of
    ticks, chunk by chunk; what is folded are counts by rule and tick."""
    ticks = arrivals(rows).withColumn("shard", shard(ceiling))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, clocks = None, Clocks(every, ceiling)
        columns = [x.split()[0] for x in EVALUATED.split(", ")]
        for pdf in batches:
            out = []
            for s, rule, tick, n, top, window, spike in pdf[["shard", "rule_id", "tick", "rows", "top_id", "window", "spike"]].itertuples(index=False):
                if s != now:
                    out += clocks.run(until)
                    now, clocks, seen = s, Clocks(every, ceiling), tick
                elif tick != seen:
                    out += clocks.run(tick - every)
                    seen = tick
                clocks.add(rule, tick, n, top, window, spike)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(clocks.run(until), columns=columns)

    return ticks.where(F.col("tick") <= until).repartition("shard").sortWithinPartitions("shard", "tick", "rule_id").mapInPandas(fold, EVALUATED)


def windows(rows: DataFrame, evaluated: DataFrame) -> DataFrame:
    """The rows that each evaluation takes, with window, its tick: those after the evaluation before (or
    the first tick) and up to it. A rule's evaluations follow each other, so each of its ticks has one
    evaluation at most, the next; it is found once for a tick, and rows meet it by rule and tick."""
    ends = evaluated.select("rule_id", "tick", "since").withColumn("end", F.col("tick"))
    marks = rows.select("rule_id", "tick").distinct().select("rule_id", "tick", F.lit(None).cast("long").alias("since"), F.lit(None).cast("long").alias("end")).unionByName(ends)
    following = W.partitionBy("rule_id").orderBy("tick").rangeBetween(0, W.unboundedFollowing)
    met = marks.withColumn("next", F.min(F.when(F.col("end").isNotNull(), F.struct("end", "since"))).over(following))
    taken = met.where(F.col("end").isNull() & (F.col("tick") > F.col("next.since"))).select("rule_id", "tick", F.col("next.end").alias("window"))
    return rows.join(taken, ["rule_id", "tick"])


def trace(taken: DataFrame, evaluated: DataFrame, rules: DataFrame, scorer=semantic.keyword_scorer) -> DataFrame:
    """Digest, judgement and trace of each evaluation (as semantic.evaluations() has it) from the rows it
    takes; rules has rule_id and pattern, the condition."""
    text = semantic.window_digests(taken).join(rules.select("rule_id", F.col("pattern").alias("condition")), "rule_id")
    judged = semantic.judge(text.select("rule_id", "window", "condition", "digest"), scorer).drop("severity")
    top = taken.groupBy("rule_id", "window", "source").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    top = top.groupBy("rule_id", "window").agg(F.max_by("source", F.struct("n", -F.col("first_id"))).alias("source"), F.sum("n").alias("event_count"))
    met = evaluated.withColumnRenamed("tick", "window").join(top, ["rule_id", "window"]).join(judged, ["rule_id", "window"])
    return semantic.trace_columns(met)
