"""Folds over time that no single task does: rows are dealt into ranges, each range is folded by itself,
and only the small states between ranges are passed along.

`hot_dispositions` folds one key's firings in many tasks: what a range does to the time of the last feed
is a step function with few steps, so ranges give their functions first, a short fold composes them, and
each range then marks its rows. `ceiling_decisions` decides which opens a ceiling over all keys lets
through: every range starts from a guessed state, and is done again where the state that the range
before hands over differs, until none does."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import written

# --------------------------------------------------------------------------- one hot key

SEGMENT = "part int, key string, first_us long, last_us long, opens_new long, opens_on long, fed_new long, fed_on long, steps array<struct<upto:long,fed:long>>"


def segment_steps(times: list[int], ttl: int, wait: int) -> tuple[int, int, int, int | None, list[tuple[int, int]]]:
    """What the firings at `times` (ascending) of one key do: (opens if the first one opens, opens if the
    incident goes on, last open or feed if the first one opens, the same if it goes on and that does not
    depend on the feed before, else the steps).

    Steps are (latest next feed, last feed): if the next feed is due by the first time of a step or
    before, the last feed of the segment is the second; if it is due after all steps, nothing feeds."""
    gaps = [k for k in range(1, len(times)) if times[k] - times[k - 1] >= ttl]
    bounds = [0, *gaps, len(times)]

    def last_feed(k: int, end: int) -> int:
        """The last feed before end, where times[k] is one."""
        at = times[k]
        while (k := bisect.bisect_left(times, at + wait, k + 1, end)) < end:
            at = times[k]
        return at

    tail = last_feed(bounds[-2], len(times))
    opens = len(bounds) - 1
    if gaps:  # an incident begins inside, and what was before it does not matter any more
        return opens, opens - 1, tail, tail, []
    # the feed before was at the latest at the first time, so the next one is due a wait after it at most
    reach = min(bisect.bisect_left(times, times[0] + wait) + 1, len(times))
    ends: dict[int, int] = {}
    for k in range(len(times) - 1, -1, -1):
        following = bisect.bisect_left(times, times[k] + wait, k + 1)
        ends[k] = ends[following] if following < len(times) else times[k]
    steps: list[tuple[int, int]] = []
    for k in range(reach):
        if steps and steps[-1][1] == ends[k]:
            steps[-1] = (times[k], ends[k])
        else:
            steps.append((times[k], ends[k]))
    return 1, 0, tail, None, steps


def hot_dispositions(firings: DataFrame, ttl_us: int) -> DataFrame:
    """incident and disposition of firings (key, id, _us, _wait, ...) of keys with very many rows.

    The firings are sorted into ranges of (key, _us, id), so a key lies in as many tasks as it needs.
    _wait has to be the same for all rows of a key."""
    names = [c for c in firings.columns if c not in ("_us", "_wait")]
    dealt = written(firings.repartitionByRange("key", "_us", "id").withColumn("_part", F.spark_partition_id()), "hot-firings")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, times, wait = None, [], 0
        for pdf in batches:
            out = []
            for part, key, us, own in zip(pdf._part, pdf.key, pdf._us, pdf._wait, strict=True):
                if (part, key) != now:
                    if times:
                        out.append(segment(now, times, wait))
                    now, times, wait = (part, key), [], own
                times.append(us)
            yield pd.DataFrame(out, columns=columns)
        if times:
            yield pd.DataFrame([segment(now, times, wait)], columns=columns)

    columns = [x.split()[0] for x in SEGMENT.split(", ")]

    def segment(at: tuple, times: list[int], wait: int) -> tuple:
        opens_new, opens_on, fed_new, fed_on, steps = segment_steps(times, ttl_us, wait)
        return (*at, times[0], times[-1], opens_new, opens_on, fed_new, -1 if fed_on is None else fed_on, [{"upto": a, "fed": b} for a, b in steps])

    def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = last = fed = None
        n = 0
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.key != key:
                    key, last, fed, n = r.key, None, None, 0
                out.append((r.part, r.key, last, fed, n))
                if last is None or r.first_us - last >= ttl_us:
                    fed, n = r.fed_new, n + r.opens_new
                elif r.fed_on >= 0 and not len(r.steps):
                    fed, n = r.fed_on, n + r.opens_on
                else:
                    fed = next((s["fed"] for s in r.steps if fed + r.wait <= s["upto"]), fed)
                last = r.last_us
            yield pd.DataFrame(out, columns=["part", "key", "_last", "_fed", "_n"]).astype({"_last": "Int64", "_fed": "Int64"})

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = last = fed = None
        n = 0
        for pdf in batches:
            out, numbers = [], []
            for part, key, us, wait, last0, fed0, n0 in zip(pdf._part, pdf.key, pdf._us, pdf._wait, pdf._last, pdf._fed, pdf._n, strict=True):
                if (part, key) != now:
                    now, n = (part, key), n0
                    last, fed = (None, None) if pd.isna(last0) else (int(last0), int(fed0))
                if last is None or us - last >= ttl_us:
                    n, fed, what = n + 1, us, "opened"
                elif us - fed >= wait:
                    fed, what = us, "fed"
                else:
                    what = "throttled"
                last = us
                out.append(what)
                numbers.append(n)
            yield pdf[names].assign(incident=numbers, disposition=out)

    order = ["_part", "key", "_us", "id"]
    segments = dealt.repartition("_part").sortWithinPartitions(*order).mapInPandas(summed, SEGMENT)
    waits = dealt.groupBy("key").agg(F.max("_wait").alias("wait"))
    # one row for each range of a key: a key of a billion firings has some thousands
    states = segments.join(waits, "key").repartition("key").sortWithinPartitions("key", "part").mapInPandas(composed, "part int, key string, _last long, _fed long, _n long")
    met = dealt.join(states.withColumnRenamed("part", "_part"), ["_part", "key"])
    schema = T.StructType([*(firings.schema[c] for c in names), T.StructField("incident", T.LongType()), T.StructField("disposition", T.StringType())])
    return met.repartition("_part").sortWithinPartitions(*order).mapInPandas(marked, schema)


# --------------------------------------------------------------------------- all keys under a ceiling

MINUTE = 60_000_000
FOLDED = "row long, what string, kind int, target int, key string, session long, us long"


def ceiling_decisions(rows: DataFrame, before: DataFrame, ceiling: int, ranges: int | None = None) -> tuple[DataFrame, int, int]:
    """(row, what) for rows (row, key, session, us, id): a session is a run of one key's firings. Its first
    firing that the ceiling lets through is "opened", those before it are "rate_limited", those after it
    are "on". before has the (us) of opens in the minute before and the (key, session) of sessions that are
    open already, with null us. Also returns how many ranges there were and in how many rounds they were
    folded.

    At most `ceiling` opens stand in any trailing minute. Rows are dealt into ranges of time. Every range
    after the first starts from the guess that all sessions opened at their first firing; a session's
    state is handed to the next range that has firings of it, the opens of the last minute to the next
    range. The first n ranges are final after n rounds, and mostly many more."""
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, "us").withColumn("part", F.spark_partition_id()), "ceiling-rows")
    # of each session and range the first row, and the next range: one row for very many of a hot session
    own = W.partitionBy("key", "session").orderBy("part")
    spans = dealt.groupBy("key", "session", "part").agg(F.min(F.struct("us", "id", "row")).alias("head"))
    spans = spans.select("key", "session", "part", "head", F.coalesce(F.lead("part").over(own), F.lit(-1)).alias("next"), (F.row_number().over(own) == 1).alias("begins"))
    spans = written(spans, "ceiling-spans")
    dealt = written(dealt.join(spans.select("key", "session", "part", "next"), ["key", "session", "part"]), "ceiling-dealt")
    begins = [(r.part, r.us) for r in dealt.groupBy("part").agg(F.min("us").alias("us")).orderBy("us").collect()]  # one row a range
    if not begins:
        return spark.createDataFrame([], "row long, what string"), 0, 0
    following = {a: b for (a, _), (b, _) in zip(begins, begins[1:], strict=False)}
    starts = dict(begins)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, opened, recent, to = None, {}, deque(), {}

        def handed() -> list[tuple]:
            """The states for later ranges: of each open session for its next range, and the opens."""
            out = [(-1, "", 0, to[s], *s, -1, part) for s in opened if to.get(s, -1) >= 0]
            if part in following:
                out += [(-1, "", 1, following[part], "", row, us, part) for us, row in recent if us >= starts[following[part]] - MINUTE]
            return out

        columns = [x.split()[0] for x in FOLDED.split(", ")]
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                if r.part != part:
                    out += handed()
                    part, opened, recent, to = r.part, {}, deque(), {}
                session = (r.key, r.session)
                if r.kind == 0:
                    opened[session] = True
                elif r.kind == 1:
                    recent.append((r.us, r.session))
                else:
                    to[session] = r.next
                    if session in opened:
                        what = "on"
                    else:
                        while recent and r.us - recent[0][0] > MINUTE:
                            recent.popleft()
                        what = "rate_limited" if len(recent) >= ceiling else "opened"
                        if what == "opened":
                            recent.append((r.us, r.row))
                            opened[session] = True
                    out.append((r.row, what, 2, -1, "", -1, -1, part))
            yield pd.DataFrame(out, columns=[*columns, "part"])
        if part is not None:
            yield pd.DataFrame(handed(), columns=[*columns, "part"])

    state = ["target", "kind", "key", "session", "us"]
    # the guess: sessions opened at their first firing, and so did the opens of the minute before a range
    begun = spans.where("begins").join(before.where("kind = 0").select("key", "session"), ["key", "session"], "left_anti")
    sessions = spans.where("next >= 0").select(F.col("next").alias("target"), F.lit(0).alias("kind"), "key", "session", F.lit(-1).cast("long").alias("us"))
    edges = spark.createDataFrame([(b, starts[b]) for b in following.values()], "target int, starts long")  # one row a range
    reach = (F.col("us") < F.col("starts")) & (F.col("us") >= F.col("starts") - MINUTE)
    recents = begun.select("head.us", "head.row").join(F.broadcast(edges), reach).select("target", F.lit(1).alias("kind"), F.lit("").alias("key"), F.col("row").alias("session"), "us")
    # what is known: the opens before go to the first range, open sessions to the first that has firings of them
    held = before.where("kind = 0").join(spans.where("begins").select("key", "session", F.col("part").alias("target")), ["key", "session"])
    known = written(before.where("kind = 1").withColumn("target", F.lit(begins[0][0])).select(*state).unionByName(held.select(*state)), "ceiling-known")
    states = written(known.unionByName(sessions.select(*state)).unionByName(recents.select(*state)).distinct(), "ceiling-states")

    def digests(table: DataFrame) -> dict[int, tuple]:
        """Of each range's starting state: one row a range."""
        h = F.xxhash64("kind", "key", "session", "us")
        found = table.groupBy("target").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"))
        return {r.target: (r.n, r.x, r.s) for r in found.collect()}

    todo, used, rounds, results = set(starts), digests(states), 0, {}
    while todo:
        rounds += 1
        chosen = sorted(todo)
        inputs = dealt.where(F.col("part").isin(chosen)).select("part", F.lit(2).alias("kind"), "row", "key", "session", "us", "id", "next")
        given = states.where(F.col("target").isin(chosen)).select(F.col("target").alias("part"), "kind", F.lit(-1).cast("long").alias("row"), "key", "session", "us", F.lit(-1).cast("long").alias("id"), F.lit(-1).alias("next"))
        ordered = inputs.unionByName(given).repartition(len(chosen), "part").sortWithinPartitions("part", "kind", "us", "id", "key")
        done = written(ordered.mapInPandas(fold, FOLDED + ", part int"), "ceiling-round")
        results |= dict.fromkeys(chosen, done)
        # what each range hands over now, from its last round
        parts: dict[int, tuple[DataFrame, list[int]]] = {}
        for part, table in results.items():
            parts.setdefault(id(table), (table, []))[1].append(part)
        after = known
        for table, held in parts.values():
            after = after.unionByName(table.where((F.col("kind") < 2) & F.col("part").isin(held)).select(*state))
        states = written(after.distinct(), "ceiling-states")
        now = digests(states)
        todo = {p for p in starts if now.get(p) != used.get(p)}
        used = now
    out = None
    for table, held in parts.values():
        rows_of = table.where((F.col("kind") == 2) & F.col("part").isin(held)).select("row", "what")
        out = rows_of if out is None else out.unionByName(rows_of)
    return out, len(begins), rounds
