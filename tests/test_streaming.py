"""The stream gives what the batch gives."""

import collections
import datetime
import os
import re
import time

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlog.operators import clock, incidents, routing
from cairnlog.sources import tables
from cairnlog.streaming import pipeline, registry, stateful

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    out, src = f"file://{tmp_path}/out", f"file://{tmp_path}/in"
    lines = tables.raw_lines(spark, SF).where("id % 4 < 2")
    for k in range(3):  # three files, in order of arrival
        lines.where((F.col("id") >= k * 350) & (F.col("id") < (k + 1) * 350)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(src)
    rules = lambda: (tables.rules(spark), tables.bindings(spark), tables.targets(spark))
    events, incident_query = pipeline.start(stream, out, rules, 7200, 3600, availableNow=True)
    assert events.awaitTermination(120)
    second = incident_query()
    assert second.awaitTermination(120)
    from cairnlog.functions.decode import decode_lines
    from cairnlog.functions.templates import template_delta

    decoded = decode_lines(lines)
    fired = routing.route(decoded, routing.compile_rules(*rules()[:2])).withColumn("key", incidents.dedup_key())
    want = incidents.dispositions(fired, 7200, 3600).select("id", "target_id", "disposition")
    got = spark.read.parquet(f"{out}/decided").select("id", "target_id", "disposition")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    hits = registry.registry(spark, f"{out}/templates").select("fp", "hits")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, template_delta(decoded).select("fp", "hits").collect()))
    assert spark.read.parquet(f"{out}/outbox").count() == got.where("disposition <> 'throttled'").count()


def test_event_windows(spark, tmp_path):
    rows = tables.log_events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).select("source", "ts")
    rows.write.parquet(f"file://{tmp_path}/e")
    s = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/e")
    q = pipeline.window_counts(s, "1 day", spike=2).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = rows.groupBy("source", F.date_trunc("day", "ts").alias("start")).count().where("count >= 2")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))


def test_snapshots_survive_many_batches_and_replays(spark, tmp_path):
    """Twelve batches, some of them replayed as a stream replays its last one: hits are counted once."""
    from cairnlog.functions.templates import merge_templates, template_delta

    path = f"file://{tmp_path}/templates"
    rows = tables.log_events(spark, SF)
    part = lambda n: template_delta(rows.where(F.col("id") % 12 == n))
    for n in [0, 1, 1, *range(2, 11), 10, 11, 11]:
        pipeline.snapshot(spark, path, part(n), merge_templates, n)
    hits = pipeline.latest_snapshot(spark, path).select("fp", "hits")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, template_delta(rows).select("fp", "hits").collect()))
    assert sorted(pipeline._snapshots(spark, path)) == [10, 11]


def test_idle_keys_are_forgotten(spark, tmp_path):
    """After the idle time a key's numbers begin again; until then its state is kept."""
    import time
    from datetime import datetime

    firing = lambda i, s: spark.createDataFrame([("k", i, datetime.fromtimestamp(s))], "key string, id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/f")
    firing(0, 0)
    s = spark.readStream.schema("key string, id long, ts timestamp_ntz").parquet(f"file://{tmp_path}/f")
    q = pipeline.stream_dispositions(s, 1, 1, idle=3).writeStream.outputMode("append").format("memory").queryName("idle").trigger(processingTime="500 milliseconds").start()

    def wait(n):
        for _ in range(160):
            if spark.table("idle").count() >= n:
                return
            time.sleep(0.5)

    wait(1)
    time.sleep(8)
    firing(1, 100)
    wait(2)
    q.stop()
    assert sorted((r.id, r.incident, r.disposition) for r in spark.table("idle").collect()) == [(0, 1, "opened"), (1, 1, "opened")]


def test_stream_gate(spark, tmp_path):
    """The stream gate gives what the batch gate gives."""
    from cairnlog.operators import semantic

    ticks = spark.createDataFrame([(r, t, n, 1800, 20) for r in (1, 2) for t, n in ((0, 50), (300, 0), (600, 5), (900, 20 * r), (4600, 1))], "rule_id long, tick long, new_rows long, window_seconds int, spike_lines int")
    for k in range(2):
        ticks.where((F.col("tick") >= 900) if k else (F.col("tick") < 900)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/t")
    s = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/t")
    q = pipeline.stream_gate(s).writeStream.outputMode("append").format("memory").queryName("gated").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("gated").collect())) == sorted(map(tuple, semantic.gate(ticks).collect()))


def test_raw_files(spark, tmp_path):
    """Blank lines go; equal lines have ids of their own, the same in splits of any size and when later
    files are read with them; they grow with time and place."""
    (tmp_path / "in").mkdir()
    text = b"one\r\n\r\ntwo\nthree\n" + b"same line\n" * 5000
    (tmp_path / "in" / "b.log").write_bytes(text)
    (tmp_path / "in" / "a.log").write_bytes(b"same line\nlast")
    os.utime(tmp_path / "in" / "b.log", (1000, 1000))
    os.utime(tmp_path / "in" / "a.log", (2000, 2000))
    read = lambda at: sorted((r.id, r.raw) for r in tables.raw_files(spark, f"file://{tmp_path}/{at}", "p").collect())
    whole = read("in")
    assert [x for _, x in whole] == ["one", "two", "three", *["same line"] * 5001, "last"] and len({i for i, _ in whole}) == len(whole)
    assert read("in/b.log") == whole[:5003]
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        assert read("in") == whole and tables.raw_files(spark, f"file://{tmp_path}/in", "p").rdd.getNumPartitions() > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_equal_lines_fire_each(spark, tmp_path, monkeypatch):
    """A file of equal lines, through the stream: as many events, firings and ledger rows as lines, by
    columns and by the index."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_bytes(b"<13>Jun 30 14:03:11 web-3 sshd[1]: user 12 failed\n" * 40 + b"<13>Jun 30 14:03:11 web-3 sshd[1]: fine\n")
    rules = lambda: (tables.rules(spark), tables.bindings(spark), tables.targets(spark))
    for few in (50, 0):
        monkeypatch.setattr(routing, "COMPILED_RULES", few)
        out = f"file://{tmp_path}/out{few}"
        told = []
        events, incident_query = pipeline.start(tables.raw_files(spark, f"file://{tmp_path}/in", stream=True), out, rules, deliver=lambda df, n: told.append((n, df.count())), availableNow=True)
        assert events.awaitTermination(120)
        assert incident_query().awaitTermination(120)
        read = lambda name: spark.read.parquet(f"{out}/{name}")
        assert read("events").select("id").distinct().count() == 41
        assert read("firings").count() == read("firings").select("id").distinct().count() == read("ledger").count() == 40
        assert [n for _, n in told] == [read("outbox").count()] and told[0][1] > 0


@pytest.fixture
def rocks(spark):
    """Stateful processors need the store that keeps state on disk."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def in_files(df, path, n):
    """df in n files, in order of id."""
    for k, part in enumerate(np.array_split(np.array(sorted(r.id for r in df.select("id").distinct().collect())), n)):
        df.where(F.col("id").between(int(part[0]), int(part[-1]))).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def routed_firings(spark):
    rows = tables.log_events(spark, SF)
    fired = routing.route(rows, routing.compile_rules(tables.rules(spark), tables.bindings(spark)))
    return fired.withColumns({"key": incidents.dedup_key(), "stateful": F.col("target_id") != 10, "known_type": (F.col("target_id") != 12) | (F.col("id") % 11 != 0), "delivery_ok": F.col("id") % 5 != 0, "gone": F.col("id") % 7 == 0})


def by_time(df):
    """ids in order of time, as a stream's arrival gives them."""
    return df.withColumn("id", F.dense_rank().over(W.orderBy("ts", "id")).cast("long"))


def test_stream_deliveries_equal_batch(spark, tmp_path, rocks):
    firings = by_time(routed_firings(spark))
    in_files(firings, f"file://{tmp_path}/in", 4)
    s = spark.readStream.schema(firings.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = stateful.stream_deliveries(s, 7200, 3600).writeStream.format("memory").queryName("delivered").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    columns = ["id", "key", "incident", "disposition", "counts_as_fed"]
    want = incidents.delivered_dispositions(firings, 7200, 3600).select(*columns)
    assert sorted(map(repr, spark.table("delivered").select(*columns).collect())) == sorted(map(repr, want.collect()))


def test_stream_ceiling_equals_batch(spark, tmp_path, rocks):
    firings = by_time(routed_firings(spark).where("target_id in (11, 12)").drop("stateful", "known_type", "delivery_ok", "gone"))
    in_files(firings, f"file://{tmp_path}/in", 3)
    s = spark.readStream.schema(firings.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = stateful.stream_ceiling(s, 1, 7200, 3600).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    columns = ["id", "key", "incident", "disposition"]
    want = incidents.with_ceiling(firings, 1, 7200, 3600, 4).select(*columns).collect()
    assert sorted(map(repr, spark.table("limited").select(*columns).collect())) == sorted(map(repr, want)) and any(r.disposition == "rate_limited" for r in want)


@pytest.mark.parametrize("ceiling", [0, 2])
def test_stream_rules_equal_batch(spark, tmp_path, rocks, ceiling):
    """Evaluations and trace of a stream that is stopped and started again, on a clock of an hour."""
    every = 3600
    tick = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / every) * every).cast("long")
    rows = by_time(tables.log_events(spark, SF)).withColumns({"rule_id": F.right("source", F.lit(2)).cast("long") % 5, "tick": tick, "window_seconds": F.lit(7200), "spike_lines": F.lit(3)})
    rules = spark.createDataFrame([(k, f"user {k} did error") for k in range(5)], "rule_id long, pattern string")
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    halves = [rows.where("id <= 500"), rows.where("id > 500")]
    for half in halves:
        in_files(half, src, 2)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
        kept, judging = stateful.start_rules(stream, out, lambda: rules, every, ceiling, availableNow=True)
        assert kept.awaitTermination(200)
        assert judging().awaitTermination(200)
    last = rows.agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0]
    until = last // every * every - every
    gated = clock.clocked_gate(rows, until, every, ceiling)
    want = clock.trace(clock.windows(rows, gated), gated, rules).collect()
    got = spark.read.parquet(f"{out}/trace").drop("batch").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 50
    with_rows = {(r.rule_id, r.tick) for r in rows.select("rule_id", "tick").distinct().collect()}
    assert any((r.rule_id, r.tick) not in with_rows for r in gated.collect())  # evaluated though no row came
    assert not ceiling or max(collections.Counter(r.tick for r in gated.collect()).values()) <= ceiling


def test_registry_writes_what_a_batch_touches(spark, tmp_path):
    """A batch of one key writes one bucket; replayed and interrupted batches change nothing."""
    from cairnlog.functions.templates import merge_templates, template_delta

    path = f"file://{tmp_path}/templates"
    rows = tables.log_events(spark, SF).withColumn("body", F.concat("body", F.lit(" at "), F.translate((F.col("id") % 60).cast("string"), "0123456789", "abcdefghij")))
    part = lambda n: template_delta(rows.where(F.col("id") % 6 == n))
    for n in [0, 1, 1, 2, 3, 3, 4, 5, 5]:
        registry.merge_batch(spark, path, part(n), "fp", merge_templates, n)
    read = lambda: sorted(map(tuple, registry.registry(spark, path).select("fp", "hits", "first_id").collect()))
    assert read() == sorted(map(tuple, template_delta(rows).select("fp", "hits", "first_id").collect())) and len(read()) > 100
    one = part(0).orderBy("fp").limit(1)
    registry.merge_batch(spark, path, one, "fp", merge_templates, 6)
    assert len(os.listdir(tmp_path / "templates" / "v=6")) == 3  # one bucket, and the mark that it is whole with its checksum
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / "templates" / f"v={v}").rglob("*.parquet"))
    assert size(6) * 5 < size(5)
    whole = read()
    os.remove(tmp_path / "templates" / "v=6" / "_SUCCESS")  # the batch did not come to its end
    assert read() != whole
    registry.merge_batch(spark, path, one, "fp", merge_templates, 6)
    assert read() == whole
    registry.merge_batch(spark, path, one.limit(0), "fp", merge_templates, 7)
    assert read() == whole and all(len(v) <= 2 for v in registry.versions(spark, path).values())


def test_rule_windows_of_a_stream(spark, tmp_path):
    """Sliding and tumbling windows of a stream, from panes, equal those of the table once they are over."""
    from pyspark.sql import Row

    from cairnlog.operators import panes

    names = [x.split()[0] for x in panes.RULE.split(", ")]
    rules = [Row(**dict(zip(names, r, strict=True))) for r in [(1, "tumbling", 7200, None, 2, None, 9), (2, "sliding", 10800, 3600, 3, "host-0*", None), (3, "sliding", 10800, 3600, 1, None, 17)]]
    rows = by_time(tables.log_events(spark, SF)).select("id", F.col("ts").cast("timestamp").alias("ts"), "source", "severity")
    in_files(rows, f"file://{tmp_path}/in", 3)
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = panes.rule_windows(s, rules, "0 seconds").writeStream.format("memory").outputMode("append").queryName("rule_windows").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(250)
    got = {tuple(r) for r in spark.table("rule_windows").collect()}
    want = {tuple(r) for r in panes.rule_windows(rows, rules).collect()}
    newest = rows.agg(F.max("ts")).first()[0]
    size = {1: 7200, 2: 10800, 3: 10800}
    over = {w for w in want if w[2] + datetime.timedelta(seconds=size[w[0]]) <= newest - datetime.timedelta(seconds=7200)}
    assert over and over <= got <= want
    with pytest.raises(ValueError):
        panes.rule_windows(rows, [Row(**dict(zip(names, (4, "sliding", 100, 30, 1, None, None), strict=True)))])
    assert panes.rule_windows(rows, []).count() == 0


def test_feed_hands_over_while_the_table_grows(spark, tmp_path):
    """Backfill and tail together have each event once, also when the feed starts again."""
    rows = by_time(tables.log_events(spark, SF)).select("id", "source", "severity")
    src, seen = f"file://{tmp_path}/in", []
    deliver = lambda df, n: seen.append((n, [r.id for r in df.collect()]))
    test = F.col("severity") >= 9
    in_files(rows.where("id <= 300"), src, 2)
    q = pipeline.feed(spark, src, rows.schema, test, deliver, f"file://{tmp_path}/cp", 1000, processingTime="200 milliseconds")
    in_files(rows.where("id between 301 and 600"), src, 3)
    q.processAllAvailable()
    q.stop()
    in_files(rows.where("id > 600"), src, 2)
    again = pipeline.feed(spark, src, rows.schema, test, deliver, f"file://{tmp_path}/cp", 1000, availableNow=True)
    assert again.awaitTermination(120)
    want = sorted(r.id for r in rows.where(test).collect())
    assert sorted(i for _, ids in seen for i in ids) == want
    assert seen[0][0] == -1 and seen[0][1] == [i for i in want if i <= 300] and len([n for n, _ in seen if n == -1]) == 1


def test_retention_job(spark, tmp_path):
    from cairnlog.operators import maintenance

    path = f"file://{tmp_path}/weeks"
    maintenance.write_weeks(tables.log_events(spark, SF), path)
    weeks = lambda: sorted(x for x in os.listdir(tmp_path / "weeks") if x.startswith("week_start="))
    before = weeks()
    q = maintenance.start_retention(spark, path, 60, "1 second", lambda: datetime.datetime(2024, 4, 20))
    for _ in range(120):
        if weeks() != before:
            break
        time.sleep(0.5)
    q.stop()
    assert weeks() == [w for w in before if datetime.date.fromisoformat(w[11:]) + datetime.timedelta(7) > datetime.date(2024, 2, 20)] != before


def test_written_weeks_are_pruned(spark, tmp_path):
    """A search in a time range opens the files of its weeks only, and finds the same rows."""
    from cairnlog.operators import maintenance
    from cairnlog.plans import queries

    path = f"file://{tmp_path}/weeks"
    events = tables.log_events(spark, SF)
    maintenance.write_weeks(events, path)
    search = lambda rows, **more: queries.search_logs(rows, source="host-07", limit=2000, **more)
    span = {"since": "2024-01-10T00:00:00Z", "until": "2024-01-20T12:00:00Z"}

    def files(df):
        """Files of the weeks that the plan's partition filters leave."""
        filters = re.search(r"PartitionFilters: \[(.*?)\], P", df._jdf.queryExecution().executedPlan().toString())[1]
        bounds = [datetime.date.fromisoformat(x) for x in re.findall(r"week_start#\d+ [<>]= (\d{4}-\d\d-\d\d)", filters)]
        low, high = (min(bounds), max(bounds)) if bounds else (datetime.date.min, datetime.date.max)
        return sum(low <= datetime.date.fromisoformat(f.parent.name[11:]) <= high for f in (tmp_path / "weeks").rglob("*.parquet"))

    table = spark.read.parquet(path)
    some, every = search(table, **span), search(table)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(some) == ids(search(events, **span)) and ids(every) == ids(search(events))
    assert 0 < files(some) < files(every)


def test_registry_merge_reads_its_batch_once(spark, tmp_path):
    """What a batch's rows are made from is gone through once, though they are merged and their buckets named."""
    gone = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            gone.add(batch.num_rows)
            yield batch

    merge = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    for batch in range(2):
        delta = spark.range(0, 300, 1, 3).selectExpr("id % 30 as k").mapInArrow(seen, "k long").groupBy("k").agg(F.count("*").alias("n"))
        registry.merge_batch(spark, f"file://{tmp_path}/r", delta, "k", merge, batch)
    assert gone.value == 600
    assert {(r.k, r.n) for r in registry.registry(spark, f"file://{tmp_path}/r").collect()} == {(k, 20) for k in range(30)}
