"""The registered queries over the given tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decode, predicates, stems, templates
from ..operators import clock, incidents, maintenance, neighbours, outbox, panes, postings, routing, semantic
from ..sources import tables as S
from ..streaming import pipeline
from . import queries as Q

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LOGS, DIMS = S.LOG_EVENTS_SQL, S.DIMENSIONS_SQL
AS_OF = datetime(2024, 4, 20)
SINCE, UNTIL = "2024-01-10T00:00:00Z", "2024-01-20T12:00:00Z"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def logs(query: str) -> str:
    return f"with {LOGS} {query}"


# ------------------------------------------------------------------ decode (S, F1-F2)

_SEV = "case severity when 17 then 3 when 10 then 5 when 9 then 6 else 7 end"
RAW_SQL = f"""{LOGS}, raw_lines as (select id, ts as received_at, case id % 4
  when 0 then concat('<', cast(8*4+{_SEV} as varchar), '>1 ', strftime(ts,'%Y-%m-%dT%H:%M:%SZ'), ' ', source, ' ', coalesce(program,'-'), ' ', cast(id as varchar), ' ID47 [ex@1 k="v', cast(id%10 as varchar), '"] ', body)
  when 1 then concat('<', cast(8*16+{_SEV} as varchar), '>', strftime(ts,'%b %d %H:%M:%S'), ' ', source, ' ', case when program is null then '' else concat(replace(program,'%',''), '[', cast(id as varchar), ']: ') end, body)
  when 2 then concat('<189>', cast(id as varchar), ': ', source, ': ', strftime(ts,'%b %d %H:%M:%S'), '.001 UTC: %LINK-', cast({_SEV} as varchar), '-UPDOWN: ', body)
  else concat('undecodable ', body) end as raw from log_events),
p as (select *, regexp_extract(raw, '^<(\\d{{1,3}})>', 1) as pri, regexp_replace(raw, '^<\\d{{1,3}}>', '') as text from raw_lines),
k as (select *, case when regexp_matches(text, '%[A-Z0-9_]+-\\d-[A-Z0-9_]+: ') and text like '%UTC: %' then 'device' when text like '1 %' then 'rfc5424'
  when regexp_matches(text, '^[A-Z][a-z][a-z] +\\d+ \\d\\d:\\d\\d:\\d\\d ') then 'rfc3164' else 'none' end as kind from p)"""


def decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode.decode_lines(S.raw_lines(spark, d))


@register("s03_decode_pri", f"""with {RAW_SQL} select id, kind, case when pri = '' then null else cast(pri as integer) // 8 end as facility_no,
  case when pri = '' then null when cast(pri as integer) // 8 = 4 then 'auth' when cast(pri as integer) // 8 = 16 then 'local0' else 'local7' end as facility from k""")  # fmt: skip
def s03(spark, d):
    number = F.create_map(*(F.lit(x) for n, name in decode.FACILITIES.items() for x in (name, n)))
    return decoded(spark, d).select("id", "kind", F.element_at(number, F.col("facility")).alias("facility_no"), "facility")


@register("s04_severity", f"""with {RAW_SQL}, s as (select id, case when kind = 'device' then cast(regexp_extract(text, '%[A-Z0-9_]+-(\\d)-', 1) as integer)
  when pri = '' then null else cast(pri as integer) % 8 end as s from k)
  select id, ([24,21,19,17,13,10,9,5])[s + 1] as severity, (['emerg','alert','crit','err','warning','notice','info','debug'])[s + 1] as severity_text from s""")  # fmt: skip
def s04(spark, d):
    return decoded(spark, d).select("id", "severity", "severity_text")


@register("s06_device_header", f"""with {RAW_SQL} select id, regexp_extract(text, '^\\d+: ([^:]+): ', 1) as source, received_at as ts,
  regexp_extract(text, '(%[A-Z0-9_]+-\\d-[A-Z0-9_]+): ', 1) as program, regexp_replace(text, '^.*%[A-Z0-9_]+-\\d-[A-Z0-9_]+: ', '') as body,
  regexp_extract(text, '^(\\d+): ', 1) as seq, regexp_extract(text, '^\\d+: [^:]+: (.* UTC): %', 1) as device_time from k where kind = 'device'""")  # fmt: skip
def s06(spark, d):
    rows = decoded(spark, d).where("kind = 'device'")
    return rows.select("id", "source", "ts", "program", "body", F.col("attributes")["device_seq"].alias("seq"), F.col("attributes")["device_time"].alias("device_time"))


@register("s07_rfc5424", f"""with {RAW_SQL} select id, split_part(text, ' ', 3) as source, nullif(split_part(text, ' ', 4), '-') as program, split_part(text, ' ', 5) as procid,
  split_part(text, ' ', 6) as msgid, regexp_extract(text, 'k="([^"]*)"', 1) as sd_k, regexp_replace(text, '^.*?\\] ', '') as body from k where kind = 'rfc5424'""")  # fmt: skip
def s07(spark, d):
    rows = decoded(spark, d).where("kind = 'rfc5424'")
    return rows.select("id", "source", "program", F.col("attributes")["procid"].alias("procid"), F.col("attributes")["msgid"].alias("msgid"), F.col("sd")["ex@1"]["k"].alias("sd_k"), "body")


@register("s08_timestamps", f"with {RAW_SQL} select id, kind, case when kind in ('rfc5424', 'rfc3164') then date_trunc('second', received_at) else received_at end as ts from k")
def s08(spark, d):
    return decoded(spark, d).select("id", "kind", "ts")


@register("s10_rfc3164", f"""with {RAW_SQL} select id, regexp_extract(text, '^\\S+ +\\d+ \\S+ (\\S+) ', 1) as source, nullif(regexp_extract(text, ' ([^\\s:\\[]+)\\[\\d+\\]: ', 1), '') as program,
  nullif(regexp_extract(text, '\\[(\\d+)\\]: ', 1), '') as pid, regexp_extract(text, '(user \\d+ did .*)$', 1) as body from k where kind = 'rfc3164'""")  # fmt: skip
def s10(spark, d):
    rows = decoded(spark, d).where("kind = 'rfc3164'")
    return rows.select("id", "source", "program", F.col("attributes")["pid"].alias("pid"), "body")


@register("s12_fallback", f"with {RAW_SQL} select id, '10.9.0.7' as source, text as body, received_at as ts from k where kind = 'none'")
def s12(spark, d):
    return decoded(spark, d).where("kind = 'none'").select("id", "source", "body", "ts")


def _duck_template(body: str) -> str:
    out = f"coalesce({body}, '')"
    for m in templates.MASKS:
        out = f"regexp_replace({out}, '{m}', '<*>', 'g')"
    return f"trim(regexp_replace({out}, '(<\\*>)(\\s+<\\*>)+', '\\1', 'g'))"


TEMPLATES_SQL = f"{LOGS}, tp as (select *, {_duck_template('body')} as template from log_events), t as (select *, sha1(concat(coalesce(program, ''), chr(0), template)) as fp from tp)"


_TWICE = f"with {RAW_SQL}, t as (select raw from raw_lines union all select raw from raw_lines where id % 3 = 0)"


@register("s01_raw_files", f"{_TWICE} select raw, count(*) as n, count(*) as n_ids, 1::bigint as n_readings from t group by raw")
def s01(spark, d):
    """Lines of files, of which some are equal: each has an id of its own, and the same one when the
    files are read again in other splits."""
    lines = S.raw_lines(spark, d).select("raw", "id")
    path = S.shared_folder(spark, "lines")
    lines.union(lines.where("id % 3 = 0")).repartition(8, "raw").select("raw").write.text(path)
    once = S.raw_files(spark, path)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        again = S.written(S.raw_files(spark, path).select("id", "raw"), "lines-again")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    both = once.select("id", "raw", F.lit(1).alias("k")).union(again.select("id", "raw", F.lit(2)))
    ids = both.groupBy("raw", "id").agg(F.count_if(F.col("k") == 1).alias("first"), F.count_if(F.col("k") == 2).alias("second"))
    same = F.when(F.count_if((F.col("first") != 1) | (F.col("second") != 1)) == 0, 1).otherwise(2).cast("long")
    return ids.groupBy("raw").agg(F.sum("first").alias("n"), F.count_if(F.col("first") > 0).alias("n_ids"), same.alias("n_readings"))


@register("s13_mine_template", f"with {TEMPLATES_SQL} select id, template, fp from t")
def s13(spark, d):
    return templates.with_template(S.log_events(spark, d)).select("id", "template", "fp")


@register("s13_document_templates", f"select doc_id, {_duck_template('text')} as template from documents")
def s13b(spark, d):
    return S.table(spark, d, "documents").select("doc_id", templates.template(F.col("text")).alias("template"))


_FIRST = "min(ts) as first_seen, max(ts) as last_seen, min(id) as first_id"


@register("s16_template_upsert", f"with {TEMPLATES_SQL} select fp, arg_min(template, id) as template, count(*) as hits, {_FIRST} from t group by fp")
def s16(spark, d):
    rows = S.log_events(spark, d)
    half = F.col("id") % 2 == 0
    old, new = templates.template_delta(rows.where(half)), templates.template_delta(rows.where(~half))
    return templates.merge_templates(old, new).select("fp", "template", F.col("hits").cast("long").alias("hits"), "first_seen", "last_seen", "first_id")


@register("s17_source_upsert", logs("select source, count(*) as events, min(ts) as first_seen, max(ts) as last_seen, true as active from log_events group by source"))
def s17(spark, d):
    rows = S.log_events(spark, d)
    half = F.col("id") % 2 == 0
    return templates.merge_sources(templates.source_delta(rows.where(half)), templates.source_delta(rows.where(~half)))


@register("a04_template_counts", f"with {TEMPLATES_SQL} select fp, count(*) as hits from t group by fp")
def a04(spark, d):
    return templates.template_delta(S.log_events(spark, d)).select("fp", "hits")


@register("f01_iso_render", logs("select id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, epoch_us(ts) // 1000 as ts_ms, strftime(ts, '%H:%M:%S') as clock from log_events"))
def f01(spark, d):
    return S.log_events(spark, d).select("id", predicates.iso(F.col("ts")).alias("iso"), predicates.epoch_ms(F.col("ts")).alias("ts_ms"), F.date_format("ts", "HH:mm:ss").alias("clock"))


@register("f16_json_fields", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def f16(spark, d):
    return S.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ------------------------------------------------------------------ predicates and queries (P, T, Q)


@register("p02_glob_route", logs("select id from log_events where regexp_matches(source, '^host-[01][^3-9]$')"))
def p02(spark, d):
    return S.log_events(spark, d).where(predicates.glob_route(F.col("source"), "host-[01][!3-9]")).select("id")


@register("p03_glob_window", logs("select id from log_events where source like 'host_1%'"))
def p03(spark, d):
    return S.log_events(spark, d).where(predicates.glob_window(F.col("source"), "host_1*")).select("id")


@register("p07_full_text", "select doc_id from documents where list_contains(string_split_regex(lower(text), '[^a-z0-9_]+'), 'from') and list_contains(string_split_regex(lower(text), '[^a-z0-9_]+'), 'nt')")
def p07(spark, d):
    return S.table(spark, d, "documents").where(predicates.contains_all(F.col("text"), "from the NT")).select("doc_id")


def _stems_sql(words: str) -> str:
    """(doc_id, w): the stems of the words (doc_id, w) of a query."""
    for expression in stems.stem_sql("w"):
        words = f"select doc_id, o, {expression} as w from ({words})"
    return f"select doc_id, case when length(o) <= 2 then o else w end as w from ({words})"


_DOC_WORDS = "select distinct doc_id, w as o, w from (select doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) as w from documents) where w <> ''"


@register("p07_postings", f"select doc_id as id from ({_stems_sql(_DOC_WORDS)}) where w in ('from', 'thing', 're') group by doc_id having count(distinct w) = 3")
def p07_postings(spark, d):
    """Stemmed search of whole texts through a written posting table."""
    path = S.shared_folder(spark, "postings")
    postings.write_postings(S.table(spark, d, "documents"), path, "doc_id", "text")
    return postings.search_postings(spark, path, "the THINGS from reing")


def _written_weeks(spark, d) -> str:
    path = S.shared_folder(spark, "weeks")
    maintenance.write_weeks(S.log_events(spark, d), path)
    return path


@register("q01_written_weeks", logs("select id, ts, source, program from log_events where source = 'host-07' and program = 'sshd' and ts between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-20 12:00:00' order by ts desc, id desc limit 200"))
def q01_weeks(spark, d):
    """A search over the written weekly partitions."""
    rows = spark.read.parquet(_written_weeks(spark, d))
    return Q.search_logs(rows, source="host-07", program="sshd", since=SINCE, until=UNTIL).select("id", "ts", "source", "program")


@register("m01_written_weeks", logs("select cast(date_trunc('week', ts) as date) as week_start, count(*) as n from log_events where date_trunc('week', ts) + interval 7 day > timestamp '2024-04-20' - interval 81 day group by 1"))
def m01_weeks(spark, d):
    """What retention leaves of the written weekly partitions."""
    path = _written_weeks(spark, d)
    schema = spark.read.parquet(path).schema
    maintenance.drop_expired(spark, path, AS_OF, 81)
    return spark.read.schema(schema).parquet(path).groupBy("week_start").agg(F.count("*").alias("n"))


@register("p12_like_any", logs("select id from log_events where body ilike '%amount 1_0%' or source ilike '%t-03%' or program ilike '%SSH%'"))
def p12(spark, d):
    rows = S.log_events(spark, d)
    test = predicates.like_any([F.col("body")], "amount 1_0") | predicates.like_any([F.col("source")], "t-03") | predicates.like_any([F.col("program")], "SSH")
    return rows.where(test).select("id")


@register("p13_cursor", logs("select id, source from log_events where id > (select max(id) from log_events) // 2"))
def p13(spark, d):
    rows = S.log_events(spark, d)
    top = rows.agg(F.max("id").alias("m")).first().m or 0
    return rows.where(F.col("id") > top // 2).select("id", "source")


_COLS = "id, ts, source, severity, severity_text, program, body"


@register("q01_search_logs", logs(f"select {_COLS} from log_events where source like 'host-0_' and program = 'sshd' and regexp_matches(body, 'amount [0-9]{{4}} ') and severity >= 9 and ts between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-20 12:00:00' order by ts desc, id desc limit 200"))
def q01(spark, d):
    return Q.search_logs(S.log_events(spark, d), source="host-0?", program="sshd", regex="amount [0-9]{4} ", severity_min=9, since=SINCE, until=UNTIL)


_WINDOW = "ts between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-20 12:00:00' and (source like 'host-0%' or source = 'host-15') and severity >= 9"


@register("q02_timeline", logs(f"select {_COLS} from log_events where {_WINDOW} order by ts, id limit 500"))
def q02(spark, d):
    return Q.timeline(S.log_events(spark, d), SINCE, UNTIL, "host-0*, host-15", 9)


@register("a01_source_summary", logs(f"select source, count(*) as n, max(severity) as worst from log_events where {_WINDOW} group by source"))
def a01(spark, d):
    return Q.timeline_summary(S.log_events(spark, d), SINCE, UNTIL, "host-0*, host-15", 9)


@register("a03_high_water", logs("select count(*) as n, coalesce(max(id), 0) as top from log_events where source like 'host-1%' and severity >= 10"))
def a03(spark, d):
    rows = S.log_events(spark, d).where(predicates.glob_window(F.col("source"), "host-1*") & predicates.severity_at_least(F.col("severity"), 10))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("top"))


_SOURCES = "s as (select source, count(*) as events, max(ts) as last_seen from log_events group by source)"


@register("q03_list_sources", f"with {LOGS}, {_SOURCES} select source, events, last_seen, true as active from s where source like 'host-1_'")
def q03(spark, d):
    rows = templates.source_delta(S.log_events(spark, d)).select("source", "events", "last_seen", "active")
    return Q.list_sources(rows, "host-1?")


@register("m02_deactivate_quiet", f"with {LOGS}, {_SOURCES} select source, last_seen >= timestamp '2024-04-20' - interval 81 day as active from s")
def m02(spark, d):
    return maintenance.deactivate_quiet(templates.source_delta(S.log_events(spark, d)), AS_OF, 81).select("source", "active")


@register("q06_backtest_rule", logs("select id, source, body from log_events where severity >= 9 and source like 'host-1%' and ts >= timestamp '2024-01-10' and regexp_matches(body, 'user 1[0-9] ') order by ts desc, id desc limit 200"))
def q06(spark, d):
    rows = Q.backtest_scope(S.log_events(spark, d), "user 1[0-9] ", "host-1*", 9, SINCE)
    return rows.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(200).select("id", "source", "body")


@register("a02_match_count", logs("select count(*) as n from log_events where severity >= 9 and source like 'host-1%' and ts >= timestamp '2024-01-10' and regexp_matches(body, 'user 1[0-9] ')"))
def a02(spark, d):
    return Q.backtest_scope(S.log_events(spark, d), "user 1[0-9] ", "host-1*", 9, SINCE).agg(F.count("*").alias("n"))


@register("t03_latest", logs("select id, source from (select * from log_events order by id desc limit 500) order by id"))
def t03(spark, d):
    return S.log_events(spark, d).orderBy(F.col("id").desc()).limit(500).orderBy("id").select("id", "source")


# ------------------------------------------------------------------ routing (J, W)


def _route_sql(dims: str, rules: str, binds: str) -> str:
    return f"""{LOGS}, {dims},
m as (select e.*, r.rule_id, r.stop, row_number() over (partition by e.id order by r.rule_order, r.rule_id) as rk
  from log_events e join {rules} r on r.kind = 'regex' and r.enabled and (coalesce(r.min_severity, 0) = 0 or e.severity >= r.min_severity)
  and (coalesce(r.source_glob, '') = '' or e.source glob r.source_glob) and regexp_matches(concat(coalesce(e.program, ''), ' ', coalesce(e.body, '')), r.pattern)
  where r.stop or r.rule_id in (select rule_id from {binds})),
c as (select *, min(case when stop then rk end) over (partition by id) as cut from m),
routed as (select c.id, c.ts, c.source, c.severity, c.severity_text, c.program, c.body, c.rule_id, b.target_id from c join {binds} b using (rule_id) where rk <= coalesce(cut, rk)
  qualify row_number() over (partition by c.id, b.target_id order by rk) = 1)"""


ROUTE_SQL = _route_sql(DIMS, "rules", "binds")


def _compiled(spark):
    return routing.compile_rules(S.rules(spark), S.bindings(spark))


def routed(spark: SparkSession, d: str) -> DataFrame:
    return routing.route(S.log_events(spark, d), _compiled(spark))


@register("q12_route", f"with {ROUTE_SQL} select id, rule_id, target_id from routed")
def q12(spark, d):
    return routed(spark, d).select("id", "rule_id", "target_id")


@register("j01_match_rules", f"with {ROUTE_SQL} select id, rule_id, cast(dense_rank() over (partition by id order by rk) as integer) as k from m")
def j01(spark, d):
    rows = routing.matches(S.log_events(spark, d), _compiled(spark))
    return rows.select("id", F.posexplode("matched").alias("p", "m")).select("id", "m.rule_id", (F.col("p") + 1).alias("k"))


@register("w02_stop_cut", f"with {ROUTE_SQL} select id, rule_id from c where rk <= coalesce(cut, rk)")
def w02(spark, d):
    rows = routing.matches(S.log_events(spark, d), _compiled(spark))
    return rows.select("id", F.explode(routing.stop_cut(F.col("matched"))).alias("m")).select("id", "m.rule_id")


@register("q07_backtest_ruleset", f"with {ROUTE_SQL} select rule_id, count(*) as n from m group by rule_id")
def q07(spark, d):
    return routing.backtest(S.log_events(spark, d), _compiled(spark))


# ------------------------------------------------------------------ incidents (O)


def _fold_sql(rows: str, ttl: int, feed: int | str) -> str:
    """Incident numbers by gaps, then feeds by a recursive walk from one row to the next; feed is a
    number of seconds or an expression over the row n."""
    return f"""f0 as ({rows}), f1 as (select *, epoch_us(ts) as us, row_number() over (partition by key order by ts, id) as rn,
  epoch_us(ts) - lag(epoch_us(ts)) over (partition by key order by ts, id) as gap from f0),
f2 as (select *, sum(case when gap is null or gap >= {ttl}000000 then 1 else 0 end) over (partition by key order by ts, id) as incident from f1),
f3 as (select *, row_number() over (partition by key, incident order by ts, id) as pos from f2),
walk(key, incident, pos, fed, what) as (
  select key, incident, pos, us, 'opened' from f3 where pos = 1
  union all select n.key, n.incident, n.pos, case when n.us - w.fed >= ({feed}) * 1000000::bigint then n.us else w.fed end,
    case when n.us - w.fed >= ({feed}) * 1000000::bigint then 'fed' else 'throttled' end
  from walk w join f3 n on n.key = w.key and n.incident = w.incident and n.pos = w.pos + 1),
folded as (select f3.*, walk.what as disposition from f3 join walk on f3.key = walk.key and f3.incident = walk.incident and f3.pos = walk.pos)"""


_BY_SOURCE = "select *, source as key from log_events where severity >= 17"
FOLD_SQL = f"with recursive {LOGS}, {_fold_sql(_BY_SOURCE, 7200, 3600)}"
_ROUTED_KEY = "select *, concat(cast(rule_id as varchar), ':', cast(target_id as varchar), ':', source) as key from routed"
ROUTED_FOLD_SQL = f"with recursive {ROUTE_SQL}, {_fold_sql(_ROUTED_KEY, 7200, 3600)}"


def _by_source(spark, d):
    return S.log_events(spark, d).where("severity >= 17").withColumn("key", F.col("source"))


def decided(spark: SparkSession, d: str) -> DataFrame:
    return incidents.split_dispositions(routed(spark, d).withColumn("key", incidents.dedup_key()), 7200, 3600)


@register("o01_incidents", f"{FOLD_SQL} select id, key, cast(incident as bigint) as incident from folded")
def o01(spark, d):
    return incidents.number_incidents(_by_source(spark, d), 7200).select("id", "key", F.col("incident").cast("long").alias("incident"))


@register("o02_feed_throttle", f"{FOLD_SQL} select id, key, disposition from folded")
def o02(spark, d):
    return incidents.dispositions(_by_source(spark, d), 7200, 3600).select("id", "key", "disposition")


_ONE_KEY = "select *, 'all' as key from log_events where severity >= 17 union all select *, source from log_events where severity >= 17"


@register("o02_hot_key", f"with recursive {LOGS}, {_fold_sql(_ONE_KEY, 7200, 3600)} select id, key, incident::bigint as incident, disposition from folded")
def o02_hot(spark, d):
    """Half of all firings under one key, which is folded in ranges of time."""
    rows = _by_source(spark, d)
    rows = rows.withColumn("key", F.lit("all")).union(rows)
    return incidents.split_dispositions(rows, 7200, 3600, hot_rows=rows.count() // 4).select("id", "key", F.col("incident").cast("long").alias("incident"), "disposition")


@register("o02_array_fold", f"{FOLD_SQL} select id, key, disposition from folded")
def o02b(spark, d):
    return incidents.array_dispositions(_by_source(spark, d), 7200, 3600).select("id", "key", "disposition")


@register("q13_incidents", f"{ROUTED_FOLD_SQL} select id, rule_id, target_id, key, disposition from folded")
def q13(spark, d):
    return decided(spark, d).select("id", "rule_id", "target_id", "key", "disposition")


@register("a09_incident_counters", f"""{ROUTED_FOLD_SQL}, g as (select key, incident, count(*) as event_count, min(ts) as opened_at, max(ts) as last_event_at, max(case when disposition <> 'throttled' then ts end) as last_fed_at from folded group by key, incident)
  select key, event_count, opened_at, last_event_at, last_fed_at from g qualify row_number() over (partition by key order by incident desc) = 1""")  # fmt: skip
def a09(spark, d):
    return incidents.current_incidents(decided(spark, d)).drop("incident")


@register("a11_last_fired", f"{ROUTED_FOLD_SQL} select rule_id, max(ts) as last_fired from folded where disposition = 'opened' group by rule_id")
def a11(spark, d):
    return incidents.last_fired(decided(spark, d))


@register("a12_disposition_rollup", f"""{ROUTED_FOLD_SQL} select rule_id, count(*) filter (disposition = 'opened') as opened, count(*) filter (disposition = 'fed') as fed, count(*) filter (disposition = 'throttled') as throttled from folded group by rule_id""")
def a12(spark, d):
    kinds = ["opened", "fed", "throttled"]
    return decided(spark, d).groupBy("rule_id").pivot("disposition", kinds).count().select("rule_id", *(F.coalesce(k, F.lit(0)).alias(k) for k in kinds))


@register("o14_event_windows", logs("select source, time_bucket(interval 1 hour, ts) as start, count(*) as n from log_events where severity >= 17 group by all having count(*) >= 2"))
def o14(spark, d):
    rows = S.log_events(spark, d).where("severity >= 17").withColumn("ts", F.col("ts").cast("timestamp"))
    return pipeline.window_counts(rows, "1 hour", spike=2).withColumn("start", F.col("start").cast("timestamp_ntz"))


#: A window rule for each region: the odd ones slide by a third of their size.
_PANE_RULES = "select r_regionkey as rule_id, case when r_regionkey % 2 = 0 then 'tumbling' else 'sliding' end as window_kind, (r_regionkey + 1) * 5400 as window_seconds, case when r_regionkey % 2 = 0 then 0 else (r_regionkey + 1) * 1800 end as slide_seconds, r_regionkey % 3 + 2 as spike_lines, case when r_regionkey = 3 then 'host-1*' else '' end as source_glob, case when r_regionkey = 4 then 0 else 9 end as min_severity from region"


@register("o14_rule_windows", f"""with {LOGS}, r as ({_PANE_RULES}), e as (select l.source, cast(floor(epoch(ts)) as bigint) as es, r.*, case when slide_seconds = 0 then window_seconds else slide_seconds end as step
    from log_events l join r on (min_severity = 0 or severity >= min_severity) and (source_glob = '' or source glob source_glob)),
  w as (select rule_id, source, spike_lines, unnest(range(es // step * step - window_seconds + step, es // step * step + 1, step)) as start from e)
  select rule_id, source, make_timestamp(start * 1000000) as start, count(*) as n from w group by rule_id, source, start, spike_lines having count(*) >= spike_lines""")  # fmt: skip
def o14_rules(spark, d):
    """Tumbling and sliding windows with a spike threshold for each rule, from shared panes."""
    S.table(spark, d, "region").createOrReplaceTempView("pane_rule_regions")
    rules = spark.sql(_PANE_RULES.replace("from region", "from pane_rule_regions")).collect()
    return panes.rule_windows(S.log_events(spark, d), rules).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("o15_rule_cooldown", f"with recursive {ROUTE_SQL}, {_fold_sql(_ROUTED_KEY, 7200, 'n.rule_id * 900')} select id, rule_id, target_id, disposition from folded")
def o15(spark, d):
    rows = routed(spark, d).withColumns({"key": incidents.dedup_key(), "cooldown_seconds": F.col("rule_id") * 900.0})
    return incidents.dispositions(rows, 7200, "cooldown_seconds").select("id", "rule_id", "target_id", "disposition")


@register("w04_trailing_minute", f"""with {LOGS}, o as (select id, ts from log_events where severity >= 9)
  select id, n as trailing from (select id, count(*) over (order by floor(epoch(ts)) range between 60 preceding and current row) - (count(*) over (partition by floor(epoch(ts))) - row_number() over (partition by floor(epoch(ts)) order by ts, id)) as n from o) where n > 1""")  # fmt: skip
def w04(spark, d):
    rows = S.log_events(spark, d).where("severity >= 9").select("id", "ts")
    return incidents.over_ceiling(rows, 1).select("id", "trailing")


#: Row by row over all keys: st holds last event, last feed of each key, recent the opens of the last minute.
_CEILING_SQL = f"""with recursive {ROUTE_SQL}, k as (select *, concat(cast(rule_id as varchar), ':', cast(target_id as varchar), ':', source) as key, epoch_us(ts) as us from routed where target_id in (11, 12)),
  f as materialized (select *, row_number() over (order by us, id, key) as rn from k),
  walk(rn, id, key, disposition, st, recent) as (
    select 0::bigint, 0::bigint, '', '', map(['']::varchar[], [[0, 0]]::bigint[][]), []::bigint[]
    union all select rn, id, key, what, case when what = 'rate_limited' then st else map_concat(st, map([key], [[us, case when what in ('opened', 'fed') then us else s[2] end]])) end,
      case when what = 'opened' then list_append(near, us) else near end
    from (select *, case when s is not null and us - s[1] < 7200000000 then case when us - s[2] >= 3600000000 then 'fed' else 'throttled' end
        when len(near) >= 1 then 'rate_limited' else 'opened' end as what
      from (select f.rn, f.id, f.key, f.us, w.st, w.st[f.key] as s, list_filter(w.recent, lambda x: f.us - x <= 60000000) as near from walk w join f on f.rn = w.rn + 1)))
  select id, key, disposition from walk where rn > 0"""


@register("o04_rate_ceiling", _CEILING_SQL)
def o04(spark, d):
    rows = routed(spark, d).where("target_id in (11, 12)").withColumn("key", incidents.dedup_key())
    return incidents.with_ceiling(rows, 1, 7200, 3600).select("id", "key", "disposition")


#: The fold with failing deliveries, row by row within each key.
_DELIVERY_SQL = f"""with recursive {ROUTE_SQL}, k as ({_ROUTED_KEY}),
  f as materialized (select *, epoch_us(ts) as us, target_id <> 10 as stateful, target_id <> 12 or id % 11 <> 0 as known, id % 5 <> 0 as ok, id % 7 = 0 as gone, row_number() over (partition by key order by ts, id) as rn from k),
  walk(key, rn, last, fed, n, id, rule_id, target_id, ts, incident, disposition, counts_as_fed) as (
    select distinct key, 0::bigint, null::bigint, null::bigint, 0::bigint, null::bigint, null::bigint, null::bigint, null::timestamp, null::bigint, null::varchar, false from f
    union all select key, rn, case when what in ('none', 'failed') then last else us end, case when what = 'feed' and (ok or not stateful) or what = 'open' then us else fed end,
      case when what = 'open' then n + 1 else n end, id, rule_id, target_id, ts,
      case what when 'open' then n + 1 when 'wait' then n when 'feed' then n end,
      case what when 'wait' then 'throttled' when 'open' then 'opened' when 'feed' then case when ok then 'fed' else 'fallback' end else 'fallback' end,
      what = 'open' or (what = 'feed' and (ok or not stateful))
    from (select *, case when not known then 'none' when live and not due then 'wait' when due and not (stateful and gone) then 'feed' when ok then 'open' else 'failed' end as what
      from (select f.*, w.last, w.fed, w.n, coalesce(f.us - w.last < 7200000000, false) as live, coalesce(f.us - w.last < 7200000000 and f.us - w.fed >= 3600000000, false) as due
        from walk w join f on f.key = w.key and f.rn = w.rn + 1))),
  delivered as (select * from walk where rn > 0)"""


def delivered(spark: SparkSession, d: str) -> DataFrame:
    rows = routed(spark, d).withColumns({"key": incidents.dedup_key(), "stateful": F.col("target_id") != 10, "known_type": (F.col("target_id") != 12) | (F.col("id") % 11 != 0), "delivery_ok": F.col("id") % 5 != 0, "gone": F.col("id") % 7 == 0})
    return incidents.delivered_dispositions(rows, 7200, 3600)


@register("o03_delivery", f"{_DELIVERY_SQL} select id, key, incident, disposition, counts_as_fed from delivered")
def o03(spark, d):
    return delivered(spark, d).select("id", "key", "incident", "disposition", "counts_as_fed")


@register("o03_incident_counters", f"""{_DELIVERY_SQL}, g as (select key, incident, count(*) as event_count, min(ts) as opened_at, max(ts) as last_event_at, max(case when counts_as_fed then ts end) as last_fed_at from delivered where incident is not null group by key, incident)
  select key, event_count, opened_at, last_event_at, last_fed_at from g qualify row_number() over (partition by key order by incident desc) = 1""")  # fmt: skip
def o03_counters(spark, d):
    return incidents.current_incidents(delivered(spark, d)).drop("incident")


@register("o05_fallback_push", f"""{_DELIVERY_SQL} select v.id, v.rule_id, v.target_id, v.disposition, 'push' as type, concat('Alert (no agent): ', r.name, ' on ', e.source) as title,
  concat('[', e.severity_text, '] dispatch degraded: delivery failed. Source ', e.source) as message, 'fallback' as destination
  from delivered v join rules r using (rule_id) join log_events e using (id) where v.disposition = 'fallback'""")  # fmt: skip
def o05_push(spark, d):
    return outbox.fallback_pushes(delivered(spark, d), S.rules(spark), "fallback")


@register("o05_fallback", f"{ROUTED_FOLD_SQL} select id, target_id, case when disposition in ('opened', 'fed') and (target_id = 12 or id % 5 = 0) then 'fallback' else disposition end as disposition from folded")
def o05(spark, d):
    kinds = F.when(F.col("target_id") == 12, "pager").when(F.col("target_id") == 11, "handoff").otherwise("push")
    rows = decided(spark, d).withColumns({"type": kinds, "delivery_ok": F.col("id") % 5 != 0})
    return incidents.with_delivery(rows).select("id", "target_id", "disposition")


@register("s19_firing_ledger", f"""{ROUTED_FOLD_SQL} select f.id, f.rule_id, f.target_id, f.source, f.ts as fired_at, f.key as dedup_key, f.disposition,
  concat(r.name, ': ', f.body)[1:500] as summary, concat('{{"disposition":"', f.disposition, '","line":"', f.body, '"}}') as sample, f.disposition in ('opened', 'fed') as notified
  from folded f join rules r using (rule_id)""")  # fmt: skip
def s19(spark, d):
    return incidents.ledger(decided(spark, d), S.rules(spark))


@register("s18_audit", f"""{ROUTED_FOLD_SQL} select id, 'dispatcher' as actor, 'dispatch.' || disposition as action,
  concat('{{"rule_id":', cast(rule_id as varchar), ',"target_id":', cast(target_id as varchar), ',"source":"', source, '"}}') as detail, true as ok from folded""")  # fmt: skip
def s18(spark, d):
    return incidents.audit(decided(spark, d))


@register("q08_alert_history", f"""{ROUTED_FOLD_SQL} select f.id, f.target_id, f.source, f.disposition, f.ts as fired_at, r.name as rule from folded f join rules r using (rule_id)
  where f.rule_id = 3 and f.ts >= timestamp '2024-01-10' order by f.ts desc, f.id desc, f.target_id limit 100""")  # fmt: skip
def q08(spark, d):
    rows = incidents.ledger(decided(spark, d), S.rules(spark))
    return Q.alert_history(rows, S.rules(spark), 3, SINCE).select("id", "target_id", "source", "disposition", "fired_at", "rule")


# ------------------------------------------------------------------ outbox (F)


def _named(spark, d):
    return routed(spark, d).join(S.rules(spark).select("rule_id", "name"), "rule_id")


_NAMED_SQL = f"with {ROUTE_SQL}, n as (select r.*, u.name from routed r join rules u using (rule_id))"


@register("f03_safe_summary", f"{_NAMED_SQL} select id, target_id, concat(name, ' matched on ', source, ' (severity ', severity_text, ')') as summary from n")
def f03(spark, d):
    return _named(spark, d).select("id", "target_id", outbox.safe_summary().alias("summary"))


@register("f04_follow_up", f"{_NAMED_SQL} select id, target_id, concat('another match (untrusted log data): ', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), ' ', source, ' [', severity_text, '] <', coalesce(program, ''), ': ', body, '>') as line from n")
def f04(spark, d):
    return _named(spark, d).select("id", "target_id", outbox.follow_up().alias("line"))


@register("f07_push", f"{_NAMED_SQL} select id, target_id, concat('Alert: ', name, ' on ', source) as title, concat('[', severity_text, '] ', name, ' matched on ', source, ' (severity ', severity_text, ')') as body from n")
def f07(spark, d):
    return _named(spark, d).select("id", "target_id", outbox.push_title(F.lit(False)).alias("title"), outbox.push_body().alias("body"))


@register("f09_handle_name", f"{_NAMED_SQL} select id, target_id, concat_ws('/', 'alerts', source, severity_text, name, strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) as handle from n")
def f09(spark, d):
    return _named(spark, d).select("id", "target_id", outbox.handle_name().alias("handle"))


_FENCE = outbox.FENCE.replace("\n", "")
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_SAFE = "concat('[', severity_text, '] ', name, ' matched on ', source, ' (severity ', severity_text, ')')"
_FOLLOW = f"concat('another match (untrusted log data): ', {_ISO}, ' ', source, ' [', severity_text, '] <', coalesce(program, ''), ': ', body, '>')"
_BRIEF = f"""concat('A monitoring rule matched; find out whether it matters.', chr(10), 'Rule: ', name, ' /', pattern, '/', chr(10), 'Source: ', source, chr(10), 'Severity: ', severity_text, chr(10), 'At: ', {_ISO}, chr(10),
  '{_FENCE}', chr(10), '  ', coalesce(program, ''), ': ', body, chr(10), '{_FENCE}', chr(10), case when trim(coalesce(instructions, '')) <> '' then concat('Instructions from the rule''s owner:', chr(10), '  ', trim(instructions), chr(10)) else '' end,
  'Look at the source''s log around that time first. Propose changes and wait for approval unless the instructions allow them. Keep details out of public messages.')"""


@register("q15_outbox", f"""{ROUTED_FOLD_SQL}, d as (select f.*, r.name, r.pattern, r.instructions, t.type from folded f join rules r using (rule_id) join targets t using (target_id) where disposition <> 'throttled')
  select id, rule_id, target_id, disposition, type, concat(case when disposition = 'fed' then 'Still active: ' else 'Alert: ' end, name, ' on ', source) as title,
  case when type = 'push' then {_SAFE} when disposition = 'fed' then {_FOLLOW} else {_BRIEF} end as message,
  case when type = 'push' then 'ops' else concat_ws('/', 'alerts', source, severity_text, name, {_ISO}) end as destination from d""")  # fmt: skip
def q15(spark, d):
    return outbox.outbox(decided(spark, d), S.rules(spark), S.targets(spark)).drop("options")


@register("q09_live_feed", f"""{ROUTED_FOLD_SQL}, l as (select 'log' as kind, id, epoch_us(ts) // 1000 as ts_ms, source, body as text, severity_text as sev from log_events where body ilike '%amount 1%' and severity >= 9 order by id desc limit 300),
  a as (select 'alert' as kind, f.id, epoch_us(f.ts) // 1000 as ts_ms, f.source, r.name as text, f.disposition as sev from folded f join rules r using (rule_id) where f.target_id = 10 order by f.id desc limit 300)
  select * from l union all select * from a""")  # fmt: skip
def q09(spark, d):
    rows = S.log_events(spark, d).where(predicates.like_any([F.col("body")], "amount 1") & predicates.severity_at_least(F.col("severity"), 9))
    fired = incidents.ledger(decided(spark, d), S.rules(spark)).where("target_id = 10").join(S.rules(spark).select("rule_id", F.col("name").alias("rule")), "rule_id")
    return outbox.feed_rows(rows, fired, None)


@register("a10_feed_counters", f"""{ROUTED_FOLD_SQL} select 'log' as kind, count(*) as n from log_events union all select 'alert', count(*) from folded""")
def a10(spark, d):
    kinds = S.log_events(spark, d).select(F.lit("log").alias("kind")).unionByName(decided(spark, d).select(F.lit("alert").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@register("m08_page_hosts", "select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, case when lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) like '%.example.com' then null else 'host' end as reason from pages")
def m08(spark, d):
    host = F.try_parse_url("url", F.lit("HOST"))
    return S.table(spark, d, "pages").select("page_id", host.alias("host"), F.when(~F.lower(host).like("%.example.com"), "host").alias("reason"))


# ------------------------------------------------------------------ digest and gating (O6-O9, A6-A8)


@register("a06_digest_groups", f"""with {TEMPLATES_SQL}, b as (select source, coalesce(program, '?') as prog, fp, body[1:200] as line, min(id) as first from t group by all),
  k as (select *, row_number() over (partition by source, prog, fp order by first) as k from b),
  l as (select source, prog, fp, string_agg(line, '|' order by first) as bodies from k where k <= 3 group by all),
  g as (select source, coalesce(program, '?') as prog, fp, count(*) as n, max(coalesce(severity, 0)) as worst, arg_max(severity_text, (coalesce(severity, 0), -id)) as sev_text, min(id) as first_id from t group by all)
  select g.*, l.bodies from g join l using (source, prog, fp)""")  # fmt: skip
def a06(spark, d):
    return semantic.digest_groups(S.log_events(spark, d)).withColumn("bodies", F.array_join("bodies", "|"))


@register("a07_top_source", logs("select source, count(*) as n, min(id) as first_id from log_events where severity >= 17 group by source order by n desc, first_id limit 1"))
def a07(spark, d):
    return semantic.top_source(S.log_events(spark, d).where("severity >= 17"))


@register("o09_window_read", logs("select id, source from log_events where id > 100 and source like 'host-0%' and severity >= 9 order by id desc limit 5000"))
def o09(spark, d):
    return semantic.window_read(S.log_events(spark, d), 100, "host-0*", 9).select("id", "source")


#: A window rule for each region; events belong to the rule of their host's number.
_REGION_RULES = "select r_regionkey as rule_id, r_name as name, (r_regionkey + 1) * 1800 as window_seconds, (r_regionkey + 1) * 10 as spike_lines, concat('link error near ', lower(r_name)) as pattern from region"


def _gate_sql(grid: int) -> str:
    return f"""{LOGS}, rg as ({_REGION_RULES}),
  ev as (select *, cast(right(source, 2) as bigint) % 5 as rule_id, cast(floor(epoch(ts) / {grid}) * {grid} as bigint) as tick from log_events where severity >= 9),
  tk as materialized (select rule_id, tick, count(*) as new_rows, row_number() over (partition by rule_id order by tick) as k from ev group by rule_id, tick)"""


GATE_SQL = f"""with recursive {_gate_sql(600)},
  gw(rule_id, k, tick, last, pending, took, elapsed, fired) as (
    select rule_id, k, tick, tick, 0::bigint, 0::bigint, 0::bigint, false from tk where k = 1
    union all select rule_id, k, tick, case when due then tick else last end, case when due then 0 else took end, took, elapsed, due
    from (select *, elapsed >= 300 and (elapsed >= window_seconds or took >= spike_lines) as due
      from (select t.rule_id, t.k, t.tick, w.last, w.pending + t.new_rows as took, t.tick - w.last as elapsed, g.window_seconds, g.spike_lines
        from gw w join tk t on t.rule_id = w.rule_id and t.k = w.k + 1 join rg g on g.rule_id = t.rule_id))),
  gated as (select rule_id, tick, took as pending, elapsed, case when took >= spike_lines then 'spike' else 'interval' end as trigger from gw join rg using (rule_id) where fired),
  wn as (select t.rule_id, t.tick, t.k, min(g.tick) over (partition by t.rule_id order by t.tick rows between current row and unbounded following) as win from tk t left join gated g using (rule_id, tick)),
  tev as (select ev.*, wn.win from ev join wn using (rule_id, tick) where wn.k > 1 and wn.win is not null)"""
DIGEST_SQL = f"""{GATE_SQL}, dt as (select *, {_duck_template('body')} as template from tev), df as (select *, sha1(concat(coalesce(program, ''), chr(0), template)) as fp from dt),
  lb as (select rule_id, win, source, coalesce(program, '?') as prog, fp, coalesce(body, '')[1:200] as line, min(id) as first from df group by all),
  lk as (select *, row_number() over (partition by rule_id, win, source, prog, fp order by first) as k from lb),
  gr as (select rule_id, win, source, coalesce(program, '?') as prog, fp, count(*) as n, max(coalesce(severity, 0)) as worst, arg_max(coalesce(severity_text, '?'), (coalesce(severity, 0), -id)) as sev_text, min(id) as first_id from df group by all),
  gk as (select *, row_number() over (partition by rule_id, win order by worst desc, n desc, first_id) as gk from gr),
  pt as (select rule_id, win, gk, string_agg(concat('  ', case when k = 1 then concat(cast(n as varchar), 'x ') else '   ' end, source, ' [', sev_text, '] ', prog, ': ', line), chr(10) order by k) as part
    from gk join lk using (rule_id, win, source, prog, fp) where k <= 3 and gk <= 50 group by rule_id, win, gk),
  ps as (select rule_id, win, string_agg(part, chr(10) order by gk) as parts from pt group by rule_id, win),
  fa as (select rule_id, win, count(*) as n, arg_min(ts, id) as a, arg_max(ts, id) as b from tev group by rule_id, win), gc as (select rule_id, win, count(*) as g from gr group by rule_id, win),
  dg as (select rule_id, win as "window", concat(cast(n as varchar), ' events over ', strftime(a, '%H:%M:%S'), '-', strftime(b, '%H:%M:%S'), 'Z, ', cast(g as varchar), ' message types, worst first:', chr(10), parts,
    case when g > 50 then concat(chr(10), '  ...(+', cast(g - 50 as varchar), ' more types)') else '' end)[1:8000] as digest, n as event_count from fa join gc using (rule_id, win) join ps using (rule_id, win))"""
JUDGE_SQL = f"""{DIGEST_SQL}, hs as (select dg.*, pattern as condition, list_filter(string_split(pattern, ' '), lambda x: length(x) > 3 and contains(lower(digest), x)) as hits from dg join rg using (rule_id)),
  jd as (select rule_id, "window", condition, digest, len(hits) > 0 as fire, case when len(hits) > 0 then 'error' else 'info' end as verdict, array_to_string(hits, ', ') as why, case when len(hits) > 0 then 17 else 9 end as severity from hs)"""
TRACE_SQL = f"""{JUDGE_SQL}, bl as (select rule_id, max(id) as baseline from ev join tk using (rule_id, tick) where k = 1 group by rule_id),
  tp2 as (select rule_id, win, source, count(*) as n, min(id) as first_id from tev group by rule_id, win, source), tops as (select rule_id, win, arg_max(source, (n, -first_id)) as source from tp2 group by rule_id, win),
  sp as (select rule_id, win, max(id) as window_to_id, count(*) as event_count from tev group by rule_id, win),
  se as (select sp.win * 10000000 + sp.rule_id as id, sp.rule_id, tops.source, make_timestamp(sp.win * 1000000) as evaluated_at, g.trigger as trigger_kind,
    coalesce(lag(window_to_id) over (partition by sp.rule_id order by sp.win), baseline) as window_from_id, window_to_id, event_count, cast(g.elapsed as double) as elapsed_s,
    jd.fire as fired, case when jd.fire then jd.verdict end as severity, jd.why, true as llm_ok, jd.digest as summary_sent
    from sp join tops using (rule_id, win) join bl using (rule_id) join gated g on g.rule_id = sp.rule_id and g.tick = sp.win join jd on jd.rule_id = sp.rule_id and jd."window" = sp.win)"""


#: The same on a clock: before a rule's next rows, what waits is evaluated when its time has come.
_CLOCK_SQL = f"""with recursive {_gate_sql(600)}, top as (select max(tick) as until from tk),
  gw(rule_id, k, tick, last, pending, b_tick, b_took, b_elapsed, a_took, a_elapsed) as (
    select rule_id, k, tick, tick, 0::bigint, null::bigint, null::bigint, null::bigint, null::bigint, null::bigint from tk where k = 1
    union all select rule_id, k, tick, case when due then tick else last2 end, case when due then 0 else took end, b_tick, b_took, b_elapsed, case when due then took end, case when due then tick - last2 end
    from (select *, tick - last2 >= 300 and (tick - last2 >= window_seconds or took >= spike_lines) as due
      from (select *, coalesce(b_tick, last) as last2, case when b_tick is null then pending else 0 end + new_rows as took
        from (select *, case when d < tick then d end as b_tick, case when d < tick then pending end as b_took, case when d < tick then d - last end as b_elapsed
          from (select t.rule_id, t.k, t.tick, t.new_rows, w.last, w.pending, g.window_seconds, g.spike_lines,
              case when w.pending > 0 then cast(ceil(greatest(w.last + 300, w.tick, case when w.pending >= g.spike_lines then 0 else w.last + g.window_seconds end) / 600.0) * 600 as bigint) end as d
            from gw w join tk t on t.rule_id = w.rule_id and t.k = w.k + 1 join rg g on g.rule_id = t.rule_id))))),
  lastly as (select *, cast(ceil(greatest(last + 300, tick, case when pending >= spike_lines then 0 else last + window_seconds end) / 600.0) * 600 as bigint) as d from gw join rg using (rule_id)
    where pending > 0 and k = (select max(k) from tk where tk.rule_id = gw.rule_id)),
  ge as (select rule_id, b_tick as tick, b_took as took, b_elapsed as elapsed from gw where b_tick is not null union all select rule_id, tick, a_took, a_elapsed from gw where a_took is not null
    union all select rule_id, d, pending, d - last from lastly, top where d <= until),
  gated as (select rule_id, tick, took as pending, elapsed, case when took >= spike_lines then 'spike' else 'interval' end as trigger from ge join rg using (rule_id)),
  wn as (select t.rule_id, t.tick, t.k, (select min(g.tick) from gated g where g.rule_id = t.rule_id and g.tick >= t.tick) as win from tk t),
  tev as (select ev.*, wn.win from ev join wn using (rule_id, tick) where wn.k > 1 and wn.win is not null)"""


def _clocked(spark, d, ceiling: int = 0):
    rows = _ticked(spark, d).join(_window_rules(spark, d).select("rule_id", "window_seconds", "spike_lines"), "rule_id")
    until = rows.agg(F.max("tick")).first()[0] or 0
    return rows, clock.clocked_gate(rows, until, 600, ceiling)


@register("o06_clocked_gate", f"{_CLOCK_SQL} select rule_id, tick, pending, elapsed, trigger from gated")
def o06_clocked(spark, d):
    return _clocked(spark, d)[1].select("rule_id", "tick", "pending", "elapsed", "trigger")


@register("s20_clocked_trace", f"{_CLOCK_SQL}{TRACE_SQL.removeprefix(GATE_SQL)} select * from se")
def s20_clocked(spark, d):
    """Digest, judgement and trace of every evaluation on the clock."""
    rows, gated = _clocked(spark, d)
    gated = S.written(gated, "evaluations")
    return clock.trace(clock.windows(rows, gated), gated, _window_rules(spark, d))


def _window_rules(spark, d):
    S.table(spark, d, "region").createOrReplaceTempView("window_rule_regions")
    return spark.sql(_REGION_RULES.replace("from region", "from window_rule_regions")).withColumn("rule_id", F.col("rule_id").cast("long"))


def _ticked(spark, d, grid: int = 600):
    tick = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / grid) * grid).cast("long")
    return S.log_events(spark, d).where("severity >= 9").withColumns({"rule_id": F.right("source", F.lit(2)).cast("long") % 5, "tick": tick})


def _gated(spark, d, rows, ceiling: int = 0):
    ticks = rows.groupBy("rule_id", "tick").agg(F.count("*").alias("new_rows"))
    return semantic.gate(ticks.join(_window_rules(spark, d).select("rule_id", "window_seconds", "spike_lines"), "rule_id"), ceiling=ceiling)


def _judged(spark, d, taken):
    """Judgements of the windows of evaluated() rows."""
    text = semantic.window_digests(taken).join(_window_rules(spark, d).select("rule_id", F.col("pattern").alias("condition")), "rule_id")
    return semantic.judge(text.select("rule_id", "window", "condition", "digest"))


def _evaluations(spark, d):
    rows = _ticked(spark, d)
    gated = _gated(spark, d, rows)
    return semantic.evaluations(rows, gated, _judged(spark, d, semantic.evaluated(rows, gated)).drop("severity"))


@register("q14_digest", f"{DIGEST_SQL} select rule_id, \"window\", digest, event_count from dg")
def q14(spark, d):
    rows = _ticked(spark, d)
    return semantic.window_digests(semantic.evaluated(rows, _gated(spark, d, rows)))


@register("o06_semantic_gate", f"{GATE_SQL} select rule_id, tick, pending, elapsed, trigger from gated")
def o06(spark, d):
    return _gated(spark, d, _ticked(spark, d))


#: Row by row over the ticks of all rules: st holds each rule's last evaluation and waiting rows.
_EVALUATION_CEILING_SQL = f"""with recursive {_gate_sql(3600)}, f as materialized (select *, row_number() over (order by tick, rule_id) as rn from tk),
  walk(rn, rule_id, tick, took, elapsed, due, st, recent) as (
    select 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, false, map([-1]::bigint[], [[0, 0]]::bigint[][]), []::bigint[]
    union all select rn, rule_id, tick, took, elapsed, runs, map_concat(st, map([rule_id], [case when runs or s is null then [tick, 0] else [s[1], took] end])), case when runs then list_append(near, tick) else near end
    from (select *, coalesce(took > 0 and elapsed >= 300 and (elapsed >= window_seconds or took >= spike_lines), false) and len(near) < 2 as runs
      from (select f.rn, f.rule_id, f.tick, w.st, w.st[f.rule_id] as s, w.st[f.rule_id][2] + f.new_rows as took, f.tick - w.st[f.rule_id][1] as elapsed, g.window_seconds, g.spike_lines, list_filter(w.recent, lambda x: f.tick - x <= 60) as near
        from walk w join f on f.rn = w.rn + 1 join rg g on g.rule_id = f.rule_id)))
  select rule_id, tick, took as pending, elapsed, case when took >= spike_lines then 'spike' else 'interval' end as trigger from walk join rg using (rule_id) where due"""


@register("o08_evaluation_ceiling", _EVALUATION_CEILING_SQL)
def o08(spark, d):
    return _gated(spark, d, _ticked(spark, d, 3600), ceiling=2)


@register("o10_judge", f"{JUDGE_SQL} select rule_id, \"window\", condition, digest, fire, verdict, why, severity from jd")
def o10(spark, d):
    rows = _ticked(spark, d)
    return _judged(spark, d, semantic.evaluated(rows, _gated(spark, d, rows)))


@register("s20_evaluation_trace", f"{TRACE_SQL} select * from se")
def s20(spark, d):
    return _evaluations(spark, d)


@register("j04_evaluations_rules", f"{TRACE_SQL} select se.id, se.rule_id, se.fired, r.name as rule, r.pattern as condition from se left join (select * from rg where rule_id <> 4) r using (rule_id)")
def j04(spark, d):
    left = _window_rules(spark, d).where("rule_id <> 4")  # a rule that was deleted leaves its evaluations
    return Q.evaluation_detail(_evaluations(spark, d), left).select("id", "rule_id", "fired", "rule", "condition")


@register("q11_evaluation_detail", f"{TRACE_SQL} select se.*, r.name as rule, r.pattern as condition from se left join rg r using (rule_id) where se.id = (select max(id) from se)")
def q11(spark, d):
    rows = _ticked(spark, d)
    gated = S.written(_gated(spark, d, rows), "gated")
    ids = gated.select(F.col("tick").alias("window"), "rule_id").select(semantic.evaluation_id().alias("id"), "rule_id", "window")
    newest = ids.orderBy(F.col("id").desc()).first()  # every evaluation takes rows, so it has its trace
    if newest:  # only its window is told and judged; its rule's other rows are counted
        rows = rows.where(F.col("rule_id") == newest.rule_id)
        gated = gated.where(F.col("rule_id") == newest.rule_id)
    taken = semantic.evaluated(rows, gated)
    judged = _judged(spark, d, taken.where(F.col("window") == newest.window) if newest else taken)
    found = semantic.evaluations(rows, gated, judged.drop("severity"))
    return Q.evaluation_detail(found, _window_rules(spark, d), newest.id if newest else 0)


_SEMANTIC_FIRINGS_SQL = """select se.id, se.rule_id, n.n_nationkey as target_id, se.source, se.evaluated_at as ts, se.why, rg.name,
  concat(cast(se.rule_id as varchar), ':', cast(n.n_nationkey as varchar), ':semantic') as key from se join rg using (rule_id) join nation n on n.n_regionkey = se.rule_id where fired"""


def _semantic_firings(spark, d):
    bindings = S.table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("rule_id"), F.col("n_nationkey").cast("long").alias("target_id"))
    return semantic.semantic_firings(_evaluations(spark, d), _window_rules(spark, d), bindings)


@register("o11_semantic_incidents", f"{TRACE_SQL}, {_fold_sql(_SEMANTIC_FIRINGS_SQL, 7200, 3600)} select id, target_id, source, key, why as body, name as program, cast(incident as bigint) as incident, disposition from folded")
def o11(spark, d):
    rows = incidents.dispositions(_semantic_firings(spark, d), 7200, 3600)
    return rows.select("id", F.col("target_id").cast("int").alias("target_id"), "source", "key", "body", "program", F.col("incident").cast("long").alias("incident"), "disposition")


@register("f06_window_brief", f"""{TRACE_SQL} select se.id, concat('A window rule fired: ', rg.name, chr(10), 'Verdict: ', se.severity, chr(10), '{_FENCE}', chr(10), se.why, chr(10), se.summary_sent, chr(10), '{_FENCE}', chr(10)) as brief from se join rg using (rule_id) where fired""")
def f06(spark, d):
    rows = _evaluations(spark, d).where("fired").join(_window_rules(spark, d).select("rule_id", "name"), "rule_id")
    return rows.withColumns({"verdict": F.col("severity"), "digest": F.col("summary_sent")}).select("id", outbox.window_brief().alias("brief"))


@register("u01_merged_feed", f"""{TRACE_SQL}, {_fold_sql(_SEMANTIC_FIRINGS_SQL, 7200, 3600)},
  l as (select 'log' as kind, id, epoch_us(ts) // 1000 as ts_ms, source, body as text, severity_text as sev from log_events order by id desc limit 50),
  a as (select 'alert' as kind, id * 100 + target_id as id, epoch_us(ts) // 1000 as ts_ms, source, name as text, disposition as sev from folded order by 2 desc limit 50),
  v as (select 'eval' as kind, id, epoch_us(evaluated_at) // 1000 as ts_ms, source, why as text, trigger_kind as sev from se order by id desc limit 50)
  select * from l union all select * from a union all select * from v""")  # fmt: skip
def u01(spark, d):
    fired = incidents.dispositions(_semantic_firings(spark, d), 7200, 3600).select((F.col("id") * 100 + F.col("target_id")).alias("id"), F.col("ts").alias("fired_at"), "source", F.col("program").alias("rule"), "disposition")
    return outbox.feed_rows(S.log_events(spark, d), fired, _evaluations(spark, d), 50)


@register("u03_kinds", f"""{TRACE_SQL} select 'eval' as kind, id, epoch_us(evaluated_at) // 1000 as ts_ms, source, why as text, trigger_kind as sev from se order by id desc limit 40""")
def u03(spark, d):
    return outbox.feed_rows(None, None, _evaluations(spark, d), 40)


@register("f12_verdict_severity", logs("select id, case when sev = 'crit' then 18 when sev = 'err' then 17 when sev = 'info' then 9 when sev = 'warn' then 13 else 13 end as severity from (select id, case id % 5 when 0 then 'crit' when 1 then 'err' when 2 then 'info' when 3 then 'warn' else body end as sev from log_events)"))
def f12(spark, d):
    word = F.when(F.col("id") % 5 == 0, "CRIT").when(F.col("id") % 5 == 1, "err").when(F.col("id") % 5 == 2, "Info").when(F.col("id") % 5 == 3, "warn").otherwise(F.col("body"))
    return S.log_events(spark, d).select("id", decode.verdict_severity(word).alias("severity"))


@register("f13_verdict", logs("select id, case when id % 4 = 3 then null else id % 2 = 0 end as fire, case when id % 4 = 3 then null else severity_text end as severity, case when id % 4 = 3 then null else body end as why from log_events"))
def f13(spark, d):
    answer = F.concat(F.lit('{"fire": '), (F.col("id") % 2 == 0).cast("string"), F.lit(', "severity": "'), "severity_text", F.lit('", "why": "'), "body", F.lit('"}'))
    reply = F.when(F.col("id") % 4 == 3, F.concat(F.lit("no {verdict: "), "body")).when(F.col("id") % 4 == 2, F.concat(F.lit('<think>{"fire": 1} or {not}</think>'), answer, F.lit(" done {}"))).otherwise(answer)
    v = semantic.extract_verdict(reply)
    return S.log_events(spark, d).select("id", v["fire"].alias("fire"), v["severity"].alias("severity"), v["why"].alias("why"))


@register("w05_outages", f"""with {LOGS}, e as (select id, ts, event_type <> 'error' as ok from (select l.*, e.event_type from log_events l join events e on e.event_id = l.id)),
  i as (select *, sum(ok::int) over (order by ts, id) as island from e),
  f as (select island, min(ts) as began, max(ts) as last, count(*) as failures from i where not ok group by island having epoch_us(max(ts)) - epoch_us(min(ts)) >= 600000000),
  n as (select i.island, min(i.ts) as notice_at from i join f using (island) where not ok and epoch_us(i.ts) - epoch_us(f.began) >= 600000000 group by i.island)
  select f.began, f.failures, n.notice_at, r.ts as recovered_at from f join n using (island) left join (select island - 1 as island, ts from i where ok) r using (island)""")  # fmt: skip
def w05(spark, d):
    rows = S.table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", (F.col("event_type") != "error").alias("ok"))
    return incidents.outages(rows, 600).drop("scope")


# ------------------------------------------------------------------ maintenance (M)


@register("m01_retention", logs("select id from log_events where date_trunc('week', ts) + interval 7 day > timestamp '2024-04-20' - interval 90 day"))
def m01(spark, d):
    return maintenance.kept_events(S.log_events(spark, d), AS_OF, 90).select("id")


@register("m03_prune", logs("select id from log_events where ts >= timestamp '2024-04-20' - interval 95 day"))
def m03(spark, d):
    return maintenance.prune(S.log_events(spark, d), "ts", AS_OF, 95).select("id")


@register("m05_apply_changes", """with ch as (select o_orderkey % 1000 as c_custkey, o_orderkey as seq, case when o_orderstatus = 'F' then 'delete' else 'upsert' end as op, o_totalprice as c_acctbal from orders),
  l as (select * from ch qualify row_number() over (partition by c_custkey order by seq desc) = 1)
  select c_custkey, c_acctbal from customer where c_custkey not in (select c_custkey from l) union all select c_custkey, c_acctbal from l where op = 'upsert'""")  # fmt: skip
def m05(spark, d):
    changes = S.table(spark, d, "orders").select((F.col("o_orderkey") % 1000).alias("c_custkey"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert").alias("op"), F.col("o_totalprice").alias("c_acctbal"))
    return maintenance.apply_changes(S.table(spark, d, "customer").select("c_custkey", "c_acctbal"), changes, ["c_custkey"])


@register("j11_cascade", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def j11(spark, d):
    gone = S.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return maintenance.cascade(S.table(spark, d, "orders"), gone, "o_custkey").select("o_orderkey")


_COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"


@register("m09_template_similarity", f"""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
  s as (select a.vec_id as query_id, b.vec_id, {_COS} as cosine from v a join v b on a.vec_id <> b.vec_id),
  k as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from s) select query_id, vec_id, cast(rank as integer) as rank, round(cosine, 6) as cosine from k where rank <= 3""")  # fmt: skip
def m09(spark, d):
    """The three nearest vectors to every vector of the table."""
    v = S.table(spark, d, "embeddings").where("vec_id is not null")  # as the join on unequal ids has it
    return templates.nearest(v, v, 3).select("query_id", "vec_id", "rank", F.round("cosine", 6).alias("cosine"))


@register("m09_neighbours", f"""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
  s as (select a.vec_id as query_id, b.vec_id, {_COS} as cosine from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
  k as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from s) select query_id, vec_id, cast(rank as integer) as rank, round(cosine, 6) as cosine from k where rank <= 5""")  # fmt: skip
def m09_neighbours(spark, d):
    v = S.table(spark, d, "embeddings")
    return templates.nearest(v, v.where("vec_id % 50 = 0"), 5).select("query_id", "vec_id", "rank", F.round("cosine", 6).alias("cosine"))


@register("m09_pruned_neighbours", ORACLE_SQL["m09_neighbours"])
def m09_pruned(spark, d):
    """The same, skipping the blocks of vectors that cannot hold a neighbour."""
    v = S.table(spark, d, "embeddings")
    return neighbours.nearest(v, v.where("vec_id % 50 = 0"), 5)[0].select("query_id", "vec_id", "rank", F.round("cosine", 6).alias("cosine"))


@register("s15_weeks", logs("select cast(date_trunc('week', ts) as varchar)[1:10] as week_start, count(*) as n from log_events group by 1"))
def s15(spark, d):
    return S.log_events(spark, d).groupBy(predicates.week_start(F.col("ts")).cast("string").alias("week_start")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ joins with derived registries


@register("j06_events_templates", f"with {TEMPLATES_SQL}, r as (select fp, arg_min(template, id) as template, min(id) as template_id from t group by fp) select t.id, r.template_id, r.template from t join r using (fp)")
def j06(spark, d):
    rows = S.log_events(spark, d)
    registry = templates.template_delta(rows).select("fp", "template", F.col("first_id").alias("template_id"))
    return templates.with_template(rows).select("id", "fp").join(registry, "fp").select("id", "template_id", "template")


@register("j07_owner_resolution", "select c_custkey as target_id, case when c_custkey % 3 = 0 then null else c_custkey end as owner_id from customer")
def j07(spark, d):
    customers = S.table(spark, d, "customer")
    # two of three names are known: one spelled in full, one by its local part
    users = customers.where("c_custkey % 3 <> 0").select(F.when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise(F.regexp_replace("c_name", "[^A-Za-z0-9._-]", "")).alias("username"), F.col("c_custkey").alias("user_id"))
    rows = customers.select(F.col("c_custkey").alias("target_id"), F.when(F.col("c_custkey") % 3 == 1, F.concat("c_name", F.lit("@example.com"))).otherwise(F.col("c_name")).alias("owner_upn"))
    return outbox.resolve_owners(rows, users).select("target_id", "owner_id")


@register("m06_source_activity", f"with {LOGS}, {_SOURCES} select source, events, source not in (select source from log_events where severity >= 17 group by source having count(*) >= 100) as active from s")
def m06(spark, d):
    rows = S.log_events(spark, d)
    sources = templates.source_delta(rows).select("source", "events", "active")
    loud = rows.where("severity >= 17").groupBy("source").count().where("count >= 100").select("source")
    changes = sources.join(loud, "source").select(F.lit(1).alias("seq"), F.lit("upsert").alias("op"), "source", "events", F.lit(False).alias("active"))
    return maintenance.apply_changes(sources, changes, ["source"])


@register("f17_handoff_options", f"""{ROUTED_FOLD_SQL} select id, target_id, case when target_id = 11 then '{{"tools":"[\\"ping\\"]","skill":"triage","model":"m1","project":"p1"}}'
  else '{{"skill":"night","project":"main"}}' end as options from folded where disposition <> 'throttled' and target_id <> 10""")  # fmt: skip
def f17(spark, d):
    return outbox.outbox(decided(spark, d), S.rules(spark), S.targets(spark)).where("type = 'handoff'").select("id", "target_id", "options")


@register("f08_fallback_body", f"{_NAMED_SQL} select id, target_id, concat('[', severity_text, '] dispatch degraded: ', body[1:120], '. Source ', source) as body from n")
def f08(spark, d):
    return _named(spark, d).select("id", "target_id", outbox.fallback_body(F.col("body")).alias("body"))


@register("u02_filtered_feed", f"""{ROUTED_FOLD_SQL}, l as (select 'log' as kind, id, source, body as text from log_events where severity >= 17 and source like 'host-0%' and (body ilike '%link%' or program ilike '%link%') order by id desc limit 50),
  a as (select 'alert' as kind, f.id, f.source, r.name as text from folded f join rules r using (rule_id) where r.name ilike '%link%' and f.target_id = 11 order by f.id desc limit 50) select * from l union all select * from a""")  # fmt: skip
def u02(spark, d):
    rows = S.log_events(spark, d).where(predicates.severity_at_least(F.col("severity"), 17) & predicates.glob_query(F.col("source"), "host-0*") & predicates.like_any([F.col("body"), F.col("program")], "link"))
    fired = incidents.ledger(decided(spark, d), S.rules(spark)).where("target_id = 11").join(S.rules(spark).select("rule_id", F.col("name").alias("rule")), "rule_id")
    return outbox.feed_rows(rows, fired.where(predicates.like_any([F.col("rule")], "link")), None, 50).select("kind", "id", "source", "text")


# ------------------------------------------------------------------ rules and targets that grow with the tables

_duck = lambda sql: sql.replace("as text)", "as varchar)")
_REASON = r"""case when kind not in ('regex', 'semantic') then 'kind' when name = '' or pattern = '' then 'empty' when window_kind not in ('sliding', 'tumbling') then 'window_kind'
  when kind = 'regex' and length(pattern) > 512 then 'too long' when kind = 'regex' and regexp_matches(pattern, '\([^()]*[+*][^()]*\)[*+]') then 'nested quantifier'
  when kind = 'regex' and contains(pattern, '{1,2000}') then 'repetition' when contains(source_glob, ',') then 'glob list' when contains(trim(source_glob), ' ') then 'glob blank' end"""
GROWING_SQL = f"gr0 as ({_duck(S.GROWING_RULES)}), gbinds as ({_duck(S.GROWING_BINDINGS)}), grules as materialized (select * from gr0 where ({_REASON}) is null)"
GROWING_ROUTE_SQL = _route_sql(GROWING_SQL, "grules", "gbinds")


def _growing_compiled(spark, d):
    accepted = routing.quarantine_rules(S.growing(spark, d, S.GROWING_RULES)).where("reason is null").drop("reason")
    return routing.compile_rules(accepted, S.growing(spark, d, S.GROWING_BINDINGS))


@register("q12_route_growing", f"with {GROWING_ROUTE_SQL} select id, rule_id, target_id from routed")
def q12_growing(spark, d):
    return routing.route_any(S.log_events(spark, d), _growing_compiled(spark, d)).select("id", "rule_id", "target_id")


@register("j01_joined_route", f"with {GROWING_ROUTE_SQL} select id, rule_id, target_id from routed")
def j01_joined(spark, d):
    return routing.indexed_route(S.log_events(spark, d), _growing_compiled(spark, d)).select("id", "rule_id", "target_id")


@register("m07_rule_quarantine", f"with {GROWING_SQL} select rule_id, {_REASON} as reason from gr0")
def m07(spark, d):
    return routing.quarantine_rules(S.growing(spark, d, S.GROWING_RULES)).select("rule_id", "reason")


_HOST = "lower(regexp_extract(json_extract_string(config, '$.url'), '^[a-z]+://([^/:?#]+)', 1))"


@register("m08_target_quarantine", f"""with t as ({_duck(S.GROWING_TARGETS)}) select target_id, case when type not in ('push', 'handoff') then 'type' when identity_policy = 'me' then 'identity' when type = 'handoff' and trim(project) = '' then 'project'
  when type = 'push' and {_HOST} not in ('building.example.com', 'machinery.example.com') then 'host' when type = 'push' and json_extract_string(config, '$.token') = 't' and json_extract_string(config, '$.url') not like 'https://%' then 'token'
  when type = 'handoff' and config like '%auto_approve":true%' then 'auto_approve' end as reason from t""")  # fmt: skip
def m08_targets(spark, d):
    return routing.quarantine_targets(S.growing(spark, d, S.GROWING_TARGETS), ["Building.example.com", "machinery.example.com"]).select("target_id", "reason")


@register("q04_list_rules", f"""with {GROWING_SQL}, b as (select rule_id, string_agg(cast(target_id as varchar), ',' order by target_id) as target_ids from gbinds group by rule_id)
  select rule_id, name, kind, coalesce(target_ids, '') as target_ids from gr0 left join b using (rule_id) where enabled and owner_oid = 'o2' and owner_bot = 'bot'""")  # fmt: skip
def q04(spark, d):
    rows = Q.list_rules(S.growing(spark, d, S.GROWING_RULES), S.growing(spark, d, S.GROWING_BINDINGS), owner=("o2", "bot"))
    return rows.select("rule_id", "name", "kind", F.array_join("target_ids", ",").alias("target_ids"))


@register("j05_rules_targets", f"""with {GROWING_SQL}, b as (select rule_id, string_agg(cast(target_id as varchar), ',' order by target_id) as target_ids from gbinds group by rule_id)
  select rule_id, enabled, coalesce(target_ids, '') as target_ids from gr0 left join b using (rule_id)""")  # fmt: skip
def j05(spark, d):
    rows = Q.list_rules(S.growing(spark, d, S.GROWING_RULES), S.growing(spark, d, S.GROWING_BINDINGS), include_disabled=True)
    return rows.select("rule_id", "enabled", F.array_join("target_ids", ",").alias("target_ids"))


@register("q05_list_targets", f"with t as ({_duck(S.GROWING_TARGETS)}) select target_id, name, type, case when owner_oid = 'o3' and owner_bot = 'bot' then config else '(hidden)' end as config from t")
def q05(spark, d):
    return Q.list_targets(S.growing(spark, d, S.GROWING_TARGETS), "o3", "bot").select("target_id", "name", "type", "config")


@register("f18_push_address", f"""with t as ({_duck(S.GROWING_TARGETS)}) select target_id, regexp_replace(coalesce(json_extract_string(config, '$.url'), 'https://push.example.com'), '/+$', '') as url,
  coalesce(nullif(json_extract_string(config, '$.topic'), ''), 'alerts') as topic, coalesce(json_extract_string(config, '$.token'), '') as token from t where type = 'push'""")  # fmt: skip
def f18(spark, d):
    rows = S.growing(spark, d, S.GROWING_TARGETS).where("type = 'push'").withColumn("a", outbox.push_address("https://push.example.com", "alerts"))
    return rows.select("target_id", "a.url", "a.topic", "a.token")


@register("j09_unknown_globs", f"""with {LOGS}, {GROWING_SQL}, a as (select distinct source from log_events), miss as (select rule_id, source_glob from gr0 where source_glob <> '' and not regexp_matches(source_glob, '[*?[]') and source_glob not in (select source from a)),
  c as (select rule_id, source, 1 - levenshtein(source_glob, source) / greatest(length(source_glob), length(source)) as ratio from miss, a),
  k as (select *, row_number() over (partition by rule_id order by ratio desc, source) as k from c where ratio >= 0.5)
  select rule_id, source_glob, coalesce((select string_agg(source, ',' order by k) from k where k.rule_id = miss.rule_id and k <= 3), '') as near from miss""")  # fmt: skip
def j09(spark, d):
    return routing.unknown_globs(S.growing(spark, d, S.GROWING_RULES), templates.source_delta(S.log_events(spark, d)).select("source", "active"))


@register("s18_rule_audit", f"""with {GROWING_SQL} select rule_id as id, owner_oid as actor, case when enabled then 'rule.create' else 'rule.disable' end as action,
  case when ({_REASON}) is null then concat('{{"rule_id":', cast(rule_id as varchar), '}}') else concat('{{"rule_id":', cast(rule_id as varchar), ',"reason":"', {_REASON}, '"}}') end as detail, ({_REASON}) is null as ok from gr0""")  # fmt: skip
def s18_rules(spark, d):
    rows = routing.quarantine_rules(S.growing(spark, d, S.GROWING_RULES))
    return incidents.audit_changes(rows.select(F.col("rule_id").alias("seq"), F.when(F.col("enabled"), "create").otherwise("disable").alias("op"), F.col("owner_oid").alias("actor"), "reason", "rule_id"), "rule", "rule_id")


@register("m05_rule_changes", f"""with {GROWING_SQL}, ch as (select o_orderkey % 40 as rule_id, o_orderkey as seq, o_orderstatus = 'F' as gone, cast(o_orderkey % 9 as bigint) as rule_order from orders),
  l as (select * from ch qualify row_number() over (partition by rule_id order by seq desc) = 1) select rule_id, rule_order from gr0 where rule_id not in (select rule_id from l) union all select rule_id, rule_order from l where not gone""")  # fmt: skip
def m05_rules(spark, d):
    changes = S.table(spark, d, "orders").select((F.col("o_orderkey") % 40).alias("rule_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert").alias("op"), (F.col("o_orderkey") % 9).alias("rule_order"))
    return maintenance.apply_changes(S.growing(spark, d, S.GROWING_RULES).select("rule_id", "rule_order"), changes, ["rule_id"])


@register("s11_year_inference", logs("""select id, case when t > r + interval 1 day then t - interval 1 year else t end as ts from (select id, ts + to_days(cast(id % 700 as integer)) as r,
  make_timestamp(year(ts + to_days(cast(id % 700 as integer))), month(ts), day(ts), hour(ts), minute(ts), floor(second(ts))) as t from log_events where id % 4 = 1)"""))  # fmt: skip
def s11(spark, d):
    rows = S.raw_lines(spark, d).withColumn("received_at", F.expr("received_at + make_interval(0, 0, 0, cast(id % 700 as int))"))
    return decode.decode_lines(rows).where("kind = 'rfc3164'").select("id", "ts")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Events routed through the ruleset and folded into incidents, by rule and disposition."""
    return QUERIES["a12_disposition_rollup"](spark, d)
