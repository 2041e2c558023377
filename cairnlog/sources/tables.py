"""Source tables, and the log views that the registered queries derive from `events`."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def session(app: str = "cairnlog", **extra: str) -> SparkSession:
    """A session with the settings the engine expects; a running one keeps its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | {k.replace("_", "."): v for k, v in extra.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or where the
    session has none and runs on this machine alone, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: later plans start from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw_files(spark: SparkSession, path: str, peer: str = "unknown", stream: bool = False) -> DataFrame:
    """Raw lines from text files: carriage returns trimmed, empty lines dropped. A batch has (id, raw,
    received_at, peer), a stream the columns that number_lines() turns into ids, batch by batch; it takes
    new files as they arrive."""
    reader = (spark.readStream.option("maxFilesPerTrigger", 64) if stream else spark.read).format("text")
    at = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_modification_time", "file_path", "file_block_start")]
    rows = reader.load(path).select("value", *at).select(F.rtrim(F.regexp_replace("value", r"[\r\n]+$", "")).alias("raw"), F.current_timestamp().cast("timestamp_ntz").alias("received_at"), F.lit(peer).alias("peer"), "_file_modification_time", "_file_path", "_file_block_start")
    return rows if stream else number_lines(rows)


def number_lines(rows: DataFrame, first: int = 0) -> DataFrame:
    """(id, raw, received_at, peer): ids count the lines of all files from `first` on, files in order of
    their time and path, lines in order of their place. Equal lines so have ids of their own; files
    that are read again, alone with earlier ones or together with later ones, in splits of any size,
    have the same ids. Only where each split of a file begins is numbered in one place."""
    own = ["_file_modification_time", "_file_path", "_file_block_start"]
    rows = rows.withColumn("_place", F.monotonically_increasing_id())
    splits = rows.groupBy(*own).agg(F.min("_place").alias("begins"), F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy(*own).rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select(*own, (F.coalesce(before, F.lit(0)) - F.col("begins") + F.lit(first)).alias("shift"))
    numbered = rows.join(splits, own).where("raw != ''")
    return numbered.select((F.col("_place") + F.col("shift")).alias("id"), "raw", "received_at", "peer")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, source, severity, severity_text, program, body from the events table."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "ts",
        "concat('host-', lpad(cast(user_id % 20 as string), 2, '0')) as source",
        "case event_type when 'error' then 17 when 'purchase' then 10 when 'signup' then 9 when 'view' then 9 else 5 end as severity",
        "case event_type when 'error' then 'err' when 'purchase' then 'notice' when 'signup' then 'info' when 'view' then 'info' else 'debug' end as severity_text",
        "case event_type when 'error' then '%LINK-3-UPDOWN' when 'purchase' then 'billing' when 'signup' then 'sshd' when 'view' then 'nginx' else null end as program",
        "concat('user ', cast(user_id as string), ' did ', event_type, ' amount ', cast(cast(round(value*100) as bigint) as string), ' from 10.0.', cast(user_id % 256 as string), '.', cast(event_id % 256 as string), ' port 0x', lower(hex(event_id % 4096))) as body",
    )


#: The same view for DuckDB.
LOG_EVENTS_SQL = """log_events as (select event_id as id, ts,
  concat('host-', lpad(cast(user_id % 20 as varchar), 2, '0')) as source,
  case event_type when 'error' then 17 when 'purchase' then 10 when 'signup' then 9 when 'view' then 9 else 5 end as severity,
  case event_type when 'error' then 'err' when 'purchase' then 'notice' when 'signup' then 'info' when 'view' then 'info' else 'debug' end as severity_text,
  case event_type when 'error' then '%LINK-3-UPDOWN' when 'purchase' then 'billing' when 'signup' then 'sshd' when 'view' then 'nginx' else null end as program,
  concat('user ', cast(user_id as varchar), ' did ', event_type, ' amount ', cast(cast(round(value*100) as bigint) as varchar),
    ' from 10.0.', cast(user_id % 256 as varchar), '.', cast(event_id % 256 as varchar), ' port 0x', lower(to_hex(event_id % 4096))) as body
  from events)"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, received_at, peer, raw: log_events written as lines of four kinds, by id % 4."""
    sev = "case severity when 17 then 3 when 10 then 5 when 9 then 6 else 7 end"
    return log_events(spark, sf_dir).selectExpr(
        "id",
        "ts as received_at",
        "'10.9.0.7' as peer",
        f"""case id % 4
        when 0 then concat('<', cast(8*4+{sev} as string), '>1 ', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), ' ', source, ' ', coalesce(program,'-'), ' ', cast(id as string), ' ID47 [ex@1 k="v', cast(id%10 as string), '"] ', body)
        when 1 then concat('<', cast(8*16+{sev} as string), '>', date_format(ts,'MMM dd HH:mm:ss'), ' ', source, ' ', case when program is null then '' else concat(replace(program,'%',''), '[', cast(id as string), ']: ') end, body)
        when 2 then concat('<189>', cast(id as string), ': ', source, ': ', date_format(ts,'MMM dd HH:mm:ss'), '.001 UTC: %LINK-', cast({sev} as string), '-UPDOWN: ', body)
        else concat('undecodable ', body) end as raw""",
    )


RULES = """values
 (1L,'link','changed|error','host-0*',17,10L,false,'regex',true,'check the uplink first'), (2L,'quiet','did view',cast(null as string),0,20L,true,'regex',true,cast(null as string)),
 (3L,'all','user 1[0-9]',cast(null as string),0,100L,false,'regex',true,' '), (4L,'big','amount [0-9]{4,}','host-1?',9,100L,false,'regex',true,'ask billing'),
 (5L,'off','did','',0,1L,true,'regex',false,cast(null as string)), (6L,'storm','many links flap','',0,1L,true,'semantic',true,cast(null as string))
 as rules(rule_id, name, pattern, source_glob, min_severity, rule_order, stop, kind, enabled, instructions)"""
BINDINGS = "values (1L,10L,100L),(1L,11L,50L),(3L,10L,100L),(4L,11L,100L),(4L,12L,100L),(5L,10L,1L),(6L,12L,1L) as binds(rule_id, target_id, target_order)"
TARGETS = """values
 (10L,'phones','push','{"topic":"ops"}','none',cast(null as string),cast(null as string),cast(null as string)),
 (11L,'triage','handoff','{"skill":"triage","model":"m1","auto_approve_tools":["ping"]}','run-as-owner','o1','alice@example.com','p1'),
 (12L,'night','handoff','{"skill":"night"}','static-svc','o2',cast(null as string),'  ')
 as targets(target_id, name, type, config, identity_policy, owner_oid, owner_upn, project)"""

_duck = lambda s: re.sub(r"\b(\d+)L\b", r"\1::bigint", s).replace("as string", "as varchar")
#: The same small dimensions for DuckDB.
DIMENSIONS_SQL = ", ".join(f"{v.rpartition(' as ')[2]} as ({_duck(v.rpartition(' as ')[0])})" for v in (RULES, BINDINGS, TARGETS))


#: A ruleset that grows with the tables: a rule for each supplier, bound to the targets of two nations unless the
#: supplier is in debt.
#: Its lines are valid in both engines ("text" stands for the string type).
GROWING_RULES = """select s_suppkey as rule_id, s_name as name, case when s_suppkey % 10 = 9 then 'semantic' else 'regex' end as kind,
  case when s_suppkey % 10 = 1 then concat('user ', cast(s_suppkey % 150 as text), ' did (view|click)') when s_suppkey % 10 = 2 then 'amount [0-9]{4,} '
    when s_suppkey % 10 = 3 then concat('sshd user ', cast(s_suppkey % 50 as text), ' ') when s_suppkey % 50 = 4 then 'did (e+)+rror' when s_suppkey % 50 = 14 then 'x{1,2000}'
    else concat('user ', cast(s_suppkey % 150 as text), ' did error') end as pattern,
  case when s_suppkey % 3 = 0 then concat('host-', cast(s_suppkey % 2 as text), '*') when s_suppkey % 20 = 5 then 'host-1,host-2' when s_suppkey % 20 = 7 then concat('hots-0', cast(s_suppkey % 10 as text)) else '' end as source_glob,
  cast(case when s_suppkey % 4 = 0 then 9 else 0 end as int) as min_severity, s_suppkey % 7 as rule_order, s_suppkey % 29 = 3 as stop,
  s_suppkey % 6 <> 5 as enabled, concat('o', cast(s_suppkey % 5 as text)) as owner_oid, case when s_suppkey % 2 = 0 then 'bot' else '' end as owner_bot,
  case when s_suppkey % 8 = 0 then 'daily' else 'sliding' end as window_kind, 300.0 * (s_suppkey % 9) as cooldown_seconds,
  case when s_suppkey % 2 = 0 then concat('call team ', cast(s_nationkey as text)) else '  ' end as instructions from supplier"""
GROWING_BINDINGS = "select s_suppkey as rule_id, s_nationkey as target_id, 1 as target_order from supplier where s_acctbal > 0 union select s_suppkey, s_suppkey * 7 % 25, 2 from supplier where s_acctbal > 0 and s_suppkey * 7 % 25 <> s_nationkey"
#: A target for each customer.
GROWING_TARGETS = """select c_custkey as target_id, c_name as name, case when c_custkey % 11 = 0 then 'pager' when c_custkey % 2 = 0 then 'push' else 'handoff' end as type,
  case when c_custkey % 2 = 0 then concat('{"url":"', case when c_custkey % 3 = 0 then 'http' else 'https' end, '://', lower(trim(c_mktsegment)), '.example.com/x/","topic":"', case when c_custkey % 5 = 0 then '' else 'ops' end, '"', case when c_custkey % 7 = 0 then ',"token":"t"' else '' end, '}')
    when c_custkey % 13 = 0 then '{"auto_approve":true}' else '{"skill":"triage"}' end as config,
  case when c_custkey % 17 = 0 then 'me' when c_custkey % 2 = 0 then 'none' else 'run-as-owner' end as identity_policy,
  concat('o', cast(c_custkey % 5 as text)) as owner_oid, case when c_custkey % 3 = 0 then 'bot' else '' end as owner_bot, case when c_custkey % 4 = 1 then ' ' else 'p1' end as project from customer"""


def growing(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the tables above, over the given supplier or customer table."""
    name = "customer" if "from customer" in sql else "supplier"
    view = f"growing_{name}_{abs(hash(sf_dir))}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    return spark.sql(sql.replace("as text)", "as string)").replace(f"from {name}", f"from {view}"))


def rules(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from {RULES}")


def bindings(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from {BINDINGS}")


def targets(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from {TARGETS}")
