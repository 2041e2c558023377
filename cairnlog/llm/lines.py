"""Repeated runs of lines, by a suffix array over line-ID sequences, in DataFrame functions only.

Every line has an ID. Prefix doubling ranks the runs of 1, 2, 4 and 8 lines: a round sorts the pairs
of two ranks of the round before, over all tasks, and the place in that order is the new rank, so ranks
order the suffixes and are equal only for equal runs. Positions that share a rank are an interval of the
suffix array whose longest common prefix has at least so many lines; the rest drop out. Within intervals
the lengths between two powers are told by two overlapping runs. Each position so gets the length of the
longest run from it that also starts earlier in the corpus, in order of doc_id and line, up to
MIN_WEIGHT lines. A run weighs one more than the blanks in each of its lines; what lies in a run of
weight MIN_WEIGHT or more that started earlier is deleted. MIN_WEIGHT lines always have the weight, so
a longer run goes as a chain of overlapping ones: maximal repeated runs go as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import drop_saved, read_table, saved

MIN_WEIGHT = 8  # words, roughly; also the most lines that the shortest run of that weight can have
PLACE = ("doc_id", "text_key", "i")


def line_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, i, id, need): each line's ID (an MD5 of the line), and how many lines from here
    have the weight, null where the text ends before."""
    lines = rows.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    weight = (F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1).alias("w")
    lines = lines.select(*PLACE, F.unhex(F.md5("line")).alias("id"), weight)
    own = W.partitionBy("doc_id", "text_key").orderBy("i")
    need = F.lit(None).cast("int")
    for k in range(MIN_WEIGHT, 0, -1):
        there = F.max("i").over(own.rangeBetween(k - 1, k - 1)).isNotNull()
        need = F.when(there & (F.sum("w").over(own.rangeBetween(0, k - 1)) >= MIN_WEIGHT), F.lit(k)).otherwise(need)
    return lines.select(*PLACE, "id", need.alias("need"))


def intervals(rows: DataFrame, *keys: str) -> DataFrame:
    """The names (keys) that two positions share, with their rank in the order of the names and their
    first place. The order is made by ranges, and numbers grow along it."""
    names = saved(rows.groupBy(*keys).agg(F.count("*").alias("c"), F.min(F.struct(*PLACE)).alias("first")).where("c > 1").drop("c"), "lines-names")
    ranked = saved(names.orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("rank"), "first"), "lines-ranks")
    drop_saved(names)
    return ranked


def _later():
    """Whether a position of an interval is not its first."""
    return F.col("first").isNotNull() & ~F.struct(*PLACE).eqNullSafe(F.col("first"))


def doubled(rows: DataFrame, k: int) -> DataFrame:
    """rows (with r{k}, the rank of k lines) and r{2k} and later{2k} of the run of twice as many lines;
    null and false where the run is in no interval."""
    own = W.partitionBy("doc_id", "text_key").orderBy("i")
    rows = saved(rows.withColumn("next", F.coalesce(F.max(f"r{k}").over(own.rangeBetween(k, k)), F.lit(-1))), "lines-next")
    found = intervals(rows.where("next >= 0"), f"r{k}", "next")
    return saved(rows.join(found, [f"r{k}", "next"], "left").select(*rows.drop("next").columns, F.col("rank").alias(f"r{2 * k}"), _later().alias(f"later{2 * k}")), "lines-level")


def overlapping(rows: DataFrame, lengths: dict[int, int], asked: dict[int, str], carry: tuple[str, ...] = ()) -> DataFrame:
    """(place, need, n, shared, later) of the runs of n lines for n of lengths, each named by the ranks of
    lengths[n] lines at its two ends; only positions that fulfil the condition asked[n] are named."""
    own = W.partitionBy("doc_id", "text_key").orderBy("i")
    ends = rows.withColumns({f"end{n}": F.max(f"r{k}").over(own.rangeBetween(n - k, n - k)) for n, k in lengths.items()})
    runs = F.array_compact(F.array(*(F.when(F.expr(asked[n]) & F.col(f"end{n}").isNotNull(), F.struct(F.lit(n).alias("n"), F.col(f"r{k}").alias("one"), F.col(f"end{n}").alias("two"))) for n, k in lengths.items())))
    named = saved(ends.select(*PLACE, "need", *carry, F.explode(runs).alias("run")).select(*PLACE, "need", *carry, "run.*"), "lines-runs")
    found = intervals(named, "n", "one", "two")
    return named.join(found, ["n", "one", "two"], "left").select(*PLACE, "need", *carry, "n", F.col("rank").isNotNull().alias("shared"), _later().alias("later"))


def repeated_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, i): the lines that belong to a later copy of a run."""
    lines = saved(line_rows(rows.select("doc_id", "text_key", "text").distinct()), "lines")
    found = intervals(lines, "id")
    one = saved(lines.join(found, "id").select(*PLACE, "need", F.col("rank").alias("r1"), _later().alias("later1")), "lines-level")
    two = doubled(one, 1)
    four = doubled(two.where("r2 is not null").drop("r1", "later1"), 2)
    eight = doubled(four.where("r4 is not null").select(*PLACE, "need", "r4", "later4"), 4)
    # the first of an interval of n lines is never a later one of more lines, so later ones need no second look
    three = overlapping(four, {3: 2}, {3: "not later4"})
    six = saved(overlapping(eight.where("not later8"), {6: 4}, {6: "true"}).select(*PLACE, "shared", F.col("later").alias("later6")), "lines-six")
    # seven lines: all members of the intervals of six; five: those that are not later ones of six
    rest = eight.join(six, list(PLACE), "left").withColumns({"shared": F.coalesce("shared", F.lit(False)), "later6": F.coalesce("later6", F.lit(False))})
    more = overlapping(rest, {5: 4, 7: 4}, {5: "not later8 and not later6", 7: "shared"})
    runs = [
        two.where("later1 and not later2").select(*PLACE, "need", F.lit(1).alias("n")),
        four.where("later2 and not later4").select(*PLACE, "need", F.lit(2).alias("n")),
        three.where("later").select(*PLACE, "need", "n"),
        eight.where("later4 and not later8").select(*PLACE, "need", F.lit(4).alias("n")),
        rest.where("later6").select(*PLACE, "need", F.lit(6).alias("n")),
        more.where("later").select(*PLACE, "need", "n"),
        eight.where("later8").select(*PLACE, "need", F.lit(8).alias("n")),
    ]
    gone = reduce(DataFrame.unionByName, runs).where("n >= need")
    return gone.select("doc_id", "text_key", F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("i"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the later copies of repeated line runs deleted from text, and n_lines, n_removed.

    Null text is empty and has one empty line. Rows that repeat both doc_id and text count as one
    document and are treated alike; rows without doc_id come first in the order; of one doc_id with
    several texts the order is that of a hash. Text that no repeated run touches stays as it is.
    Columns other than text pass through whatever their names; earlier n_lines and n_removed are
    replaced. An empty table gives no rows. A text's lines are one window's partition, sorted on disk if
    they are very many."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the row is one column here, so that none of its names can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    gone = repeated_lines(rows).groupBy("doc_id", "text_key").agg(F.collect_set("i").alias("gone"))
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "text_key": "gone_key"})
    met = rows.join(gone, rows.doc_id.eqNullSafe(gone.gone_id) & (rows.text_key == gone.gone_key), "left")
    # the split stays a column of its own: within a lambda it would be done for every line
    met = met.withColumn("lines", F.split("text", "\n"))
    lines = F.col("lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")
    met = met.select(
        "row",
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("text")).alias("text"),
    )
    passed = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return met.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in passed), "n_lines", "n_removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, n_lines, n_removed, kept_sha256 (of the text that is left)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}

_RUNS = " union all ".join(
    f"select s.doc_id, i, {k} as n, list_slice(string_split(d.text, chr(10)), i + 1, i + {k}) as run from s join d using (doc_id) where s{k} >= {MIN_WEIGHT} and i + {k} <= m" for k in range(1, MIN_WEIGHT + 1)
)
ORACLE_SQL = {
    "op7_line_dedup": f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i,
  len(string_split(text, chr(10))) as m from d),
w as (select *, length(line) - length(replace(line, ' ', '')) + 1 as w from l),
s as (select *, {", ".join(f"sum(w) over (partition by doc_id order by i rows between current row and {k - 1} following) as s{k}" for k in range(1, MIN_WEIGHT + 1))} from w),
runs as ({_RUNS}),
o as (select *, row_number() over (partition by n, run order by doc_id, i) as k from runs),
gone as (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as i from o where k > 1)
select l.doc_id, count(*) as n_lines, count(g.i) as n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) order by l.i) filter (where g.i is null), '')) as kept_sha256
from l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id"""
}
