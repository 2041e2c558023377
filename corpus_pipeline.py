"""A corpus pipeline of five stages over documents: toxicity, line dedup, near-dedup, mixing, packing.

run() writes each stage's rows as Parquet in the shared folder and reads them again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.llm import lines, minhash, mixing, packing, toxicity
from cairnlog.llm.shared import read_table, saved

#: No SQL: a trained model, tokens and a packing decide.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold of their language."""
    model, thresholds = toxicity.fitted(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs.select(F.struct("*").alias("row"), "text", "lang"), model)
    return scored.where(F.col("score") < toxicity.threshold_of(thresholds)).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of maximal repeated line runs; one of which no line is left goes.

    The condition uses the counts alone: one on the new text would be evaluated below the step that
    splits it into lines, once for every line."""
    left = lines.without_repeats(docs).where("n_removed < n_lines")
    left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, and of several texts or
    rows under it one. Documents without words or doc_id are in no group and stay."""
    groups = saved(minhash.near_duplicates(docs), "pipeline-groups")
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), key.alias("key"))
    dropped = groups.where("not leads").select(F.col("doc_id").alias("id"), F.col("row_key").alias("key")).distinct()
    rows = rows.join(dropped, ["id", "key"], "left_anti")
    # rows that repeat both id and text are rare, and looked for in the small table
    again = groups.where("leads and n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("id"), F.col("row_key").alias("key")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = saved(again, "pipeline-again")
    if not again.isEmpty():
        one = rows.join(again, ["id", "key"]).groupBy("id", "key").agg(F.first("row").alias("row")).select("row", "id", "key")
        rows = rows.join(again, ["id", "key"], "left_anti").select("row", "id", "key").union(one)
    return rows.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture at the default target weights: documents of sources under their weight are used
    again until they reach it. Rows stand in the order of the slots."""
    mixture = mixing.mixed(docs)
    return mixture.repartitionByRange("mix_slot", "doc_id").sortWithinPartitions("mix_slot", "doc_id").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixture and the sequences that hold them. The slots' order ends here, but not
    the weights: any stretch of sequence numbers holds the sources in their shares."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
