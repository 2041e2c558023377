"""Full-text search through a written posting table: stem, id, one row for each text that has the stem.

The table is partitioned by a hash of the stem and sorted by it, so that a search reads the parts of the
stems it asks for and nothing of the texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import STOP_WORDS, tokens
from ..functions.stems import stems
from ..sources.tables import written

PARTS = 256


def _part(term):
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def postings(texts: DataFrame, key: str = "id", text: str = "body") -> DataFrame:
    """(id, term) of every text's stems. Each distinct word of all texts is stemmed once, and the texts'
    words meet their stems in a join; null and empty texts have none."""
    words = written(texts.select(F.col(key).alias("id"), F.explode(tokens(F.col(text))).alias("word")), "posting-words")
    known = words.select("word").distinct().repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, "word")
    known = written(known.select("word", F.element_at(stems(F.array("word")), 1).alias("term")), "posting-stems")
    return words.join(known, "word").select("id", "term").distinct()


def write_postings(texts: DataFrame, path: str, key: str = "id", text: str = "body") -> None:
    """Write the posting table. A stem that a third of all texts have is dealt out by id too, so it is
    no single task's; its rows lie in several files of its part."""
    rows = postings(texts, key, text).withColumn("part", _part(F.col("term")))
    salted = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "part", F.pmod(F.xxhash64("id"), F.lit(8)))
    salted.sortWithinPartitions("part", "term", "id").write.mode("overwrite").partitionBy("part").parquet(path)


def query_stems(spark: SparkSession, query: str) -> list[str]:
    """The stems of a query's words that are no stop words, by the table's own expression."""
    words = [w for w in dict.fromkeys(re.split(r"[^a-z0-9_]+", query.lower())) if w and w not in STOP_WORDS]
    if not words:
        return []
    return sorted(set(spark.createDataFrame([(words,)], "w array<string>").select(stems(F.col("w"))).first()[0]))


def search_postings(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id) of the texts that have all stems of the query; a query without words finds nothing."""
    terms = query_stems(spark, query)
    table = spark.read.parquet(path)
    if not terms:
        return table.select("id").where("false")
    parts = sorted({r.p for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_part(F.col("t")).alias("p")).collect()})
    found = table.where(F.col("part").isin(parts) & F.col("term").isin(terms))
    return found.groupBy("id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms)).select("id")
