"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal text size. Its target weight w gives its j-th block the
release time j / w and the deadline (j + 1) / w, and each slot of the mixture goes to the released
block whose deadline comes first. Weights are exact fractions and every slot of the mixture is
scheduled, so after any number of slots every source has had its share to within less than one
block. The schedule has a row for each block; one task makes it, in memory for the sources alone."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import read_table, saved

BLOCK_CHARS = 1 << 16
TEMPERATURE = 0.8
BROADCAST_SOURCES = 100_000  # sources (a name and two numbers each) that may go to every task
PARTS = 256  # ranges in which a source's documents are ordered and summed


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Integers in the very proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if bad := [s for s, w in exact.items() if w <= 0]:
        raise ValueError(f"no weight for {sorted(bad)}")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def schedule(weights: dict[str, int], length: int) -> Iterator[tuple[str, int]]:
    """(source, block) of each slot by earliest deadline first among released blocks.

    Block j of a source with a of P is released at floor(jP / a) and due at ceil((j + 1)P / a); as
    the weights sum to one, every block runs in its window."""
    total = sum(weights.values())
    coming = [(0, s, 0) for s in weights]  # released at, source, block
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []  # due at, source, block
    for t in range(length):
        while coming and coming[0][0] <= t:
            _, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j))
        due, s, j = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block missed its deadline")
        heapq.heappush(coming, ((j + 1) * total // weights[s], s, j + 1))
        yield s, j


def slot_rows(spark: SparkSession, weights: dict[str, int], count: dict[str, int], length: int, batch: int = 1 << 16) -> DataFrame:
    """(mix_of, mix_at, mix_epoch, mix_block, mix_slot): the source that each slot holds, and its block
    within one use of the source."""
    schema = "mix_of string, mix_at long, mix_epoch long, mix_block long, mix_slot long"
    names = ["mix_of", "mix_at", "mix_epoch", "mix_block", "mix_slot"]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for _ in frames:
            for t, (s, j) in enumerate(schedule(weights, length)):
                out.append((s, j % count[s], j // count[s], j, t))
                if len(out) == batch:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return saved(spark.range(0, 1, 1, 1).mapInPandas(rows, schema), "mix-slots")


def blocks(rows: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """rows (row, doc_id, text, mix_source, mix_size) with the block of each. A source's rows stand in
    the order of a hash of their id; sizes are summed within PARTS ranges of the hash and the ranges'
    sums are added up, so a source of any size is spread over tasks."""
    rows = rows.withColumn("mix_hash", F.xxhash64("doc_id", "text")).drop("text")
    rows = rows.withColumn("mix_part", F.pmod(F.shiftright("mix_hash", 40), F.lit(PARTS)))
    sums = rows.groupBy("mix_source", "mix_part").agg(F.sum("mix_size").alias("part_size"))
    before = W.partitionBy("mix_source").orderBy("mix_part").rowsBetween(W.unboundedPreceding, -1)
    starts = saved(sums.select(F.col("mix_source").alias("s"), F.col("mix_part").alias("p"), F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start")), "mix-parts")
    own = W.partitionBy("mix_source", "mix_part").orderBy("mix_hash", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("mix_size").over(own), F.lit(0)))
    rows = rows.join(starts, (F.col("mix_source") == F.col("s")) & (F.col("mix_part") == F.col("p")))
    return rows.select("row", "mix_source", F.floor((F.col("part_start") + F.col("within")) / block_chars).alias("block"))


def default_weights(sizes: dict[str, int], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Weights that lift small sources: size to the power of the temperature."""
    return {s: float(max(n, 1)) ** temperature for s, n in sizes.items()}


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs in the mixture: one row for each use of a document, with mix_epoch, mix_block (its number
    in the source, over all epochs), mix_release, mix_deadline and mix_slot.

    The mixture is as long as the source that is richest against its weight needs to be used once;
    other sources begin again until then, so every document is used and the weights hold to the end.
    A source without a weight is an error; null sources are the source ''. Null and empty texts take
    no room and stand in the block they fall into; a text longer than a block is in the block where it
    begins; repeated rows are rows of their own; rows that tie in the hash order stand by doc_id; an
    empty table gives an empty mixture. Other
    columns pass through whatever their names; earlier mix_* columns of the same names are replaced.
    Sources are few (the weights are a parameter); their names and sizes are all that reaches the
    driver."""
    spark = docs.sparkSession
    added = {"mix_epoch": "long", "mix_block": "long", "mix_release": "double", "mix_deadline": "double", "mix_slot": "long"}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    passed = [c for c in docs.columns if c not in added]
    # the row is one column here, so that none of its names can clash
    rows = docs.select(F.struct(*passed).alias("row"), "doc_id", F.col("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"), F.length(text).cast("long").alias("mix_size"))
    sizes = {r.mix_source: r.n for r in rows.groupBy("mix_source").agg(F.sum("mix_size").alias("n")).collect()}
    if not sizes:
        return docs.select(*passed, *(F.lit(None).cast(t).alias(n) for n, t in added.items()))
    weights = weights or default_weights(sizes)
    if missing := set(sizes) - set(weights):
        raise ValueError(f"no weight for {sorted(missing)}")
    exact = whole({s: weights[s] for s in sizes})
    total = sum(exact.values())
    count = {s: max(1, -(-n // block_chars)) for s, n in sizes.items()}
    length = max(-(-count[s] * total // exact[s]) for s in sizes)  # the last first use is due by then
    plan = spark.createDataFrame([(s, count[s], total / a) for s, a in exact.items()], "mix_s string, mix_blocks long, mix_width double")
    rows = blocks(rows, block_chars).join(F.broadcast(plan) if len(exact) <= BROADCAST_SOURCES else plan, F.col("mix_source") == F.col("mix_s"))
    # empty texts behind a source's last full block belong to it
    rows = rows.withColumn("mix_within", F.least("block", F.col("mix_blocks") - 1))
    rows = rows.join(slot_rows(spark, exact, count, length), (F.col("mix_source") == F.col("mix_of")) & (F.col("mix_within") == F.col("mix_at")))
    rows = rows.withColumns({"mix_release": F.col("mix_block") * F.col("mix_width"), "mix_deadline": (F.col("mix_block") + 1) * F.col("mix_width")})
    return rows.select(*(F.col("row").getField(c).alias(c) for c in passed), *added)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in the mixture: doc_id, source, and the block's epoch, number, window and slot."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).drop("text").withColumn("source", F.coalesce("source", F.lit("")))


QUERIES = {"op8_mixing": op8_mixing}
ORACLE_SQL: dict[str, str] = {}
