"""Nearest vectors by cosine, exactly, without comparing every pair.

Angles obey the triangle inequality. Every vector goes to its nearest pivot and, by its angle to it, to a
ring around it; large rings are dealt into several blocks. A query's angle to a pivot then bounds its angle
to all vectors of a block at once. The blocks that may be nearest are searched first; what the k-th best of
these leaves open is searched after that, and all other blocks are skipped."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.templates import best_cosines
from ..sources.tables import written

PIVOTS = 64  # vectors that are sent to every task
RINGS = 256
BLOCK = 2048  # vectors of a block, about
CHUNK = 512  # queries that meet a block in one task, about
PAIRS = 1 << 17  # (query, block) that are handed on together, about
FIRST = 2  # blocks that give a query its first bound
SLACK = 1e-7  # of an angle, for rounding

SCORED = "query_id long, vec_id long, cosine double"


def placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, embedding as doubles, norm, angles to all pivots) of the vectors that have an angle: those
    that are null, zero or hold null or non-finite components have none and are nobody's neighbours."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = pdf[pdf.embedding.map(lambda e: e is not None and not pd.isna(np.asarray(e, np.float64)).any())]
            rows = [np.asarray(e, np.float64) for e in keep.embedding]
            norms = np.array([math.sqrt(float((x * x).sum())) for x in rows])
            good = np.isfinite(norms) & (norms > 0)
            ids, rows, norms = keep.vec_id[good], [x for x, g in zip(rows, good, strict=True) if g], norms[good]
            cos = np.array([np.clip(pivots @ (x / n), -1, 1) for x, n in zip(rows, norms, strict=True)]).reshape(-1, len(pivots))
            yield pd.DataFrame({"vec_id": ids, "embedding": rows, "norm": norms, "angles": list(np.arccos(cos))})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(place, "vec_id long, embedding array<double>, norm double, angles array<double>")


def search(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, vec_id, cosine) within each pair (query_id, block) of a query asked (query_id, q). A block that very
    many queries meet is met in chunks of these."""
    chunks = pairs.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    left = pairs.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).drop("chunks")
    right = blocks.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        return best_cosines(queries.select(["query_id", "q"]), vectors.select(["vec_id", "embedding"]), k)

    keys = ["block", "chunk"]
    left = left.join(asked.select("query_id", "q"), "query_id").select(*keys, "query_id", "q")
    return left.groupBy(*keys).cogroup(right.select(*keys, "vec_id", "embedding").groupBy(*keys)).applyInArrow(best, SCORED)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, float]:
    """(query_id, vec_id, cosine, rank) of the k nearest vectors to each query vector, ties by the smaller
    vec_id, and the share of all comparisons that was made. Vectors have one length."""
    spark = vectors.sparkSession
    drawn = vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * PIVOTS).select("embedding").collect()
    drawn = [x for x in (np.array([np.nan if c is None else c for c in r.embedding], np.float64) for r in drawn) if np.isfinite(x).all() and x.any()][:PIVOTS]
    if not drawn:
        return spark.createDataFrame([], SCORED + ", rank int"), 0.0
    pivots = np.stack([x / np.sqrt((x * x).sum()) for x in drawn])
    rows = placed(vectors, pivots).withColumn("r", F.array_min("angles"))
    rows = rows.withColumn("p", F.array_position("angles", F.col("r")).cast("int") - 1).withColumn("ring", F.floor(F.col("r") / math.pi * RINGS).cast("int")).drop("angles")
    rows = written(rows, "near-vectors")
    sizes = rows.groupBy("p", "ring").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / BLOCK).cast("int"))
    salt = F.pmod(F.xxhash64("vec_id"), F.col("salts"))
    blocks = rows.join(F.broadcast(sizes.drop("n")), ["p", "ring"]).withColumn("block", (F.col("p") * RINGS + F.col("ring")) * (1 << 32) + salt)  # sizes: at most PIVOTS * RINGS rows
    blocks = written(blocks.select("block", "p", "r", "vec_id", "embedding", "norm"), "near-blocks")
    bounds = blocks.groupBy("block").agg(F.first("p").alias("p"), F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n"))
    table = bounds.orderBy("block").toPandas()  # one row for about BLOCK vectors, or for a ring
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("block", "p", "low", "high", "n")))

    def reach(chosen):
        """(query_id, block, n) for the blocks that chosen(least angles, the query's limit) names."""

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block, p, low, high, n = shared.value
            queries, places, size = [], [], 0

            def rows() -> pd.DataFrame:
                at = np.concatenate([np.zeros(0, np.int64), *places])
                return pd.DataFrame({"query_id": np.repeat(np.array(queries, np.int64), [len(x) for x in places]), "block": block[at], "n": n[at]})

            for pdf in batches:
                for query, angles, limit in zip(pdf.query_id, pdf.angles, pdf.limit, strict=True):
                    at = np.asarray(angles)[p]
                    least = np.maximum(0, np.maximum(at - high, low - at))
                    queries.append(query)
                    places.append(np.asarray(chosen(least, limit), np.int64))
                    size += len(places[-1])
                    if size >= PAIRS:  # a query may reach every block
                        yield rows()
                        queries, places, size = [], [], 0
            yield rows()

        return find

    pairs = "query_id long, block long, n long"
    asked = placed(queries, pivots).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "angles")
    asked = written(asked.withColumn("limit", F.lit(0.0)), "near-queries")
    home = written(asked.drop("q").mapInPandas(reach(lambda least, _: np.argsort(least, kind="stable")[:FIRST]), pairs), "near-first")
    found = written(search(home, asked, blocks, k), "near-found")
    kth = found.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id"))).where(F.col("k") == k)
    limits = kth.select("query_id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine"))).alias("limit"))
    open_ = asked.drop("limit", "q").join(limits, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(math.pi)))
    rest = open_.mapInPandas(reach(lambda least, limit: np.setdiff1d(np.flatnonzero(least <= limit + SLACK), np.argsort(least, kind="stable")[:FIRST])), pairs)
    rest = written(rest, "near-rest")
    both = found.unionByName(search(rest, asked, blocks, k))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id"))).where(F.col("rank") <= k)
    made = home.unionByName(rest).agg(F.sum("n")).first()[0] or 0
    return ranked, made / max(1, asked.count() * int(table.n.sum()))
