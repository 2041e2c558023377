"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors are turned onto their principal axes, sorted by the grid cells (side epsilon) of the
leading ones, and cut into sequence blocks. Intervals of the sequence are joined recursively, first
intervals of many blocks over the cluster, then halves of a block within a task; two intervals whose
bounding boxes lie farther apart than epsilon are skipped. Cosine >= c is a distance of at most
sqrt(2 - 2c) between unit vectors, so skipping loses nothing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, read_table, saved

MIN_COSINE = 0.9
LEADING = 8  # axes of the grid and of the boxes that pair blocks
BLOCK = 8192  # vectors in a block
FAN = 16  # intervals that make one of the next level
LEAF = 512  # vectors in an interval that is compared outright
BOX = 16  # axes of the boxes within a task
_SLACK = 1e-4  # float32 products this near the limit are taken again in double precision


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _units(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    scaled = vectors / np.where(scale > 0, scale, 1)
    norm = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / np.where(norm > 0, norm, 1)


def valid_classes(vectors: DataFrame) -> DataFrame:
    """(v, members, first_id, rep): the distinct usable vectors as double arrays, with the number of
    rows that hold each, the smallest id and a number of their own (kept once it is written). Null,
    zero and non-finite vectors are left out. Exact copies meet in a partial aggregate."""
    v = F.col("v")
    usable = vectors.where(
        v.isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return usable.groupBy("v").agg(F.count("*").alias("members"), F.min("vec_id").alias("first_id")).withColumn("rep", F.monotonically_increasing_id())


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """The orthogonal axes of the unit vectors, by falling variance: every batch adds up its outer
    products, and only dim x dim sums reach the driver."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            u = _units(_matrix(batch.column(0), dim))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dim), dim)), pa.array(np.tile(np.arange(dim), dim)), pa.array(total.ravel())], ["i", "j", "s"])

    sums = classes.select("v").mapInArrow(outer, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    c = np.zeros((dim, dim))
    for r in sums:
        c[r.i, r.j] = r.s
    _, axes = np.linalg.eigh((c + c.T) / 2)
    return axes[:, ::-1].copy()


def sequence_blocks(classes: DataFrame, axes: np.ndarray, epsilon: float, block: int) -> DataFrame:
    """Blocks of the grid order: block id, box on the leading axes, packed ids, weights, vectors."""
    dim = len(axes)
    leading = min(LEADING, dim)
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor(_units(_matrix(batch.column(0), dim)) @ shared.value[:, :leading] / epsilon).astype(np.int64)
            # cells lie within +-1/epsilon, so one byte each keeps the lexicographic order
            keys = (np.clip(at, -127, 127) + 128).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), *batch.columns], ["cell", "v", "members", "rep"])

    ordered = classes.select("v", "members", "rep").mapInArrow(cells, "cell binary, v array<double>, members long, rep long")
    ordered = saved(ordered, "ego").repartitionByRange("cell", "rep").sortWithinPartitions("cell", "rep")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        part, k, held = TaskContext.get().partitionId(), 0, []

        def row(ids, members, vectors):
            nonlocal k
            x = _units(vectors) @ shared.value[:, :leading]
            k += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + k - 1]), pa.array([x.min(0).tolist()]), pa.array([x.max(0).tolist()]), pa.array([ids.tobytes()]), pa.array([members.tobytes()]), pa.array([vectors.tobytes()])],
                ["block", "lo", "hi", "ids", "members", "vectors"],
            )

        size = 0
        for batch in batches:
            held.append((batch.column(3).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(1), dim)))
            size += batch.num_rows
            if size >= block:
                ids, members, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                full = size - size % block
                for a in range(0, full, block):
                    yield row(ids[a : a + block], members[a : a + block], vectors[a : a + block])
                held, size = [(ids[full:], members[full:], vectors[full:])], size - full
        if size:
            yield row(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return saved(ordered.mapInArrow(pack, "block long, lo array<double>, hi array<double>, ids binary, members binary, vectors binary"), "ego-blocks")


def near_blocks(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (x <= y) of blocks whose boxes come within epsilon. FAN neighbours of the sequence at a
    time make an interval with a box of its own, level by level up to one interval; from there down
    the halves of near pairs are paired, so that only near intervals ever meet."""
    levels = [saved(blocks.select("block", F.col("block").alias("id"), "lo", "hi"), "ego-boxes")]
    low, high = (F.array(*(f(F.col(c)[k]) for k in range(_axes(blocks)))) for f, c in ((F.min, "lo"), (F.max, "hi")))
    while levels[-1].agg(F.count_distinct("id")).first()[0] > 1:
        # ids hold the partition above and the place in it below; places run out first
        inner = levels[-1].agg(F.max(F.col("id").bitwiseAND((1 << 32) - 1))).first()[0] > 0
        parent = F.shiftleft(F.shiftright("id", 32), 32) + F.floor(F.col("id").bitwiseAND((1 << 32) - 1) / FAN) if inner else F.shiftleft(F.floor(F.shiftright("id", 32) / FAN), 32)
        below = levels.pop().withColumn("parent", parent.cast("long"))
        levels += [below, saved(below.groupBy(F.col("parent").alias("id")).agg(low.alias("lo"), high.alias("hi")), "ego-boxes")]
    pairs = levels.pop().select(F.col("id").alias("x"), F.col("id").alias("y"))
    gap = F.expr("aggregate(arrays_zip(xlo, xhi, ylo, yhi), 0D, (s, z) -> s + pow(greatest(z.ylo - z.xhi, z.xlo - z.yhi, 0D), 2))")
    for level in reversed(levels):
        left = level.select(F.col("parent").alias("x"), F.col("id").alias("cx"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
        right = level.select(F.col("parent").alias("y"), F.col("id").alias("cy"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"))
        met = pairs.join(left, "x").join(right, "y").where("cx <= cy").where(gap <= epsilon * epsilon * (1 + 1e-9))
        pairs = saved(met.select(F.col("cx").alias("x"), F.col("cy").alias("y")), "ego-pairs")
    return pairs


def _axes(blocks: DataFrame) -> int:
    return blocks.select(F.size("lo").alias("n")).first().n


def links_between(a: tuple, b: tuple | None, axes: np.ndarray, cosine: float, leaf: int = LEAF):
    """Join two blocks (or one with itself): linked members of each row of a and of b, and edges
    that connect what the links connect. The recursion halves the longer interval and stops where
    the boxes are farther apart than epsilon."""
    ids = np.concatenate([a[0], b[0]]) if b is not None else a[0]
    members = np.concatenate([a[1], b[1]]) if b is not None else a[1]
    units = _units(np.concatenate([a[2], b[2]]) if b is not None else a[2])
    small, x = units.astype(np.float32), units @ axes[:, : min(BOX, len(axes))]
    reach = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    counts, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(s: int, e: int, t: int, f: int) -> None:
        gap = np.maximum(np.maximum(x[t:f].min(0) - x[s:e].max(0), x[s:e].min(0) - x[t:f].max(0)), 0)
        if (gap * gap).sum() > reach:
            return
        if max(e - s, f - t) > leaf:
            if s == t:
                m = (s + e) // 2
                join(s, m, s, m), join(s, m, m, e), join(m, e, m, e)
            elif e - s >= f - t:
                m = (s + e) // 2
                join(s, m, t, f), join(m, e, t, f)
            else:
                m = (t + f) // 2
                join(s, e, t, m), join(s, e, m, f)
            return
        product = small[s:e] @ small[t:f].T
        i, j = np.nonzero(product >= cosine - _SLACK)
        if s == t:
            i, j = i[i < j], j[i < j]
        near = np.abs(product[i, j] - cosine) <= _SLACK
        if near.any():
            exact = np.einsum("ij,ij->i", units[s + i[near]], units[t + j[near]])
            good = np.ones(len(i), bool)
            good[near] = exact >= cosine
            i, j = i[good], j[good]
        i, j = i + s, j + t
        np.add.at(counts, i, members[j])
        np.add.at(counts, j, members[i])
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(p), root(q)
            if p != q:
                parent[max(p, q)] = min(p, q)

    n = len(a[0])
    if len(ids):
        join(0, n, 0, n) if b is None else join(0, n, n, len(ids))
    roots = np.array([root(i) for i in range(len(ids))], np.int64)
    return ids, counts, ids[roots] if len(ids) else ids


def embedding_links(vectors: DataFrame, cosine: float = MIN_COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, v array<double>).

    Copies of a vector link with each other; null, empty, zero and non-finite vectors are components
    of their own, and so are those that no other comes near. Vectors of unequal lengths have no cosine
    and never link: each length is joined by itself. Repeated vec_ids are rows of their own, each
    counted as a vector. Ties need no rule, as every link counts; other columns are ignored; an
    empty table gives no rows. Only one row per link-bearing vector and task leaves a task: never
    the links themselves."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    classes = saved(valid_classes(rows), "ego-classes")
    lengths = sorted(r.d for r in classes.select(F.size("v").alias("d")).distinct().collect())  # a few
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = [linked_classes(classes.where(F.size("v") == d) if len(lengths) > 1 else classes, d, cosine, block) for d in lengths]
    found = reduce(DataFrame.unionByName, found)
    return rows.join(found, "v", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def linked_classes(classes: DataFrame, dim: int, cosine: float, block: int) -> DataFrame:
    """(v, n_links, component_id) of the distinct vectors of one length."""
    axes = principal_axes(classes, dim)
    epsilon = float(np.sqrt(2 - 2 * cosine))
    blocks = sequence_blocks(classes, axes, epsilon, block)
    pairs = near_blocks(blocks, epsilon)
    shared = classes.sparkSession.sparkContext.broadcast(axes)  # dim x dim numbers

    def unpack(batch: pa.RecordBatch, i: int, at: int) -> tuple:
        ids, members, v = (batch.column(at + k)[i].as_py() for k in range(3))
        return np.frombuffer(ids, np.int64), np.frombuffer(members, np.int64), np.frombuffer(v, np.float64).reshape(-1, dim)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a = unpack(batch, i, 2)
                b = None if batch.column(0)[i] == batch.column(1)[i] else unpack(batch, i, 5)
                ids, counts, roots = links_between(a, b, shared.value, cosine)
                hit = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(counts[hit]), pa.array(roots[hit])], ["rep", "n", "root"])

    side = lambda k: [F.col("block").alias(k), *(F.col(c).alias(k + c) for c in ("ids", "members", "vectors"))]
    met = pairs.join(blocks.select(*side("x")), "x").join(blocks.select(*side("y")), "y")
    met = met.select("x", "y", "xids", "xmembers", "xvectors", "yids", "ymembers", "yvectors")
    # one pair of blocks is work enough for a task's Arrow batch
    found = saved(met.repartition(F.col("x"), F.col("y")).mapInArrow(compare, "rep long, n long, root long"), "ego-found")
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # a class is known by number: its smallest vec_id may be another class's too
    per_class = (
        classes.join(found.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left")
        .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .withColumn("c", F.coalesce("component_id", "rep"))
    )
    least = per_class.groupBy("c").agg(F.min("first_id").alias("least"))
    return saved(per_class.join(least, "c").select("v", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.col("least").alias("component_id")), "ego-result")


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> vec_id, n_links, component_id, kept at cosine >= 0.9."""
    return embedding_links(read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")))


QUERIES = {"op3_embedding_links": op3_embedding_links}

_NORM = "sqrt(list_sum(list_transform(e, lambda x: x * x)))"
ORACLE_SQL = {
    "op3_embedding_links": """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
u as (select vec_id, e, list_dot_product(e, e) as n from v
  where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
links as (select a.vec_id as a, b.vec_id as b from u a join u b
  on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) >= 0.9 * sqrt(a.n) * sqrt(b.n)),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a, min(b) as component_id from reach group by a),
deg as (select a, count(*) as n from links group by a)
select v.vec_id, cast(coalesce(d.n, 0) as bigint) as n_links, c.component_id, c.component_id = v.vec_id as kept
from v join comp c on c.a = v.vec_id left join deg d on d.a = v.vec_id"""
}
