"""Message templates: variable parts masked, so that one row stands for a message shape."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: the masks, in order (uuid, mac, ipv4 with port, ipv6-like, hex, long hex run, number)
MASKS = (
    r"\b[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b",
    r"\b(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}\b",
    r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b",
    r"\b(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}\b",
    r"\b0x[0-9a-fA-F]+\b",
    r"\b[0-9a-fA-F]{16,}\b",
    r"\b\d+(?:\.\d+)?\b",
)


def template(body):
    t = F.coalesce(body, F.lit(""))
    for mask in MASKS:
        t = F.regexp_replace(t, mask, "<*>")
    t = F.regexp_replace(t, r"(<\*>)(\s+<\*>)+", "$1")
    return F.regexp_replace(t, r"\A\s+|\s+\z", "")


def fingerprint(program, masked):
    return F.sha1(F.concat(F.coalesce(program, F.lit("")), F.lit("\0"), masked))


def with_template(events: DataFrame) -> DataFrame:
    return events.withColumn("template", template(F.col("body"))).withColumn("fp", fingerprint(F.col("program"), F.col("template")))


def template_delta(events: DataFrame) -> DataFrame:
    """Hits per fingerprint with the first template and the first and last time."""
    return with_template(events).groupBy("fp").agg(
        F.min_by("template", "id").alias("template"), F.count("*").alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min("id").alias("first_id")
    )


def merge_templates(old: DataFrame, delta: DataFrame) -> DataFrame:
    """A new snapshot of the registry: the first template stays, hits add up."""
    both = old.unionByName(delta)
    return both.groupBy("fp").agg(
        F.min_by("template", "first_id").alias("template"), F.sum("hits").alias("hits"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first_id").alias("first_id")
    )


def source_delta(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.count("*").alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.lit(True).alias("active"))


def merge_sources(old: DataFrame, delta: DataFrame) -> DataFrame:
    """A new snapshot of the sources: counts add up, a source that wrote again is active again."""
    both = old.withColumn("fresh", F.lit(0)).unionByName(delta.withColumn("fresh", F.lit(1)))
    return both.groupBy("source").agg(F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("active", "fresh").alias("active"))


def _vectors(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components and lengths of the vectors in columns 0 and `k` that have an angle: those that are null,
    zero or hold null or non-finite components have none."""
    sizes = pc.fill_null(pc.list_value_length(table.column(k)), 0).to_numpy()
    dim = int(sizes.max(initial=0))
    table = table.filter(pa.array((sizes == dim) & (sizes > 0)))
    rows = pc.list_flatten(table.column(k)).to_numpy().reshape(-1, max(1, dim))
    total = np.zeros(len(rows))
    for x in rows.T:  # one component after another: equal vectors are equally long wherever they stand
        total += x * x
    good = np.isfinite(total) & (total > 0)
    return table.column(0).to_numpy()[good], rows[good], np.sqrt(total[good])


def _first_copies(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The rows but for copies of a vector that come after as many by their ids that none of these can be among
    the k best of a query: k of its copies do not bear the query's own id."""
    _, group = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    place = np.arange(len(ids)) - np.searchsorted(group[order], group[order])
    return np.sort(order[place < k + np.unique(ids, return_counts=True)[1].max(initial=0)])


def best_cosines(queries: pa.Table, vectors: pa.Table, k: int, rows: int = 256, columns: int = 8192) -> pa.Table:
    """The k best (query_id, vec_id, cosine) of each query (query_id, q) among the vectors (vec_id, embedding),
    ties by the smaller vec_id. Matrix products of bounded size in single precision leave out what cannot be
    among them by more than their error; what is left has its cosine taken component by component in double
    precision, so that equal vectors are equally near."""
    qid, q, qn = _vectors(queries, 1)
    vid, v, vn = _vectors(vectors, 1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    kept = _first_copies(vid, v, k)
    vid, v, vn = vid[kept], v[kept], vn[kept]
    unit = (v / vn[:, None]).astype(np.float32)
    slack = (v.shape[1] + 8) * 2.0**-22  # over twice the error of a product of unit vectors, for both sides
    by_id = np.argsort(vid, kind="stable")
    for a in range(0, len(qid) if len(vid) else 0, rows):
        ids, part, own = qid[a : a + rows], q[a : a + rows], qn[a : a + rows]
        first, last = (np.searchsorted(vid, ids, side, by_id) for side in ("left", "right"))
        mine = np.repeat(np.arange(len(ids)), last - first)  # where a query meets rows of its own id
        same = by_id[np.arange(len(mine)) - np.repeat(np.cumsum(last - first) - last, last - first)]
        asked = (part / own[:, None]).astype(np.float32)
        least = np.full(len(ids), -np.inf)
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # (query's place, vec_id, cosine)
        b, width = 0, min(columns, 512)  # the first columns give bounds for more of them
        while b < len(vid):
            near = asked @ unit[b : b + width].T
            here = (same >= b) & (same < b + width)
            near[mine[here], same[here] - b] = -np.inf
            if not b and near.shape[1] > k:
                least = np.partition(near, -k, axis=1)[:, -k].astype(np.float64)
            i, j = np.divmod(np.flatnonzero(near >= np.maximum(least - slack, -2)[:, None].astype(np.float32)), near.shape[1])
            dot = np.zeros(len(i))
            for d in range(part.shape[1]):
                dot += part[i, d] * v[b + j, d]
            i, found, cosine = (np.concatenate(x) for x in zip(held, (i, vid[b + j], dot / (own[i] * vn[b + j])), strict=True))
            order = np.lexsort((found, -cosine, i))
            i, found, cosine = i[order], found[order], cosine[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            least[i[place == k - 1]] = cosine[place == k - 1]
            held = i[place < k], found[place < k], cosine[place < k]
            b, width = b + width, min(columns, 4 * width)
        out.append((ids[held[0]], held[1], held[2]))
    return pa.table(dict(zip(("query_id", "vec_id", "cosine"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1 << 16, asked: int = 1 << 16) -> DataFrame:
    """The k nearest vectors (vec_id, embedding) to each query vector by cosine, exactly: all pairs are compared.
    A task takes at most about `asked` queries and `block` vectors, so its memory does not grow with the tables;
    nothing is broadcast, and each task keeps its own best k before the rank. Both sides are cut so that about 24
    tasks or more get them in the fewest copies."""
    n, m = vectors.count(), queries.count()
    parts = max(1, -(-n // block), min(24, -(-n // 2048), round((24 * n / max(1, m)) ** 0.5)))
    groups = max(1, -(-m // asked), min(-(-24 // parts), -(-m // 2048)))
    each = lambda df, x, name: df.join(df.sparkSession.range(0, x, 1, 1).select(F.col("id").cast("int").alias(name)).hint("shuffle_replicate_nl"))
    own = lambda x: F.pmod(F.xxhash64("vec_id"), F.lit(x)).cast("int")
    q = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"), own(groups).alias("g"))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), own(parts).alias("h"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_cosines(left.select(["query_id", "q"]), right.select(["vec_id", "embedding"]), k)

    found = each(q, parts, "h").groupBy("g", "h").cogroup(each(v, groups, "g").groupBy("g", "h")).applyInArrow(compare, "query_id long, vec_id long, cosine double")
    best = W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
