"""Toxicity scores from a convolutional text classifier, trained in numpy within Spark's tasks.

Words are hashed into buckets; a bucket that occurs in enough training documents has an embedding,
all others share the zero vector. Filters of several widths slide over the embedded words of the
whole text, each keeps its largest response, and a logistic unit turns the responses into a score.
All labelled documents teach: they are dealt into shards, each of which a task goes through, and the
parameters of the shards are averaged after every round.
Scoring needs the text alone; the language only chooses the threshold of the `flagged` column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import _BYTE, drop_saved, read_table, saved, slices, span_hashes, utf8

BUCKETS = 1 << 22
WIDTHS = (1, 2, 3)
FILTERS = 16
DIM = 16
SHARD_WORDS = 4_000_000  # words of a shard's documents, about; there is one shard where all have no more
EPOCHS = 6  # over the documents where there is one shard, at least
ROUNDS = 3  # in which several shards go through their documents, once in each, at least
STEPS = 300  # of training within a shard, at least
LEAST_DOCS = 3  # documents that a bucket with an embedding occurs in, at least
VOCABULARY = 1 << 18  # and a share of all occurrences of one in so many, which bounds the embedding
CHUNK = 100_000  # words whose responses are held at once
BLOCK = 4096  # rows of the embedding that are averaged together
PLACES = 1 << 25  # bits at most of the map of ids that may teach
CALIBRATE = 20  # documents of each class that a language's threshold is set from, at least
BINS = 256  # of a unit of the logit, in which scores are counted for the thresholds

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def bucketed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words (runs of letters, digits and non-ASCII bytes, A-Z folded), and the
    number of words before each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD_BYTE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    hashes = span_hashes(data, starts, ends, _FOLDED) if len(starts) else np.zeros(0, np.uint64)
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(starts, offsets)


class Model:
    """rows: bucket -> embedding row (0: none). The tables hold, for each filter and place in its
    window, the response to every embedding row, so that a convolution is a sum of lookups."""

    def __init__(self, rows: np.ndarray, embedding: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, weights: np.ndarray, offset: float):
        self.rows, self.bias, self.weights, self.offset = rows, bias, weights, offset
        self.tables = np.concatenate([(embedding @ f[j]).astype(np.float32) for f in filters for j in range(len(f))], axis=1)
        self.tables[0] = 0

    @classmethod
    def of(cls, state: dict) -> Model:
        """A model from another's __dict__, which holds only arrays and numbers."""
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    def pooled(self, words: np.ndarray, before: np.ndarray, chunk: int = 100_000) -> np.ndarray:
        """Largest response of each filter in each text, at least 0; chunk bounds the memory, and
        windows reach over its edge, so that results do not depend on it."""
        n, pad = len(before) - 1, max(WIDTHS) - 1
        sizes = np.diff(before)
        flat = np.zeros(len(words) + pad * n + pad, np.int64)  # zeros between texts
        owner = np.repeat(np.arange(n), sizes)
        place = np.arange(len(words)) + pad * owner
        flat[place] = self.rows[words]
        out = np.zeros((n, len(self.bias)), np.float32)
        for a in range(0, len(words), chunk):
            at = place[a : a + chunk]
            who = owner[a : a + chunk]
            x = self.tables[flat[at[0] : at[-1] + pad + 1]]
            local = at - at[0]
            heads = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            column = 0
            for k, w in enumerate(WIDTHS):
                y = sum(x[j : len(x) - pad + j, column + j * FILTERS : column + (j + 1) * FILTERS] for j in range(w))
                best = np.maximum.reduceat(y[local] if len(local) != len(y) else y, heads, axis=0)
                s = slice(k * FILTERS, (k + 1) * FILTERS)
                out[who[heads], s] = np.maximum(out[who[heads], s], best + self.bias[s])
                column += w * FILTERS
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words, before = bucketed(data, offsets)
        return 1 / (1 + np.exp(-(self.pooled(words, before).astype(np.float64) @ self.weights + self.offset)))


def loss_and_gradients(p: dict[str, np.ndarray], ids: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, keep: np.ndarray):
    """The weighted log loss of a batch of texts (embedding rows), the gradients of all parameters but
    the embedding, and the rows of the embedding that have one with theirs. Pooling passes a gradient
    to the one window that gave the largest response; `keep` scales the responses (dropout)."""
    pad, total = max(WIDTHS) - 1, FILTERS * len(WIDTHS)
    # words without an embedding give no gradient of their own but keep their places
    flat = np.concatenate([np.r_[x, np.zeros(pad, np.int64)] for x in ids])
    ends = np.cumsum([len(x) + pad for x in ids])
    heads = np.r_[0, ends[:-1]]
    padded = np.r_[flat, np.zeros(pad, np.int64)]
    pooled, where = np.full((len(ids), total), -np.inf), np.zeros((len(ids), total), np.int64)
    for at in range(0, len(flat), CHUNK):
        size = min(CHUNK, len(flat) - at)
        x = p["e"][padded[at : at + size + pad]]
        texts = range(int(np.searchsorted(ends, at, side="right")), int(np.searchsorted(heads, at + size)))
        for k, w in enumerate(WIDTHS):
            y = sum(x[j : j + size] @ p[f"f{w}"][j] for j in range(w))
            s = slice(k * FILTERS, (k + 1) * FILTERS)
            for i in texts:
                a, b = max(heads[i] - at, 0), min(ends[i] - at, size)
                place = a + y[a:b].argmax(0)
                best = y[place, np.arange(FILTERS)]
                more = best > pooled[i, s]
                where[i, s], pooled[i, s] = np.where(more, at + place, where[i, s]), np.where(more, best, pooled[i, s])
    z = pooled + p["b"]
    active = z > 0
    h = np.where(active, z, 0) * keep
    score = 1 / (1 + np.exp(-np.clip(h @ p["w"] + p["o"], -30, 30)))
    loss = -(cost * (labels * np.log(score) + (1 - labels) * np.log(1 - score))).sum() / len(ids)
    delta = (score - labels) * cost / len(ids)
    dz = delta[:, None] * p["w"] * keep * active
    g = {"w": h.T @ delta, "o": np.array([delta.sum()]), "b": dz.sum(0), **{f"f{w}": np.zeros_like(p[f"f{w}"]) for w in WIDTHS}}
    touched, moved = [], []
    for k, w in enumerate(WIDTHS):
        s = slice(k * FILTERS, (k + 1) * FILTERS)
        d, place = dz[:, s], where[:, s]
        for j in range(w):
            g[f"f{w}"][j] = np.einsum("bf,bfd->df", d, p["e"][padded[place + j]])
            touched.append(padded[place + j].ravel())
            moved.append((d[:, :, None] * p[f"f{w}"][j].T[None]).reshape(-1, DIM))
    hit, back = np.unique(np.concatenate(touched), return_inverse=True)
    ge = np.zeros((len(hit), DIM))
    np.add.at(ge, back, np.concatenate(moved))
    return loss, g, hit, ge


def first_parameters(buckets: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters before any training, with embeddings for so many buckets and the zero vector."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    p = {
        "e": rng.normal(0, 0.1, (buckets + 1, DIM)),
        **{f"f{w}": rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS},
        "b": np.zeros(total),
        "w": rng.normal(0, 0.1, total),
        "o": np.zeros(1),
    }
    p["e"][0] = 0
    return p


def train(p: dict[str, np.ndarray], ids: list[np.ndarray], labels: np.ndarray, positive: float, epochs: range, of: int, seed: tuple = (7,), rate: float = 0.02) -> np.ndarray:
    """Fit the parameters p, in place, to texts (arrays of embedding rows) by Adam on log loss, classes
    weighted evenly by the share `positive`: these epochs `of` all, over which the rate falls. Returns how
    many steps moved each row of the embedding."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    cost = np.where(labels == 1, 0.5 / max(positive, 1e-9), 0.5 / max(1 - positive, 1e-9))
    size_of_batch, moves = batch_size(len(ids)), np.zeros(len(p["e"]), np.int64)
    for epoch in epochs:
        order, at = rng.permutation(len(ids)), 0
        while at < len(order):
            end, size = at, 0
            while end < len(order) and end - at < size_of_batch and (end == at or size + len(ids[order[end]]) < 60_000):
                size += len(ids[order[end]])
                end += 1
            batch, at = order[at:end], end
            keep = (rng.random((len(batch), total)) < 0.8) / 0.8  # dropout
            _, g, hit, ge = loss_and_gradients(p, [ids[i].astype(np.int64) for i in batch], labels[batch], cost[batch], keep)
            g["w"] += 1e-4 * p["w"]
            t += 1
            moves[hit] += 1
            for k in [*g, "e"]:
                at_rows = hit if k == "e" else slice(None)
                grad = ge if k == "e" else g[k]
                m[k][at_rows] = 0.9 * m[k][at_rows] + 0.1 * grad
                v[k][at_rows] = 0.99 * v[k][at_rows] + 0.01 * grad**2
                p[k][at_rows] -= rate * (1 - epoch / of) * (m[k][at_rows] / (1 - 0.9**t)) / (np.sqrt(v[k][at_rows] / (1 - 0.99**t)) + 1e-6)
            p["e"][0] = 0
    return moves


def batch_size(texts: int) -> int:
    return 64 if texts >= 2000 else 16


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 5, is 0: such rows never teach the model."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def mapped(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with an id in known (doc_id) and a few of the others: those whose hash has its bit set in a map of
    the ids known, which is bounded and goes to every task, so that other texts need not be shuffled."""
    n = known.count()
    bits = min(PLACES, max(64, 1 << (8 * n).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    own = known.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    marks = own.groupBy("word").agg(F.bit_or("bit").alias("marks"))
    met = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(marks), "word")
    return met.where(F.call_function("shiftrightunsigned", F.col("marks"), F.col("bit")).bitwiseAND(F.lit(1).cast("long")) == 1).select(*rows.columns)


def training_rows(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """All labelled documents that may teach, whole: (toxic, lang, words as bytes of int32 buckets, doc_id).
    An id with two labels counts as toxic; rows that repeat an id teach each. With `most`, only so many
    ids of each class, in the order of a hash, for trials of the method."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out())
    if most is not None:
        known = known.where(F.col("toxic") == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).union(known.where(F.col("toxic") == 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(~held_out())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            words = []
            for a, b in slices(offsets):
                ids, before = bucketed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                words += [ids[before[i] : before[i + 1]].astype(np.int32).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(words, pa.binary()), batch.column(3)], ["toxic", "lang", "words", "doc_id"])

    # the same join at every size
    return mapped(rows, known).join(known.hint("merge"), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "lang", "doc_id").mapInArrow(hashed, "toxic int, lang string, words binary, doc_id long")


def training_sample(docs: DataFrame, labels: DataFrame, most: int | None = None, most_words: int = 20_000_000) -> list:
    """training_rows() of each class in the order of a hash of the id, as long as they have no more than
    `most_words` words together. Only for looking at what teaches: no model is fitted on it."""
    upto = F.sum(F.octet_length("words") / 4).over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "words").rowsBetween(W.unboundedPreceding, 0))
    return training_rows(docs, labels, most).withColumn("upto", upto).where(F.col("upto") <= most_words).drop("upto").collect()


def _integers(column: pa.Array) -> list[np.ndarray]:
    """The int32 arrays that a binary column holds."""
    data, offsets = utf8(column)
    return [data[a:b].view(np.int32) if b > a else np.zeros(0, np.int32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n): in how many of the rows' texts each bucket occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.unique(x) for x in _integers(batch.column(0))]
            buckets, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(n.astype(np.int64))], ["bucket", "n"])

    return rows.select("words").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def sharded(rows: DataFrame, known: np.ndarray, shards: int) -> DataFrame:
    """(shard, toxic, ids): rows' words as rows of the embedding (bytes of int32), each shard's together
    and in order."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.zeros(BUCKETS, np.int32)
        places[shared.value] = np.arange(1, len(shared.value) + 1)
        for batch in batches:
            ids = [places[x].tobytes() for x in _integers(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.binary()), batch.column(3)], ["shard", "toxic", "ids", "doc_id"])

    # by the words too, so that rows that repeat an id do not meet in one shard
    shard = F.pmod(F.xxhash64("doc_id", "words"), F.lit(shards)).cast("int")
    numbered = rows.select(shard.alias("shard"), "toxic", "words", "doc_id").mapInArrow(number, "shard int, toxic int, ids binary, doc_id long")
    return numbered.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids").select("shard", "toxic", "ids")


MOVED = "block int, shard int, rows binary, weights binary, data binary"


def trained(shards: DataFrame, p: dict[str, np.ndarray], positive: float, epochs: range, of: int) -> dict[str, np.ndarray]:
    """The parameters after these epochs within each shard, averaged: a row of the embedding over the shards
    that moved it, by their steps, all others over the shards by their texts. Averages are taken in
    blocks by Spark, so that the driver gets parameters once, however many shards there are; rows of the
    embedding travel as 32-bit floats."""
    names = [k for k in p if k != "e"]
    shared = shards.sparkSession.sparkContext.broadcast(p)
    kind = lambda block: np.float32 if block >= 0 else np.float64

    def learn(shard: int, ids: list[np.ndarray], labels: list[int]) -> Iterator[pa.RecordBatch]:
        own = {k: x.copy() for k, x in shared.value.items()}
        moves = train(own, ids, np.array(labels, np.float64), positive, epochs, of, seed=(7, shard, epochs[0]))
        dense = np.concatenate([own[k].ravel() for k in names])
        out = [(-1, np.zeros(1, np.int64), np.array([len(ids)]), dense)]
        hit = np.flatnonzero(moves)
        for block in np.unique(hit // BLOCK):
            rows = hit[hit // BLOCK == block]
            out.append((int(block), rows, moves[rows], own["e"][rows]))
        for block, rows, weights, data in out:
            yield pa.RecordBatch.from_pylist([{"block": block, "shard": shard, "rows": rows.astype(np.int32).tobytes(), "weights": weights.astype(np.int32).tobytes(), "data": data.astype(kind(block)).tobytes()}], arrow)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, labels = None, [], []
        for batch in batches:
            for shard, toxic, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _integers(batch.column(2)), strict=True):
                if shard != now:
                    if ids:
                        yield from learn(now, ids, labels)
                    now, ids, labels = shard, [], []
                ids.append(x.copy())
                labels.append(toxic)
        if ids:
            yield from learn(now, ids, labels)

    def averaged(parts: pa.Table) -> pa.Table:
        block, found = parts.column("block")[0].as_py(), sorted(parts.to_pylist(), key=lambda r: r["shard"])  # sums of floats depend on the order
        base, total = max(block, 0) * BLOCK, None
        weight = np.zeros(BLOCK if block >= 0 else 1)
        for part in found:
            rows, weights = (np.frombuffer(part[k], np.int32) for k in ("rows", "weights"))
            data = np.frombuffer(part["data"], kind(block)).reshape(len(rows), -1)
            total = np.zeros((len(weight), data.shape[1])) if total is None else total
            total[rows - base] += weights[:, None] * data
            weight[rows - base] += weights
        held = np.flatnonzero(weight)
        rows, mean = held + base, total[held] / weight[held, None]
        return pa.Table.from_pylist([{"block": block, "shard": 0, "rows": rows.astype(np.int32).tobytes(), "weights": b"", "data": mean.astype(kind(block)).tobytes()}], arrow)

    arrow = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("rows", pa.binary()), ("weights", pa.binary()), ("data", pa.binary())])
    found = shards.mapInArrow(each, MOVED).groupBy("block").applyInArrow(averaged, MOVED).collect()
    p = {k: x.copy() for k, x in p.items()}
    for r in found:
        data = np.frombuffer(r.data, kind(r.block))
        if r.block >= 0:
            p["e"][np.frombuffer(r.rows, np.int32)] = data.reshape(-1, DIM)
            continue
        for k in names:
            p[k], data = data[: p[k].size].reshape(p[k].shape).copy(), data[p[k].size :]
    shared.destroy()
    return p


def language_thresholds(back: DataFrame, model: Model) -> dict[str, float]:
    """For each language, from training rows that did not teach, the middle of the widest gap in scores at
    which balanced accuracy is best. All rows count; scores are counted in narrow bins, and gaps lie
    between these. A language with fewer than CALIBRATE such rows of either class keeps 0.5."""
    shared = back.sparkSession.sparkContext.broadcast(model.__dict__)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value)
        for batch in batches:
            z = [np.zeros(0)]
            for x in _integers(batch.column(2)):
                z.append(model.pooled(x.astype(np.int64), np.array([0, len(x)])).astype(np.float64) @ model.weights + model.offset)
            z = np.concatenate(z)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.floor(z * BINS).astype(np.int64)), pa.array(1 / (1 + np.exp(-z)))], ["toxic", "lang", "bin", "score"])

    bins = back.where("lang is not null").select("toxic", "lang", "words").mapInArrow(place, "toxic int, lang string, bin long, score double")
    bins = bins.groupBy("lang", "bin").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"), F.min("score").alias("low"), F.max("score").alias("high"))

    def widest(pdf):
        pdf = pdf.sort_values("bin")
        bad, good = pdf.bad.to_numpy(np.float64), pdf.good.to_numpy(np.float64)
        if len(pdf) < 2 or min(bad.sum(), good.sum()) < CALIBRATE:
            return pdf[["lang"]].head(0).assign(threshold=np.zeros(0))
        low, high = pdf.low.to_numpy(), pdf.high.to_numpy()
        right = 1 - np.cumsum(bad)[:-1] / bad.sum() + np.cumsum(good)[:-1] / good.sum()
        best = np.flatnonzero(right >= right.max() - 1e-12)
        k = best[np.argmax((low[1:] - high[:-1])[best])]
        return pdf[["lang"]].head(1).assign(threshold=(low[k + 1] + high[k]) / 2)

    return {r.lang: r.threshold for r in bins.groupBy("lang").applyInPandas(widest, "lang string, threshold double").collect()}


def fitted(docs: DataFrame, labels: DataFrame, most: int | None = None) -> tuple[Model, dict[str, float]]:
    """The model and a threshold for each language, from all labelled documents that may teach. One of five
    of them is kept back to set the thresholds, all others train; where so few are of a class that a fifth
    sets none, all train. The vocabulary, the model and the
    thresholds come to the driver, no rows."""
    rows = saved(training_rows(docs, labels, most), "toxicity-words")
    sums = F.count("*").alias("n"), F.sum("toxic").alias("bad"), F.sum(F.octet_length("words") / 4).alias("words")
    facts, kept_back = rows.agg(*sums).first(), F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4
    teach, back = rows, rows.limit(0)
    if facts.n and min(facts.bad, facts.n - facts.bad) >= 5 * CALIBRATE:
        teach, back = rows.where(~kept_back), rows.where(kept_back)
        facts = teach.agg(*sums).first()
    if not facts.n or facts.bad in (0, facts.n):  # nothing to tell apart
        p = first_parameters(0)
        return Model(np.zeros(BUCKETS, np.int32), p["e"], [p[f"f{w}"] for w in WIDTHS], p["b"].astype(np.float32), p["w"], 0.0), {}
    counts = saved(bucket_counts(teach), "toxicity-counts")
    least = max(LEAST_DOCS, -(-counts.agg(F.sum("n")).first()[0] // VOCABULARY) if facts.words else 0)
    known = np.sort(counts.where(F.col("n") >= least).select("bucket").toPandas().bucket.to_numpy(np.int64))  # at most VOCABULARY
    number = max(1, int(-(-facts.words // SHARD_WORDS)))
    shards, p = saved(sharded(teach, known, number), "toxicity-shards"), first_parameters(len(known))
    # few texts are gone through more often, in smaller batches
    own = -(-facts.n // number)
    epochs = max(ROUNDS if number > 1 else EPOCHS, -(-STEPS * batch_size(own) // own))
    for e in [range(k, k + 1) for k in range(epochs)] if number > 1 else [range(epochs)]:
        p = trained(shards, p, facts.bad / facts.n, e, epochs)
    places = np.zeros(BUCKETS, np.int32)
    places[known] = np.arange(1, len(known) + 1)
    model = Model(places, p["e"], [p[f"f{w}"] for w in WIDTHS], p["b"].astype(np.float32), p["w"], float(p["o"][0]))
    thresholds = language_thresholds(back, model)
    drop_saved(rows, counts, shards)
    return model, thresholds


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a score column (0 to 1) from each whole text; null text scores as the empty one. An
    earlier column of that name is replaced; all others pass through."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model.__dict__)
    position = docs.columns.index("text")
    names = [*docs.columns, "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value)
        for batch in batches:
            data, offsets = utf8(batch.column(position))
            out = [np.zeros(0)]
            for a, b in slices(offsets):
                out.append(model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names)

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(score, schema)


def threshold_of(thresholds: dict[str, float], lang="lang"):
    """The threshold column: by language where one was calibrated, else 0.5."""
    column = F.lit(0.5)
    for name, value in sorted(thresholds.items()):
        column = F.when(F.col(lang) == name, F.lit(value)).otherwise(column)
    return column


def toxicity(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), and flagged: the score reaches the
    threshold of the document's language. Null and empty texts get the score of no words; without
    usable labels of both classes the score is near 0.5 for all; repeated rows are scored each, and
    alike; texts of any length are read whole; an empty table gives no rows; other columns are ignored."""
    model, thresholds = fitted(docs, labels, most)
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), model)
    return rows.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") >= threshold_of(thresholds)).alias("flagged"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents scored by a model learned from labels.toxic."""
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = {}
