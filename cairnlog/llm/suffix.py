"""Repeated byte strings across a corpus, by prefix-free parsing.

A rolling hash over every 64 bytes sets the triggers: in each string of `length` bytes the smallest
hash inside it is its trigger, so equal strings have the same trigger at the same place and no string
is without one. The strings that one trigger serves start next to each other; together they span one
phrase. The dictionary holds each distinct phrase once, with the number of its occurrences in the
parse: strings of a phrase that occurs twice are repeated without another look, which is what makes
highly repetitive text cheap.

The rest of the dictionary goes into suffix order in ranges of triggers: a task ranks the suffixes of
its phrases by prefix doubling on their bytes, up to `length` of them, and equal ranks are equal
strings. Phrases of one trigger stand in one range, and no string equals one of another trigger, so
the ranges together are the order of the corpus as far as it decides. As each phrase reaches `length`
bytes past its last string, what follows it in the parse never decides, and the parse needs no suffix
array of its own. Where bytes do not decide themselves, 128-bit BLAKE2b digests of them do."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import _BYTE, _power, drop_saved, mix, read_table, saved, slices, span_hashes, utf8

LENGTH = 200
TRIGGER = 64
SMALL = 512  # phrases of a trigger that one task compares; triggers with more are parsed again, finer
FINE = 16  # strings of a phrase in that second parse
MOST_ROWS = 1 << 16  # phrases in one batch of a parse
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The 128-bit BLAKE2b digest of each byte span data[start:end]."""
    view = memoryview(np.ascontiguousarray(data))
    return pa.array([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, width: int):
    """The phrases of the rows of data: row, first start, number of starts, trigger hash, and the place of
    the trigger after the first start, which follows from the phrase's bytes.

    A phrase holds all strings data[s:s + length] whose leftmost smallest `width`-byte hash is at
    the same place; its text is data[start : start + count - 1 + length]."""
    n, span = len(data), length - width + 1  # a string holds so many places for a trigger
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", n), out=sums[1:])
    rolling = mix((sums[width:] - sums[:-width]) * _power("down", n - width + 1))
    del sums
    # the hash's upper bits decide and then the place, for which 40 bits are enough for any text;
    # equal strings break ties alike
    bits = np.uint64(40)
    keys = (rolling >> bits << bits) | np.arange(len(rolling), dtype=np.uint64)
    padded = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts])
    anchor = (least & np.uint64((1 << 40) - 1)).astype(np.int64)
    # strings that reach past the end of their row do not count
    inside = np.ones(starts, bool)
    for end in offsets[1:]:
        inside[max(0, end - length + 1) : min(end, starts)] = False
    edge = inside.copy()
    edge[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(edge)
    if not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    # a run of starts ends before the next edge or the first start that does not count
    stop = np.r_[first[1:], starts]
    outside = np.flatnonzero(np.r_[~inside, True])
    stop = np.minimum(stop, outside[np.searchsorted(outside, first)])
    at = anchor[first]
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, first - offsets[row], stop - first, rolling[at], at - first


def _sliced(column: pa.Array):
    data, offsets = utf8(column)
    for a, b in slices(offsets, 2 << 20):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


PHRASES = "doc_id long, text_key long, start int, strings int, trigger long, phrase binary, at int"


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose texts take about 2 MB together, so that work arrays stay small."""
    for batch in batches:
        for a, b in slices(utf8(batch.column(column))[1], 2 << 20):
            yield batch.slice(a, b - a)


def corpus_phrases(docs: DataFrame, length: int, width: int) -> DataFrame:
    """The phrases of every text: docs has doc_id, text_key and text."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for a, _, data, offsets in _sliced(batch.column(2)):
                found = phrases(data, offsets, length, width)
                for k in range(0, len(found[0]), MOST_ROWS):
                    row, start, count, trigger, inside = (x[k : k + MOST_ROWS] for x in found)
                    at, begin = pa.array(row + a), start + offsets[row]
                    phrase = digests(data, begin, begin + count - 1 + length)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), keys.take(at), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(trigger.view(np.int64)), phrase, pa.array(inside.astype(np.int32))],
                        [x.split()[0] for x in PHRASES.split(", ")],
                    )

    return docs.mapInArrow(parse, PHRASES)


PIECES = "doc_id long, text_key long, start int, strings int, trigger long, phrase binary, n long, hot boolean, text binary, at int"
SPANS = "doc_id long, text_key long, a int, b int"


def same_row(left: DataFrame, right: DataFrame):
    return left.doc_id.eqNullSafe(right.doc_id) & (left.text_key == right.text_key)


def phrase_texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted with the bytes of each phrase. The places wanted in a document are gathered first and
    meet its text in one join."""
    places = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "strings", "trigger", "phrase", "n", "hot", "at")).alias("places"))
    met = docs.join(places, same_row(docs, places)).select(docs.doc_id, docs.text_key, "text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in _parts(batches, 2):
            data, offsets = utf8(batch.column(2))
            listed = batch.column(3)
            inner, counts = listed.flatten(), np.diff(listed.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), counts)
            start = inner.field("start").to_numpy() + offsets[row]
            stop = start + inner.field("strings").to_numpy() - 1 + length
            texts = [data[x:y].tobytes() for x, y in zip(start, stop, strict=True)]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(inner.field(k) for k in ("start", "strings", "trigger", "phrase", "n", "hot")), pa.array(texts, pa.binary()), inner.field("at")], names
            )

    return met.mapInArrow(cut, PIECES)


def string_ranks(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings text[s:s + length] in the order of their bytes, equal only for equal ones:
    the suffixes of the text by prefix doubling, from 8 bytes on (length is at least 8)."""
    n, size = len(text), 8
    wide = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | wide[k : k + n]
    ranks = np.unique(words, return_inverse=True)[1]
    while 2 * size <= length:
        after = np.r_[ranks[size:], np.zeros(min(size, n), np.int64)]  # strings end before the filling
        ranks = np.unique((ranks << 32) | after, return_inverse=True)[1]
        size *= 2
    return np.unique((ranks[starts] << 32) | ranks[starts + length - size], return_inverse=True)[1]


def compared(pieces: DataFrame, length: int, step: int = 4_000) -> DataFrame:
    """Spans of the repeated strings in phrases that occur once. The phrases of one trigger, at
    most SMALL, stand together in their partition; their strings are put in order, about `step`
    phrases at a time, and neighbours that are equal are repeated."""

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, offsets = utf8(batch.column(8))
        text, offsets = text[offsets[0] : offsets[-1]], offsets - offsets[0]
        counts = batch.column(3).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        keys = string_ranks(text, offsets[:-1][owner] + inside, length)
        order = np.argsort(keys, kind="stable")
        equal = keys[order][1:] == keys[order][:-1]
        repeated = np.zeros(len(keys), bool)
        repeated[order[1:][equal]] = True
        repeated[order[:-1][equal]] = True
        repeated &= (batch.column(6).to_numpy() == 1)[owner]
        start = inside + batch.column(2).to_numpy()[owner]
        new = np.r_[True, owner[1:] != owner[:-1]]
        heads = np.flatnonzero(repeated & (new | ~np.r_[False, repeated[:-1]]))
        tails = np.flatnonzero(repeated & (np.r_[new[1:], True] | ~np.r_[repeated[1:], False]))
        at = pa.array(owner[heads])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(start[heads].astype(np.int32)), pa.array((start[tails] + length).astype(np.int32))], ["doc_id", "text_key", "a", "b"]
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks()
            batch = table.to_batches()[0] if table.num_rows else None
            if batch is None:
                continue
            trigger = batch.column(4).to_numpy()
            last = int(np.searchsorted(trigger, trigger[-1]))  # the last group may go on
            held, at = batch.slice(last), 0
            while at < last:  # whole groups, about `step` phrases of them
                end = last if last - at <= step else max(int(np.searchsorted(trigger, trigger[at + step])), int(np.searchsorted(trigger, trigger[at], side="right")))
                yield spans(batch.slice(at, end - at))
                at = end
        if held is not None:
            yield spans(held)

    return pieces.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(compare, SPANS)


def compared_hot(pieces: DataFrame, length: int) -> DataFrame:
    """The same for triggers with more phrases than a task should hold: one row for each string,
    with its digest, counted by Spark."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                text, offsets = utf8(part.column(8))
                counts = part.column(3).to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(counts)), counts)
                inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                begin = offsets[:-1][owner] + inside
                start, at = inside + part.column(2).to_numpy()[owner], pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(part.column(6).to_numpy()[owner] == 1), digests(text, begin, begin + length)],
                    ["doc_id", "text_key", "a", "single", "string"],
                )

    rows = saved(pieces.mapInArrow(explode, "doc_id long, text_key long, a int, single boolean, string binary"), "pfp-strings")
    again = saved(rows.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string"), "pfp-again")
    return rows.where("single").join(again, "string").select("doc_id", "text_key", "a", (F.col("a") + length).alias("b"))


def refined(pieces: DataFrame, length: int) -> DataFrame:
    """Spans for triggers with very many phrases, by a second dictionary: each phrase is cut into
    parts of up to FINE strings, aligned with the trigger. All strings of a part share its core (the
    bytes that each of them holds), so parts meet only where trigger, alignment and core are equal."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                text, offsets = utf8(part.column(8))
                counts, at = (part.column(c).to_numpy().astype(np.int64) for c in (3, 9))
                owner = np.repeat(np.arange(len(counts)), counts)
                inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                group = (at[owner] - inside) // FINE  # of each string: its distance to the trigger
                head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (group[1:] != group[:-1])])
                size = np.diff(np.r_[head, len(owner)])
                own, first = owner[head], inside[head]
                lo, anchor = offsets[own] + first, offsets[own] + at[own]
                # the core of the aligned part, whether or not the phrase has all its strings
                core_from, core_to = anchor - group[head] * FINE, anchor - group[head] * FINE - (FINE - 1) + length
                base = int(offsets[0])
                data = text[base : int(offsets[-1])]
                trigger = part.column(4).to_numpy().view(np.uint64)[own]
                core = span_hashes(data, core_from - base, core_to - base)
                key = mix(core ^ mix(trigger + group[head].astype(np.uint64)))
                whole = digests(data, lo - base, lo - base + size - 1 + length)
                rows = pa.array(own)
                texts = [text[x : x + y - 1 + length].tobytes() for x, y in zip(lo, size, strict=True)]
                start = part.column(2).to_numpy()[own] + first
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(key.view(np.int64)), whole, part.column(6).take(rows), part.column(7).take(rows), pa.array(texts, pa.binary()), pa.array((anchor - lo).astype(np.int32))],
                    names,
                )

    parts = saved(pieces.mapInArrow(cut, PIECES), "pfp-parts")
    place = F.struct("doc_id", "text_key", "start", "strings", "text", "at")
    dictionary = saved(parts.groupBy("trigger", "phrase").agg(F.sum("n").alias("n"), F.min(place).alias("w")), "pfp-part-dictionary")
    keys = dictionary.groupBy("trigger").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1")
    left = dictionary.join(keys.select("trigger", (F.col("c") > SMALL).alias("hot")), "trigger")
    left = saved(left.select("w.doc_id", "w.text_key", "w.start", "w.strings", "trigger", "phrase", "n", "hot", "w.text", "w.at"), "pfp-part-pieces")
    twice = saved(dictionary.where("n > 1").select("trigger", "phrase"), "pfp-part-twice")
    whole = parts.where("n = 1").join(twice, ["trigger", "phrase"]).select("doc_id", "text_key", F.col("start").alias("a"), (F.col("start") + F.col("strings") - 1 + length).alias("b"))
    return whole.union(compared(left.where("not hot"), length)).union(compared_hot(left.where("hot"), length))


def repeated_spans(docs: DataFrame, length: int = LENGTH, width: int = TRIGGER) -> DataFrame:
    """(doc_id, text_key, a, b): byte spans covered by strings of `length` bytes that start at
    another place too. docs has doc_id, text_key and text. Spans may overlap."""
    parse = saved(corpus_phrases(docs, length, width), "pfp-parse")
    shared = saved(parse.groupBy("trigger").agg(F.count("*").alias("n")).where("n > 1").select("trigger"), "pfp-triggers")
    again = saved(parse.join(shared, "trigger"), "pfp-again")
    drop_saved(parse, shared)
    place = F.struct("doc_id", "text_key", "start", "strings", "at")
    dictionary = saved(again.groupBy("trigger", "phrase").agg(F.count("*").alias("n"), F.min(place).alias("w")), "pfp-dictionary")
    open_triggers = saved(
        dictionary.groupBy("trigger").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("trigger", (F.col("c") > SMALL).alias("hot")), "pfp-open"
    )
    wanted = dictionary.join(open_triggers, "trigger").select("w.doc_id", "w.text_key", "w.start", "w.strings", "w.at", "trigger", "phrase", "n", "hot")
    pieces = saved(phrase_texts(docs, wanted, length), "pfp-pieces")
    twice = saved(dictionary.where("n > 1").select("trigger", "phrase"), "pfp-twice")
    whole = again.join(twice, ["trigger", "phrase"]).select("doc_id", "text_key", F.col("start").alias("a"), (F.col("start") + F.col("strings") - 1 + length).alias("b"))
    return whole.union(compared(pieces.where("not hot"), length)).union(refined(pieces.where("hot"), length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, width: int = TRIGGER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes for each row of docs
    (doc_id, text): every byte that lies in a string of `length` bytes which also starts elsewhere,
    in the same text or another, goes. Null text is empty; a repeated row is a second place, and so
    are texts that repeat under one id or without one; texts shorter than a string keep all bytes; an
    empty table gives no rows; a text is one task's work, whose arrays take about 64 bytes for each of
    its bytes; other columns are ignored; ties need no rule, as all places of a string are alike."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # spans that touch are joined before those of a row are gathered: a text of one letter has one for every byte
    own = W.partitionBy("doc_id", "text_key").orderBy("a", "b")
    found = repeated_spans(keyed, length, width).withColumn("reach", F.max("b").over(own.rowsBetween(W.unboundedPreceding, -1)))
    begins = F.when(F.col("reach") >= F.col("a"), 0).otherwise(1)
    found = found.withColumn("run", F.sum(begins).over(own.rowsBetween(W.unboundedPreceding, 0))).groupBy("doc_id", "text_key", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    met = keyed.join(spans, same_row(keyed, spans), "left").select(keyed.doc_id, "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 1):
            data, offsets = utf8(batch.column(1))  # the whole batch's bytes, of which the part has offsets
            listed = batch.column(2)
            inner = listed.flatten()
            counts = np.asarray(listed.value_lengths().fill_null(0))
            row = np.repeat(np.arange(batch.num_rows), counts)
            base = int(offsets[0])
            a = inner.field("a").to_numpy() + offsets[row] - base
            b = inner.field("b").to_numpy() + offsets[row] - base
            size = int(offsets[-1]) - base
            depth = np.zeros(size + 1, np.int32)
            np.add.at(depth, a, 1)
            np.add.at(depth, b, -1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.zeros(size + 1, bool)
            edge[offsets - base] = True
            first = gone & (edge[:-1] | ~np.r_[False, gone[:-1]])[: len(gone)] if size else gone
            total, firsts = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(first)]
            lo, hi = offsets[:-1] - base, offsets[1:] - base
            kept = [data[base + x : base + y][~gone[x:y]].tobytes() for x, y in zip(lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hi - lo), pa.array(total[hi] - total[lo]), pa.array(firsts[hi] - firsts[lo]), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return met.mapInArrow(cut, RESULT + ", kept binary")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the bytes covered by 200-byte strings that occur more than once."""
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op4_suffix": op4_suffix}
ORACLE_SQL: dict[str, str] = {}
