"""Packing documents into token sequences of a fixed size, by bin completion.

Only how many pieces there are of each length matters for the number of sequences, so the search
runs on that histogram (at most `size` entries whatever the corpus holds) and yields patterns: so
many sequences, each filled by the same lengths at the same offsets. Spark then gives every piece
its rank among the pieces of its length, and the rank decides its sequence and offset."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Vocabulary, vocabulary_path
from .shared import read_table, saved, slices, utf8

SIZE = 2048
END_ID = 0
KEPT = 16  # open nodes of the search whose options stay in memory
STEPS = 500  # of the search for each node of its effort
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

# --------------------------------------------------------------------------- the plan

Bin = tuple[int, ...]  # lengths, largest first


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, Bin]]:
    """Best-fit decreasing on a histogram: (number of sequences, their lengths)."""
    rooms: dict[int, list[list]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:  # as many copies as one sequence holds, then the rest
                per = min(size // length, left)
                made = left // per
                rooms.setdefault(size - per * length, []).append([made, (length,) * per])
                left -= made * per
                continue
            group = rooms[room][-1]
            per = min(room // length, left)
            used = min(group[0], left // per)
            group[0] -= used
            if not group[0]:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            rooms.setdefault(room - per * length, []).append([used, group[1] + (length,) * per])
            left -= used * per
    return [(n, lengths) for groups in rooms.values() for n, lengths in groups if n]


class Spent(Exception):
    """The search has used up its effort."""


class Effort:
    """Steps left to a search. Every length looked at, filling drawn, option passed over or made again
    costs one, so that nothing in the search goes on uncounted."""

    def __init__(self, steps: int):
        self.left = steps

    def use(self, steps: int = 1) -> None:
        self.left -= steps
        if self.left < 0:
            raise Spent


def fillings(counts: list[int], room: int, largest: int, waste: int, longest_first: bool, effort: Effort) -> Iterator[tuple[int, Bin]]:
    """The undominated fillings of `room` beside `largest` that waste at most `waste`, as (waste,
    lengths), least waste first: multisets of the lengths that are left, of any number of items.

    A filling is dominated when one of its items, or two of them together, could be swapped for a
    longer (or single) item that is left and still fits. Lengths are chosen from the longest on, so
    whether a longer one is left is known when a shorter one is chosen, and dominated branches end
    there. sums[i] has a bit for each total that the i shortest lengths can make, so the walk never
    enters a branch without a filling."""
    kinds = [x for x in range(1, min(largest, room) + 1) if counts[x]]
    effort.use(1 + len(kinds))
    mask, made = (1 << (room + 1)) - 1, 1
    sums = [made]
    for x in kinds:
        many, step = min(counts[x], room // x), 1
        while many:  # copies in powers of two
            step = min(step, many)
            made |= (made << (step * x)) & mask
            many -= step
            step *= 2
        sums.append(made)

    def free(first: int, last: int, chosen: dict[int, int]) -> bool:
        """Whether a length from first to last is left."""
        for y in range(first, min(last, largest) + 1):
            effort.use()
            if counts[y] > chosen.get(y, 0):
                return True
        return False

    def dominated(x: int, n: int, chosen: dict[int, int], lost: int) -> bool:
        """Whether n more of x, shorter than all chosen, could be swapped, alone or with one of those."""
        return free(x + 1, x + lost, chosen) or n > 1 and free(2 * x, 2 * x + lost, chosen) or any(free(x + y, x + y + lost, chosen) for y in chosen)

    def walk(i: int, left: int, chosen: dict[int, int], lost: int) -> Iterator[Bin]:
        if not left:
            yield tuple(x for x, n in chosen.items() for _ in range(n))
            return
        for k in range(i, 0, -1) if longest_first else range(1, i + 1):
            effort.use()
            x = kinds[k - 1]
            most = min(counts[x], left // x)
            for n in range(most, 0, -1) if longest_first else range(1, most + 1):
                effort.use()
                if sums[k - 1] >> (left - n * x) & 1 and not (lost and dominated(x, n, chosen, lost)):
                    yield from walk(k - 1, left - n * x, {**chosen, x: n}, lost)

    for lost in range(min(waste, room) + 1):
        effort.use()
        if made >> (room - lost) & 1:
            for chosen in walk(len(kinds), room - lost, {}, lost):
                yield lost, chosen


def bin_completion(histogram: dict[int, int], size: int = SIZE, nodes: int = 4_000) -> list[tuple[int, Bin]]:
    """Patterns (number of sequences, lengths) that hold every piece of the histogram.

    Best-fit decreasing is the first incumbent. The depth-first search always completes the largest
    length left, takes a filling as often as the counts allow (and, after that, once), and leaves a
    branch whose waste rules out fewer sequences than the incumbent. It is exact when it ends by
    itself or at the bound ceil(total / size). `nodes` bounds the effort alone, at STEPS steps a node,
    half of it for fillings of long items first and half for short ones: a search cut short by it keeps
    the best packing found, which still holds every piece."""
    total = sum(k * v for k, v in histogram.items())
    if not total:
        return []
    bound = -(-total // size)
    best = best_fit({k: v for k, v in histogram.items() if v}, size)
    for longest_first in (True, False):
        if sum(n for n, _ in best) > bound:
            best = searched(histogram, size, best, longest_first, Effort(nodes // 2 * STEPS))
    return best


def searched(histogram: dict[int, int], size: int, best: list[tuple[int, Bin]], longest_first: bool, effort: Effort) -> list[tuple[int, Bin]]:
    """The best packing that a search with this effort finds, or else the incumbent `best`."""
    counts = [0] * (size + 1)
    for k, v in histogram.items():
        counts[k] = v
    total = sum(k * v for k, v in histogram.items())
    bound, best_n = -(-total // size), sum(n for n, _ in best)

    def spare() -> int:  # the waste that a packing better than the incumbent may have
        return (best_n - 1) * size - total

    def put(times: int, filled: Bin) -> None:
        for x in filled:
            counts[x] -= times

    def options(longest: int, wasted: int) -> Iterator[tuple[int, int, Bin]]:
        """(times, waste of one, lengths) for the sequences that hold the longest length left."""
        rest = list(counts)
        rest[longest] -= 1
        for waste, others in fillings(rest, size - longest, longest, spare() - wasted, longest_first, effort):
            filled = (longest, *others)
            times = min(counts[x] // filled.count(x) for x in set(filled))
            if waste:  # no oftener than the bound allows
                times = min(times, max(1, (spare() - wasted) // waste))
            yield times, waste, filled
            if times > 1:
                yield 1, waste, filled

    def resumed(longest: int, wasted: int, last: tuple | None) -> Iterator[tuple[int, int, Bin]]:
        """The options after `last`, which the node had tried before."""
        found = options(longest, wasted)
        for step in found if last else ():
            effort.use()
            if step[2] == last[2] and step[0] in (last[0], 1):
                break
        return found

    lost, used = 0, 0
    # an open node: its options, or None where they are made again on return, and how it was opened
    longest = max(k for k in range(size + 1) if counts[k])
    open_nodes = [[options(longest, 0), longest, 0, None]]
    taken: list[tuple[int, int, Bin]] = []  # the step below each open node that is being followed
    try:
        while open_nodes and best_n > bound:
            effort.use()
            if len(taken) == len(open_nodes):  # back from below
                times, waste, filled = taken.pop()
                put(-times, filled)
                lost, used = lost - times * waste, used - times
            node = open_nodes[-1]
            if node[0] is None:
                node[0] = resumed(node[1], node[2], node[3])
            step = next(node[0], None)
            if step is None:
                open_nodes.pop()
                continue
            times, waste, filled = node[3] = step
            if lost + times * waste > spare():  # the incumbent has become better since
                continue
            put(times, filled)
            taken.append(step)
            lost, used = lost + times * waste, used + times
            longest = next((k for k in range(filled[0], 0, -1) if counts[k]), 0)
            if longest:
                open_nodes.append([options(longest, lost), longest, lost, None])
                if len(open_nodes) > KEPT:  # the options of a node take up to half a megabyte
                    open_nodes[-KEPT - 1][0] = None
            elif used < best_n:  # all is packed, in fewer sequences
                best, best_n = [(n, x) for n, _, x in taken], used
    except Spent:
        pass
    return best


def placement(patterns: list[tuple[int, Bin]]) -> dict[str, np.ndarray]:
    """For each length the rank ranges of its pieces and where they go, sorted by (length, rank)."""
    rows, given, base = [], {}, 0
    for n, lengths in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            per = lengths.count(length)
            rank = given.get(length, 0)
            rows.append((length, rank, base, per, offset))
            given[length] = rank + n * per
            offset += per * length
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "base", "per", "offset"))}


# --------------------------------------------------------------------------- Spark


def token_pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each whole text and an end id, cut
    from the end into pieces of `size`, so that the first may be shorter. Null text is empty. The ids
    are those of the tokenizers library (bpe.Vocabulary), for texts of any kind and length."""
    path = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(path)
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            column = batch.column(1)
            _, offsets = utf8(column)
            for a, b in slices(offsets):
                ids, at = vocab.encode_texts([x or "" for x in column.slice(a, b - a).to_pylist()])
                n = np.diff(at)
                total = n + 1  # with the end id
                pieces = -(-total // size)
                owner = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = total - (pieces - 1) * size
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * size)
                length = np.where(piece == 0, first[owner], size)
                ended = np.insert(ids, at[1:], END_ID).astype("<u4")
                begin = (at[:-1] + np.arange(b - a))[owner] + start
                crc = [zlib.crc32(ended[x : x + y].tobytes()) for x, y in zip(begin.tolist(), length.tolist(), strict=True)]
                doc = batch.column(0).take(pa.array(owner + a))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def packed(pieces: DataFrame, size: int = SIZE, salts: int = 64, nodes: int = 4_000) -> DataFrame:
    """Add sequence_id and offset to written pieces (a table that reads the same each time).

    Ranks within a length are counted in `salts` parts, so a length that very many pieces share is
    not gathered in one task. The plan that goes to the tasks has at most a few rows for each of the
    `size` possible lengths. Pieces of a length are ranked in the order of a hash and sequences of one
    pattern are numbered far apart, so that every stretch of sequence numbers holds all lengths and
    sources in their shares: a mixture keeps its weights through the packing."""
    spark = pieces.sparkSession
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `size` rows
    patterns = bin_completion({r.length: r.n for r in lengths}, size, nodes)
    plan = placement(patterns)
    sequences = max(1, sum(n for n, _ in patterns))
    stride = next(k for k in range(int(sequences * 0.618) or 1, 2 * sequences + 1) if math.gcd(k, sequences) == 1)
    shared = spark.sparkContext.broadcast(plan)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    ranked = salted.withColumn("r", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece"))).join(firsts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("r") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        step = int(plan["rank"].max(initial=0)) + 1
        if step * (int(plan["length"].max(initial=0)) + 2) >= 2**62:
            raise ValueError("too many pieces for 64-bit keys")
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(plan["length"] * step + plan["rank"], length * step + np.minimum(rank, step - 1), side="right") - 1
            local = rank - plan["rank"][at]
            sequence = (plan["base"][at] + local // plan["per"][at]) * stride % sequences
            offset = plan["offset"][at] + local % plan["per"][at] * length
            columns = [*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PACKED.split(", ")])

    return ranked.mapInArrow(place, PACKED)


def pack_documents(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """Pack whole texts of docs (doc_id, text) into sequences of at most `size` tokens.

    Null and empty texts are one piece that holds the end id alone; repeated rows are packed each;
    an empty table packs into nothing; other columns are ignored."""
    return packed(saved(token_pieces(docs, size, vocabulary), "pieces"), size)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> one row per piece with its place."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
