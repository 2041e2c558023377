"""MinHash near-duplicates by a chosen-path set similarity join.

A document's shingle set is embedded as minwise tokens, one for each of many hash functions. Trees
branch documents by some of these tokens: every node chooses the same coordinates for all documents
in it, none twice on a path, and a child holds those that agree there. Nodes that became small are
compared exhaustively; larger ones are linked through a pivot and branch on while they hold documents
that no link connects yet: over the cluster while a node is too large for a task, within the task from
then on. A path that has used up its coordinates ends in an exhaustive comparison, in pairs of blocks
over many tasks. Of the pairs that a task finds, spanning forests of the components they join are confirmed
first; the rest is looked at again only where these links leave its ends apart. Independent trees raise
the recall; every link is confirmed on the full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, drop_saved, mix, read_table, saved, slices, utf8, word_hashes

WORDS = 5
SIMILARITY = 75  # hundredths
TOKENS = 64  # minwise tokens of a document
TREES = 8
BRANCHES = (2, 2)  # children per node below the root's TREES children
SMALL = 256  # documents of a node that are compared exhaustively
TASK = 8192  # documents of a node that one task branches further; larger nodes branch over the cluster
LEVELS = 2  # levels that nodes larger than TASK branch at once
DEEPEST = 40  # depth at which nodes still larger than TASK are compared exhaustively, in pairs of blocks
BOTTOM = 256  # least shingle hashes kept of a set: a set of no more is kept whole
LIKELY = 34  # agreeing tokens below which a pair is not looked up: 4 deviations under 0.75 * TOKENS
FORESTS = 4  # times as many spanning forests of likely pairs are confirmed in each further look at a node
ALL = 256  # forests from which on all pairs are
BROADCAST_ROWS = 100_000  # documents (two longs each) that may go to every task
SKETCH = "doc_id long, row_key long, n_shingles long, set_a long, set_b long, tokens binary, bottom binary"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of the word shingles of each row; fewer words make one shingle."""
    hashes, before = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        if len(hashes) >= words:
            sums = hashes[: len(hashes) - words + 1].copy()
            for k in range(1, words):
                sums += np.roll(mix(hashes + np.uint64(k) * _GOLDEN), -k)[: len(sums)]
            sums = mix(sums)
        else:
            sums = np.zeros(0, np.uint64)
        out = []
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(sums[a : b - words + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for x in hashes[a:b]:
                    whole = mix(np.array([whole * _GOLDEN + x]))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


_FACTORS = np.random.default_rng(1).integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = np.random.default_rng(2).integers(0, 2**63, TOKENS, dtype=np.uint64)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """For each set and hash function the least hash's low 32 bits after mixing; empty sets get 0."""
    sizes = np.array([len(x) for x in sets])
    out = np.zeros((len(sets), TOKENS), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        heads = np.cumsum(sizes[full]) - sizes[full]
        folded = mix(flat)
        for k in range(TOKENS):
            least = np.minimum.reduceat((folded ^ _TERMS[k]) * _FACTORS[k], heads)
            out[full, k] = (least >> np.uint64(32)).astype(np.uint32)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, set size, two independent sums that name the set, and its minwise tokens."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in slices(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                with np.errstate(over="ignore"):
                    one = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
                    two = np.array([mix(s ^ _GOLDEN).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
                tokens = minwise(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([x.tobytes() for x in tokens], pa.binary()), pa.array([(x[:BOTTOM] >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets], pa.binary())],
                    [x.split()[0] for x in SKETCH.split(", ")],
                )

    return docs.mapInArrow(sketch, SKETCH)


def _unused(used: np.ndarray, wish: np.ndarray) -> np.ndarray:
    """The first coordinate from `wish` on (cyclically) whose bit in `used` is not set."""
    pick = wish % np.uint64(TOKENS)
    while (taken := (used >> pick) & np.uint64(1)).any():
        pick = (pick + taken) % np.uint64(TOKENS)
    return pick


def _branch(nodes: np.ndarray, used: np.ndarray, tokens: np.ndarray, children: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The children of each (node, document): node hashes, coordinates used (bits) and the rows they
    come from. Which coordinate a child looks at depends on the node alone; none comes twice."""
    rows = np.tile(np.arange(len(nodes)), children)
    used = used[rows]
    salt = np.repeat(np.arange(1, children + 1, dtype=np.uint64), len(nodes))
    pick = _unused(used, mix(nodes[rows] + salt * _GOLDEN))
    token = tokens[rows, pick.astype(np.int64)].astype(np.uint64)
    found = mix(mix(nodes[rows] + salt) ^ mix(token + (pick + np.uint64(1)) * _GOLDEN))
    return found, used | (np.uint64(1) << pick), rows


def _second_child(nodes: np.ndarray) -> np.ndarray:
    """Whether a node has a second child: one of three has, so that of a pair at the similarity 0.75
    one child is expected to hold both, and of less similar pairs fewer."""
    return mix(nodes + np.uint64(7)) % np.uint64(3) == 0


NODES = "node long, used long, rep long"


def first_nodes(classes: DataFrame) -> DataFrame:
    """NODES for all trees at the depth where most nodes have one document."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                part = batch.slice(k, 4000)
                tokens = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, TOKENS)
                rows = np.arange(len(tokens))
                nodes, used = mix(np.zeros(len(tokens), np.uint64)), np.zeros(len(tokens), np.uint64)
                for children in (TREES, *BRANCHES):
                    nodes, used, more = _branch(nodes, used, tokens[rows], children)
                    rows = rows[more]
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(used.view(np.int64)), part.column(0).take(pa.array(rows))], ["node", "used", "rep"])

    return classes.select("rep", "tokens").mapInArrow(walk, NODES)


def deeper_nodes(nodes: DataFrame) -> DataFrame:
    """The descendants, LEVELS down, of (node, used, rep, tokens)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, TOKENS)
            found, used = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            rows = np.arange(len(found))
            for _ in range(LEVELS):
                more, mask, back = _branch(found, used, tokens[rows], 2)
                keep = (np.arange(len(back)) < len(found)) | _second_child(found)[back]
                found, used, rows = more[keep], mask[keep], rows[back[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(used.view(np.int64)), batch.column(2).take(pa.array(rows))], ["node", "used", "rep"])

    return nodes.select("node", "used", "rep", "tokens").mapInArrow(walk, NODES)


def block_pairs(nodes: DataFrame, size: int) -> DataFrame:
    """(node, used, rep, ...) with each node dealt into pairs of blocks of about size / 2 documents, which are
    nodes of their own with no coordinate left: every two documents of a node meet in one of them."""
    blocks = F.ceil(F.col("n") * 2 / size).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = nodes.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.withColumns({"node": pair, "used": F.lit(-1).cast("long")}).drop("own", "other")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles): the full sets of the classes wanted (rep, first_id, first_key), from the texts.
    Few enough of them are sent to the scan; more meet the texts in a shuffled join."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])

    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # rows may repeat a class's first row: any of them has the same text
    met = docs.join(wanted, (docs.doc_id == wanted.first_id) & (docs.row_key == wanted.first_key)).select("rep", "text")
    return met.mapInArrow(build, "rep long, shingles binary").dropDuplicates(["rep"])


_PAD = np.uint32(0xFFFFFFFF)


def least_hashes(column: pa.Array) -> np.ndarray:
    """The least hashes of each row, BOTTOM places wide."""
    data, offsets = utf8(column)
    sizes = np.diff(offsets) // 4
    out = np.full((len(column), BOTTOM), _PAD, np.uint32)
    out[np.arange(BOTTOM) < sizes[:, None]] = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint32)
    return out


def resemblance(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The similarity of pairs of sets as their least hashes show it, and whether both sets are kept whole."""
    likeness, kept = [np.zeros(0)], [np.zeros(0, bool)]
    for k in range(0, len(x), 2048):
        a, b = x[k : k + 2048], y[k : k + 2048]
        whole = (a[:, -1] == _PAD) & (b[:, -1] == _PAD)
        both = np.sort(np.concatenate([a, b], axis=1), axis=1)
        equal = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
        place = np.cumsum(~equal, axis=1)  # distinct hashes before each
        limit = np.where(whole, 2 * BOTTOM, BOTTOM)
        common = (equal & (place < limit[:, None])).sum(axis=1)
        union = np.minimum((both != _PAD).sum(axis=1) - equal.sum(axis=1), limit)
        likeness.append(np.where(union > 0, common / np.maximum(union, 1), 1))
        kept.append(whole)
    return np.concatenate(likeness), np.concatenate(kept)


def may_link(x: np.ndarray, y: np.ndarray, similarity: int) -> np.ndarray:
    """Whether pairs of sets can reach the similarity, from their least hashes: exactly, up to the hashes'
    32 bits, where both sets are kept whole, else unless the estimate lies 4 deviations below."""
    return _reaches(*resemblance(x, y), similarity)


def _reaches(likeness: np.ndarray, whole: np.ndarray, similarity: int) -> np.ndarray:
    goal = similarity / 100
    return likeness >= goal - np.where(whole, 0.01, 4 * (goal * (1 - goal) / BOTTOM) ** 0.5)


def forests(ends: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs of components, the columns of ends in the order of preference, lie in one of so many
    spanning forests: a pair goes into the first forest that does not connect its ends yet. What one
    forest connects all before it do, so that one is found by halving."""
    if most >= ALL:
        return np.ones(ends.shape[1], bool)
    _, number = np.unique(ends, return_inverse=True)
    number, keep, ups = number.reshape(2, -1), np.zeros(ends.shape[1], bool), []

    def root(up: list[int], v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for k, (a, b) in enumerate(zip(*number.tolist(), strict=True)):
        low, high = 0, len(ups)
        while low < high:
            middle = (low + high) // 2
            if root(ups[middle], a) == root(ups[middle], b):
                low = middle + 1
            else:
                high = middle
        if low == len(ups) < most:
            ups.append(list(range(number.max() + 1)))
        if low < len(ups):
            ups[low][root(ups[low], a)] = root(ups[low], b)
            keep[k] = True
    return keep


def likely(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose minwise tokens and least hashes allow a link."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, TOKENS) for k in (2, 3))
            near = batch.filter(pa.array((x == y).sum(axis=1) >= LIKELY))
            good = may_link(least_hashes(near.column(4)), least_hashes(near.column(5)), similarity)
            yield near.select(["a", "b"]).filter(pa.array(good))

    left = reps.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"), F.col("bottom").alias("ba"))
    right = reps.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"), F.col("bottom").alias("bb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb", "ba", "bb").mapInArrow(agree, "a long, b long")


def node_pairs(node: int, used: int, reps: np.ndarray, c: np.ndarray, tokens: np.ndarray, small: int) -> np.ndarray:
    """Positions (i, j) of documents of one node whose tokens agree often enough, of different
    components c: the node branches until at most `small` documents are left or no coordinate is,
    and those are compared with each other outright."""
    low = tokens.astype(np.uint8)  # the tokens' last bytes decide here
    found, todo = [np.zeros((2, 0), np.int64)], [(np.uint64(node), np.uint64(used), np.arange(len(reps)))]
    while todo:
        at, mask, rows = todo.pop()
        if len(rows) < 2 or c[rows].min() == c[rows].max():
            continue
        if len(rows) <= small or mask == np.uint64((1 << 64) - 1):
            part, own, ids = low[rows], c[rows], reps[rows]
            for k in range(0, len(rows), 128):  # so many rows at a time bound the comparison's memory
                equal = np.count_nonzero(part[k : k + 128, None, :] == part[None, :, :], axis=2) >= LIKELY
                i, j = np.nonzero(equal & (own[k : k + 128, None] != own[None, :]) & (ids[k : k + 128, None] < ids[None, :]))
                found.append(np.stack([rows[i + k], rows[j]]))
            continue
        children = 2 if _second_child(np.array([at]))[0] else 1
        nodes, masks, back = _branch(np.full(len(rows), at), np.full(len(rows), mask), tokens[rows], children)
        order = np.argsort(nodes, kind="stable")
        heads = np.flatnonzero(np.r_[True, nodes[order][1:] != nodes[order][:-1]])
        for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
            if b - a > 1:
                todo.append((nodes[order[a]], masks[order[a]], rows[back[order[a:b]]]))
    both = np.concatenate(found, axis=1)
    _, first = np.unique(both[0] * len(reps) + both[1], return_index=True)
    return both[:, first]


def compared(nodes: DataFrame, similarity: int, small: int, most: int) -> DataFrame:
    """Likely pairs (a < b) within nodes that fit a task: nodes has node, used, rep, c, tokens and
    bottom; the rows of a node stand together in their partition. Pairs of one component are left out, and
    so are those outside the first `most` spanning forests of a batch's, the most alike first: a large group
    in several components gives a few pairs for each, not all between them. Rows with `more` name the
    nodes of which pairs were left out that way."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
            node, used = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            reps, c = (batch.column(k).to_numpy() for k in (2, 3))
            tokens = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(-1, TOKENS)
            heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            met = np.concatenate([a + node_pairs(node[a], used[a], reps[a:b], c[a:b], tokens[a:b], small) for a, b in zip(heads, [*heads[1:], len(node)], strict=True)], axis=1)
            # one pair turns up in many nodes of a batch: its least hashes are looked at once
            _, number = np.unique(reps, return_inverse=True)
            _, first = np.unique(number[met[0]] * len(reps) + number[met[1]], return_index=True)
            met = met[:, first]
            bottoms = least_hashes(batch.column(5)) if met.shape[1] else None
            looks = [(np.zeros(0), np.zeros(0, bool)), *(resemblance(bottoms[met[0, k : k + 4096]], bottoms[met[1, k : k + 4096]]) for k in range(0, met.shape[1], 4096))]
            likeness, whole = (np.concatenate(x) for x in zip(*looks, strict=True))
            good = _reaches(likeness, whole, similarity)
            met = met[:, good][:, np.argsort(-likeness[good], kind="stable")]
            keep = forests(c[met], most)
            left = np.unique(node[met[0, ~keep]]).view(np.int64)
            met = met[:, keep]
            pair = np.arange(met.shape[1] + len(left)) < met.shape[1]
            columns = [np.r_[reps[side], np.zeros(len(left), np.int64)] for side in met], np.r_[np.zeros(met.shape[1], np.int64), left]
            return pa.RecordBatch.from_arrays([*(pa.array(x, mask=~pair) for x in columns[0]), pa.array(columns[1], mask=pair)], ["a", "b", "more"])

        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            node = batch.column(0).to_numpy()
            last = int(np.flatnonzero(node == node[-1])[0])  # the last node may go on
            held = batch.slice(last)
            if last:
                yield pairs(batch.slice(0, last))
        if held is not None:
            yield pairs(held)

    rows = nodes.select("node", "used", "rep", "c", "tokens", "bottom")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(walk, "a long, b long, more long")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                common = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(s) else 0
                good.append(100 * common >= similarity * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text), and row_key (a hash
    of the text) and leads: whether (doc_id, row_key) is the least of its component.

    Rows with equal sets form a class that goes through the join once; sets count as equal when their
    sizes and two independent 64-bit sums of their shingles' hashes are. Null, blank and empty texts
    have no shingles and link with nothing. Rows that repeat a doc_id are rows of their own under one
    id, linked only as their texts are; a repeated row shares its twin's result. A row without doc_id
    links with nothing. Of a pair at just the similarity 0.75 in a crowd of about as similar
    documents some are missed (the README gives the recall); ties need no rule, as every link counts.
    Texts of any length are read whole; an empty table gives no rows; other columns are ignored.

    First every node links its documents to its smallest one. After that only documents that no
    confirmed link connects yet need comparing, so a large group of near copies costs a few
    comparisons for each document, not all pairs: nodes within one component are done, mixed nodes
    branch and are compared, those too large for a task also meet a pivot. Where a task left pairs out and
    what it handed on turns out to leave their ends apart, its nodes are looked at again, with more pairs
    each time, until nothing is left out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketch = saved(sketches(rows), "minhash-sketch")
    usable = sketch.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "row_key", "tokens", "bottom"))
    classes = usable.groupBy("set_a", "set_b", "n_shingles").agg(first.alias("f"))
    # numbered once and written: the number names the class, whatever ids its rows have
    reps = saved(classes.select(F.monotonically_increasing_id().alias("rep"), "set_a", "set_b", "n_shingles", F.col("f.doc_id").alias("first_id"), F.col("f.row_key").alias("first_key"), F.col("f.tokens").alias("tokens"), F.col("f.bottom").alias("bottom")), "minhash-classes")

    nodes = saved(first_nodes(reps), "minhash-nodes")
    shared = saved(nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1"), "minhash-shared")
    live = saved(nodes.join(shared, "node").select("node", "used", "rep", "pivot"), "minhash-live")
    drop_saved(nodes, shared)
    spark = docs.sparkSession
    sets = spark.createDataFrame([], "rep long, shingles binary")
    stars = saved(live.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "minhash-pairs")
    close = saved(likely(stars, reps, similarity), "minhash-close")
    live, depth, links, groups, tried, most = live.select("node", "used", "rep"), len(BRANCHES) + 1, None, None, close, 1
    while True:
        ends = close.select(F.col("a").alias("rep")).union(close.select("b")).distinct()
        missing = saved(ends.join(sets.select("rep"), "rep", "left_anti").join(reps.select("rep", "first_id", "first_key"), "rep"), "minhash-missing")
        if not missing.isEmpty():
            sets = sets.union(saved(full_sets(rows, missing), "minhash-sets"))
        new = saved(confirmed(close, sets, similarity), "minhash-links")
        if links is None or not new.isEmpty():
            links = new if links is None else links.union(new)
            groups = saved(components(links), "minhash-groups")
        # a node whose documents are all in one component is done
        placed = saved(live.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("node", "used", "rep", F.coalesce("component_id", "rep").alias("c")), "minhash-placed")
        stats = placed.groupBy("node").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct(F.xxhash64("node", "rep").alias("h"), "rep", "c")).alias("p"))
        mixed = saved(stats.where("lo < hi").select("node", "n", F.col("p.rep").alias("pivot"), F.col("p.c").alias("pc")), "minhash-mixed")
        if mixed.isEmpty():
            break
        inside = saved(placed.join(mixed, "node").join(reps.select("rep", "tokens", "bottom"), "rep"), "minhash-inside")
        ready, large = inside.where(F.col("n") <= TASK), inside.where(F.col("n") > TASK)
        if has_large := not large.isEmpty():
            if depth >= DEEPEST:
                ready, has_large = ready.unionByName(block_pairs(large, TASK)), False
            else:
                star = large.where("c != pc").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
                star = likely(star, reps, similarity)
        found = saved(compared(ready, similarity, SMALL, most), "minhash-found")
        close, more = found.where("more is null").select("a", "b").distinct(), found.where("more is not null").select(F.col("more").alias("node")).distinct()
        live = ready.join(more, "node", "left_semi").select("node", "used", "rep")
        if has_large:
            close = close.union(star).distinct()
            live = live.union(deeper_nodes(large))
            depth += LEVELS
        live, most = saved(live, "minhash-live"), most * FORESTS
        close = saved(close.join(tried, ["a", "b"], "left_anti"), "minhash-close")
        tried = tried.union(close)
        if close.isEmpty() and live.isEmpty():
            break
    # a component has the least doc_id of its classes
    linked = reps.select("rep", "set_a", "set_b", F.col("n_shingles").alias("n"), "first_id", "first_key").join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component_id", "rep")).drop("component_id")
    heads = linked.groupBy("c").agg(F.min(F.struct("first_id", "first_key")).alias("head"))
    member = saved(linked.join(heads, "c").select("set_a", "set_b", "n", "head"), "minhash-members")
    met = sketch.join(member, (sketch.set_a == member.set_a) & (sketch.set_b == member.set_b) & (sketch.n_shingles == member.n), "left")
    usable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(usable, F.col("head.first_id")).otherwise(F.col("doc_id"))
    leads = ~usable | ((F.col("head.first_id") == F.col("doc_id")) & (F.col("head.first_key") == F.col("row_key")))
    found = met.select("doc_id", "n_shingles", component.alias("component_id"), "row_key", leads.alias("leads"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row_key", "leads")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, kept."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op1_minhash": op1_minhash}

ORACLE_SQL: dict[str, str] = {}
