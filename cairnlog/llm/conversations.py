"""The prefix trie of conversations, by whole-sequence collapse.

Turns are put in order over all tasks and named by a SHA-256 of role and text; a prefix is named by its
depth and 128 bits that combine the names of its turns with their places. Identical conversations
collapse into one weighted sequence, whose members stay as a list of ends. Sequences that are a proper
prefix of another one go by an anti-join, which leaves the leaves. The weighted prefixes of the
sequences are then aggregated into nodes, all sums of subtrees with them: a sequence adds to each of its
prefixes what lies below, once with its weight, and once alone where no smaller member has the node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import drop_saved, read_table, saved

GROUP = 100  # conversations that take over turns of one
MOST_SHARED = 6  # turns taken over, fewer than this
STRETCH = 1024  # turns of one conversation that are summed up in one task
KEY = ("depth", "x", "y")  # names a prefix


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, i, turn_name, chars): the turns with their places from 0, written.

    They are sorted by ranges, so a conversation of very many turns lies in several tasks. Only the
    first conversation of a range can have begun before it, so there is at most one offset a range."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name.alias("turn_name"), F.length(text).cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("turn_name")]
    dealt = saved(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "trie-dealt")
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    earlier = F.sum("size").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("conv_id", "part", earlier.alias("earlier")).where("earlier is not null")
    local = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order)) - 1
    placed = dealt.withColumn("i", local).join(F.broadcast(offsets), ["conv_id", "part"], "left")
    out = saved(placed.select("conv_id", (F.col("i") + F.coalesce("earlier", F.lit(0))).alias("i"), "turn_name", "chars"), "trie-turns")
    drop_saved(dealt)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and their rebuilt turns (conv_id, depth from 1, turn_name, chars):
    the first h turns of the group's first conversation, then the own ones after the first h. A
    conversation hands at most MOST_SHARED - 1 turns to each of at most 2 * GROUP others."""
    h = F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED
    heads = turns.where((F.col("i") < MOST_SHARED - 1) & (F.col("conv_id") % GROUP == 0))
    heads = heads.groupBy(F.col("conv_id").alias("lender")).agg(F.array_sort(F.collect_list(F.struct("i", "turn_name", "chars"))).alias("lent"))
    known = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("lender"), h.alias("h"))
    lent = F.coalesce(F.slice("lent", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<i:bigint,turn_name:binary,chars:bigint>>"))
    convs = saved(known.join(heads, "lender", "left").select("conv_id", "h", lent.alias("lent")), "trie-convs")
    own = turns.where(F.col("i") >= h).join(convs.select("conv_id", (F.size("lent") - F.col("h") + 1).alias("shift")), "conv_id")
    own = own.select("conv_id", (F.col("i") + F.col("shift")).alias("depth"), "turn_name", "chars")
    taken = convs.select("conv_id", F.explode("lent").alias("t")).select("conv_id", (F.col("t.i") + 1).alias("depth"), "t.turn_name", "t.chars")
    return convs.select("conv_id"), own.union(taken)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, above_x, above_y, chars, upto): each prefix's name, that of the one above
    it, the code points of its last text and of all its texts. Sums run within stretches; what earlier
    stretches hold is added to those of conversations that have several."""
    own = [F.xxhash64(F.lit(k), "depth", "turn_name") for k in (1, 2)]
    named = turns.select("conv_id", "depth", own[0].alias("a"), own[1].alias("b"), "chars", F.floor((F.col("depth") - 1) / STRETCH).alias("stretch"))
    upto = W.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    sums = named.withColumns({"x": F.bit_xor("a").over(upto), "y": F.bit_xor("b").over(upto), "upto": F.sum("chars").over(upto)})
    # a stretch that is followed by another one is full
    full = named.groupBy("conv_id", "stretch").agg(F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"), F.sum("chars").alias("upto"), F.count("*").alias("n")).where(F.col("n") == STRETCH)
    before = W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)
    carried = full.select("conv_id", (F.col("stretch") + 1).alias("stretch"), F.bit_xor("x").over(before).alias("cx"), F.bit_xor("y").over(before).alias("cy"), F.sum("upto").over(before).alias("cu"))
    zero = F.lit(0).cast("long")
    met = sums.join(carried, ["conv_id", "stretch"], "left")
    x, y = (F.col(c).bitwiseXOR(F.coalesce("c" + c, zero)) for c in ("x", "y"))
    return met.select("conv_id", "depth", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("a")).alias("above_x"), y.bitwiseXOR(F.col("b")).alias("above_y"), "chars", (F.col("upto") + F.coalesce("cu", zero)).alias("upto"))


def end_lists(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256): the SHA-256 of each whole sequence's members, ascending and joined by
    commas. Members are sorted by ranges and joined there in pieces; a digest has to take its bytes in
    order, so one task reads a sequence's pieces, one after another and never all at once."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3).to_pylist()
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            rows, a = [], 0
            for b in range(1, len(ids) + 1):
                if b == len(ids) or keys[b] != keys[a]:
                    rows.append((*keys[a], ids[a], ",".join(map(str, ids[a:b]))))
                    a = b
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["depth", "x", "y", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            rows = []
            for depth, x, y, piece in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if (depth, x, y) != now:
                    if now is not None:
                        rows.append((*now, digest.hexdigest()))
                    now, digest = (depth, x, y), hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["depth", "x", "y", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, digest.hexdigest())], ["depth", "x", "y", "ends_sha256"])

    members = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = members.mapInArrow(joined, "depth long, x long, y long, first long, piece string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "depth long, x long, y long, ends_sha256 string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with n_children and parent_conv_id. Parents of more than a thousandth of all nodes, of
    which there are under a thousand, are broadcast, so that the children of the root or of a very
    common turn are not dealt out by that key."""
    counts = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above_x").alias("x"), F.col("above_y").alias("y")).agg(F.count("*").alias("n_children"))
    counted = saved(nodes.join(counts, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-counted")
    above = [(F.col("depth") + 1).alias("depth"), F.col("x").alias("above_x"), F.col("y").alias("above_y"), F.col("conv_id").alias("parent_conv_id")]
    on = ["depth", "above_x", "above_y"]
    wide = F.col("n_children") * 1000 > counted.count()
    hot = F.broadcast(counted.where(wide).select(*above))
    met = counted.join(hot, on).unionByName(counted.join(hot, on, "left_anti").join(counted.where(~wide & (F.col("n_children") > 0)).select(*above), on, "left"))
    return met


def prefix_trie(rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every
    node of the trie of rebuilt conversations, with members n_convs and their smallest conv_id.

    Null role or text is empty; turns are ordered by turn, null first, and equal ones by a hash of role
    and text, so the order of rows does not matter; repeated rows are turns each; rows without conv_id
    belong to no conversation and are left out; texts of any length are read whole; an empty table has
    no node, not even a root; other columns are ignored. Different turns are taken as equal only on a
    SHA-256 collision, different prefixes of one depth on one of 128 bits."""
    turns = ordered_turns(rows)
    known, again = rebuilt(turns)
    all_prefixes = saved(prefixes(again), "trie-prefixes")
    last = all_prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "x", "y", "upto")).alias("last"))
    zero = F.lit(0).cast("long")
    ends = known.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(F.col(f"last.{c}"), zero).alias(c) for c in (*KEY, "upto")))
    ends = saved(ends, "trie-ends")
    # whole-sequence collapse: one weighted sequence for identical conversations
    sequences = ends.groupBy(*KEY).agg(F.min("conv_id").alias("first"), F.count("*").alias("weight"), F.first("upto").alias("total"))
    sequences = saved(sequences.withColumnRenamed("depth", "turns"), "trie-sequences")
    of = sequences.select(F.col("first").alias("conv_id"), "weight", "total", "turns")
    root = [zero.alias(c) for c in ("depth", "x", "y", "above_x", "above_y", "chars", "upto")]
    weighted = all_prefixes.join(of, "conv_id").unionByName(of.select("conv_id", *root, "weight", "total", "turns"))
    weighted = saved(weighted.withColumn("before", F.col("upto") - F.col("chars")), "trie-weighted")
    # leaves: sequences that are no proper prefix
    proper = weighted.where("depth < turns").select(*KEY).distinct()
    leaves = sequences.withColumnRenamed("turns", "depth").join(proper, list(KEY), "left_anti").select(F.col("first").alias("conv_id"), F.lit(1).alias("leaf"))
    # the smallest member of a node is that of all nodes below on its way: from one depth on
    smallest = weighted.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.first("before").alias("before"))
    alone = smallest.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("own"))
    about = of.select("conv_id").join(alone, "conv_id", "left").join(leaves, "conv_id", "left")
    rest = F.when(F.col("own").isNull(), zero).otherwise(F.col("total") - F.when(F.col("depth") >= F.col("own.depth"), F.col("before")).otherwise(F.col("own.before")))
    nodes = weighted.join(about, "conv_id").groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.coalesce(F.sum("leaf"), F.lit(0)).cast("long").alias("n_leaves"),
        F.sum(F.col("weight") * (F.col("total") - F.col("before")) - rest).alias("saved_tokens"),
        F.first("above_x").alias("above_x"),
        F.first("above_y").alias("above_y"),
    )
    nodes = with_parents(saved(nodes, "trie-nodes")).join(end_lists(ends), list(KEY), "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> the nodes of their prefix trie."""
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}

_CRC_TABLE = "select list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(0, 256) as r(i)"

ORACLE_SQL = {
    "op12_prefix_trie": f"""
with crc as materialized ({_CRC_TABLE}),
turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as i from conversations where conv_id is not null),
original as materialized (select conv_id, list(struct_pack(r := role, t := text) order by i) as s from turns group by conv_id),
hashed as (select conv_id, s, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: unicode(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {MOST_SHARED} as h from original, crc),
rebuilt as materialized (select c.conv_id, list_concat(coalesce(b.s[1:c.h], []), c.s[c.h + 1:]) as s from hashed c left join original b on b.conv_id = c.conv_id - c.conv_id % {GROUP}),
pre as (select conv_id, unnest(range(0, len(s) + 1)) as depth, s from rebuilt),
nodes as materialized (select s[1:depth] as p, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(length(s[1:depth][-1].t), 0) as chars,
  string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(s) = depth) as ends from pre group by all),
kids as (select p[1:depth - 1] as p, count(*) as n_children from nodes where depth > 0 group by all),
full_nodes as materialized (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on k.p = n.p),
ups as (select p[1:d] as p, n_children, (n_convs - 1) * chars as saved from (select *, unnest(range(0, depth + 1)) as d from full_nodes)),
sums as (select p, count(*) filter (where n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from ups group by all)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from full_nodes n join sums s on s.p = n.p left join full_nodes u on n.depth > 0 and u.p = n.p[1:n.depth - 1]"""
}
