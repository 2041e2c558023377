"""Document fingerprints by spot signatures, in DataFrame functions only.

A spot is a chain of content words that follows a run of common words (the anchors). A document's
fingerprint is the sorted set of its spots' hashes; two fingerprints are alike as their sets'
Jaccard coefficient. Anchors are fixed, so that fingerprints of different runs can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import read_table, saved

# fixed values: frequent words of English, German, French and Spanish
ANCHORS = (
    "the of and to a in is that for it was on with be as by this are at from or an not but "
    "der die und den von zu das sich mit auf des für ist nicht im dem ein eine als er "
    "la le et les en un du une que pour est qui dans par pas au sur avec ou elle "
    "el y los se del las por no su con una es para al lo de"
).split()
CHAIN = 2  # content words in a spot
LEAST = 0.5  # likeness from which documents_alike() looks for pairs
RANGE_CHARS = 1 << 20  # of text in one range of neighbours
MOST_RANGES = 1 << 14  # beyond, ranges grow; their bounds are a constant of the plan


def _trie(words: list[str]) -> str:
    """A regular expression for the words that branches letter by letter."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [c + _trie(rest) for c, rest in heads.items()]
    body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return body if "" not in words else (f"(?:{body})?" if parts else "")


def with_spots(df: DataFrame, text: str, out: str, anchors=ANCHORS, chain: int = CHAIN) -> DataFrame:
    """df with the sorted distinct spot hashes (long) of a text column.

    Words are runs of letters and digits in lower case. Anchor words are tied to the word after
    them, so that one split leaves content words that carry the anchors before them; where there
    are some, the word and the next chain - 1 content words are a spot. A chain that the text's end
    cuts short does not count. A text with no such spot, as in a language without anchors here, has
    the chains of chain + 1 neighbouring content words as spots; one too short for that has one spot
    of all its words, so that equal short texts are alike; without words there is none."""
    words = F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "))
    df = df.withColumn("_words", F.regexp_replace(words, rf"(?<![^ ])({_trie(list(anchors))}) ", "$1\u0001"))
    df = df.withColumn("_content", F.split("_words", " "))
    content, mark = F.col("_content"), F.lit("\u0001")

    def spot(x, i):
        parts = [x, *(F.substring_index(F.get(content, i + k), "\u0001", -1) for k in range(1, chain))]
        return F.when(F.contains(x, mark) & (i + (chain - 1) < F.size(content)), F.xxhash64(*parts))

    def plain(x, i):
        return F.when(i + chain < F.size(content), F.xxhash64(x, *(F.get(content, i + k) for k in range(1, chain + 1))))

    df = df.withColumn("_found", F.array_sort(F.array_distinct(F.array_compact(F.transform(content, spot)))))
    found = F.col("_found")
    none = F.array().cast("array<long>")
    other = F.when(F.size(content) > chain, F.array_sort(F.array_distinct(F.array_compact(F.transform(content, plain))))).otherwise(F.array(F.xxhash64("_words", F.lit(0))))
    column = F.when(F.col("_words") == "", none).when(F.size(found) == 0, other).otherwise(found)
    return df.withColumn(out, column).drop("_words", "_content", "_found")


def fingerprint(spots_column):
    """The set as text: hexadecimal spots, in order."""
    return F.array_join(F.transform(spots_column, lambda h: F.lower(F.hex(h))), ",")


def likeness(a, b, least: float = 0.0):
    """Jaccard coefficient of two spot sets; 0 where the sizes alone keep it at or under `least`,
    which the intersection then need not be counted for. Two empty sets are wholly alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(large == 0, F.lit(1.0)).when(small <= large * F.lit(least), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def with_next(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """docs (doc_id, text) with spots and the next row's text and spots by doc_id (ties by text), the
    last row's next being the first. Rows are dealt out by ranges of doc_id between percentiles, as
    many as the texts' total length asks for; a copy of each range's first row stands at the end of
    the range before, so that no task needs another's rows. Only the bounds (at most MOST_RANGES ids)
    reach the driver. The spots of a row are made once, before it is dealt out."""
    chars = docs.agg(F.sum(F.length("text").cast("long")).alias("n")).first().n or 0
    ranges = min(-(-chars // range_chars), MOST_RANGES)
    bounds = docs.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("b")).first().b if ranges > 1 else []
    bounds = sorted(set(bounds or []))
    # the range of an id in two steps over the bounds: blocks of about the square root of their number
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    place = F.lit(0)
    if bounds:
        longs = lambda xs: F.lit(xs).cast("array<long>")
        at_least = lambda xs: F.size(F.filter(xs, lambda e: F.col("doc_id") >= e))
        block = at_least(longs([x[0] for x in blocks]))
        inside = F.element_at(F.lit(blocks).cast("array<array<long>>"), block)
        place = F.when(block == 0, 0).otherwise((block - 1) * step + at_least(inside))
    rows = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place))
    # the first row of each range: its id from the ids alone, then its text
    least = rows.groupBy("part").agg(F.min("doc_id").alias("least"))
    before = F.coalesce(F.lag("part").over(W.orderBy("part")), F.max("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    least = saved(least.select(F.col("part").alias("own"), "least", before.alias("to")), "spots-ranges")  # a row for each range
    heads = rows.join(F.broadcast(least), (F.col("part") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("least")))
    heads = saved(heads.groupBy("own", "to").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id")), "spots-heads")
    guard = with_spots(heads, "text", "spots").select("doc_id", "text", "spots", F.col("to").alias("part"), F.lit(1).alias("guard"))
    both = with_spots(rows, "text", "spots").select("doc_id", "text", "spots", "part", F.lit(0).alias("guard")).union(guard)
    own = W.partitionBy("part").orderBy("guard", "doc_id", "text")
    return both.select("*", F.lead("text").over(own).alias("next_text"), F.lead("spots").over(own).alias("next_spots")).where("guard = 0").drop("part", "guard")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text of docs (doc_id, text), of its edited text, and the likenesses.

    The edited text swaps the last floor(n / 2) code points for the first ones of the next document.
    Null text is empty; rows that repeat a doc_id follow each other by text; the only row is its own
    next; a null doc_id comes first; an empty table gives no rows; other columns are ignored. Texts
    of any length are taken whole. Two texts without words are wholly alike."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = with_next(rows)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = met.select("doc_id", n.cast("long").alias("n_chars"), "spots", "next_spots", edited.alias("edited"))
    out = with_spots(out, "edited", "edited_spots")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def documents_alike(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b, likeness) of distinct fingerprints with likeness >= least, a and b being the
    smallest ids that bear them. Sets are partitioned by length so that only lengths within the
    bound meet, and within a pair of partitions by the rarest spots of each set, of which two alike
    sets must share one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # written first: a condition on the spots must not move below the steps that make them
    rows = saved(with_spots(rows, "text", "spots").drop("text"), "spots-rows")
    sets = saved(rows.where(F.size("spots") > 0).groupBy("spots").agg(F.min("doc_id").alias("id")), "spots-sets")
    counts = sets.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count("*").alias("c"))
    ranked = sets.select("id", F.size("spots").alias("n"), F.explode("spots").alias("spot")).join(counts, "spot")
    order = ranked.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("c", "spot")))
    prefix = saved(order.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("id", "n", "spot"), "spots-prefix")
    # lengths fall into partitions whose bounds grow by 1 / least: alike sets are in the same or adjoining ones
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least)))
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "spot", F.explode(F.array(part, part + 1)).alias("part"))
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "spot", part.alias("part"))
    pairs = left.join(right, ["spot", "part"]).where((F.col("a") != F.col("b")) & (F.col("nb") >= F.col("na")) & (F.col("na") >= F.col("nb") * least))
    pairs = pairs.where("nb > na or a < b").select("a", "b").distinct()
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("spots").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("spots").alias("sb")), "b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb"), 0.0).alias("likeness")).where(F.col("likeness") >= least)


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next."""
    return fingerprints(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_spotsigs": op2_spotsigs}
ORACLE_SQL: dict[str, str] = {}
