"""Spelling variants: words at edit distance one, through an index of variable-length grams.

The gram dictionary holds the grams that occur in more than a few distinct words. A word is decomposed
at every place into the shortest gram that is not in the dictionary, up to LONGEST code points; a mark
at the word's end counts as one. So what a gram is depends on its own code points alone, and an edit
affects those grams only that reach over it. For each of the word's possible edits the affected grams
are known, and the first of the unaffected ones, in an order of all grams, is the list that the word
enters for it: two near words leave the same grams unaffected, so they meet in that list. Lists are as
short as the dictionary's threshold. Where every unaffected gram is frequent, the two parts of the word
beside the edit are the list's name together; such lists hold near words only. Pairs that meet in a list
are verified by their edit distance."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_saved, read_table, saved

LETTERS = "[A-Za-zÀ-ÿ]+"
SHORTEST, LONGEST = 2, 6  # code points of a gram
RARE = 64  # a gram of at most so many places in distinct words is never in the dictionary
DICTIONARY = 1 << 17  # grams of one length in the dictionary, at most: a larger share of all places is asked for
LEAST_CHARS, LEAST_COUNT = 5, 3
END = "$"  # no letter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spelled_words(docs: DataFrame) -> DataFrame:
    """The words of the texts as they are counted: lower-cased runs of letters, with one code point
    deleted in one of 97 (by a hash of doc_id and run), as a rule that plants typing errors. A run of
    a row without doc_id stays whole."""
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), run.alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % 97 == 0, cut).otherwise(F.col("run")).alias("word"))


def counted_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least: int = LEAST_COUNT) -> DataFrame:
    words = spelled_words(docs).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """Gram -> places, for the grams with more than RARE places and more than one of DICTIONARY of all.
    No length has over DICTIONARY of them, however many words there are. Every prefix of a gram in the
    dictionary, down to SHORTEST, is in it too."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    marked = words.select(F.concat("word", F.lit(END)).alias("w"))
    places = marked.select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("p"))
    sizes = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("w") - F.col("p") + 1))
    grams = places.select("w", "p", F.explode(sizes).alias("q")).select(F.substring("w", F.col("p"), F.col("q")).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("c"))
    return dict(counts.where(F.col("c") > max(RARE, total // DICTIONARY)).collect())


def decomposed(word: str, dictionary: dict[str, int]) -> list[tuple[int, str, bool]]:
    """(place, gram, rare) for every place of the word."""
    marked, out = word + END, []
    for p in range(len(word)):
        most = min(LONGEST, len(marked) - p)
        q = SHORTEST
        while q < most and marked[p : p + q] in dictionary:
            q += 1
        gram = marked[p : p + q]
        out.append((p, gram, gram not in dictionary))
    return out


def lists_of(word: str, dictionary: dict[str, int]) -> set[tuple[str, int]]:
    """(list, role) pairs that the word enters. Role 2 meets role 2 (one code point replaced); role 0,
    the longer word, meets role 1 (one deleted). A list is named by the kind and length of the edit,
    the side of the edit on which its gram stands, the gram's distance from that end, and the gram."""
    n = len(word)
    none = (1 << 32, "")
    before, after = [none] * (n + 1), [none] * (n + 1)  # the first rare gram that ends by / starts from here
    for p, gram, rare in decomposed(word, dictionary):
        if rare:
            order = zlib.crc32(gram.encode())
            end = p + len(gram)
            if end <= n:
                before[end] = min(before[end], (order, f"b{p}{gram}"))
            after[p] = min(after[p], (order, f"a{n - p}{gram}"))
    for i in range(1, n + 1):
        before[i] = min(before[i], before[i - 1])
        after[n - i] = min(after[n - i], after[n - i + 1])
    out = set()
    for e in range(n):  # the code point at e replaced or deleted
        first = min(before[e], after[e + 1])
        if first is none:
            rest = word[:e] + word[e + 1 :]
            out |= {(f"R{e} {rest}", 2), (f"D{rest}", 0)}
        else:
            out |= {(f"r{n}{first[1]}", 2), (f"d{n - 1}{first[1]}", 0)}
    for g in range(n + 1):  # one inserted before g
        first = min(before[g], after[g])
        out.add((f"D{word}", 1) if first is none else (f"d{n}{first[1]}", 1))
    return out


def gram_lists(words: DataFrame, dictionary: dict[str, int]) -> DataFrame:
    """(list, role, word) entries of the index."""
    shared = words.sparkSession.sparkContext.broadcast(dictionary)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names, roles, found = [], [], []
            for word in batch.column(0).to_pylist():
                for name, role in lists_of(word, known):
                    names.append(name)
                    roles.append(role)
                    found.append(word)
                if len(names) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(roles, pa.int32()), pa.array(found, pa.string())], ["name", "role", "word"])
                    names, roles, found = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(roles, pa.int32()), pa.array(found, pa.string())], ["name", "role", "word"])

    rows = words.select("word").mapInArrow(entries, "name string, role int, word string")
    return rows.select(F.xxhash64("name").alias("list"), "role", "word")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other) both ways for words that differ by exactly one inserted, deleted or replaced code
    point. words are distinct, of at least two code points."""
    index = saved(gram_lists(words, gram_dictionary(words)), "spelling-lists")
    a, b = index.toDF("list", "role", "word"), index.toDF("list", "other_role", "other")
    meet = ((F.col("role") == 2) & (F.col("other_role") == 2) & (F.col("word") < F.col("other"))) | ((F.col("role") == 0) & (F.col("other_role") == 1))
    pairs = a.join(b, "list").where(meet & (F.levenshtein("word", "other", 1) == 1)).select("word", "other")
    once = saved(pairs.distinct(), "spelling-pairs")
    drop_saved(index)
    return once.union(once.select("other", "word"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: where the chain of forms ends. n doubles with each form, so
    chains have at most 63 steps and pointer doubling ends in 6 rounds."""
    jumps = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        there = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(jumps.join(there, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_saved(jumps)
        if step.where("moved").isEmpty():
            return step.drop("moved")
        jumps = step.drop("moved")
        jumps._saved_at = step._saved_at


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least 5 code points and 3 occurrences.

    Null and empty texts have no words; texts of any length are read whole; rows that repeat count each;
    a row without doc_id counts with its runs unchanged; of near words that are equally frequent the
    smallest in code-point order is the form; no words give an empty result; other columns of docs are
    ignored."""
    words = saved(counted_words(docs), "spelling-words")
    pairs = near_pairs(words)
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = pairs.join(counts, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    near = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))
    holds = F.col("form_n") >= 2 * F.col("n")
    near = saved(near.select("word", "n", "n_near", *(F.when(holds, F.col(c)).alias(c) for c in ("form", "form_n"))), "spelling-near")
    roots = roots_of(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> word, form, root, n, n_near, form_n."""
    return spelling_variants(read_table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling": op11_spelling}

_CRC_TABLE = "select list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(0, 256) as r(i)"
_CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"
_BYTES = "flatten(list_transform(string_split(doc_id::varchar || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end))"

ORACLE_SQL = {
    "op11_spelling": f"""
with recursive crc as materialized ({_CRC_TABLE}),
runs as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{LETTERS}')), '{UPPER}', '{LOWER}') as run from documents),
counted as (select doc_id, run, count(*) as c from runs group by all),
hashed as (select run, c, {_CRC.format(bytes=_BYTES, table="t")} as h from counted, crc),
spelled as (select case when h % 97 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word, c from hashed),
words as materialized (select word, sum(c)::bigint as n from spelled where length(word) >= {LEAST_CHARS} group by word having sum(c) >= {LEAST_COUNT}),
cuts as (select word, n, e, substring(word, 1, e::int) || substring(word, e::int + 2) as rest from (select word, n, unnest(range(0, length(word))) as e from words)),
pairs as (select a.word, b.word as other, b.n as other_n from cuts a join cuts b on a.rest = b.rest and a.e = b.e and a.word <> b.word
  union select c.word, w.word, w.n from cuts c join words w on c.rest = w.word
  union select w.word, c.word, c.n from cuts c join words w on c.rest = w.word),
best as (select word, count(*) as n_near, max(other_n) as top_n from pairs group by word),
formed as (select b.word, min(p.other) as form from best b join words w on w.word = b.word join pairs p on p.word = b.word and p.other_n = b.top_n where b.top_n >= 2 * w.n group by b.word),
chain as (select word, form as root from formed union all select c.word, f.form from chain c join formed f on f.word = c.root),
ends as (select word, root from chain where root not in (select word from formed))
select w.word, f.form, coalesce(e.root, w.word) as root, w.n, coalesce(b.n_near, 0) as n_near, case when f.form is not null then b.top_n end as form_n
from words w left join best b on b.word = w.word left join formed f on f.word = w.word left join ends e on e.word = w.word"""
}
