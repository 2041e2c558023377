"""URL filtering by rules and, where none fits, by the words in host and path.

A unigram model is counted over the words of all pages. Names of host and path are split into the words
that are likeliest under it (Viterbi), so "freecasino" is "free casino". URLs with a word of MARKS teach
multinomial naive Bayes what unwanted URLs look like, all others what wanted ones do; every URL's words
are then scored. A word counts once in a URL, so that no long URL outweighs the rest. Both models hold what has at least one of 2^18 of all counts, and one share for the rest,
so neither has more than 2^18 entries whatever the corpus."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_saved, read_table, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARE = 1 / (1 << 18)  # of all counts: what is rarer is an unknown word
LONGEST = 24  # letters of a word that a name is split into; a longer known word stays a chain of unknown ones

#: The rules of the query, host and path together.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Words that mark unwanted sites.
MARKS = ("adult", "ads", "bet", "bets", "betting", "bingo", "casino", "cialis", "escort", "gambling", "jackpot", "lottery", "pills", "poker", "porn", "roulette", "sex", "slots", "spam", "viagra", "warez", "xxx")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host, path = (F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones the first in code-point order), and its
    verdict; null where none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, kind in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


def common(counts: DataFrame, *columns: str) -> tuple[list, list[int]]:
    """The rows of counts (word, ...columns) whose columns add up to at least SHARE of all, at most
    1 / SHARE of them, and the columns' totals."""
    totals = [t or 0 for t in counts.agg(*(F.sum(c) for c in columns)).first()]
    together = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return counts.where(together >= SHARE * sum(totals)).collect(), totals


def word_shares(pages: DataFrame) -> dict[str, float]:
    """Word -> log of its share of all words in the pages' text (markup left out), for common words and
    MARKS."""
    text = F.lower(F.regexp_replace(F.col("html").cast("string"), "<[^<>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = saved(words.groupBy("word").agg(F.count("*").alias("n")), "url-words")
    rows, (total,) = common(counts, "n")
    shares = {r.word: math.log(r.n / total) for r in rows}
    for mark in MARKS:
        shares[mark] = max(shares.get(mark, -math.inf), math.log(4 * SHARE))
    drop_saved(counts)
    return shares


def segmented(name: str, shares: dict[str, float]) -> list[str]:
    """The likeliest words that make up name. An unknown word of n letters has SHARE / 10^n; of equally
    likely splits the one with the longest last word counts, from the end on."""
    n = len(name)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            word = name[start:end]
            score = best[start] + shares.get(word, math.log(SHARE) - len(word) * math.log(10))
            if score > best[end]:
                best[end], back[end] = score, start
    words = []
    while n:
        words.append(name[back[n] : n])
        n = back[n]
    return words[::-1]


def with_tokens(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """rows (page_id, host, path, rule, ruled) with tokens, the words of host and path."""
    shared = rows.sparkSession.sparkContext.broadcast(shares)
    names = [*rows.columns, "tokens"]
    at = [rows.columns.index(c) for c in ("host", "path")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        letters = re.compile(r"[^\W\d_]+")
        words_of = lru_cache(1 << 16)(lambda name: segmented(name, known))
        for batch in batches:
            hosts, paths = (batch.column(k).to_pylist() for k in at)
            tokens = [[w for part in (host, path.lower()) for name in letters.findall(part) for w in words_of(name)] for host, path in zip(hosts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.list_(pa.string()))], names)

    return rows.mapInArrow(split, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", tokens array<string>")


def bayes(rows: DataFrame) -> tuple[float, dict[str, float], float]:
    """The log odds of an unwanted URL: of all, of each common word, and of any other word. URLs with a
    word of MARKS are the unwanted ones; one is added to every count."""
    marked = F.arrays_overlap("tokens", F.array(*map(F.lit, MARKS)))
    urls = rows.agg(F.count_if(marked).alias("bad"), F.count_if(~marked).alias("good")).first()
    words = rows.select(marked.alias("marked"), F.explode(F.array_distinct("tokens")).alias("word"))
    counts = saved(words.groupBy("word").agg(F.count_if("marked").alias("bad"), F.count_if(~F.col("marked")).alias("good")), "url-tokens")
    found, (bad, good) = common(counts, "bad", "good")
    drop_saved(counts)
    size = len(found) + 1
    odds = {r.word: math.log((r.bad + 1) / (bad + size)) - math.log((r.good + 1) / (good + size)) for r in found}
    rest = math.log((bad - sum(r.bad for r in found) + 1) / (bad + size)) - math.log((good - sum(r.good for r in found) + 1) / (good + size))
    return math.log((urls.bad + 1) / (urls.good + 1)), odds, rest


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, tokens, score for every row of pages: score is the log odds
    of an unwanted URL, and above 0 the method blocks.

    A null url and one without :// have an empty host and path, no words and so nothing against them:
    allow, at the score of all URLs; null html has no words; URLs and pages of any length are read whole;
    repeated rows are judged alike; without any row the result is empty; other columns are ignored."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = saved(with_tokens(rows.select("*", rule.alias("rule"), ruled.alias("ruled")), word_shares(pages)), "url-rows")
    model = rows.sparkSession.sparkContext.broadcast(bayes(rows))
    names, at = [*rows.columns, "score"], rows.columns.index("tokens")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, odds, rest = model.value
        for batch in batches:
            scores = [math.fsum([prior, *(odds.get(w, rest) for w in set(tokens))]) for tokens in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(scored, schema + ", score double")
    method = F.when((F.col("score") > 0) & (F.size("tokens") > 0), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "tokens", "score")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> page_id, host, path, rule, verdict, score."""
    return judged(read_table(spark, sf_dir, "pages")).drop("tokens")


QUERIES = {"op13_url_filter": op13_url_filter}
#: No SQL: the splits and the scores come from models. Hosts, paths and rules are tested against plain Python.
ORACLE_SQL: dict[str, str] = {}
