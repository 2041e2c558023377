"""Token counts and ids by byte-level BPE with numpy.

A batch's texts become one code-point array; pre-tokens are cut by comparing neighbouring character
classes; distinct pre-tokens are held as one ragged array of symbol ids. In every round each
sequence merges its lowest-rank pair, all sequences at once, until no sequence has a mergeable pair.
The symbols that survive are the tokens."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, slices, span_hashes, utf8

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 0


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# fixed values: the code points of White_Space
_WHITE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class CharClasses:
    """The class of code points: letters L*, numbers N*, white space, others; looked up once each."""

    def __init__(self):
        self.table = np.full(0x110000, 255, np.uint8)
        self.table[_WHITE] = SPACE

    def of(self, cps: np.ndarray) -> np.ndarray:
        found = self.table[cps]
        missing = found == 255
        if missing.any():
            for cp in np.unique(cps[missing]).tolist():
                self.table[cp] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(cp))[0], OTHER)
            found = self.table[cps]
        return found


class Vocabulary:
    """Pair ranks and symbol ids of a byte-level BPE file, as numpy arrays for lookup."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        ids = model["model"]["vocab"]
        # byte-level files write each byte as one printable character: printable ones stand for
        # themselves, the rest for 256, 257, ... in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.byte_ids = np.array([ids[char[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        keys = np.array([(ids[a] << 20) | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.specials = {x["content"]: x["id"] for x in model["added_tokens"]}
        if any(x.get(k) for x in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip")) or model.get("normalizer"):
            raise ValueError("added tokens that look at their surroundings, and normalizers, are not supported")
        # of several at one place the longest counts
        longest = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.classes = CharClasses()
        # pre-tokens seen so far: hash, number of tokens, and where their ids begin in `known_ids`
        self.cache_keys = np.zeros(0, np.uint64)
        self.cache_counts = np.zeros(0, np.int64)
        self.cache_at = np.zeros(0, np.int64)
        self.known_ids = np.zeros(1 << 16, np.uint32)
        self.known = 0

    NONE = 1 << 60

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], self.NONE)

    def merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of symbols left of each byte sequence after all merges, every sequence in step,
        and the symbols of all sequences one after another."""
        lengths = ends - starts
        out = lengths.copy()
        left: list[tuple[np.ndarray, np.ndarray]] = []  # (sequences, symbols) that are done
        owner = np.repeat(np.arange(len(lengths)), lengths)
        first = np.cumsum(lengths) - lengths
        symbols = self.byte_ids[data[np.arange(len(owner)) - np.repeat(first - starts, lengths)]]
        while len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            rank = np.full(len(symbols), self.NONE, np.int64)  # of the pair that begins here
            rank[:-1][same] = self.pair_ranks(symbols[:-1][same], symbols[1:][same])
            heads = np.flatnonzero(np.r_[True, ~same])
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(symbols)])
            ended = least == self.NONE
            out[owner[heads[ended]]] = sizes[ended]
            hit = (rank == np.repeat(least, sizes)) & (rank != self.NONE)
            # in a run such as "aaa" pairs overlap: from the left every second one counts
            at = np.flatnonzero(hit)
            if len(at):
                run = np.r_[True, np.diff(at) > 1]
                start = at[np.flatnonzero(run)][np.cumsum(run) - 1]
                at = at[(at - start) % 2 == 0]
                symbols[at] = self.made[rank[at]]
            keep = np.repeat(~ended, sizes)
            left.append((owner[~keep], symbols[~keep]))
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols) == 1:
            out[owner[0]] = 1
        left.append((owner, symbols))
        whose, ids = (np.concatenate(x) for x in zip(*left, strict=True))
        return out, ids[np.argsort(whose, kind="stable")].astype(np.uint32)

    def pretokens(self, cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of the texts cps[bounds[i]:bounds[i + 1]], all texts at once.

        The rule is that of byte-level BPE: contractions, then letters, numbers or other signs with
        at most one blank before them, then white space, of which a run gives its last character
        to what follows (a blank joins the next pre-token; any other stands alone)."""
        n = len(cps)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes.of(cps)
        text_start = np.zeros(n + 1, bool)
        text_start[bounds] = True
        start = text_start[:-1].copy()
        start[1:] |= kind[1:] != kind[:-1]
        run_end = np.r_[start[1:], True]  # this is the last of its run
        space_last = (kind == SPACE) & run_end & ~text_start[1:]  # a run of white space that text follows
        at = np.flatnonzero(space_last)
        start[at] = True
        blank = at[cps[at] == 0x20]
        start[blank + 1] = False  # the blank begins the next pre-token
        # contractions: a lone apostrophe that begins a pre-token, with letters right after it
        quote = np.flatnonzero((cps == 0x27) & start[:n] & run_end & ~text_start[1:])
        quote = quote[kind[quote + 1] == LETTER]
        if len(quote):
            nxt = cps[quote + 1]
            two = np.where(quote + 2 < n, cps[np.minimum(quote + 2, n - 1)], 0)
            inside = (quote + 2 < n) & ~text_start[np.minimum(quote + 2, n)] & (kind[np.minimum(quote + 2, n - 1)] == LETTER)
            # fixed values: 's 't 'm 'd, and 're 've 'll
            one = np.isin(nxt, [ord(c) for c in "stmd"])
            pair = inside & (((nxt == ord("r")) & (two == ord("e"))) | ((nxt == ord("v")) & (two == ord("e"))) | ((nxt == ord("l")) & (two == ord("l"))))
            short = quote[one | pair]
            size = np.where(one, 1, 2)[one | pair]
            start[short + 1] = False
            rest = short + 1 + size
            ok = rest < n
            rest = rest[ok]
            start[rest[(kind[rest] == LETTER) & ~text_start[rest]]] = True
        return np.flatnonzero(start)

    def tokens_of(self, data: np.ndarray, byte_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pre-token data[byte_at[i]:byte_at[i + 1]] its number of tokens and where in
        known_ids its ids begin. Each distinct pre-token is merged once and then remembered."""
        keys = span_hashes(data, byte_at[:-1], byte_at[1:])
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if self.known > 1 << 25:  # the memory only saves time: begin anew before it grows large
            self.cache_keys, self.cache_counts, self.cache_at, self.known = self.cache_keys[:0], self.cache_counts[:0], self.cache_at[:0], 0
        at = np.searchsorted(self.cache_keys, distinct)
        seen = np.zeros(len(distinct), bool)
        inside = at < len(self.cache_keys)
        seen[inside] = self.cache_keys[at[inside]] == distinct[inside]
        new = np.flatnonzero(~seen)
        if len(new):
            spot = first[new]
            counts, ids = self.merged(data, byte_at[spot], byte_at[spot + 1])
            if self.known + len(ids) > len(self.known_ids):
                self.known_ids = np.concatenate([self.known_ids[: self.known], np.zeros(self.known + 2 * len(ids), np.uint32)])
            self.known_ids[self.known : self.known + len(ids)] = ids
            begin = self.known + np.cumsum(counts) - counts
            self.known += len(ids)
            self.cache_counts = np.insert(self.cache_counts, at[new], counts)
            self.cache_at = np.insert(self.cache_at, at[new], begin)
            self.cache_keys = np.insert(self.cache_keys, at[new], distinct[new])
            at = np.searchsorted(self.cache_keys, distinct)
        return self.cache_counts[at][back], self.cache_at[at][back]

    def parts(self, texts: list[str]) -> tuple[list[str], list[int], list[int]]:
        """The texts cut at added tokens: parts, the text of each, and the id of the added token
        after it, or -1."""
        parts, owner, after = [], [], []
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if self.special and any(x in text for x in self.specials) else [text]
            parts += pieces[::2]
            owner += [i] * len(pieces[::2])
            after += [*(self.specials[x] for x in pieces[1::2]), -1]
        return parts, owner, after

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As the tokenizers library does it, special strings included: of each piece (a pre-token or
        an added token) its text, number of tokens and place in known_ids; pieces of a text stand in
        order. Added tokens have place -1 and their id in the last array."""
        parts, owner, after = self.parts(texts)
        sizes = np.fromiter((len(x) for x in parts), np.int64, len(parts))
        joined = "".join(parts)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        bounds = np.r_[0, np.cumsum(sizes)]
        starts = self.pretokens(cps, bounds)
        if len(data) == len(cps):
            byte_at = np.r_[starts, len(cps)]
        else:
            width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
            byte_at = np.r_[0, np.cumsum(width)][np.r_[starts, len(cps)]]
        counts, at = self.tokens_of(data, byte_at) if len(starts) else (np.zeros(0, np.int64),) * 2
        part = np.searchsorted(bounds, starts, side="right") - 1
        owner, after = np.asarray(owner, np.int64), np.asarray(after, np.int64)
        extra = np.flatnonzero(after >= 0)
        if len(extra):  # each added token follows the pre-tokens of its part
            spot = np.searchsorted(part, extra, side="right")
            counts, at, part = np.insert(counts, spot, 1), np.insert(at, spot, -1), np.insert(part, spot, extra)
        return owner[part], counts, at, np.where(at < 0, after[part], 0)

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        owner, counts, _, _ = self.encoded(texts)
        return np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the n + 1 offsets of the texts in them."""
        owner, counts, at, added = self.encoded(texts)
        first = np.cumsum(counts) - counts
        place = np.repeat(at - first, counts) + np.arange(counts.sum())
        ids = self.known_ids[np.maximum(place, 0)]
        special = np.flatnonzero(at < 0)
        ids[first[special]] = added[special]
        return ids, np.r_[0, np.cumsum(np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64))]


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of docs (doc_id, text); null text is
    empty, repeated rows are counted each, whole texts are read, an empty table gives no rows. `vocabulary` is the path of a
    byte-level BPE file of the tokenizers library, readable on the executors."""
    path = vocabulary or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(path)
        for batch in batches:
            column = batch.column(1)
            _, offsets = utf8(column)
            sizes = np.diff(offsets)
            tokens = [np.zeros(0, np.int64)]
            for a, b in slices(offsets):
                tokens.append(vocab.count_texts([x or "" for x in column.slice(a, b - a).to_pylist()]))
            tokens = np.concatenate(tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, COUNTS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, n_bytes, n_tokens, over_limit (n_tokens > 512) over whole texts."""
    return token_counts(read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLE_SQL: dict[str, str] = {}
