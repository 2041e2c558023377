"""Each operator against brute force, a round trip, or held-out accuracy, and its edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlog.llm import bpe, embedding, lines, minhash, mixing, packing, shared, spotsigs, suffix, toxicity, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def prose(rng, n, words=200):
    return " ".join(rng.choice(["w%d" % rng.randrange(words), "the", "of", "A"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, nulls, empty and long texts, repeated rows, a null id, clashing columns."""
    rng = random.Random(5)
    rows = []
    base = [prose(rng, rng.choice([3, 40, 120, 400])) for _ in range(25)]
    for i in range(110):
        t = rng.choice(base)
        if rng.random() < 0.6:
            w = t.split(" ")
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(9)
            t = " ".join(w)
        rows.append((i, t.replace(" w1 ", "\n") if rng.random() < 0.5 else t))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one two"), (204, "ONE Two"), (205, prose(rng, 30_000)), (206, "a" * 700), (206, "a" * 700), (207, rows[0][1]), (None, rows[1][1]), (208, "é" * 300), (209, "x\x00y 🙂 <|endoftext|> don't")]
    df = spark.createDataFrame([(i, t, "en", "s%d" % ((i or 0) % 3) if i != 5 else None, 1, 2, 3) for i, t in rows], DOC + ", lang string, source string, n int, id int, part int")
    return df.repartition(5)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


# -- 1


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    ids = [i for i, _ in rows]
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("task, deepest", [(8192, 40), (4, 40), (4, 5)])
def test_minhash(spark, docs, monkeypatch, task, deepest):
    """Null, empty and long texts, ties, repeated rows, clashing columns; nodes that fit a task, nodes
    that branch over the cluster, and nodes compared in pairs of blocks."""
    monkeypatch.setattr(minhash, "TASK", task)
    monkeypatch.setattr(minhash, "SMALL", min(task, 8))
    monkeypatch.setattr(minhash, "DEEPEST", deepest)
    want = brute_groups([r for r in dict(rows_of(docs)).items() if r[0] is not None])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept and r.leads
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == r.leads == (r.doc_id == r.component_id)
    if task > 4:
        assert minhash.near_duplicates(empty(spark, docs)).count() == 0


def test_minhash_repeated_ids(spark):
    """Rows under one doc_id are linked as their texts are, in any order of the rows."""
    far, near = "a b c d e f g h i j k l", "m n o p q r s t u v w x y z a1 b1 c1 d1 e1 f1"
    rows = [(1, far), (1, near), (2, near + " g1"), (2, "own text of five words here"), (3, far + " new")]
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(order, DOC)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.leads) for r in got) == [(1, 8, 1, True), (1, 16, 1, True), (2, 2, 2, True), (2, 17, 1, False), (3, 9, 1, False)]


def test_minhash_crowd(spark, monkeypatch):
    """Recall of the branching itself: 1,500 documents at similarities of about 0.58 to each other and
    300 near copies at 0.75 to 0.8, in nodes that are far larger than a task takes, no pivot's help."""
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(400)]
    rows, planted = [], []
    for i in range(1500):
        w = list(base)
        for k in rng.choice(400, 12, replace=False):  # two of them differ in about 24 places of 400
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
        if i < 300:
            v = list(w)
            for k in rng.choice(400, 11, replace=False):
                v[k] = f"y{i}-{k}"
            rows.append((10_000 + i, " ".join(v)))
    sets = {i: shingles(t) for i, t in rows}
    same = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    planted = [i for i in range(300) if same(i, 10_000 + i)]
    assert len(planted) > 100
    monkeypatch.setattr(minhash, "SMALL", 32)
    monkeypatch.setattr(minhash, "TASK", 400)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    recall = np.mean([got[i] == got[10_000 + i] for i in planted])
    print("recall in the crowd:", recall, "of", len(planted))
    assert recall >= 0.9


def test_minhash_group_in_parts(spark):
    """A large group of near copies in several components gives a link or so for each of them, not all pairs
    between them, and names its node as long as pairs are left out."""
    words = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(100)]
    reps = minhash.sketches(spark.createDataFrame(rows, DOC).select("doc_id", F.lit(0).cast("long").alias("row_key"), "text"))
    for parts, most, expected in ((2, 1, 1), (10, 1, 9), (10, 4, 36), (2, minhash.ALL, 2500)):
        nodes = reps.select(F.lit(1).cast("long").alias("node"), F.lit(0).cast("long").alias("used"), F.col("doc_id").alias("rep"), (F.col("doc_id") % parts).alias("c"), "tokens", "bottom")
        got = minhash.compared(nodes, 75, minhash.SMALL, most).collect()
        pairs = [(r.a, r.b) for r in got if r.more is None]
        assert all(a < b and a % parts != b % parts for a, b in pairs)
        if most < minhash.ALL:
            assert len(pairs) <= expected and [r.more for r in got if r.a is None] == [1]
        else:
            assert len(pairs) > expected / 2 and len(pairs) == len(got)


def test_slices_bound_the_work_arrays():
    """Encoding, sketching and bucketing a batch of 6 MB hold work arrays for a small part of it at a time."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(2)
    column = pa.array([prose(rng, 800, 20_000) for _ in range(1500)], pa.string())
    data, offsets = shared.utf8(column)
    vocab = bpe.Vocabulary(bpe.vocabulary_path())
    work = [
        lambda a, b: vocab.encode_texts(column.slice(a, b - a).to_pylist()),
        lambda a, b: minhash.minwise(minhash.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])),
        lambda a, b: toxicity.bucketed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]),
    ]
    for step in work:
        tracemalloc.start()
        for a, b in shared.slices(offsets):
            step(a, b)
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        print("MB of work arrays:", peak)
        assert peak < 64


def test_forests():
    """Every pair left out joins what the forests' pairs connect."""
    rng = np.random.default_rng(8)
    ends = rng.integers(0, 60, (2, 900)) * 1_000_003
    for most in (1, 4):
        keep = minhash.forests(ends, most)
        assert 0 < keep.sum() <= most * 59
        up = {int(v): int(v) for v in ends.ravel()}
        for a, b in ends[:, keep].T.tolist():
            old, new = up[a], up[b]
            up = {v: new if r == old else r for v, r in up.items()}
        assert all(up[a] == up[b] for a, b in ends.T.tolist())
    assert minhash.forests(ends, minhash.ALL).all() and not minhash.forests(ends[:, :0], 1).size


def test_may_link():
    rng = random.Random(3)
    sets = [np.array(sorted(rng.sample(range(600), rng.choice([3, 100, 255, 256, 400]))), np.uint32) for _ in range(40)]
    import pyarrow as pa

    x = minhash.least_hashes(pa.array([None, *(s[: minhash.BOTTOM].tobytes() for s in sets)], pa.binary()))[1:]
    i, j = np.triu_indices(40, 1)
    got = minhash.may_link(x[i], x[j], 40)
    for a, b, g in zip(i, j, got, strict=True):
        s, t = set(sets[a].tolist()), set(sets[b].tolist())
        if len(s) < 256 and len(t) < 256:
            assert g == (len(s & t) >= 0.39 * len(s | t))
        elif len(s & t) >= 0.5 * len(s | t):
            assert g


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.component_id for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


# -- 2


def brute_spots(text, chain=2):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    if not words:
        return set()
    content, tied = [], ""
    for k, w in enumerate(words):
        if w in spotsigs.ANCHORS and k < len(words) - 1:
            tied += w + "\x01"
        else:
            content.append((tied, w))
            tied = ""
    found = {(t + w, *(x for _, x in content[i + 1 : i + chain])) for i, (t, w) in enumerate(content) if t and i + chain - 1 < len(content)}
    if not found and len(content) > chain:  # no anchor leads a chain: neighbouring words
        found = {tuple(t + w for t, w in content[i : i + chain + 1]) for i in range(len(content) - chain)}
    return found or {("all", " ".join(words))}


@pytest.mark.parametrize("chars", [spotsigs.RANGE_CHARS, 20_000])
def test_spotsigs(spark, docs, monkeypatch, chars):
    """In one range of neighbours, and in many."""
    monkeypatch.setattr(spotsigs.with_next, "__defaults__", (chars,))
    docs = docs.union(spark.createDataFrame([(210 + k, f"kein anker hier wort{k} zwei drei vier", "xx", "s", 1, 2, 3) for k in range(3)], docs.schema))
    got = spotsigs.fingerprints(docs).collect()
    rows = sorted(((i, t or "") for i, t in rows_of(docs)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    edited = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        edited.setdefault(i, []).append((t, t[: len(t) - h] + nxt[:h], nxt))
    assert len(got) == len(rows)
    like = lambda a, b: 1.0 if not (a | b) else len(a & b) / len(a | b)
    by_print = {}
    for r in got:
        ways = edited[r.doc_id]
        assert any(hashlib.sha256(e.encode()).hexdigest() == r.edited_sha256 and len(t) == r.n_chars and abs(like(brute_spots(t), brute_spots(e)) - r.near_edited) < 1e-9 and abs(like(brute_spots(t), brute_spots(n)) - r.near_next) < 1e-9 for t, e, n in ways)
        by_print.setdefault(ways[0][0], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_print.values())
    assert spotsigs.fingerprints(empty(spark, docs)).count() == 0


def test_spotsigs_pairs(spark, docs):
    rows = {}
    for i, t in sorted(r for r in rows_of(docs) if r[0] is not None and brute_spots(r[1])):
        rows.setdefault(frozenset(brute_spots(t)), i)
    want = {(min(a, b), max(a, b)) for x, a in rows.items() for y, b in rows.items() if a < b and len(x & y) >= 0.5 * len(x | y)}
    got = {(r.a, r.b) for r in spotsigs.documents_alike(docs.where("doc_id is not null")).collect()}
    assert got == want


# -- 3


def test_embedding(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 8))
    v = [(centre[i % 12] + rng.normal(size=8) * 0.25).astype(np.float32).tolist() for i in range(240)]
    v += [v[0], v[0], [0.0] * 8, None, [float("nan")] * 8, [1.0] * 7 + [None], [float("inf")] * 8, [x * 2 for x in v[5]], [1e30] * 8, [1e-30] * 8]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, v array<float>")
    ok = {i: np.array(x, np.float64) for i, x in enumerate(v) if x is not None and None not in x and np.isfinite(x).all() and any(x)}
    unit = {i: (x / np.abs(x).max()) / np.linalg.norm(x / np.abs(x).max()) for i, x in ok.items()}
    links = {i: [j for j in unit if j != i and unit[i] @ unit[j] >= 0.9] for i in unit}

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    for block in (32, 8192):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.embedding_links(df, block=block).collect()}
        assert got == {i: (len(links.get(i, [])), reach(i), reach(i) == i) for i in range(len(v))}
    assert embedding.embedding_links(df.limit(0)).count() == 0
    # vectors of other lengths among them, repeated ids of other vectors, a clashing column
    more = df.union(spark.createDataFrame([(900, [1.0, 0.0]), (901, [1.0, 0.1]), (902, []), (900, [0.0, 1.0]), (903, [0.0, 2.0])], df.schema)).withColumn("rep", F.lit(1)).withColumn("first_id", F.lit(1))
    rows = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding.embedding_links(more, block=32).collect())
    assert [r for r in rows if r[0] >= 900] == [(900, 1, 900), (900, 1, 900), (901, 1, 900), (902, 0, 902), (903, 1, 900)]
    assert [r for r in rows if r[0] < 900] == [(i, len(links.get(i, [])), reach(i)) for i in range(len(v))]
    ids, counts, roots = embedding.links_between((np.arange(3), np.ones(3, np.int64), np.eye(3)), None, np.eye(3), 0.9, leaf=1)
    assert counts.tolist() == [0, 0, 0] and roots.tolist() == [0, 1, 2]


# -- 4


@pytest.mark.parametrize("small, step", [(512, 4000), (512, 2), (1, 4000)])
def test_suffix(spark, docs, monkeypatch, small, step):
    """Null, empty and long texts, repeated rows, a null id, clashing columns; hot and cut groups."""
    monkeypatch.setattr(suffix, "SMALL", small)
    monkeypatch.setattr(suffix.compared, "__defaults__", (step,))
    texts = [(i, (t or "").encode()) for i, t in rows_of(docs)]
    n = 200
    seen = collections.Counter(b[s : s + n] for _, b in texts for s in range(len(b) - n + 1))
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if seen[b[s : s + n]] > 1:
                gone[s : s + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix.remove_repeats(docs).drop("kept").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert suffix.remove_repeats(empty(spark, docs)).count() == 0


def test_suffix_long_run(spark):
    """A text of one letter, every byte of which begins a string that starts elsewhere too."""
    import time

    rows = spark.createDataFrame([(1, "a" * 300_000), (2, "b" * 199), (3, "c" * 201)], DOC)
    began = time.time()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(rows).collect()}
    assert got == {1: (300_000, 300_000, 1), 2: (199, 0, 0), 3: (201, 201, 1)} and time.time() - began < 120


def test_string_ranks():
    """Ranks against the sorted strings; groups of triggers that end anywhere in a batch."""
    rng = np.random.default_rng(2)
    for length in (8, 13, 200):
        text = rng.integers(97, 99, 900, dtype=np.uint8)
        text[400:700] = text[100:400]
        starts = np.sort(rng.choice(900 - length, 300, replace=False))
        strings = [text[k : k + length].tobytes() for k in starts]
        order = {x: i for i, x in enumerate(sorted(set(strings)))}
        assert suffix.string_ranks(text, starts, length).tolist() == [order[x] for x in strings]


# -- 5 and 9


ALPHABET = ["a", "s", "'", "'s", "'re", "'ll", "'l", " ", "  ", "\n", "\t", "1", "²", "é", "日本", "!", "<|endoftext|>", "🙂", "́", "\x1c", "\r\n", "don't", "I'LL", "''", "\xa0", "٣", "​"]


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "a" * 5000, "aaa " * 999]
    library = Tokenizer.from_file(bpe.vocabulary_path())
    texts += [" " * 1_000_000, "\n" * 200_000 + "x", "<|endoftext|>" * 3, "<|endoftext|>a<|endoftext|>"]
    ids = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    vocab = bpe.Vocabulary(bpe.vocabulary_path())
    for part in (slice(0, 1000), slice(None), slice(500, 2500)):  # with pre-tokens known from before
        assert vocab.count_texts(texts[part]).tolist() == [len(x) for x in ids[part]]
        found, at = vocab.encode_texts(texts[part])
        assert [found[a:b].tolist() for a, b in zip(at, at[1:])] == ids[part]
    assert vocab.encode_texts([])[0].tolist() == [] and vocab.encode_texts(["", ""])[1].tolist() == [0, 0, 0]


def test_added_tokens_with_context_are_refused(tmp_path):
    import json

    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        model = json.load(f)
    model["added_tokens"][0]["lstrip"] = True
    (tmp_path / "v.json").write_text(json.dumps(model))
    with pytest.raises(ValueError, match="added tokens"):
        bpe.Vocabulary(str(tmp_path / "v.json"))


def test_token_counts(spark, docs):
    got = bpe.token_counts(docs).collect()
    assert len(got) == docs.count() and all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got}[201] == (0, 0)
    assert bpe.token_counts(empty(spark, docs)).count() == 0


def test_bin_completion():
    for seed, n in enumerate([0, 1, 30, 400, 3000]):
        rng = random.Random(seed)
        counts = collections.Counter(min(99, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(n))
        plan = packing.bin_completion(counts, 100)
        held = collections.Counter()
        for times, lengths in plan:
            assert sum(lengths) <= 100 and times > 0
            for x in lengths:
                held[x] += times
        assert held == counts
        used, bound = sum(t for t, _ in plan), -(-sum(k * v for k, v in counts.items()) // 100)
        assert bound <= used <= sum(t for t, _ in packing.best_fit(dict(counts), 100))
    assert packing.best_fit({60: 2, 40: 2}, 100) and sum(n for n, _ in packing.bin_completion({6: 1, 5: 2, 4: 1, 3: 2, 2: 2}, 10)) == 3


@pytest.mark.parametrize("seed", [0, 3, 6])
def test_bin_completion_finds_better_than_best_fit(seed):
    """Triplets that fill their bins: the optimum is known, and best fit misses it."""
    rng = random.Random(seed)
    size, bins = 100, 12
    counts = collections.Counter()
    for _ in range(bins):
        a, b = rng.randrange(26, 49), rng.randrange(26, 49)
        counts.update([a, b, size - a - b])
    assert sum(n for n, _ in packing.best_fit(dict(counts), size)) > bins
    plan = packing.bin_completion(counts, size)
    assert sum(n for n, _ in plan) == bins and all(sum(x) == size for _, x in plan)


def test_bin_completion_is_exact():
    """Small histograms against all packings; fillings of far more than eight items take part."""

    def least(items, rooms):
        if not items:
            return len(rooms)
        found = least(items[1:], (*rooms, 20 - items[0])) if len(rooms) < 9 else 99
        for k in {r: i for i, r in enumerate(rooms) if r >= items[0]}.values():
            found = min(found, least(items[1:], tuple(sorted((*rooms[:k], rooms[k] - items[0], *rooms[k + 1 :])))))
        return found

    rng = random.Random(3)
    for _ in range(25):
        items = sorted((rng.randrange(4, 14) for _ in range(9)), reverse=True)
        plan = packing.bin_completion(collections.Counter(items), 20, nodes=100_000)
        assert sum(n for n, _ in plan) == least(items, ())
    assert packing.bin_completion({1: 2040, 8: 1}, 2048) == [(1, (8, *[1] * 2040))]
    counts = {700: 300, 690: 200, 650: 400, 30: 50}
    assert sum(n for n, _ in packing.bin_completion(counts, 2048)) < sum(n for n, _ in packing.best_fit(counts, 2048)) - 40


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    docs = docs.union(spark.createDataFrame([(800, " " * 1_000_000, "en", "s", 1, 2, 3)], docs.schema))
    got = packing.pack_documents(docs).collect()
    want = collections.Counter()
    for i, t in rows_of(docs):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack_documents(empty(spark, docs)).count() == 0


# -- 6


@pytest.mark.parametrize("members", [False, True])
def test_warc_round_trip(spark, tmp_path, members):
    """Null and long payloads, repeated page_ids with equal and other payloads, a null page_id."""
    rows = [(1, "http://a/1", "same"), (2, "http://a/2\r\nX: y", "same"), (3, None, None), (4, "", ""), (5, "u", "é" * 5000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "alone"), (7, "u", "same"), (8, "u", "solo")]
    rows += [(20, "a", "X"), (20, "a", "Y"), (30, "b", "Y"), (40, "c", "twice"), (40, "c", "twice"), (41, "d", "long " * 400_000)]
    pages = spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, sha long, payload string").repartition(3)
    found = warc.with_digests(pages)
    links = warc.revisits(found)
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(found.join(links, ["page_id", "sha"], "left"), folder, target_bytes=300, members=members)
    got = collections.defaultdict(list)
    for r in warc.read_archives(index, folder).collect():
        got[r.page_id, r.payload_digest].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        for r in got[i, warc._digest(data)]:
            assert r.payload_bytes == len(data) and bytes(r.payload) == (data if r.record_type == "response" else b"")
    assert {i: r.refers_to for (i, _), rs in got.items() for r in rs if r.refers_to} == {1: 7, 2: 7, 3: 4, 20: 30}
    assert [r.record_type for r in got[40, warc._digest(b"twice")]] == ["response"] * 2
    some = index.where("page_id in (5, 6)")
    assert {r.page_id for r in warc.read_archives(some, folder, gap=0).collect()} == {5, 6}
    assert warc.read_archives(index.limit(0), folder).count() == 0
    assert warc.read_archives(index, folder).rdd.getNumPartitions() == 1
    assert [(a, b, m) for a, b, m in warc.coalesced([(0, 5), (5, 5), (30, 5)], 10, 100)] == [(0, 10, [0, 1]), (30, 35, [2])]
    assert not warc.revisits(found, min_bytes=1).where("page_id = 3").count()


def test_warc_of_no_pages(spark, tmp_path):
    """No page, no archive, no row; folders go by the names their stores have in Arrow."""
    none = spark.createDataFrame([], "page_id long, url string, html string")
    none.write.parquet(f"file://{tmp_path}/pages.parquet")
    assert warc.op6_warc(spark, f"file://{tmp_path}").count() == 0
    assert warc._arrow_uri("s3a://bucket/x") == "s3://bucket/x" and warc._arrow_uri("file:///x") == "file:///x" and warc._arrow_uri("/x") == "/x"
    with pytest.raises(ValueError, match="viewfs"):
        warc._arrow_uri("viewfs://store/x")


def test_warc_headers():
    """The headers that WARC/1.1 asks of each record, and ids of their own for repeated page_ids."""
    one = warc.record_bytes(7, "http://a", b"<p>", warc._digest(b"<p>"), None, date="2024-01-02T03:04:05Z").decode()
    two = warc.record_bytes(7, "http://a", b"<q>", warc._digest(b"<q>"), 9, "http://b").decode()
    for name in ("WARC-Type: ", "WARC-Record-ID: <", "WARC-Date: ", "Content-Type: application/http", "Content-Length: "):
        assert f"\r\n{name}" in one and f"\r\n{name}" in two
    assert one.endswith("\r\n\r\n<p>\r\n\r\n") and "<q>" not in two and f"WARC-Refers-To: {warc.record_id(9, warc._digest(b'<q>'), 'http://b')}" in two
    assert one.split("Record-ID: ")[1].split("\r")[0] != two.split("Record-ID: ")[1].split("\r")[0]


# -- 7


def brute_lines(texts):
    """Every run of the weight, of any length, that started earlier: the lines that go, by text."""
    first, gone = {}, collections.defaultdict(set)
    for i, ls in sorted(texts.items()):
        for p in range(len(ls)):
            for q in range(p + 1, min(len(ls), p + 40) + 1):
                if sum(x.count(" ") + 1 for x in ls[p:q]) >= 8 and first.setdefault(tuple(ls[p:q]), (i, p)) != (i, p):
                    gone[i] |= set(range(p, q))
    return gone


def test_lines(spark, docs):
    """Null, empty and long texts, repeated rows, ties, columns named like those of the operator."""
    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    df = df.union(spark.createDataFrame([(300 + k, t, "en", "s", 1, 2, 3) for k, t in enumerate(["a b c d\nx\ne f g h", "q\na b c d\nx\ne f g h", "long line of eight words or more now\nz", "z\nlong line of eight words or more now\n\n", "r\n" * 30])], df.schema))
    texts = {i: (t or "").split("\n") for i, t in rows_of(df)}
    gone = brute_lines(texts)
    for clash in ({}, {c: F.lit("mine") for c in ("gone", "gone_id", "text_key", "_lines", "lines", "row", "i", "r1", "n_lines", "n_removed", "need")}):
        got = lines.without_repeats(df.withColumns(clash)).collect()
        assert len(got) == len(texts)
        for r in got:
            ls = texts[r.doc_id]
            assert (r.n_lines, r.n_removed) == (len(ls), len(gone[r.doc_id])) and r.text == "\n".join(x for k, x in enumerate(ls) if k not in gone[r.doc_id])
            assert r.lang == "en" and (not clash or r.gone == r.row == r._lines == "mine")
    assert lines.without_repeats(empty(spark, docs)).count() == 0
    assert lines.without_repeats(docs).count() == docs.count()


def test_maximal_lines(spark):
    """Runs of many lengths and weights against brute force; copies leave no tail."""
    import corpus_pipeline

    rng = random.Random(8)
    line = lambda: " ".join(rng.choice("ab") for _ in range(rng.choice([1, 1, 2, 3, 9])))
    base = [[line() for _ in range(rng.randrange(1, 24))] for _ in range(12)]
    texts = [b[rng.randrange(len(b)) :] + rng.choice(base)[: rng.randrange(1, 14)] for b in base * 3]
    texts += [["long line of eight words or more now", "its tail."]] * 2 + [["r"] * 30, [""] * 12, ["x"] * 7, ["x"] * 7]
    texts += [[f"u{k}" for k in range(n)] for n in range(5, 14)] + [[f"v{n}", *(f"u{k}" for k in range(3, 3 + n))] for n in range(1, 10)]
    gone = brute_lines(dict(enumerate(texts)))
    df = spark.createDataFrame([(i, "\n".join(ls), 0) for i, ls in enumerate(texts)], DOC + ", n_chars long").repartition(3)
    got = {r.doc_id: r for r in lines.without_repeats(df).collect()}
    for i, ls in enumerate(texts):
        assert (got[i].n_removed, got[i].text) == (len(gone[i]), "\n".join(x for k, x in enumerate(ls) if k not in gone[i]))
    kept = {r.doc_id for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}
    assert kept == {i for i, ls in enumerate(texts) if len(gone[i]) < len(ls)} and 37 not in kept


def test_line_ranks_are_a_suffix_order(spark):
    """Ranks of two lines grow with the suffixes' order and are equal only for equal pairs."""
    rows = spark.createDataFrame([(i, k, j, c, 1) for i, (k, t) in enumerate([(1, "abcabd"), (2, "bcab"), (3, "abc")]) for j, c in enumerate(t)], "doc_id long, text_key long, i int, id string, need int")
    one = rows.join(lines.intervals(rows, "id"), "id").select(*lines.PLACE, "need", "id", F.col("rank").alias("r1"))
    two = lines.doubled(one.drop("id"), 1).where("r2 is not null").join(one.select(*lines.PLACE, "id"), list(lines.PLACE)).collect()
    text = {0: "abcabd", 1: "bcab", 2: "abc"}
    pairs = {(text[r.doc_id][r.i : r.i + 2], r.r2) for r in two}
    assert {p for p, _ in pairs} == {"ab", "bc", "ca"} and len(pairs) == 3
    assert [p for p, _ in sorted(pairs, key=lambda x: x[1])] == ["ab", "bc", "ca"]


# -- 8


def test_pfair_schedule():
    """Against a plain simulation with fractions; every block in its window, under one block of lag."""
    from fractions import Fraction

    rng = random.Random(4)
    for _ in range(15):
        weights = {f"s{k}": rng.random() ** 3 + 1e-4 for k in range(rng.randrange(1, 9))}
        exact = mixing.whole(weights)
        total = sum(exact.values())
        w = {s: Fraction(a, total) for s, a in exact.items()}
        assert all(w[s] == Fraction(weights[s]) / sum(map(Fraction, weights.values())) for s in w)
        had = dict.fromkeys(weights, 0)
        for t, (s, j) in enumerate(mixing.schedule(exact, 300)):
            released = {x: (-(-(had[x] + 1) // w[x]), x) for x in w if had[x] // w[x] <= t}  # deadline of the next block
            assert (s, j) == (min(released.values())[1], had[min(released.values())[1]])
            assert j / w[s] < t + 1 and t < (j + 1) / w[s]
            had[s] += 1
            assert all(abs(had[x] - w[x] * (t + 1)) < 1 for x in w)


def test_mixing(spark, docs):
    """Null sources, null and long texts, repeated rows; columns named like those of the operator."""
    clash = {c: F.lit("mine") for c in ("s", "p", "given", "used", "within", "block", "row", "mix_source", "mix_part", "mix_slot", "part_start")}
    got = mixing.mixed(docs.withColumns(clash), {"s0": 1, "s1": 2, "s2": 1, "": 1}, block_chars=500).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows_of(docs)}
    assert all(r.mix_release < r.mix_slot + 1 and r.mix_slot < r.mix_deadline + 1 for r in got)
    assert all(r.block == r.s == r.within == r.row == r.mix_source == "mine" for r in got)
    slots = {}
    for r in got:
        assert slots.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block)
    once = collections.Counter((r.doc_id, r.text) for r in got if r.mix_epoch == 0)
    assert once == collections.Counter(rows_of(docs))  # the first epoch holds every row once
    with pytest.raises(ValueError):
        mixing.mixed(docs, {"s0": 1})
    assert mixing.mixed(empty(spark, docs)).count() == 0


@pytest.mark.parametrize("weights", [{"big": 1.0, "mid": 0.1, **{f"t{k}": 3.7e-4 for k in range(5)}}, {f"s{k}": 1.0 + (k % 7) ** 2 for k in range(1100)}])
def test_mixing_exact_weights(spark, weights):
    """Tiny and more than 1000 sources: under one block from the weights as they were given."""
    rows = [(k, "x" * 10, s) for k, s in enumerate(weights)] + [(9000 + k, "y" * 10, next(iter(weights))) for k in range(40)]
    rows += [(20_000 + k, "", next(iter(weights))) for k in range(40)]
    df = spark.createDataFrame(rows, DOC + ", source string")
    got = mixing.mixed(df, weights, block_chars=10).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    slots = {r.mix_slot: r.source for r in got}
    order = [slots[t] for t in range(len(slots))]
    total, had = sum(weights.values()), collections.Counter()
    for t, s in enumerate(order, 1):
        had[s] += 1
        assert abs(had[s] - weights[s] / total * t) < 1 + 1e-9
        if t % 97 == 0 or t == len(order):
            assert all(abs(had[x] - w / total * t) < 1 + 1e-9 for x, w in weights.items())


# -- 10


def test_toxicity(spark, docs):
    d, lab = (shared.read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = toxicity.toxicity(d, lab, 400).join(lab, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([[(a > b) + (a == b) / 2 for b in good[1]] for a in good[0]])
    assert auc > 0.8  # 30 toxic documents to learn from; more data does better
    model, thresholds = toxicity.fitted(d, lab.limit(0))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and thresholds == {}
    assert toxicity.scored(empty(spark, docs), model).count() == 0
    text = np.frombuffer("the scum of it all".encode(), np.uint8)
    words, before = toxicity.bucketed(text, np.array([0, len(text)]))
    assert np.array_equal(model.pooled(words, before), model.pooled(words, before, chunk=2))


def test_toxicity_columns(spark, docs):
    """An earlier score is replaced; null, empty and long texts and repeated rows have scores."""
    d, lab = (shared.read_table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    model, _ = toxicity.fitted(d, lab)
    got = toxicity.scored(docs.withColumn("score", F.lit("mine")), model)
    assert got.columns == [*docs.columns, "score"]
    rows = got.select("doc_id", "text", "score").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (200, 201, 202)}) == 1 and len({r.score for r in rows if r.doc_id == 206}) == 1
    few = toxicity.training_sample(d, lab, most_words=500)
    words = collections.Counter()
    for r in few:
        words[r.toxic] += len(r.words) // 4
    assert few and all(n <= 500 for n in words.values())


def test_toxicity_learns_from_all(spark, monkeypatch):
    """What only documents late in the order of the ids' hash show is learned too, in one shard or in
    many; each document that may teach stands in one shard."""
    ids = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), F.row_number().over(W.partitionBy(F.col("id") % 2).orderBy(F.xxhash64("id"))).alias("k"))
    word = F.when(F.col("toxic") == 0, "calm").when(F.col("k") <= 3300, "blip").otherwise("zork")
    d = shared.saved(ids.select("doc_id", "toxic", F.lit("en").alias("lang"), F.concat(F.lit("word "), (F.col("doc_id") % 50).cast("string"), F.lit(" is "), word).alias("text")), "test")
    new = spark.createDataFrame([(1, "word 3 is zork"), (2, "word 3 is calm")], "doc_id long, text string")
    rows = toxicity.training_rows(d, d.select("doc_id", "toxic"))
    expected = d.where(~toxicity.held_out()).count()
    for words in (toxicity.SHARD_WORDS, 6000):
        monkeypatch.setattr(toxicity, "SHARD_WORDS", words)
        model, thresholds = toxicity.fitted(d, d.select("doc_id", "toxic"))
        score = {r.doc_id: r.score for r in toxicity.scored(new, model).collect()}
        assert score[1] > 0.9 and score[2] < 0.1 and 0.1 < thresholds["en"] < 0.9
    counts = {r.bucket: r.n for r in toxicity.bucket_counts(rows).collect()}
    assert max(counts.values()) == rows.count() == expected
    shards = toxicity.sharded(rows, np.sort(np.array(list(counts))), 5)
    assert shards.count() == expected and shards.select("shard").distinct().count() == 5


def test_toxicity_shuffles_what_may_teach(spark, monkeypatch):
    """Texts without a label stay out of the shuffled join but for a few, and none with one is lost, also
    where the map of ids is full."""
    rows = spark.range(-20_000, 20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    known = rows.where("doc_id % 40 = 0").select("doc_id")
    got = toxicity.mapped(rows, known)
    assert got.columns == rows.columns and got.join(known, "doc_id").count() == 1000 and got.count() < 8000
    assert toxicity.mapped(rows, known.limit(0)).count() == 0
    monkeypatch.setattr(toxicity, "PLACES", 64)
    assert toxicity.mapped(rows, known).join(known, "doc_id").count() == 1000
    shards = toxicity.sharded(spark.range(700).selectExpr("1 as toxic", "'en' as lang", "cast('' as binary) as words", "id as doc_id"), np.zeros(0, np.int64), 7)
    assert shards.select("shard", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().where("count > 1").isEmpty()


def test_long_texts_in_chunks(monkeypatch):
    """Responses are held for so many words at once; the loss and its gradients do not depend on it."""
    rng = np.random.default_rng(3)
    p = toxicity.first_parameters(20)
    texts = [rng.integers(0, 21, n) for n in (40, 0, 3, 17)]
    args = p, texts, np.array([1.0, 0.0, 1.0, 0.0]), np.ones(4), np.ones((4, toxicity.FILTERS * len(toxicity.WIDTHS)))
    whole = toxicity.loss_and_gradients(*args)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    parts = toxicity.loss_and_gradients(*args)
    assert abs(whole[0] - parts[0]) < 1e-12 and np.array_equal(whole[2], parts[2]) and np.allclose(whole[3], parts[3])
    assert all(np.allclose(whole[1][k], parts[1][k]) for k in whole[1])


def test_convolution_and_gradients():
    """The table look-ups against plain loops, and the gradients against differences of the loss."""
    rng = np.random.default_rng(5)
    total = toxicity.FILTERS * len(toxicity.WIDTHS)
    p = {"e": rng.normal(0, 0.5, (6, toxicity.DIM)), "b": rng.normal(0, 0.1, total), "w": rng.normal(0, 0.5, total), "o": rng.normal(0, 0.1, 1)}
    p |= {f"f{w}": rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS}
    p["e"][0] = 0
    texts = [np.array([1, 2, 0, 3, 5]), np.array([4]), np.array([2, 2, 1])]
    model = toxicity.Model(np.arange(6), p["e"], [p[f"f{w}"] for w in toxicity.WIDTHS], p["b"], p["w"], 0.0)
    pooled = model.pooled(np.concatenate([*texts, []]).astype(np.int64), np.array([0, 5, 6, 9, 9]))
    for t, got in zip([*texts, np.zeros(0, np.int64)], pooled, strict=True):
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                at = lambda i: p["e"][t[i]] if i < len(t) else np.zeros(toxicity.DIM)  # noqa: E731, B023
                best = [sum(at(i + j) @ p[f"f{w}"][j][:, f] for j in range(w)) for i in range(len(t))]
                column = k * toxicity.FILTERS + f
                assert abs(got[column] - max([0, *(x + p["b"][column] for x in best)])) < 1e-4
    labels, cost, keep = np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.2, 0.7]), np.ones((3, total))
    loss, g, hit, ge = toxicity.loss_and_gradients(p, texts, labels, cost, keep)
    full = g | {"e": np.zeros_like(p["e"])}
    full["e"][hit] = ge
    for name, grad in full.items():
        for spot in rng.choice(grad.size, min(grad.size, 12), replace=False):
            place = np.unravel_index(spot, grad.shape)
            if name == "e" and place[0] == 0:
                continue
            q = {k: v.copy() for k, v in p.items()}
            q[name][place] += 1e-5
            assert abs((toxicity.loss_and_gradients(q, texts, labels, cost, keep)[0] - loss) / 1e-5 - grad[place]) < 1e-3


# -- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    source = shared.read_table(spark, SF, "documents")
    df, kept = source, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = shared.saved(stage(spark, df, SF), "test-stage")
        assert df.columns == source.columns
        kept[name] = df
    assert kept["toxicity"].count() < source.count() and kept["near-dedup"].count() <= kept["line dedup"].count()
    clean = dict(rows_of(kept["near-dedup"]))
    groups = brute_groups(list(dict(rows_of(kept["line dedup"])).items()))
    assert set(clean) == {i for i, (_, c) in groups.items() if i == c}
    assert {i for i, _ in rows_of(kept["mixing"])} == set(clean)
    packed = corpus_pipeline.pack(spark, df, SF)
    assert packed.where("piece = 0").count() == df.count() and not df.select("doc_id").exceptAll(packed.where("piece = 0").select("doc_id")).count()


def test_bin_completion_ends():
    """A histogram on which the search has very many fillings and skipped steps: all effort counts."""
    counts = {k: 200 for k in range(2, 1023, 2)} | {1025: 5000}
    effort = packing.Effort(200_000)
    incumbent = packing.best_fit(dict(counts), 2048)
    found = packing.searched(counts, 2048, incumbent, False, effort)
    assert effort.left < 0 and sum(n for n, _ in found) <= sum(n for n, _ in incumbent)
    plan = packing.bin_completion(counts, 2048, nodes=1_000)
    held = collections.Counter()
    for times, lengths in plan:
        assert sum(lengths) <= 2048
        for x in lengths:
            held[x] += times
    assert held == counts and sum(n for n, _ in plan) < sum(n for n, _ in incumbent)
