"""Spelling variants, the conversation trie and the URL filter against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from cairnlog.llm import conversations, spelling, urls

# -- 11


def brute_near(words):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    return {a: [b for b in words if near(a, b)] for a in words}


def brute_spelling(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if i is not None:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % 97 == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    near, form = brute_near(list(counts)), {}
    for w, others in near.items():
        top = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = top if top is not None and counts[top] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def spelled(rng, n):
    """Words of few letters, so that many are near each other; some with letters beyond ASCII."""
    return [("".join(rng.choice("abé") for _ in range(rng.choice([5, 6, 7, 8]))), int(2 + 40 * rng.random() ** 3)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    """Nulls, empty and long texts, ties, repeated rows, a null id, upper case, clashing columns."""
    rng = random.Random(11)
    words = [w for w, n in spelled(rng, 120) for _ in range(n)]
    rng.shuffle(words)
    rows = [(i, " ".join(words[k : k + 9]).replace("ab", "AB", 1)) for i, k in enumerate(range(0, len(words), 9))]
    rows += [(900, None), (901, ""), (902, "12 - 34"), (903, "À÷×ÿÀ " * 4), (904, "hello" + "o" * 70_000), (905, "tionz " * 20_000), rows[0], rows[0], (None, rows[1][1]), (906, "aba\U0001f642bab bab\u0000abaab")]
    return rows, spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n long, word string, list string").repartition(3)


@pytest.mark.parametrize("rare", [64, 8, 1])
def test_spelling(spark, texts, monkeypatch, rare):
    """At 64 no gram is frequent; at 1 many words have no rare gram that an edit leaves."""
    monkeypatch.setattr(spelling, "RARE", rare)
    rows, docs = texts
    got = {tuple(r) for r in spelling.spelling_variants(docs).collect()}
    assert got == brute_spelling(rows)
    assert spelling.spelling_variants(spark.createDataFrame([], docs.schema)).count() == 0


def test_near_words_share_a_list():
    """Every near pair meets in a list of the right roles, whatever the dictionary."""
    rng = random.Random(3)
    for trial in range(40):
        words = sorted({w for w, _ in spelled(rng, 60)})
        grams = collections.Counter((w + "$")[p : p + q] for w in words for p in range(len(w)) for q in range(2, 7) if p + q <= len(w) + 1)
        dictionary = {g: c for g, c in grams.items() if c > trial}
        lists = {w: spelling.lists_of(w, dictionary) for w in words}
        for a, others in brute_near(words).items():
            for b in others:
                roles = [(ra, rb) for (x, ra), (y, rb) in itertools.product(lists[a], lists[b]) if x == y]
                assert (2, 2) in roles if len(a) == len(b) else ((0, 1) if len(a) > len(b) else (1, 0)) in roles


def test_gram_dictionary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(spelling, "DICTIONARY", 8)
    monkeypatch.setattr(spelling, "RARE", 0)
    words = spark.createDataFrame([("".join(w),) for w in itertools.product("ab", repeat=6)], "word string")
    found = spelling.gram_dictionary(words)
    assert max(collections.Counter(map(len, found)).values()) <= 8 and all(g[:-1] in found for g in found if len(g) > 2)


# -- 12


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns[c].append(((turn is not None, turn or 0), name, (role, text)))
    original = {c: [t[2] for t in sorted(v, key=lambda t: t[:2])] for c, v in turns.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(original.get(c - c % 100, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = set()
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        children = [q for q in below if len(q) == len(p) + 1]
        gain = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(ids) if len(rebuilt[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.add((min(ids), len(p), parent, len(ids), len(children), len(leaves), gain, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def turns(spark):
    """Shared beginnings, identical and turnless conversations, a missing lender, null turns, roles,
    texts and ids, ties, repeated rows, a long conversation and a long text, clashing columns."""
    rng = random.Random(12)
    rows = []
    for c in [*range(0, 60), *range(100, 140), *range(205, 225), 399]:
        for k in range(rng.choice([1, 2, 3, 4, 5, 7])):
            rows.append((c, k, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "c🙂c"])))
    rows += [(300, k, "user", "same") for k in range(37)] + [(301 + j, k, "user", "same") for j in range(4) for k in range(37)]
    rows += [(310, None, None, None), (310, None, "user", None), (310, 0, None, ""), (310, 0, "user", "tie"), (310, 0, "user", "eit"), (311, 1, "user", "x" * 50_000)]
    rows += [rows[0], rows[0], (None, 0, "user", "no one's")]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth long, x long").repartition(4)


@pytest.mark.parametrize("stretch", [1024, 4])
def test_trie(spark, turns, monkeypatch, stretch):
    monkeypatch.setattr(conversations, "STRETCH", stretch)
    rows, table = turns
    got = {tuple(r) for r in conversations.prefix_trie(table).collect()}
    assert got == brute_trie(rows)
    assert conversations.prefix_trie(spark.createDataFrame([], table.schema)).count() == 0


def test_trie_of_one_long_conversation(spark):
    """A conversation that lies in several ranges, and one without a rebuilt turn."""
    rows = [(7, k, "user", str(k % 3)) for k in range(300)]
    turnless = next(c for c in range(500, 600) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows.append((turnless, 0, "user", "gone"))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {tuple(r) for r in conversations.prefix_trie(table).collect()}
    assert got == brute_trie(rows)


# -- 13


def best_split(name, shares):
    unknown = lambda w: math.log(urls.SHARE) - len(w) * math.log(10)
    splits = []
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(name)]
        words = [name[a:b] for a, b in itertools.pairwise(edges)]
        splits.append((sum(shares.get(w, unknown(w)) for w in words), words))
    return max(s for s, _ in splits), splits


def test_segmentation_is_the_likeliest():
    shares = {w: math.log(p) for w, p in {"free": 0.01, "casino": 1e-4, "win": 1e-3, "in": 0.02, "wi": 1e-6, "a": 0.03, "no": 0.01, "ree": 1e-5}.items()}
    for name in ("freecasino", "casinowin", "awinno", "zzfreezz", "x", "freeafree"):
        top, splits = best_split(name, shares)
        got = urls.segmented(name, shares)
        assert "".join(got) == name and math.isclose(next(s for s, w in splits if w == got), top)
    assert urls.segmented("freecasino", shares) == ["free", "casino"] and urls.segmented("", shares) == []
    assert "".join(urls.segmented("q" * 3000, shares)) == "q" * 3000


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(13)
    good = ["garden", "music", "river", "essex", "stone", "green"]
    rows = []
    for k in range(160):
        host = "".join(rng.sample(good, 2)) if k % 5 else rng.choice(["casinowin", "freebets", "wincasino", "win-poker"])
        rows.append((k, f"http{'s' * (k % 2)}://{rng.choice(['www.', 'M.', ''])}{host}.Example.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['en', 'de', 'fr'])}/{k}{rng.choice(['', '?q=://x/y', '#a?b'])}"))
    rows += [(200, None), (201, ""), (202, "no scheme/net/"), (203, "://net"), (204, "http://NET/"), (205, "http://xnet/en"), (206, "http://a.example.net/en"), (207, "http://example.net/en/#x"), (208, "http://freewin.example.com"), (208, "http://freewin.example.com"), (None, "x://y.org/fr/\n?z"), (209, "http://" + "garden" * 4000 + ".com/" + "a/" * 9000), (210, "mailto:a?http://casino.org/fr/x"), (211, "http://a?://b.net/")]
    html = "<p>" + " ".join(["free", "win", *good, "bets"] * 30) + "</p><script>"
    return rows, spark.createDataFrame([(i, u, None if k % 7 == 0 else html, "r", 1.0) for k, (i, u) in enumerate(rows)], "page_id long, url string, html string, rule string, score double").repartition(3)


def plain_parts(url):
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", None
    host = re.match("(?s)[^/?#]*", rest)[0]
    path = re.match("(?s)[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, default=None)


def test_url_filter(spark, pages):
    rows, table = pages
    got = urls.judged(table).collect()
    assert sorted(map(repr, ((r.page_id, r.host, r.path) for r in got))) == sorted(map(repr, ((i, *plain_parts(u)[:2]) for i, u in rows)))
    # the scores, from the tokens, by plain counting
    bad = [r.tokens for r in got if set(r.tokens) & set(urls.MARKS)]
    good = [r.tokens for r in got if not set(r.tokens) & set(urls.MARKS)]
    nb, ng = (collections.Counter(w for t in x for w in set(t)) for x in (bad, good))
    size = len(set(nb) | set(ng)) + 1
    odds = {w: math.log((nb[w] + 1) / (nb.total() + size)) - math.log((ng[w] + 1) / (ng.total() + size)) for w in set(nb) | set(ng)}
    prior = math.log((len(bad) + 1) / (len(good) + 1))
    for r in got:
        fit = next(plain_parts(u)[2] for i, u in rows if i == r.page_id and plain_parts(u)[:2] == (r.host, r.path))
        assert r.rule == (fit and fit[1])
        assert math.isclose(r.score, prior + sum(odds[w] for w in set(r.tokens)), abs_tol=1e-6)
        assert r.verdict == (fit[2] if fit else "block" if r.score > 0 and r.tokens else "allow")
    free = [r for r in got if r.rule is None]
    assert all(r.verdict == "block" for r in free if re.search("casino|bets|poker", r.host))
    assert [r.host for r in free if r.verdict == "block" and not re.search("casino|bets|poker|win", r.host)] == []
    assert urls.judged(spark.createDataFrame([], table.schema)).count() == 0


def test_url_without_any_mark(spark):
    got = urls.judged(spark.createDataFrame([(1, "http://garden.com/x", "<p>garden</p>"), (2, None, None)], "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {(1, None, "allow"), (2, None, "allow")}
