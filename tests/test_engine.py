"""Decode, template, routing, incident, outbox and maintenance cases."""

import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlog.functions import decode, patterns, predicates, templates
from cairnlog.operators import incidents, maintenance, outbox, routing, semantic

NOW = datetime(2026, 7, 1, 12)


def lines(spark, *raws):
    return spark.createDataFrame([(i, r, NOW, p) for i, (r, p) in enumerate(raws)], "id long, raw string, received_at timestamp_ntz, peer string")


def test_decode_formats(spark):
    rows = {r.id: r for r in decode.decode_lines(lines(
        spark,
        ("<189>123: rtr-core-1: Jun 30 14:03:11.001 UTC: %LINK-3-UPDOWN: Interface Gi0/1, changed state to down", "10.0.0.9"),
        ("<34>1 2026-06-30T14:03:11.000Z host-a app-b 4321 ID47 - core dumped", "10.0.0.1"),
        ("<13>Jun 30 14:03:11 web-3 sshd[2211]: Failed password for root", "10.0.0.2"),
        ("this is not syslog at all", "10.0.0.42"),
        ("<34>1 2026 host-a - - - [a x=\"1\" x=\"2\"][b][a y=\"3\"] body ] x", ""),
        ("<999>1 too few", None),
        ("<13>Feb 29 14:03:11 web-3 msg", "p"),
        ("<13>Dec 31 23:00:00 web-3 tag: two\nlines", "p"),
        ("", "p"),
        (None, "p"),
        ("<13>Dec 31 23:00:00 web-3 tag: old", "p"),
    )).collect()}
    assert (rows[0].source, rows[0].program, rows[0].severity, rows[0].severity_text, rows[0].ts) == ("rtr-core-1", "%LINK-3-UPDOWN", 17, "err", NOW)
    assert rows[0].attributes == {"device_time": "Jun 30 14:03:11.001 UTC", "device_seq": "123"} and rows[0].facility == "local7"
    assert (rows[1].source, rows[1].program, rows[1].body, rows[1].attributes["procid"], rows[1].ts) == ("host-a", "app-b", "core dumped", "4321", datetime(2026, 6, 30, 14, 3, 11))
    assert (rows[2].source, rows[2].program, rows[2].attributes) == ("web-3", "sshd", {"pid": "2211"})
    assert (rows[3].source, rows[3].body, rows[3].ts, rows[3].severity) == ("10.0.0.42", "this is not syslog at all", NOW, None)
    assert rows[4].sd == {"a": {"y": "3"}, "b": {}} and rows[4].body == "body ] x" and rows[4].ts == NOW and rows[4].program is None
    assert rows[5].source == "unknown" and rows[5].body == "1 too few" and rows[5].facility == "124"
    assert rows[6].ts == NOW and rows[6].source == "web-3"
    assert rows[7].kind == "none"
    assert rows[8].body == "" and rows[10].ts == datetime(2025, 12, 31, 23)


def test_templates(spark):
    df = spark.createDataFrame([(1, "p", "Gi0/1 from 10.0.0.1:80 at 14:03:11"), (2, "p", "Gi0/2 from 10.9.0.1:81 at 15:00:00"), (3, "q", None)], "id long, program string, body string")
    a, b, c = templates.with_template(df).orderBy("id").collect()
    assert a.template == b.template and a.fp == b.fp and c.template == ""


def rule(i, pattern, order=1, stop=False, least=None, glob=None):
    return (i, f"r{i}", pattern, glob, least, order, stop)


RULE = "rule_id long, name string, pattern string, source_glob string, min_severity int, rule_order long, stop boolean"
EVENT = "id long, source string, severity int, severity_text string, program string, body string, ts timestamp_ntz"


@pytest.mark.parametrize(
    "rules, binds, body, severity, source, want",
    [
        ([rule(1, "flap")], [(1, 10)], "link flap detected", 17, "rtr-1", {(1, 10)}),
        ([rule(1, "flap")], [(1, 10)], "all healthy", 17, "rtr-1", set()),
        ([rule(1, "flap", least=18)], [(1, 10)], "flap", 13, "rtr-1", set()),
        ([rule(1, "flap", least=18)], [(1, 10)], "flap", None, "rtr-1", set()),
        ([rule(1, "flap", glob="sw-*")], [(1, 10)], "flap", 17, "rtr-1", set()),
        ([rule(1, "flap")], [(1, 10), (1, 11)], "flap", 17, "rtr-1", {(1, 10), (1, 11)}),
        ([rule(1, "flap"), rule(2, "flap", 2)], [(1, 10), (2, 10), (2, 11)], "flap", 17, "rtr-1", {(1, 10), (2, 11)}),
        ([rule(1, "flap", stop=True), rule(2, "flap", 2)], [(1, 10), (2, 11)], "flap", 17, "rtr-1", {(1, 10)}),
        ([rule(1, "allow", stop=True), rule(2, "allow", 2)], [(2, 11)], "allow this", 17, "rtr-1", set()),
        ([rule(1, "allow"), rule(2, "allow", 2)], [(2, 11)], "allow this", 17, "rtr-1", {(2, 11)}),
    ],
)
def test_route(spark, rules, binds, body, severity, source, want):
    r = spark.createDataFrame(rules, RULE)
    b = spark.createDataFrame([(*x, 1) for x in binds], "rule_id long, target_id long, target_order long")
    e = spark.createDataFrame([(1, source, severity, "err", "%X", body, NOW)], EVENT)
    got = routing.route(e, routing.compile_rules(r, b)).select("rule_id", "target_id").collect()
    assert {tuple(x) for x in got} == want


def test_bad_pattern_names_its_rule(spark):
    b = spark.createDataFrame([(1, 10, 1)], "rule_id long, target_id long, target_order long")
    with pytest.raises(ValueError, match="rule 1"):
        routing.compile_rules(spark.createDataFrame([rule(1, "(")], RULE), b)


def firings(spark, *seconds, key="k"):
    return spark.createDataFrame([(key, i, datetime.fromtimestamp(s), 1, 1, "s") for i, s in enumerate(seconds)], "key string, id long, ts timestamp_ntz, rule_id long, target_id long, source string")


def test_incident_boundaries(spark):
    df = firings(spark, 0, 30, 60, 100, 7299, 7300, 14500, 14500)
    want = ["opened", "throttled", "fed", "throttled", "fed", "throttled", "opened", "throttled"]
    for f in (incidents.dispositions, incidents.array_dispositions):
        assert [r.disposition for r in f(df, 7200, 60).orderBy("id").collect()] == want
    now = incidents.current_incidents(incidents.dispositions(df, 7200, 60)).collect()
    assert [(r.incident, r.event_count) for r in now] == [(2, 2)]


def test_rate_ceiling(spark):
    df = firings(spark, 0, key="a").union(firings(spark, 10, 61, key="b").withColumn("id", F.col("id") + 10))
    got = {r.id: r.disposition for r in incidents.with_ceiling(df, 1).collect()}
    assert got == {0: "opened", 10: "rate_limited", 11: "opened"}
    at_60 = firings(spark, 0, key="a").union(firings(spark, 60, key="b").withColumn("id", F.col("id") + 10))
    assert {r.id: r.disposition for r in incidents.with_ceiling(at_60, 1).collect()}[10] == "rate_limited"


def test_public_messages_hide_the_body(spark):
    r = spark.createDataFrame([(1, "leak é", "x")], "rule_id long, name string, pattern string")
    t = spark.createDataFrame([(1, "push", '{"topic":"night"}', None), (2, "handoff", '{"auto_approve":true,"auto_approve_tools":["a"]}', " ")], "target_id long, type string, config string, project string")
    secret = "root=hunter2 token=ABCDEF ip=10.0.0.9"
    d = spark.createDataFrame([(1, 1, 1, "s", "err", "p", secret, NOW, "opened"), (2, 1, 2, "s", "err", "p", secret, NOW, "opened")], "id long, rule_id long, target_id long, source string, severity_text string, program string, body string, ts timestamp_ntz, disposition string")
    push, hand = outbox.outbox(d, r, t).orderBy("id").collect()
    assert "hunter2" not in push.message + push.title and push.destination == "night" and push.title == "Alert: leak ? on s"
    assert "hunter2" in hand.message and '"auto_approve":' not in hand.options and '"project":"main"' in hand.options


def test_owner_resolution(spark):
    users = spark.createDataFrame([("aliceexample.com", "u1"), ("bob", "u2"), ("c@x", "u3")], "username string, user_id string")
    rows = spark.createDataFrame([(1, "alice@example.com"), (2, "bob@else"), (3, "c@x"), (4, "nobody"), (5, " "), (6, None)], "target_id long, owner_upn string")
    got = {r.target_id: r.owner_id for r in outbox.resolve_owners(rows, users).collect()}
    assert got == {1: "u1", 2: "u2", 3: "u3", 4: None, 5: None, 6: None}


def test_quarantine(spark):
    rows = [("a", "regex", "x", "sliding", ""), ("b", "other", "x", "sliding", ""), ("", "regex", "x", "sliding", ""), ("d", "regex", "x", "odd", ""), ("e", "regex", "(a+)+", "sliding", ""), ("f", "regex", "a{1,2000}", "sliding", ""), ("g", "regex", "x", "sliding", "a,b"), ("h", "semantic", "(a+)+", "tumbling", "a b"), ("i", "regex", "y" * 513, "sliding", None)]
    got = [r.reason for r in routing.quarantine_rules(spark.createDataFrame(rows, "name string, kind string, pattern string, window_kind string, source_glob string")).collect()]
    assert got == [None, "kind", "empty", "window_kind", "nested quantifier", "repetition", "glob list", "glob blank", "too long"]
    rows = [("push", '{"url":"https://ok.example/x"}', "none", None), ("push", '{"url":"https://bad.example"}', "none", None), ("push", '{"url":"http://ok.example","token":"t"}', "none", None), ("handoff", "{}", "none", " "), ("handoff", '{"auto_approve":true}', "static-svc", "p"), ("pager", "{}", "none", "p"), ("push", "{}", "me", None)]
    got = [r.reason for r in routing.quarantine_targets(spark.createDataFrame(rows, "type string, config string, identity_policy string, project string"), ["ok.example"]).collect()]
    assert got == [None, "host", "token", "project", "auto_approve", "type", "identity"]


def test_globs_and_bounds(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("a[b",), ("A_B",)], "s string")
    pick = lambda t: [r.s for r in df.where(t).collect()]
    s = F.col("s")
    assert pick(predicates.glob_query(s, "a_*")) == ["a_b"] and pick(predicates.glob_window(s, "a_b")) == ["a_b", "axb", "a[b"]
    assert pick(predicates.glob_route(s, "a[!x]b")) == ["a_b", "a[b"] and pick(predicates.glob_route(s, "a[b")) == ["a[b"]
    with pytest.raises(ValueError):
        predicates.parse_bound("yesterday")


def test_verdict_and_gate(spark):
    replies = ['<think>{"fire": 1}</think> {"fire": true, "severity": "crit", "why": "x"} end', "nothing", '{"a": {"fire": false, "why": "y"}}', "{broken fire"]
    got = [r.v for r in spark.createDataFrame([(r,) for r in replies], "t string").select(semantic.extract_verdict(F.col("t")).alias("v")).collect()]
    assert got[0].fire is True and got[0].severity == "crit" and got[1] is None and got[2].fire is False
    ticks = spark.createDataFrame([(1, 0, 50), (1, 300, 0), (1, 600, 5), (1, 900, 20), (1, 4600, 1)], "rule_id long, tick long, new_rows long")
    assert [(r.tick, r.pending, r.trigger) for r in semantic.gate(ticks, None, 20).orderBy("tick").collect()] == [(900, 25, "spike"), (4600, 1, "interval")]


def test_retention_and_changes(spark, tmp_path):
    e = spark.createDataFrame([(1, "s", datetime(2024, 1, 1)), (2, "s", datetime(2024, 6, 1))], "id long, source string, ts timestamp_ntz")
    path = f"file://{tmp_path}/e"
    maintenance.write_weeks(e, path)
    assert maintenance.drop_expired(spark, path, datetime(2024, 6, 2), 90) == ["2024-01-01"]
    assert maintenance.drop_expired(spark, path, datetime(2024, 6, 2), 90) == [] and maintenance.drop_expired(spark, path, NOW, 0) == []
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    ch = spark.createDataFrame([(1, "upsert", 1, "x"), (2, "delete", 1, None), (3, "upsert", 3, "y")], "seq long, op string, k long, v string")
    assert sorted(map(tuple, maintenance.apply_changes(table, ch, ["k"]).collect())) == [(2, "b"), (3, "y")]


def test_unknown_globs(spark):
    r = spark.createDataFrame([rule(1, "x", glob="host-1"), rule(2, "x", glob="hots-1"), rule(3, "x", glob="z*")], RULE)
    s = spark.createDataFrame([("host-1", True), ("host-2", True), ("gone", False), *((f"other-name-{k}", True) for k in range(600))], "source string, active boolean")
    assert [tuple(x) for x in routing.unknown_globs(r, s).collect()] == [(2, "hots-1", "host-1,host-2")]


def test_indexed_route_equals_columns(spark):
    from cairnlog.sources import tables

    d = "/root/testdata/sf0.001"
    rows = tables.log_events(spark, d)
    odd = spark.createDataFrame([(1, NOW, s, v, "x", p, b) for s in ("host-01", None) for v in (None, 17) for p in ("A", None) for b in (None, "user 1", "USER 1 did x")], "id long, ts timestamp_ntz, source string, severity int, severity_text string, program string, body string")
    own = [rule(11, "(?i)user 1 did", 0), rule(12, "", 9), rule(13, "[A-Z] ", 0, glob="host-0?"), rule(14, "did (view|click)|no such", 0, glob="host-01"), rule(15, "^A ", 17), rule(16, "x$|^ $", 0)]
    small = routing.compile_rules(tables.rules(spark), tables.bindings(spark))
    odd_rules = routing.compile_rules(spark.createDataFrame(own, RULE), spark.createDataFrame([(10 + k, 70 + k % 3, 1) for k in range(1, 7)], "rule_id long, target_id long, target_order long"))
    rows = rows.union(odd).union(odd)  # repeated rows fire each
    for compiled in (small, odd_rules, []):
        one, two = (sorted(map(repr, f(rows, compiled).select("id", "source", "severity", "program", "body", "target_id", "rule_id", "rank").collect())) for f in (routing.route, routing.indexed_route))
        assert one == two and (len(one) > 100 or not compiled)
    assert routing.indexed_route(rows.limit(0), small).count() == 0


@pytest.mark.parametrize("pattern, needs", [
    ("user 7 did (view|click)", {"user 7 did "}), ("changed|Error", {"changed", "error"}), ("(?i)Foo.*BAR+", {"foo", "bar"}), (r"a\.b\d+cc", {"a.b"}), ("(ab|cd)e", {"ab", "cd"}),
    ("x{,3}yy", {"yy"}), ("(ab){2}c", {"ab"}), ("abc?d", {"ab"}), (r"a\12b", {"a", "b"}), ("[[:x]]yz", {"yz"}), ("(?<!no)yes", {"yes"}), ("", None), ("a|", None), ("a*", None), (r"\Qa.b\E", None), ("(?x)a b", None), ("(?iu)k", None),
])
def test_required_literals(pattern, needs):
    found = patterns.required(pattern)
    assert found == (needs and frozenset(needs)) or (found and needs and found < frozenset(needs))


PIECES = st.recursive(
    st.sampled_from(["a", "b", "ab", ".", "[ab]", "[^a]", r"\d", r"\.", "^", "$", "é", "B"]),
    lambda inner: st.one_of(
        st.lists(inner, min_size=1, max_size=3).map("".join),
        st.lists(inner, min_size=2, max_size=3).map(lambda x: "(" + "|".join(x) + ")"),
        st.tuples(inner, st.sampled_from(["?", "*", "+", "{2}", "{0,1}", "{1,}", "+?"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
        inner.map(lambda x: f"(?={x})"),
    ),
    max_leaves=6,
)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.lists(st.text("abBé.1", max_size=9), min_size=8, max_size=8))
def test_every_match_has_a_required_literal(pattern, texts):
    needs = patterns.required(pattern)
    for text in texts:
        if needs and re.search(pattern, text):
            assert any(n in patterns.folded(text) for n in needs)


def test_risky_patterns():
    risky = {"(a+)+b": True, "((a+)b)+": True, "((a+)+b)+": True, "(a*){2}": True, "(a*)?z": False, "(ab)+": False, "[(a+)+]": False, r"\(a+\)+": False, "((?:x|y*)z)*": True, "(a{2,}b)*": True, "(a{2}b)*": False}
    assert {p: patterns.facts(p).nested for p in risky} == risky
    assert [patterns.facts(p).most for p in ("x{1,2000}", "(x{3}){ 1001 }", "x{5,}", "x{a}")] == [2000, 1001, 5, 0]


def test_deliveries(spark):
    """Failing and vanished targets: what opens, feeds and falls back, and what the incident keeps."""
    rows = [(0, True, True, True, False), (100, True, True, False, False), (101, True, True, True, False), (300, True, True, True, True), (310, False, True, False, False), (9000, True, True, False, False), (9001, True, True, True, False), (9100, True, False, True, False)]
    df = spark.createDataFrame([("k", i, datetime.fromtimestamp(s), st, kn, ok, g) for i, (s, st, kn, ok, g) in enumerate(rows)], "key string, id long, ts timestamp_ntz, stateful boolean, known_type boolean, delivery_ok boolean, gone boolean")
    got = [(r.disposition, r.incident, r.counts_as_fed) for r in incidents.delivered_dispositions(df, 7200, 60).orderBy("id").collect()]
    assert got == [("opened", 1, True), ("fallback", 1, False), ("fed", 1, True), ("opened", 2, True), ("throttled", 2, False), ("fallback", None, False), ("opened", 3, True), ("fallback", None, False)]
    once = spark.createDataFrame([("k", 0, datetime.fromtimestamp(0), False, True), ("k", 1, datetime.fromtimestamp(100), False, False), ("k", 2, datetime.fromtimestamp(130), False, True)], "key string, id long, ts timestamp_ntz, stateful boolean, delivery_ok boolean")
    assert [(r.disposition, r.counts_as_fed) for r in incidents.delivered_dispositions(once, 7200, 60).orderBy("id").collect()] == [("opened", True), ("fallback", True), ("throttled", False)]


def test_ceiling_from_the_first_violation(spark):
    """The serial fold takes over late, with the state of the fold before it."""
    quiet = [("a", 0), ("a", 200), ("b", 1000), ("a", 1100), ("b", 1190)]
    loud = [("c", 1200), ("d", 1201), ("e", 1210), ("a", 1220), ("c", 1225), ("d", 1270), ("d", 1290), ("b", 9000)]
    df = spark.createDataFrame([(k, i, datetime.fromtimestamp(s)) for i, (k, s) in enumerate(quiet + loud)], "key string, id long, ts timestamp_ntz")
    got = [r.disposition for r in incidents.with_ceiling(df, 2, 7200, 60).orderBy("id").collect()]
    assert got == ["opened", "fed", "opened", "fed", "fed", "opened", "opened", "rate_limited", "fed", "throttled", "fed", "throttled", "opened"]


def test_large_incidents_leave_the_array(spark, monkeypatch):
    monkeypatch.setattr(incidents, "ARRAY_ROWS", 3)
    df = firings(spark, 0, 30, 60, 100, 7299, 7300, 14500, 14500)
    got = incidents.array_dispositions(df, 7200, 60).orderBy("id").collect()
    assert [r.disposition for r in got] == ["opened", "throttled", "fed", "throttled", "fed", "throttled", "opened", "throttled"] and {r.key for r in got} == {"k"}


def test_outages_across_buckets(spark):
    """Runs that go over several days, end at a day's edge, or alternate, against a plain walk."""
    import random

    rng = random.Random(6)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([60, 600, 7200, 40_000])
        rows.append((i, datetime.fromtimestamp(t), rng.random() < 0.3 if (i // 40) % 2 else False if i % 97 else True))
    want, run = set(), []
    for i, at, ok in [*rows, (None, None, True)]:
        if not ok:
            run.append(at)
        elif run:
            late = [x for x in run if (x - run[0]).total_seconds() >= 86_400]
            if late:
                want.add((run[0], len(run), late[0], at))
            run = []
    got = incidents.outages(spark.createDataFrame(rows, "id long, ts timestamp_ntz, ok boolean")).drop("scope").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 3


def test_redaction_and_fallback_pushes(spark):
    from cairnlog.plans import queries

    t = spark.createDataFrame([(1, "c1", "o1", "b"), (2, "c2", "o1", None), (3, "c3", None, "")], "target_id long, config string, owner_oid string, owner_bot string")
    assert [r.config for r in queries.list_targets(t, "o1", "b").collect()] == ["c1", "(hidden)", "(hidden)"]
    assert [r.config for r in queries.list_targets(t, "o1").collect()] == ["(hidden)", "c2", "(hidden)"]
    assert [r.config for r in queries.list_targets(t, "x", operator=True).collect()] == ["c1", "c2", "c3"]
    d = spark.createDataFrame([(1, 1, 1, "s", "err", "secret body", "fallback"), (2, 1, 1, "s", "err", "x", "opened"), (3, 1, 1, "s", "err", "x", "rate_limited")], "id long, rule_id long, target_id long, source string, severity_text string, body string, disposition string")
    r = spark.createDataFrame([(1, "leak")], "rule_id long, name string")
    got = outbox.fallback_pushes(d, r, "people").orderBy("id").collect()
    assert [(x.id, x.destination) for x in got] == [(1, "people"), (3, "people")] and "secret" not in got[0].message
    assert outbox.fallback_pushes(d, r, None).count() == 0


def test_evaluation_ceiling(spark):
    ticks = spark.createDataFrame([(r, t, 50) for r in (1, 2, 3) for t in (0, 4000, 4030, 4100)], "rule_id long, tick long, new_rows long")
    run = lambda ceiling: sorted((r.tick, r.rule_id) for r in semantic.gate(ticks, ceiling=ceiling).collect())
    assert run(0) == run(3) == [(4000, 1), (4000, 2), (4000, 3)]
    assert run(2) == [(4000, 1), (4000, 2), (4100, 3)]


def test_neighbours(spark):
    """Every row whose id is divisible by 50, in several blocks, against all rows; ties by id."""
    import random

    from cairnlog.functions import templates
    from cairnlog.plans import catalog

    rng = random.Random(2)
    vecs = {i: [float(rng.randrange(1, 5)) for _ in range(3)] for i in range(400)}
    v = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<float>").repartition(3)
    found = templates.nearest(v, v.where("vec_id % 50 = 0"), 5, block=3)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" not in plan
    got = {(r.query_id, r["rank"]): r.vec_id for r in found.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for q in range(0, 400, 50):
        cos = lambda i: dot(vecs[q], vecs[i]) / (dot(vecs[q], vecs[q]) ** 0.5 * dot(vecs[i], vecs[i]) ** 0.5)  # noqa: E731, B023
        best = sorted((i for i in vecs if i != q), key=lambda i: (-cos(i), i))[:5]
        assert [got[q, k] for k in range(1, 6)] == best
    rows = catalog.QUERIES["m09_neighbours"](spark, "/root/testdata/sf0.001").collect()
    ids = [r.vec_id for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 50 = 0").collect()]
    assert {(r.query_id, r["rank"]) for r in rows} == {(i, k) for i in ids for k in range(1, 6)}


def test_every_window_is_judged(spark):
    """One digest and judgement for each evaluation of the gate, from all rows that it took."""
    from cairnlog.plans import catalog

    d = "/root/testdata/sf0.001"
    gated = {(r.rule_id, r.tick): r.pending for r in catalog.QUERIES["o06_semantic_gate"](spark, d).collect()}
    ticked = catalog._ticked(spark, d)
    rows = semantic.evaluated(ticked, catalog._gated(spark, d, ticked)).cache()
    found = {(r.rule_id, r.window): r for r in semantic.window_digests(rows).collect()}
    assert len(gated) > 1 and {k: r.event_count for k, r in found.items()} == gated
    for rule, window in sorted(found)[:3]:
        alone = semantic.digest(rows.where((F.col("rule_id") == rule) & (F.col("window") == window))).collect()[0]
        assert found[rule, window].digest == alone.digest
    judged = catalog.QUERIES["o10_judge"](spark, d).collect()
    assert sorted((r.rule_id, r.window) for r in judged) == sorted(gated) and all(r.fire is not None for r in judged)
    print("windows judged:", len(judged))


def bursts(spark, seed, n, keys=12):
    """Random bursts of firings in many keys, with ties in time."""
    import random

    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 0, 0, 1, 2, 5, 20, 70, 400]) if rng.random() < 0.97 else 8000
        rows.append((f"k{int(keys * rng.random() ** 2)}", i, datetime.fromtimestamp(at), 1, 1, "s"))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, id long, ts timestamp_ntz, rule_id long, target_id long, source string")


def serial_ceiling(rows, ceiling, ttl, feed):
    state, recent, out = {}, [], {}
    for key, i, ts, *_ in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        at = ts.timestamp()
        last, fed, n = state.get(key, (None, 0, 0))
        if last is not None and at - last < ttl:
            what = "fed" if at - fed >= feed else "throttled"
            state[key] = (at, at if what == "fed" else fed, n)
        else:
            recent = [x for x in recent if at - x <= 60]
            what = "rate_limited" if len(recent) >= ceiling else "opened"
            if what == "opened":
                recent.append(at)
                n += 1
                state[key] = (at, at, n)
        out[i] = (what, n)
    return out


@pytest.mark.parametrize("seed, ceiling, ttl, ranges", [(1, 1, 300, 7), (2, 2, 60, 5), (3, 1, 7200, 6), (4, 3, 30, 9), (5, 100, 300, 4), (6, 1, 300, 1)])
def test_ceiling_in_ranges(spark, seed, ceiling, ttl, ranges):
    rows, df = bursts(spark, seed, 700)
    got = incidents.with_ceiling(df, ceiling, ttl, 100, ranges).collect()
    assert {r.id: (r.disposition, r.incident) for r in got} == serial_ceiling(rows, ceiling, ttl, 100) and len(got) == len(rows)


def test_ceiling_takes_several_ranges(spark):
    """More than one task folds, and fewer rounds than ranges are needed."""
    from cairnlog.operators.ranges import ceiling_decisions

    _, df = bursts(spark, 7, 900)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    numbered = incidents.number_incidents(df, 300).select(F.monotonically_increasing_id().alias("row"), "key", F.col("incident").cast("long").alias("session"), us.alias("us"), "id")
    none = spark.createDataFrame([], "kind int, key string, session long, us long")
    what, ranges, rounds = ceiling_decisions(numbered, none, 1, 8)
    assert ranges == 8 and rounds < 8 and what.count() == 900 and {r.what for r in what.collect()} == {"opened", "rate_limited", "on"}


@pytest.mark.parametrize("seed, ttl, feed", [(1, 300, 100), (2, 60, 60), (3, 7200, 3600), (4, 10, 500), (5, 9000, 30)])
def test_one_key_holds_all_rows(spark, seed, ttl, feed):
    """A key in many ranges equals the fold in one task, also beside other keys."""
    _, df = bursts(spark, seed, 600, keys=1)
    one = df.withColumn("key", F.when(F.col("id") % 9 == 0, F.concat(F.lit("x"), (F.col("id") % 27).cast("string"))).otherwise("hot"))
    for rows in (df, one):
        columns = ["key", "id", "incident", "disposition"]
        want = incidents.dispositions(rows, ttl, feed).select(*columns).collect()
        got = incidents.split_dispositions(rows, ttl, feed, hot_rows=100).select(*columns).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_hot_keys_span_partitions(spark, monkeypatch):
    """The ranges of a hot key really are several."""
    from cairnlog.operators import ranges

    seen = []
    keep = ranges.written
    monkeypatch.setattr(ranges, "written", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    _, df = bursts(spark, 8, 600, keys=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        incidents.split_dispositions(df, 300, 100, hot_rows=100).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0].select("_part").distinct().count() == 4


def test_segment_steps():
    from cairnlog.operators.ranges import segment_steps

    assert segment_steps([0, 5, 10], 100, 5) == (1, 0, 10, None, [(5, 10)])
    assert segment_steps([0, 4, 9, 12], 100, 9)[4] == [(0, 9), (4, 4), (9, 9)]
    assert segment_steps([0, 200, 210], 100, 50) == (2, 1, 200, 200, [])


def test_stems(spark):
    from cairnlog.functions.stems import stems

    want = {"caresses": "caress", "ponies": "poni", "ties": "tie", "gas": "gas", "this": "this", "agreed": "agree", "feed": "feed", "bled": "bled", "sing": "sing", "hopping": "hop", "hoping": "hope", "happy": "happi", "say": "say",
        "relational": "relat", "rational": "ration", "hesitancy": "hesit", "differently": "differ", "operator": "oper", "decisiveness": "decis", "hopefulness": "hope", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt",
        "rate": "rate", "cease": "ceas", "controlling": "control", "roll": "roll", "failed": "fail", "errors": "error", "ed": "ed", "x1": "x1"}
    want["cease"] = "cease"  # its e stands behind two vowels and one consonant
    got = spark.createDataFrame([(w,) for w in want], "w string").select("w", stems(F.array("w"))[0].alias("s")).collect()
    assert {r.w: r.s for r in got} == want


def test_postings(spark, tmp_path):
    """Stemmed search finds what the words' stems say; the plan reads the parts of the asked stems only."""
    from cairnlog.operators import postings

    texts = spark.createDataFrame([(1, "Links failed; the LINK fails"), (2, "failing power"), (3, None), (4, ""), (5, "the and"), (6, "linked failures"), (1, "power")], "id long, body string")
    path = f"file://{tmp_path}/p"
    postings.write_postings(texts, path)
    find = lambda q: sorted(r.id for r in postings.search_postings(spark, path, q).collect())
    assert find("link failing") == [1] and find("fail") == [1, 2] and find("the") == [] and find("POWERS") == [1, 2] and find("nothing") == []
    plan = postings.search_postings(spark, path, "links")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,link)" in plan
    postings.write_postings(texts.limit(0), f"{path}0")
    assert spark.read.schema("id long, term string, part int").parquet(f"{path}0").count() == 0


def test_pruned_neighbours(spark, monkeypatch):
    """Exactly the k nearest, ties by id, with most of the comparisons of clustered vectors skipped; vectors
    without an angle are nobody's neighbours."""
    import math

    import numpy as np

    from cairnlog.operators import neighbours

    for name, value in (("BLOCK", 30), ("CHUNK", 4), ("PIVOTS", 16)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.05 * rng.normal(size=8)]) for i in range(600)]
    rows += [(600 + j, rows[j][1]) for j in range(20)] + [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, share = neighbours.nearest(df, df.where("vec_id % 10 = 0"), 7)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, round(r.cosine, 9))
    good = [(i, np.array(e)) for i, e in rows if i < 700]
    for i, q in good:
        if i % 10 == 0:
            cos = sorted((-float((q * e).sum() / (math.sqrt((q * q).sum()) * math.sqrt((e * e).sum()))), j) for j, e in good if j != i)[:7]
            assert [(j, round(-c, 9)) for c, j in cos] == [found[i][k] for k in range(1, 8)]
    assert len(found) == 62 and share < 0.35
    assert neighbours.nearest(df.limit(0), df, 3)[0].count() == 0


def test_nearest_in_blocks(spark):
    """Equal vectors rank by vec_id whichever blocks they fall in; nothing without an angle is a neighbour;
    matrix products are taken in parts."""
    import numpy as np
    import pyarrow as pa

    from cairnlog.functions import templates

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (rng.normal(size=7) if i % 3 else np.arange(1, 8) / 3)]) for i in range(400)]
    rows += [(400, None), (401, [0.0] * 7), (402, [float("nan")] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: np.array(e) for i, e in rows[:400]}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    want = {(q, r, i) for q in range(0, 400, 20) for r, (_, i) in enumerate(sorted((-round(cos(v[q], v[i]), 12), i) for i in v if i != q)[:5], 1)}
    got = templates.nearest(df, df.where("vec_id % 20 = 0"), 5, block=64, asked=8).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == want
    table = lambda ids, names: pa.table({names[0]: ids, names[1]: pa.array([v[i].tolist() for i in ids], pa.list_(pa.float64()))})
    part = templates.best_cosines(table(list(range(0, 400, 20)), ("query_id", "q")), table(list(v), ("vec_id", "embedding")), 5, rows=3, columns=37)
    assert {(r["query_id"], r["vec_id"]) for r in part.to_pylist()} == {(q, i) for q, _, i in want}


def test_clock_windows_meet_by_tick(spark):
    """Rows meet their evaluation by rule and tick, not every evaluation of their rule."""
    from cairnlog.operators import clock

    rows = spark.createDataFrame([(r, t, 100 * r + t) for r in (1, 2) for t in range(0, 70, 10)], "rule_id long, tick long, id long")
    spans = spark.createDataFrame([(1, 20, 0, 0, 0), (1, 50, 20, 0, 0), (2, 35, 10, 0, 0)], "rule_id long, tick long, since long, window_from_id long, window_to_id long")
    found = clock.windows(rows, spans)
    assert {(r.id, r.window) for r in found.collect()} == {(110, 20), (120, 20), (130, 50), (140, 50), (150, 50), (220, 35), (230, 35)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(tick" in [x for x in plan.splitlines() if "Join Inner" in x][0]


def test_words_are_stemmed_once(spark):
    """The table of stems has each word once, however many texts have it."""
    from cairnlog.operators import postings

    texts = spark.createDataFrame([(i, f"links failing again number{i % 2} failed") for i in range(40)], "id long, body string")
    found = postings.postings(texts)
    assert found.count() == 40 * 4 and {r.term for r in found.where("id = 1").collect()} == {"link", "fail", "again", "number1"}
    assert "stems" in str(found.inputFiles()) and not found.where("id is null").count()


def test_gates_keep_what_can_fire():
    """Tasks hold a few rules for each pattern, gates and target, however many rules there are."""
    from cairnlog.operators import routing

    rules = [{"rank": k, "rule_id": k, "stop": k == 900, "pattern": "x", "min_severity": 0, "source_glob": "", "targets": [(1, k % 5)]} for k in range(1000)]
    whole, firsts = (routing.Gates(rules, f).open(0, "host", 1) for f in (False, True))
    assert len(whole) == 1000 and len(firsts) == 6 and routing.first_firings(list(whole)) == routing.first_firings(list(firsts))


def test_every_vector_is_asked(spark):
    """Each row of the table has its three nearest, not only those of some ids; rows without an id have none."""
    import numpy as np

    from cairnlog.plans import catalog

    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], np.float64)
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    cos = unit @ unit.T
    np.fill_diagonal(cos, -np.inf)
    best = np.argsort(-cos, axis=1, kind="stable")[:, :3]
    got = catalog.QUERIES["m09_template_similarity"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(ids[q], k, ids[i]) for q, near in enumerate(best) for k, i in enumerate(near, 1)} and len(got) == 3 * len(ids)
    assert max(abs(r.cosine - cos[np.searchsorted(ids, r.query_id), np.searchsorted(ids, r.vec_id)]) for r in got) < 1e-6


def test_vectors_without_an_id(spark, tmp_path):
    from cairnlog.plans import catalog

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.5]), (None, [1.0, 0.1]), (3, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.QUERIES["m09_template_similarity"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)}


@pytest.mark.parametrize("k, repeats", [(1, 1), (3, 1), (3, 4)])
def test_copies_of_vectors(k, repeats):
    """Many copies of a vector, vectors that differ by less than single precision tells, and ids that repeat."""
    import numpy as np
    import pyarrow as pa

    from cairnlog.functions import templates

    rng = np.random.default_rng(6)
    v = rng.normal(size=(3, 9)).astype(np.float32).astype(np.float64)[rng.integers(0, 3, 900)]
    v[::3] += 1e-9 * rng.normal(size=(300, 9))
    ids = rng.permutation(900) // repeats
    table = lambda at, names: pa.table({names[0]: ids[at], names[1]: pa.array(v[at].tolist(), pa.list_(pa.float64()))})
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    for q in range(0, 900, 90):
        got = templates.best_cosines(table([q], ("query_id", "q")), table(np.arange(900), ("vec_id", "embedding")), k, rows=7, columns=101).to_pylist()
        want = sorted((-cos(v[q], v[i]), ids[i]) for i in range(900) if ids[i] != ids[q])[:k]
        assert [r["vec_id"] for r in got] == [i for _, i in want]
