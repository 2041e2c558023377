"""Matching events against an ordered ruleset, stop rules, and one firing per event and target."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.patterns import facts, folded, required
from ..functions.predicates import glob_regex, glob_route, severity_at_least

#: Above so many rules the compiled columns give way to the index of literals.
COMPILED_RULES = 50
MOST_CHARS, MOST_COUNT = 512, 1000  # of a rule's pattern and of a counted repetition in it


def java_pattern(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


def subject() -> Column:
    return F.concat(F.coalesce("program", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))


def usable_rules(rules: DataFrame, bindings: DataFrame) -> DataFrame:
    """Enabled line rules with a target, and stop rules even without one."""
    if "kind" in rules.columns:
        rules = rules.where("kind = 'regex'")
    if "enabled" in rules.columns:
        rules = rules.where("enabled")
    bound = rules.join(bindings.select("rule_id").distinct(), "rule_id", "left_semi")
    return bound.union(rules.where("stop").join(bindings, "rule_id", "left_anti"))


def compile_rules(rules: DataFrame, bindings: DataFrame) -> list[dict]:
    """The usable rules in order, with their targets, as plain values: the ruleset is a small
    dimension. A pattern that Spark's regular expressions reject raises here, by name."""
    ordered = usable_rules(rules, bindings).orderBy("rule_order", "rule_id").collect()
    targets: dict[int, list] = {}
    for b in bindings.orderBy("rule_id", "target_order", "target_id").collect():
        targets.setdefault(b.rule_id, []).append((b.target_order, b.target_id))
    spark = rules.sparkSession
    for r in {r.pattern: r for r in reversed(ordered)}.values():  # each distinct pattern once
        try:
            spark._jvm.java.util.regex.Pattern.compile(java_pattern(r.pattern))
        except Exception as error:
            raise ValueError(f"rule {r.rule_id} has a bad pattern: {r.pattern!r}") from error
    return [r.asDict() | {"rank": k, "targets": targets.get(r.rule_id, [])} for k, r in enumerate(ordered, 1)]


def _test(rule: dict) -> Column:
    # cheap gates first: when() keeps the order of AND
    test = severity_at_least(F.col("severity"), rule["min_severity"])
    if rule["source_glob"]:
        test &= F.coalesce(glob_route(F.col("source"), rule["source_glob"]), F.lit(False))
    return test & subject().rlike(java_pattern(rule["pattern"]))


def matches(events: DataFrame, compiled: list[dict]) -> DataFrame:
    """events with an array of the matching rules (rank, rule_id, stop), in rule order; no shuffle.
    Events that match nothing are left out."""
    if not compiled:
        return events.withColumn("matched", F.array().cast("array<struct<rank:int,rule_id:bigint,stop:boolean>>")).where("false")
    structs = [F.when(_test(r), F.struct(F.lit(r["rank"]).alias("rank"), F.lit(r["rule_id"]).cast("long").alias("rule_id"), F.lit(r["stop"]).alias("stop"))) for r in compiled]
    found = F.filter(F.array(*structs), lambda x: x.isNotNull())
    return events.withColumn("matched", found).where(F.size("matched") > 0)


def literal_index(patterns: list[str]) -> tuple[dict[str, list[int]], list[int]]:
    """The places of the patterns that each literal may announce, and of those that none does."""
    found: dict[str, list[int]] = {}
    rest = []
    for k, pattern in enumerate(patterns):
        needs = required(pattern)
        for literal in needs or ():
            found.setdefault(literal, []).append(k)
        if not needs:
            rest.append(k)
    return found, rest


class Gates:
    """The rules of each distinct pattern whose severity and source gates are open, in rule order."""

    def __init__(self, compiled: list[dict], firsts: bool = False):
        """With `firsts` only rules that can fire are kept: rules of one pattern with the same gates match
        together, so of these a target's first rule counts, and none behind a stop rule."""
        self.patterns = list(dict.fromkeys(r["pattern"] for r in compiled))
        at = {p: k for k, p in enumerate(self.patterns)}
        groups: dict[tuple, list] = {}
        seen: dict[tuple, set] = {}
        for r in compiled:
            key = at[r["pattern"]], r["min_severity"] or 0, r["source_glob"] or ""
            group, known = groups.setdefault(key, []), seen.setdefault(key, set())
            targets = tuple(t for _, t in r["targets"] if not firsts or t not in known)
            if firsts and (None in known or not (targets or r["stop"])):
                continue
            group.append((r["rank"], r["rule_id"], r["stop"], targets))
            known.update(targets, [None] if r["stop"] else [])
        self.rules: list[list[tuple]] = [[] for _ in self.patterns]
        for (k, severity, glob), group in groups.items():
            self.rules[k].append((severity, glob, tuple(group)))
        self.tests: dict = {}  # of a task's own
        self.open = lru_cache(1 << 17)(self._open)

    def __getstate__(self) -> dict:
        return {"patterns": self.patterns, "rules": self.rules}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, tests={})
        self.open = lru_cache(1 << 17)(self._open)

    def _fits(self, glob: str, source: str | None) -> bool:
        if source is None or not set(glob) & set("*?["):  # without wildcards an equality
            return source == glob
        if glob not in self.tests:
            self.tests[glob] = re.compile(glob_regex(glob).replace(r"\z", r"\Z"), re.ASCII)
        return bool(self.tests[glob].search(source))

    def _open(self, pattern: int, source: str | None, severity: int | None) -> tuple:
        return tuple(
            r
            for least, glob, rules in self.rules[pattern]
            if (not least or (severity is not None and severity >= least)) and (not glob or self._fits(glob, source))
            for r in rules
        )


def indexed(events: DataFrame, compiled: list[dict], made: str, make: Callable, firsts: bool = False) -> DataFrame:
    """events with an array `made` of what make(matching rules of a row, in rule order) returns.

    One automaton of the literals that patterns need runs over a line once and names the few patterns
    that may match; each distinct pattern with an open gate is then tested once, by the same regular
    expressions as anywhere else. Everything is done within the row, so there is no shuffle."""
    shared = events.sparkSession.sparkContext.broadcast(Gates(compiled, firsts))
    names, n = events.columns, len(events.columns)
    severity_at, source_at = names.index("severity"), names.index("source")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        gates = shared.value
        literals, rest = literal_index(gates.patterns)
        automaton = ahocorasick.Automaton()
        for literal, places in literals.items():
            automaton.add_word(literal, places)
        if literals:
            automaton.make_automaton()
        entries = [{"k": k, "pattern": java_pattern(p)} for k, p in enumerate(gates.patterns)]
        for batch in batches:
            found = []
            for subject, severity, source in zip(*(batch.column(k).to_pylist() for k in (n, severity_at, source_at)), strict=True):
                hit = set(rest)
                if literals:
                    for _, places in automaton.iter(folded(subject)):
                        hit.update(places)
                found.append([entries[k] for k in hit if gates.open(k, source, severity)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, pa.list_(pa.struct([("k", pa.int32()), ("pattern", pa.string())])))], [*names, "_found"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gates = shared.value
        for batch in batches:
            out = []
            for matched, severity, source in zip(*(batch.column(k).to_pylist() for k in (n, severity_at, source_at)), strict=True):
                out.append(make(sorted(r for k in matched for r in gates.open(k, source, severity))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, arrow)], [*names, "_made"])

    kind = T._parse_datatype_string(f"array<{made}>")
    arrow = to_arrow_type(kind)
    rows = events.withColumn("_subject", subject()).mapInArrow(candidates, T.StructType([*events.schema.fields, T.StructField("_found", T._parse_datatype_string("array<struct<k:int,pattern:string>>"))]))
    matched = F.transform(F.filter("_found", lambda c: F.regexp_like(subject(), c["pattern"])), lambda c: c["k"])
    rows = rows.where(F.size("_found") > 0).select(*names, matched.alias("_matched")).where(F.size("_matched") > 0)
    return rows.mapInArrow(decide, T.StructType([*events.schema.fields, T.StructField("_made", kind)]))


def indexed_matches(events: DataFrame, compiled: list[dict]) -> DataFrame:
    """matches() for large rulesets."""
    rows = indexed(events, compiled, "struct<rank:int,rule_id:bigint,stop:boolean>", lambda rules: [{"rank": rank, "rule_id": rule, "stop": stop} for rank, rule, stop, _ in rules])
    return rows.withColumnRenamed("_made", "matched")


def first_firings(rules: list[tuple]) -> list[dict]:
    """Of matching rules in order, up to the first stop rule: the first one for each target."""
    fired: dict[int, tuple] = {}
    for rank, rule, stop, targets in rules:
        for target in targets:
            fired.setdefault(target, (rule, rank))
        if stop:
            break
    return [{"target_id": t, "rule_id": rule, "rank": rank} for t, (rule, rank) in sorted(fired.items())]


def indexed_route(events: DataFrame, compiled: list[dict]) -> DataFrame:
    """route() for large rulesets, through the literal index; rows that repeat an id fire each."""
    rows = indexed(events, compiled, "struct<target_id:bigint,rule_id:bigint,rank:int>", first_firings, firsts=True)
    return rows.select(*events.columns, F.inline("_made"))


def route_any(events: DataFrame, compiled: list[dict]) -> DataFrame:
    """route(), through columns or the index as the size of the ruleset asks."""
    return route(events, compiled) if len(compiled) <= COMPILED_RULES else indexed_route(events, compiled)


def stop_cut(matched: Column) -> Column:
    """Matches up to and with the first stop rule."""
    first = F.array_position(F.transform(matched, lambda x: x["stop"]), True)
    return F.when(first > 0, F.slice(matched, F.lit(1), first.cast("int"))).otherwise(matched)


def route(events: DataFrame, compiled: list[dict]) -> DataFrame:
    """One row per (event, target): the best-ranked rule that fires it. All within the event's row:
    rule order, stop rules and the choice per target need no shuffle."""
    found = matches(events, compiled).withColumn("matched", stop_cut(F.col("matched")))
    bound = {r["rule_id"]: r["targets"] for r in compiled if r["targets"]}
    seen: set[int] = set()
    for ts in bound.values():
        seen |= {t for _, t in ts}

    def firing(target: int) -> Column:
        ids = [r for r, ts in bound.items() if any(t == target for _, t in ts)]
        best = F.try_element_at(F.filter(F.col("matched"), lambda m: m["rule_id"].isin(ids)), F.lit(1))
        return F.when(best.isNotNull(), F.struct(F.lit(target).cast("long").alias("target_id"), best["rule_id"].alias("rule_id"), best["rank"].alias("rank")))

    firings = [firing(t) for t in sorted(seen)]
    if not firings:
        return events.withColumns({"target_id": F.lit(0).cast("long"), "rule_id": F.lit(0).cast("long"), "rank": F.lit(0)}).where("false")
    fired = found.withColumn("f", F.explode(F.array(*firings))).where("f is not null")
    return fired.select(*events.columns, "f.target_id", "f.rule_id", "f.rank")


def backtest(events: DataFrame, compiled: list[dict]) -> DataFrame:
    """Matches per rule over history in one pass, without order or stop rules."""
    found = matches if len(compiled) <= COMPILED_RULES else indexed_matches
    rows = found(events, compiled).select(F.explode("matched").alias("m"))
    return rows.groupBy(F.col("m.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


def unknown_globs(rules: DataFrame, sources: DataFrame, near: int = 3) -> DataFrame:
    """Rules whose wildcard-free glob is no active source, with up to `near` similar names: all
    active sources are looked at, each task ranks its own first."""
    plain = rules.where(F.col("source_glob").isNotNull() & (F.col("source_glob") != "") & ~F.col("source_glob").rlike(r"[*?\[]"))
    active = sources.where("active").select("source")
    missing = plain.join(active, plain.source_glob == active.source, "left_anti").select("rule_id", "source_glob")
    ratio = 1 - F.levenshtein("source_glob", "source") / F.greatest(F.length("source_glob"), F.length("source"))
    # a name half or twice as long has a ratio under a half, so names meet by their lengths
    n = F.length("source_glob")
    lengths = missing.withColumn("chars", F.explode(F.sequence(F.ceil(n / 2).cast("int"), 2 * n)))
    close = active.withColumn("chars", F.length("source")).join(lengths, "chars").where(ratio >= 0.5).withColumn("k", F.row_number().over(W.partitionBy("rule_id").orderBy(ratio.desc(), "source")))
    names = close.where(F.col("k") <= near).groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "source"))), lambda x: x["source"]), ",").alias("near"))
    return missing.join(names, "rule_id", "left").select("rule_id", "source_glob", F.coalesce("near", F.lit("")).alias("near"))


@F.pandas_udf(T.StringType())
def _risk(patterns: pd.Series) -> pd.Series:
    """Why a pattern may take very long: a part that repeats without bound within one that repeats, at
    any depth, or a large counted repetition; else null."""

    def why(pattern: str | None) -> str | None:
        found = facts(pattern) if pattern and len(pattern) <= MOST_CHARS else None
        return found and ("nested quantifier" if found.nested else "repetition" if found.most > MOST_COUNT else None)

    return patterns.map(why)


def quarantine_rules(rules: DataFrame) -> DataFrame:
    """rules (name, kind, pattern, window_kind, source_glob) with a reason, null where accepted."""
    regex = F.col("kind") == "regex"
    checked = _risk(F.when(regex, F.col("pattern")))
    glob = F.trim(F.coalesce("source_glob", F.lit("")))
    return rules.withColumn(
        "reason",
        F.when(~F.coalesce(F.col("kind").isin("regex", "semantic"), F.lit(False)), "kind")
        .when((F.coalesce("name", F.lit("")) == "") | (F.coalesce("pattern", F.lit("")) == ""), "empty")
        .when(~F.coalesce(F.col("window_kind").isin("sliding", "tumbling"), F.lit(False)), "window_kind")
        .when(regex & (F.length("pattern") > MOST_CHARS), "too long")
        .when(checked.isNotNull(), checked)
        .when(F.contains(glob, F.lit(",")), "glob list")
        .when(glob.rlike(r"\s"), "glob blank"),
    )


def quarantine_targets(targets: DataFrame, allowed_hosts: list[str], default_project: str | None = None) -> DataFrame:
    """targets (type, config, identity_policy, project) with a reason, null where accepted."""
    url = F.trim(F.coalesce(F.get_json_object("config", "$.url"), F.lit("")))
    token = F.coalesce(F.get_json_object("config", "$.token"), F.lit(""))
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return targets.withColumn(
        "reason",
        F.when(~F.coalesce(F.col("type").isin("push", "handoff"), F.lit(False)), "type")
        .when(~F.coalesce(F.col("identity_policy").isin("run-as-owner", "static-svc", "none"), F.lit(False)), "identity")
        .when((F.col("type") == "handoff") & (F.trim(F.coalesce("project", F.lit(""))) == "") & F.lit(not default_project), "project")
        .when((F.col("type") == "push") & (url != "") & ~host.isin([h.lower() for h in allowed_hosts]), "host")
        .when((F.col("type") == "push") & (token != "") & (url != "") & ~F.lower(url).startswith("https://"), "token")
        .when((F.col("type") == "handoff") & F.coalesce(F.get_json_object("config", "$.auto_approve") == "true", F.lit(False)), "auto_approve"),
    )
