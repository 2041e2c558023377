"""Predicates and small scalar expressions of the queries."""

from __future__ import annotations

import functools
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_query(column: Column, glob: str) -> Column:
    """Search globs: * and ? are wildcards and everything else is literal; without them, equality."""
    if "*" not in glob and "?" not in glob:
        return column == glob
    escaped = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.like(escaped.replace("*", "%").replace("?", "_"))


def glob_regex(glob: str) -> str:
    """A routing glob (* ? [seq] [!seq], whole string) as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "!" else i + 3) if c == "[" else -1
        if end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body.replace("^", "\\^", 1) if body.startswith("^") else body) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "-_ /,:" else "\\" + c)
        i += 1
    return rf"(?s)\A{out}\z"


def glob_route(column: Column, glob: str) -> Column:
    return column.rlike(glob_regex(glob))


def glob_window(column: Column, glob: str) -> Column:
    """Window globs: * and ? are wildcards, and so are % and _."""
    return column.like(glob.replace("*", "%").replace("?", "_"))


def severity_at_least(column: Column, least: int | None) -> Column:
    """Null severities fail any floor; no floor or 0 lets everything pass."""
    return F.coalesce(column >= least, F.lit(False)) if least else F.lit(True)


def parse_bound(text: str) -> datetime:
    """A time bound in ISO form, in UTC; raises on anything else."""
    at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def between(column: Column, since: str | None, until: str | None, week: Column | None = None) -> Column:
    """Inclusive bounds; with the partition column given, its weeks are bounded too."""
    test = F.lit(True)
    for bound, upper in ((since, False), (until, True)):
        if bound:
            at = F.lit(parse_bound(bound).isoformat(sep=" ")).cast("timestamp_ntz")
            test &= (column <= at) if upper else (column >= at)
            if week is not None:
                monday = F.date_trunc("week", at).cast("date")
                test &= (week <= monday) if upper else (week >= monday)
    return test


STOP_WORDS = ("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with").split()


def tokens(text: Column, stop=STOP_WORDS) -> Column:
    """Lower-case words without stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+")
    return F.array_except(F.array_distinct(words), F.array(*(F.lit(w) for w in ("", *stop))))


def contains_all(text: Column, query: str, stop=STOP_WORDS) -> Column:
    """Every word of the query that is no stop word occurs; a query without such words finds nothing."""
    import re

    terms = [w for w in dict.fromkeys(re.split(r"[^a-z0-9_]+", query.lower())) if w and w not in stop]
    if not terms:
        return F.lit(False)
    found = tokens(text, stop)
    return functools.reduce(lambda a, b: a & b, (F.array_contains(found, t) for t in terms))


def any_of(columns: list[Column], test) -> Column:
    return functools.reduce(lambda a, b: a | b, (test(c) for c in columns))


def like_any(columns: list[Column], query: str) -> Column:
    """Case-insensitive substring in one of the columns; % and _ of the query stay wildcards."""
    return any_of(columns, lambda c: F.coalesce(c.ilike(f"%{query}%"), F.lit(False)))


def iso(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("?"))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def week_start(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("date")
