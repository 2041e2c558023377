"""English stems as column expressions, after Porter's later algorithm: suffixes are taken off in steps,
and in each step the longest suffix that stands there decides.

A rule is a pattern of a whole word and what replaces it. Where a suffix has to lie behind the word's first
vowel and consonant, or behind two of these, the pattern asks for them in front of it. The rules are data,
so that the same steps can be stated in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

V, C = "[aeiouy]", "[^aeiouy]"
ONE, TWO = f".*{V}{C}.*?", f".*{V}{C}.*{V}{C}.*?"  # what may stand before a suffix in the first, second region
_SAME = "bdfgmnprt"  # doubled at the end they lose one

# fixed values: the suffixes of the steps, and what is left of them
PLURALS = [("^(.*)sses$", r"\1ss"), ("^(.{2,})(ied|ies)$", r"\1i"), ("^(.)(ied|ies)$", r"\1ie"), ("^(.*)(us|ss)$", r"\1\2"), (f"^(.*{V}.+)s$", r"\1")]
PAST = [(f"^({ONE})(eed|eedly)$", r"\1ee"), ("^(.*)(eed|eedly)$", r"\1\2"), (f"^(.*{V}.*?)(edly|ingly|ed|ing)$", "\\1\u0001")]
AFTER_PAST = [("^(.*)(at|bl|iz)\u0001$", r"\1\2e"), *((f"^(.*){c}{c}\u0001$", rf"\1{c}") for c in _SAME), (f"^({C}*{V}[^aeiouywx])\u0001$", r"\1e"), (f"^({V}{C})\u0001$", r"\1e"), ("^(.*)\u0001$", r"\1")]
Y = [(f"^(.+{C})y$", r"\1i")]
SECOND = [
    *((f"^({ONE}){a}$", rf"\1{b}") for a, b in (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
        ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))),
    (f"^({ONE})l(ogi)$", r"\1log"), (f"^({ONE})([cdeghkmnrt])li$", r"\1\2"),
]
THIRD = [*((f"^({ONE}){a}$", rf"\1{b}") for a, b in (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))), (f"^({TWO})ative$", r"\1")]
FOURTH = [*((f"^({TWO}){a}$", r"\1") for a in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")), (f"^({TWO}[st])ion$", r"\1")]
FIFTH = [(f"^({TWO})e$", r"\1"), (f"^({ONE}{V}{V}[^aeiouywx]|{ONE}[^aeiouy][wxy]|{ONE}{C}{C})e$", r"\1"), (f"^(.*{V}{C}.*{V}l|{TWO}l)l$", r"\1")]
STEPS = (PLURALS, PAST, AFTER_PAST, Y, SECOND, THIRD, FOURTH, FIFTH)


def _step(rules) -> Callable[[Column], Column]:
    def apply(word: Column) -> Column:
        out = None
        for pattern, left in rules:
            told = F.regexp_replace(word, pattern, left.replace("\\", "$"))  # in Java a group is $1
            out = F.when(word.rlike(pattern), told) if out is None else out.when(word.rlike(pattern), told)
        return out.otherwise(word)

    return apply


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words; words of one or two letters stay. Each step goes over
    the array the step before made, so no step is written into another."""
    short, out = F.filter(words, lambda w: F.length(w) <= 2), F.filter(words, lambda w: F.length(w) > 2)
    for rules in STEPS:
        out = F.transform(out, _step(rules))
    return F.concat(short, out)


def stem_sql(word: str) -> list[str]:
    """The steps as SQL expressions, each over a column w that the one before names; the first is over
    `word`."""
    steps, name = [], word
    for rules in STEPS:
        cases = " ".join(f"when regexp_matches({name}, '{p}') then regexp_replace({name}, '{p}', '{r}')" for p, r in rules)
        steps.append(f"case {cases} else {name} end")
        name = "w"
    return steps
