"""What a regular expression needs and how it repeats, found by reading it once.

Nothing here matches text. `required` names literals of which every matching text contains one, so that
an index of literals can leave out most patterns of a large ruleset; `repeats` tells patterns that may
take very long. A pattern that is not understood in full needs nothing, which is always right."""

from __future__ import annotations

from dataclasses import dataclass, field

MOST = 64  # literals of one pattern; one with more alternatives needs nothing
_LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def folded(text: str) -> str:
    """A-Z lower-cased: patterns may ignore case, so literals and texts are compared like this."""
    return text.translate(_LOWER)


@dataclass
class Group:
    """What is known of the part between two parentheses (or of the whole): the alternatives read so
    far, the needs of the sequence being read, and whether a part of it repeats without bound."""

    silent: bool = False  # a look-around: what it needs is not consumed
    done: list = field(default_factory=list)  # of each finished alternative: its best need, or None
    needs: list = field(default_factory=list)  # of the current sequence: sets of literals
    run: str = ""  # literal characters that follow each other
    unbounded: bool = False

    def flush(self) -> None:
        if self.run:
            self.needs.append(frozenset([self.run]))
        self.run = ""

    def best(self) -> frozenset | None:
        """The need whose shortest literal is longest, of those the one with fewest literals."""
        return max(self.needs, key=lambda s: (min(map(len, s)), -len(s)), default=None)

    def end_alternative(self) -> None:
        self.flush()
        self.done.append(self.best())
        self.needs = []

    def closed(self) -> frozenset | None:
        self.end_alternative()
        if self.silent or None in self.done:
            return None
        found = frozenset().union(*self.done)
        return found if len(found) <= MOST else None


@dataclass
class Facts:
    required: frozenset | None = None
    nested: bool = False  # a part that repeats without bound lies within one that repeats
    most: int = 0  # the largest counted repetition


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at, self.facts, self.sure = pattern, 0, Facts(), True

    def take(self, n: int = 1) -> str:
        found = self.text[self.at : self.at + n]
        self.at += n
        return found

    def quantifier(self) -> tuple[int, bool, bool] | None:
        """(least, whether unbounded, whether more than an option) of the quantifier that stands here,
        which is passed over."""
        c = self.text[self.at : self.at + 1]
        if c and c in "*+?":
            self.take()
            found = (1 if c == "+" else 0, c != "?", c != "?")
        elif c == "{" and (end := self.text.find("}", self.at)) > 0:
            low, comma, high = (p.strip() for p in self.text[self.at + 1 : end].partition(","))
            if not (low + high).isdecimal() or not (low or comma) or not (low + "0").isdecimal():
                return None
            self.at = end + 1
            self.facts.most = max(self.facts.most, int(high or low))
            found = (int(low or 0), bool(comma) and not high, True)
        else:
            return None
        if self.text[self.at : self.at + 1] in ("?", "+"):  # reluctant or possessive
            self.take()
        return found

    def bracket(self) -> None:
        """Pass over a character class, whose [ is taken; classes may hold others."""
        depth, first = 1, True
        if self.text[self.at : self.at + 1] == "^":
            self.take()
        while depth and self.at < len(self.text):
            c = self.take()
            if c == "\\":
                self.take()
            elif c == "[":
                depth += 1
            elif c == "]" and not first:
                depth -= 1
            first = False

    def escape(self, group: Group) -> str:
        """The literal that an escape stands for, or nothing where it is a class, a place or a reference."""
        c = self.take()
        if c in ("Q", "E"):
            self.sure = False
        if c and not c.isalnum():
            return c
        while c.isdigit() and self.text[self.at : self.at + 1].isdigit():
            self.take()
        if c in ("x", "u", "c", "p", "P", "k", "N", "o"):  # forms with more characters behind them
            if self.text[self.at : self.at + 1] in ("{", "<"):
                closing = "}" if self.take() == "{" else ">"
                end = self.text.find(closing, self.at)
                self.at = end + 1 if end >= 0 else len(self.text)
            else:
                self.take({"x": 2, "u": 4}.get(c, 1))
        group.flush()
        return ""

    def opened(self) -> Group:
        """The group that begins here, whose ( is taken."""
        if self.text[self.at : self.at + 1] != "?":
            return Group()
        self.take()
        if self.text.startswith(("P<", "<"), self.at) and not self.text.startswith(("<=", "<!"), self.at):
            end = self.text.find(">", self.at)
            self.at = end + 1 if end >= 0 else len(self.text)
            return Group()
        if self.text[self.at : self.at + 1] in (":", ">"):
            self.take()
            return Group()
        if self.text[self.at : self.at + 1] in ("=", "!", "<"):
            self.take()
            return Group(silent=True)
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in ":)":
            self.take()
        flags = self.text[start : self.at]
        if set(flags) - set("ims-") or not flags:  # comments, conditions, references
            self.sure = False
        if self.text[self.at : self.at + 1] == ":":
            self.take()
        return Group()

    def read(self) -> Facts:
        stack = [Group()]
        while self.at < len(self.text):
            c, group = self.take(), stack[-1]
            if c == "(":
                group.flush()
                stack.append(self.opened())
                continue
            if c == "|":
                group.end_alternative()
                continue
            atom, inner, unbounded = "", None, False
            if c == ")":
                if len(stack) == 1:
                    self.sure = False
                    continue
                ended = stack.pop()
                group, inner, unbounded = stack[-1], ended.closed(), ended.unbounded
            elif c == "[":
                self.bracket()
            elif c == "\\":
                atom = self.escape(group)
            elif c not in ".^$":
                atom = c
            many = self.quantifier()
            if many and many[2] and unbounded:
                self.facts.nested = True
            group.unbounded |= unbounded or bool(many and many[1])
            least = many[0] if many else 1
            if not atom or not least:
                group.flush()
            if atom and least:
                group.run += folded(atom)
                if many:  # more of it may follow
                    group.flush()
            elif inner and least:
                group.needs.append(inner)
        if len(stack) > 1:
            self.sure = False
        self.facts.required = stack[0].closed() if self.sure else None
        return self.facts


def facts(pattern: str) -> Facts:
    return _Reader(pattern).read()


def required(pattern: str) -> frozenset | None:
    """Literals (folded), at least one of which is in every folded text that the pattern matches
    somewhere; None if no such set is known."""
    return facts(pattern).required
