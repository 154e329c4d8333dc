"""Boolean trigram queries of regular expressions.

A query is a set of branches, each a set of trigrams: a text that the expression matches holds all
trigrams of one branch at least. The query {{}} says nothing, so such an expression has to be run on
every text. Trigrams are in small ASCII letters; whatever is not settled here (large character
classes, letters beyond ASCII, back references) counts as any character, which only weakens a query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as C  # type: ignore[no-redef]
    import sre_parse as parser  # type: ignore[no-redef]

Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])
#: Most branches of a query, most strings of a set, most letters of a class: beyond them it is weakened.
BRANCHES, STRINGS, LETTERS, REPEATS = 32, 32, 8, 4


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def least(branches: set[frozenset[str]]) -> Query:
    """Without branches that hold another one."""
    return frozenset(b for b in branches if not any(o < b for o in branches))


def either(a: Query, b: Query) -> Query:
    found = least(set(a | b))
    return found if len(found) <= BRANCHES else ALWAYS


def both(a: Query, b: Query) -> Query:
    found = least({x | y for x, y in product(a, b)})
    if len(found) <= BRANCHES:
        return found
    return max(a, b, key=lambda q: min(map(len, q)))


def holding(strings: frozenset[str]) -> Query:
    """Texts that hold one of the strings."""
    return least({grams(s) for s in strings}) if 0 < len(strings) <= BRANCHES else ALWAYS


@dataclass(frozen=True)
class Known:
    """What is known of the texts that a part of an expression matches: all of them if they are few,
    else how they begin and end (two letters at most), and a query."""

    exact: frozenset[str] | None
    begin: frozenset[str] = frozenset([""])
    end: frozenset[str] = frozenset([""])
    query: Query = ALWAYS

    def loose(self) -> Known:
        if self.exact is None:
            return self
        return Known(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), holding(self.exact))


EMPTY, ANY = Known(frozenset([""])), Known(None)


def joined(a: frozenset[str], b: frozenset[str]) -> frozenset[str] | None:
    return frozenset(x + y for x, y in product(a, b)) if len(a) * len(b) <= STRINGS else None


def then(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and (whole := joined(a.exact, b.exact)) is not None:
        return Known(whole)
    x, y = a.loose(), b.loose()
    across = joined(x.end, y.begin)
    query = both(both(x.query, y.query), holding(across) if across else ALWAYS)
    begin = (joined(a.exact, y.begin) if a.exact is not None else None) or x.begin
    end = (joined(x.end, b.exact) if b.exact is not None else None) or y.end
    return Known(None, frozenset(s[:2] for s in begin), frozenset(s[-2:] for s in end), query)


def choice(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= STRINGS:
        return Known(a.exact | b.exact)
    x, y = a.loose(), b.loose()
    few = lambda s: s if len(s) <= STRINGS else frozenset([""])
    return Known(None, few(x.begin | y.begin), few(x.end | y.end), either(x.query, y.query))


def letters(codes: list[int]) -> Known:
    if not codes or any(c > 127 for c in codes):
        return ANY
    return Known(frozenset(chr(c).lower() for c in codes))


def part(op, value) -> Known:
    if op is C.LITERAL:
        return letters([value])
    if op is C.IN:
        codes: list[int] = []
        for kind, x in value:
            if kind is C.LITERAL:
                codes.append(x)
            elif kind is C.RANGE and x[1] - x[0] < LETTERS:
                codes += range(x[0], x[1] + 1)
            else:
                return ANY
        return letters(codes) if len(codes) <= LETTERS else ANY
    if op is C.BRANCH:
        found = sequence(value[1][0])
        for other in value[1][1:]:
            found = choice(found, sequence(other))
        return found
    if op is C.SUBPATTERN:
        return sequence(value[-1])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)):
        low, high, inner = value
        once = sequence(inner)
        if low == 0:
            return choice(once, EMPTY) if high == 1 else ANY
        found = once
        for _ in range(min(low, REPEATS) - 1):
            found = then(found, once)
        return found if low == high <= REPEATS else then(found, ANY)
    if op is getattr(C, "ATOMIC_GROUP", None):
        return sequence(value)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):  # nothing is consumed
        return EMPTY
    return ANY


def sequence(parts) -> Known:
    found = EMPTY
    for op, value in parts:
        found = then(found, part(op, value))
    return found


def query(pattern: str) -> Query:
    """The Boolean trigram query of an expression, ALWAYS if it has no mandatory trigrams."""
    return sequence(parser.parse(pattern)).loose().query


def may_match(pattern_query: Query, text: str) -> bool:
    """Whether a text passes a query, for one text on the driver."""
    there = grams(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return any(branch <= there for branch in pattern_query)
