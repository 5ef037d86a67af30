"""What a text must hold for a pattern to match: literals (one of several) and kinds of characters.

`gate` walks a pattern's parsed form. A gate only rules out: a text that passes may still have no match. Literals are
compared in lower case; texts with letters whose case folding Python's `re` treats apart aren't gated at all.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as c
from re import _parser

#: Dotless and dotted i, long s and the Kelvin sign match ASCII letters without regard to case.
ODD_CASE = frozenset("İıſK")
#: More literals than that aren't worth looking for.
MOST_LITERALS = 64
_DIGIT = re.compile(r"\d")


@lru_cache(maxsize=1024)
def gate(pattern: str) -> tuple[frozenset[str] | None, bool]:
    """(literals of which a match holds one at least, or None; whether a match holds a digit)."""
    parsed = _parser.parse(pattern)
    return _literals(parsed), _has_digit(parsed)


def _literals(items) -> frozenset[str] | None:
    """Of a sequence's parts the best set: few literals, and long ones."""
    found, run = [], ""
    for op, value in items:
        if op is c.LITERAL:
            run += chr(value).lower()
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        own = None
        if op is c.SUBPATTERN:
            own = _literals(value[3])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] > 0:
            own = _literals(value[2])
        elif op is c.BRANCH:
            parts = [_literals(x) for x in value[1]]
            own = frozenset().union(*parts) if all(parts) else None
        elif op is c.IN and all(k is c.LITERAL for k, _ in value):
            own = frozenset(chr(v).lower() for _, v in value)
        elif op is c.ATOMIC_GROUP:
            own = _literals(value)
        if own:
            found.append(own)
    if run:
        found.append(frozenset([run]))
    found = [x for x in found if len(x) <= MOST_LITERALS and "" not in x]
    return max(found, key=lambda x: (min(map(len, x)), -len(x))) if found else None


def _has_digit(items) -> bool:
    for op, value in items:
        if op is c.LITERAL and chr(value).isdigit():
            return True
        if op is c.IN and all((k is c.CATEGORY and v is c.CATEGORY_DIGIT) or (k is c.RANGE and chr(v[0]).isdigit() and chr(v[1]).isdigit()) or (k is c.LITERAL and chr(v).isdigit()) for k, v in value):
            return True
        if op is c.SUBPATTERN and _has_digit(value[3]) or op is c.BRANCH and all(map(_has_digit, value[1])):
            return True
        if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] > 0 and _has_digit(value[2]):
            return True
    return False


class Gated:
    """Which of several patterns may match a text."""

    def __init__(self, patterns: list[str]):
        self.gates = [gate(p) for p in patterns]

    def passing(self, text: str) -> list[bool]:
        if not ODD_CASE.isdisjoint(text):
            return [True] * len(self.gates)
        low, known = text.lower(), {}
        digit = _DIGIT.search(text) is not None

        def has(x: str) -> bool:
            got = known.get(x)
            if got is None:
                got = known[x] = x in low
            return got

        return [(digit or not d) and (xs is None or any(map(has, xs))) for xs, d in self.gates]
