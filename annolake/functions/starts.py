"""What a pattern's matches can begin with, as a condition before the pattern: most places of a text then fail at one character,
not at every alternative. The condition holds wherever an alternative can match, so matches stay what they are."""

from __future__ import annotations

import re
import warnings
from re import _parser as sre

from annolake.functions.groups import FLAGS

#: What Python and Java read differently, or Python can't: such patterns get no condition.
OTHERWISE = re.compile(r"&&|\\[pPhHvVRXQNGkzZ]|\(\?<|\(\?[a-zA-Z]")
CLASSES = {"CATEGORY_DIGIT": r"\d", "CATEGORY_SPACE": r"\s", "CATEGORY_WORD": r"\w", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_NOT_SPACE": r"\S", "CATEGORY_NOT_WORD": r"\W"}


def _item(op, value) -> str:
    """An item of a character class, as one of Java's."""
    if op == sre.LITERAL:
        return rf"\x{{{value:x}}}"
    if op == sre.RANGE:
        return rf"\x{{{value[0]:x}}}-\x{{{value[1]:x}}}"
    if op == sre.CATEGORY:
        return CLASSES[str(value)]
    raise ValueError(op)


def _first(items, cased: bool) -> tuple[set[tuple[str, bool]], bool]:
    """(item of a class, whether case counts there in any case) of each first character, and whether there may be none."""
    out: set[tuple[str, bool]] = set()
    for op, value in items:
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            found, empty = _first(value[2], cased)
            empty = empty or value[0] == 0
        elif op == sre.SUBPATTERN:
            found, empty = _first(value[3], cased or bool(value[2] & re.I))
        elif op == sre.ATOMIC_GROUP:
            found, empty = _first(value, cased)
        elif op == sre.BRANCH:
            each = [_first(x, cased) for x in value[1]]
            found, empty = set().union(*(f for f, _ in each)), any(e for _, e in each)
        else:
            found, empty = {(_item(*x), cased) for x in (value if op == sre.IN else [(op, value)])}, False
        out |= found
        if not empty:
            return out, False
    return out, True


def condition(alternatives: list[str], flags: str) -> str:
    """A condition without width for ``flags`` and any of the alternatives; empty if it can't be told."""
    kinds: dict[tuple[bool, bool], set[str]] = {}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            for a in alternatives:
                if OTHERWISE.search(a) or FLAGS.search(a) or not re.fullmatch(r"(?:\(\?[iU]+\))?", flags):
                    return ""
                items = list(sre.parse(a))
                found, empty = _first(items, False)
                if empty:
                    return ""
                bounded = items[0] == (sre.AT, sre.AT_BOUNDARY)
                for item, cased in found:
                    kinds.setdefault((bounded, cased), set()).add(item)
    except (re.error, ValueError, KeyError, Warning):
        return ""
    if len(alternatives) == 1 and not any(bounded for bounded, _ in kinds):
        return ""
    each = [f"(?=(?-i:[{''.join(sorted(x))}]))" if cased else f"(?=[{''.join(sorted(x))}])" for (_, cased), x in sorted(kinds.items())]
    return "(?:" + "|".join(c + (r"\b" if bounded else "") for c, (bounded, _) in zip(each, sorted(kinds))) + ")"
