"""Where a pattern's capturing groups stand within a match. Spark gives a group's text but not its place; so a pattern is written
anew with everything between its groups captured too, and the lengths of what comes before a group are its place."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FLAGS = re.compile(r"\(\?[a-zA-Z]*(?:-[a-zA-Z]+)?\)")
OPEN = re.compile(r"\((?:\?(?:<(?![=!])[A-Za-z][A-Za-z0-9]*>|:|=|!|<=|<!|>|[a-zA-Z]*(?:-[a-zA-Z]+)?:))?")
QUANTIFIER = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})[+?]?")
ESCAPE = re.compile(r"\\Q.*?(?:\\E|$)|\\[pP]\{[^}]*\}|\\x\{[0-9A-Fa-f]+\}|\\k<[A-Za-z0-9]+>|\\.", re.DOTALL)


@dataclass
class Group:
    opening: str
    branches: list[list] = field(default_factory=lambda: [[]])
    quantifier: str = ""

    @property
    def captures(self) -> bool:
        return self.opening == "(" or self.opening.startswith("(?<") and self.opening not in ("(?<=", "(?<!")

    @property
    def repeats(self) -> bool:
        return self.quantifier not in ("", "?", "??", "?+")

    @property
    def looks_around(self) -> bool:
        return self.opening in ("(?=", "(?!", "(?<=", "(?<!", "(?>")

    def holds_captures(self) -> bool:
        return any(isinstance(x, Group) and (x.captures or x.holds_captures()) for b in self.branches for x in b)


def _class_end(pattern: str, i: int) -> int:
    """The place behind the character class that begins at i."""
    depth, i, first = 1, i + 1, True
    while i < len(pattern) and depth:
        if pattern[i] == "\\":
            i = ESCAPE.match(pattern, i).end()
            first = False
            continue
        if pattern[i] == "[":
            depth += 1
        elif pattern[i] == "]" and not first:
            depth -= 1
        first = pattern[i] == "^" and first
        i += 1
    return i


def parse(pattern: str) -> Group:
    """The pattern's groups; all else stays text."""
    root = Group("")
    stack, i = [root], 0
    while i < len(pattern):
        c, top = pattern[i], stack[-1]
        if c == "(" and (m := FLAGS.match(pattern, i)):
            top.branches[-1].append(("flags", m[0]))
            i = m.end()
        elif c == "(":
            m = OPEN.match(pattern, i)
            stack.append(Group(m[0]))
            i = m.end()
        elif c == ")" and len(stack) > 1:
            group = stack.pop()
            i += 1
            if m := QUANTIFIER.match(pattern, i):
                group.quantifier, i = m[0], m.end()
            stack[-1].branches[-1].append(group)
        elif c == "|":
            top.branches.append([])
            i += 1
        else:
            end = ESCAPE.match(pattern, i).end() if c == "\\" else _class_end(pattern, i) if c == "[" else i + 1
            if m := QUANTIFIER.match(pattern, end):
                end = m.end()
            if top.branches[-1] and isinstance(top.branches[-1][-1], str):
                top.branches[-1][-1] += pattern[i:end]
            else:
                top.branches[-1].append(pattern[i:end])
            i = end
    if len(stack) > 1:
        raise ValueError(f"a group of {pattern!r} has no end")
    return root


@dataclass
class Pieces:
    """``pattern`` written anew. ``entities``: for each of its groups in order, the group's number and the numbers of those
    whose lengths come before it; (number, None) where that can't be told, for groups that are repeated within another."""

    pattern: str = ""
    n: int = 0
    entities: list[tuple[int, list[int] | None]] = field(default_factory=list)
    numbers: dict[int, int] = field(default_factory=dict)


def pieces(pattern: str) -> Pieces:
    out, before = Pieces(), []

    def plain(group: Group) -> str:
        """A group as it is, its own captures counted."""
        inner = "|".join("".join(x if isinstance(x, str) else x[1] if isinstance(x, tuple) else numbered(x) for x in b) for b in group.branches)
        return f"{group.opening}{inner}{')' if group.opening else ''}{group.quantifier}"

    def numbered(group: Group) -> str:
        if group.captures:
            out.n += 1
            out.numbers[len(out.numbers) + 1] = out.n
            out.entities.append((out.n, None))
        return plain(group)

    def piece(text: str) -> str:
        out.n += 1
        before.append(out.n)
        return f"({text})"

    def written(branch: list, inner: bool = False) -> str:
        text, held = "", ""
        for x in branch:
            if isinstance(x, str) or isinstance(x, Group) and not x.captures and not x.holds_captures():
                held += x if isinstance(x, str) else plain(x)
                continue
            text, held = text + (piece(held) if held else ""), ""
            if isinstance(x, tuple):
                text += x[1]
            elif x.captures:
                # what the group takes in all its turns comes first; it stands in the last of them
                if x.repeats:
                    out.n += 1
                    whole = out.n
                out.n += 1
                own = out.n
                out.numbers[len(out.numbers) + 1] = own
                out.entities.append((own, [*before, whole, -own] if x.repeats else list(before)))
                once = plain(Group(x.opening, x.branches))
                text += f"({once}{x.quantifier})" if x.repeats else once + x.quantifier
                before.append(whole if x.repeats else own)
            elif x.repeats or x.looks_around:
                out.n += 1
                whole = out.n
                text += f"({plain(x)})"
                before.append(whole)
            else:
                text += x.opening + "|".join(written(b, True) for b in x.branches) + ")" + x.quantifier
        return text + (piece(held) if held and inner else held)

    text = "|".join(written(b) for b in parse(pattern).branches)
    out.pattern = re.sub(r"((?<!\\)(?:\\\\)*)\\([1-9][0-9]?)", lambda m: f"{m[1]}\\{out.numbers.get(int(m[2]), int(m[2]))}", text)
    return out
