"""Cheap necessary conditions for a regex, worked out once while the plan is built.

A regex costs microseconds per character, a substring test about a nanosecond.  For every
pattern we collect literals that any match must contain and test those first, so that the
regex itself only runs on the few rows that could match.  The conditions are *necessary*
ones: a row that fails them cannot match, hence no result ever changes.
"""

from __future__ import annotations

import re
from typing import NamedTuple

try:  # the parse tree Python itself compiles from; without it no condition is known and every regex runs
    from re import _constants as sre, _parser as sre_parser
except ImportError:
    sre = sre_parser = None

FOLDING_TO_ASCII = "ſKİı"  # the only non-ASCII characters that match an ASCII letter


class Needs(NamedTuple):
    """What a match must contain: one literal out of every group, a digit run, a non-ASCII character."""

    groups: tuple[frozenset[str], ...]
    digit_run: int
    non_ascii: bool


def _only_non_ascii(chars: str) -> bool:
    return bool(chars) and all(ord(v) > 127 for c in chars for v in c + c.lower() + c.upper())


def _class_members(items) -> str | None:
    """Characters of a small explicit class, None for categories, ranges over many or negations."""
    out = []
    for op, arg in items:
        if op is sre.LITERAL:
            out.append(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 16:
            out.extend(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return None
    return "".join(out)


def _is_digit_item(op, arg) -> bool:
    if op is sre.LITERAL:
        return chr(arg).isdigit()
    if op is sre.IN:
        members = _class_members(arg)
        return arg == [(sre.CATEGORY, sre.CATEGORY_DIGIT)] or (members is not None and members.isdigit())
    return False


def _worth(group: frozenset[str]) -> int:
    """Selectivity of a group: its shortest literal; lone letters and digits say nothing."""
    shortest = min(group, key=len)
    if len(shortest) == 1:
        return 0 if any(len(g) == 1 and g.isalnum() for g in group) else 1
    return len(shortest)


# Letters of running text from frequent to rare; a space is the most frequent of all.
FREQUENT_FIRST = " etaoinsrhldcumfpgwybvkxjqz"


def anchor(word: str, least: int = 4) -> str:
    """The part of a literal to search for: it starts at the rarest letter that leaves ``least`` characters.

    A substring search pays for every position where the first character matches, so
    ``uction`` is found several times faster than ``instruction``, and is just as necessary.
    """
    starts = range(max(len(word) - least, 0) + 1)
    return word[max(starts, key=lambda i: (FREQUENT_FIRST.find(word[i]) if word[i] in FREQUENT_FIRST else 20, -i)):]


def shortest(group: frozenset[str]) -> frozenset[str]:
    """The group without members that contain another member: the shorter one decides anyway."""
    return frozenset(g for g in group if not any(o != g and o in g for o in group))


def _walk(seq) -> tuple[list[frozenset[str]], int, bool]:
    groups: list[frozenset[str]] = []
    run, digits, longest, non_ascii = "", 0, 0, False

    def close() -> None:
        nonlocal run
        if run:
            groups.append(frozenset([run]))
        run = ""

    for op, arg in seq:
        if op is sre.AT:
            continue
        if _is_digit_item(op, arg):
            digits += 1
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and len(arg[2]) == 1 and _is_digit_item(*arg[2][0]):
            digits = digits + arg[0] if arg[0] == arg[1] else arg[0]
        else:
            digits = 0
        longest = max(longest, digits)

        if op is sre.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        close()
        if op is sre.LITERAL:
            non_ascii |= _only_non_ascii(chr(arg))
        elif op is sre.IN:
            members = _class_members(arg)
            if members is not None and members.isascii():
                groups.append(frozenset(members.lower()))
            elif members is not None:
                non_ascii |= _only_non_ascii(members)
        elif op is sre.SUBPATTERN and not (arg[1] or arg[2]):
            inner = _walk(arg[3])
            groups += inner[0]
            longest, non_ascii = max(longest, inner[1]), non_ascii or inner[2]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            inner = _walk(arg[2])
            groups += inner[0]
            longest, non_ascii = max(longest, inner[1]), non_ascii or inner[2]
        elif op is sre.BRANCH:
            inner_all = [_walk(option) for option in arg[1]]
            best = [max(i[0], key=_worth, default=None) for i in inner_all]
            if all(b is not None for b in best):
                groups.append(frozenset().union(*best))
            longest = max(longest, min(i[1] for i in inner_all))
            non_ascii |= all(i[2] for i in inner_all)
    close()
    return groups, longest, non_ascii


def needs(pattern: str, most_groups: int = 2) -> Needs:
    """Necessary literals (lower-cased) of ``pattern``; empty groups mean "no cheap condition known"."""
    if sre_parser is None:
        return Needs((), 0, False)
    tree = sre_parser.parse(pattern)
    if tree.state.flags & ~re.UNICODE:  # inline flags change what a literal means
        return Needs((), 0, False)
    groups, digit_run, non_ascii = _walk(tree)
    useful = sorted({shortest(g) for g in groups if _worth(g) > 0}, key=lambda g: (-_worth(g), len(g), sorted(g)))
    return Needs(tuple(useful[:most_groups]), digit_run, non_ascii)
