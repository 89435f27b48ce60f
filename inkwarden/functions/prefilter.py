"""Literals without which a pattern cannot match, and one pass that finds them all.

A pattern's syntax tree is searched for a run of plain characters, or a choice
between such runs, that every match must contain. ``contains`` tests on these
are far cheaper than the pattern and never hide a match. For columns, all
patterns' literals are one prefix tree, as a regular expression that looks at
each place once.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

LEAST = 3


def _runs(tree) -> list[frozenset[str]]:
    """Sets of alternatives of which each match has one."""
    found: list[frozenset[str]] = []
    run = ""
    for kind, value in [*tree, (None, None)]:
        if kind is op.LITERAL and chr(value).isascii():
            run += chr(value).lower()
            continue
        if len(run) >= LEAST:
            found.append(frozenset([run]))
        run = ""
        if kind is op.SUBPATTERN:
            found += _runs(value[-1])
        elif kind is op.BRANCH:
            each = [_runs(branch) for branch in value[1]]
            if all(each):
                found.append(frozenset().union(*[max(sets, key=_worth) for sets in each]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
            found += _runs(value[2])
    return found


def _worth(alternatives: frozenset[str]) -> tuple[int, int]:
    return min(map(len, alternatives)), -len(alternatives)


def necessary_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match of ``pattern`` (ignoring case) has one; none if there is no such set."""
    sets = _runs(parser.parse(pattern, re.I | re.S))
    return tuple(sorted(max(sets, key=_worth))) if sets else ()


def necessary_sets(pattern: str) -> tuple[tuple[str, ...], ...]:
    """All sets of lower-case literals that :func:`necessary_literals` chooses from; every match has one of each."""
    return tuple(tuple(sorted(s)) for s in sorted(_runs(parser.parse(pattern, re.I | re.S)), key=_worth, reverse=True))


def _beginnings(tree, most: int) -> tuple[list[str], bool]:
    """The literals that a match can begin with, and whether they are all of it."""
    found = [""]
    for kind, value in tree:
        if kind is op.AT:
            continue
        if kind is op.LITERAL and chr(value).isascii():
            more, whole = [chr(value).lower()], True
        elif kind is op.SUBPATTERN:
            more, whole = _beginnings(value[-1], most)
        elif kind is op.BRANCH:
            each = [_beginnings(branch, most) for branch in value[1]]
            more, whole = [w for words, _ in each for w in words], all(w for _, w in each)
        else:
            return found, False
        if len(found) * len(more) > most:
            return found, False
        found = [a + b for a in found for b in more]
        if not whole:
            return found, False
    return found, True


def beginnings(pattern: str, most: int = 64) -> tuple[str, ...]:
    """Lower-case literals of which every match of ``pattern`` (ignoring case) begins with one; none if some match needn't begin with two known characters."""
    found, _ = _beginnings(parser.parse(pattern, re.I | re.S), most)
    return tuple(sorted(set(found))) if min(map(len, found)) >= 2 else ()


def shortest(words: set[str]) -> dict[str, str]:
    """Each word's shortest beginning that is a word itself, so that no two kept words start alike."""
    return {w: min((v for v in words if w.startswith(v)), key=len) for w in words}


def tree_pattern(words: list[str]) -> str:
    """A regular expression for any of some words, none of which starts another, that branches by letter."""
    if words == [""]:
        return ""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(words):
        by_letter.setdefault(w[0], []).append(w[1:])
    branches = [re.escape(c) + tree_pattern(rest) for c, rest in by_letter.items()]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
