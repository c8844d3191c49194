"""Regular expressions for the JVM, and the words that a pattern cannot match without.

``needs`` states them as clauses that must all hold; a clause holds if one of its strings is
in the folded text, or one of its alternatives' clauses all hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as op
from re import _parser

import pyarrow as pa
import pyarrow.compute as pc

#: Strings that one clause of ``needs`` is multiplied out to at most.
MOST_STRINGS = 8

#: Repeated groups that make java.util.regex recurse once per repetition, and flat forms with the same matches.
FLAT = (
    (r"(?:\w+\s+)*", r"(?:\w[\w\s]*\s)?"),
    (r"(?:\.\.(?:/|\\))+", r"(?:\.\.[/\\])+"),
    (r"(?:[\w-]+\.)*", r"(?:[\w-]+\.){0,127}"),
)


def java(pattern: str) -> str:
    """``pattern`` with Python's meaning of classes, case and the dot, safe on long texts."""
    for deep, flat in FLAT:
        pattern = pattern.replace(deep, flat)
    return "(?dU)" + pattern.replace("(?i)", "(?iu)")


def _best(found: list[frozenset[str] | None]) -> frozenset[str] | None:
    usable = [x for x in found if x and min(map(len, x)) >= 2]
    return max(usable, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _needs(items) -> frozenset[str] | None:
    found, run = [], ""
    for kind, arg in items:
        if kind is op.LITERAL:
            run += chr(arg).casefold()
            continue
        found.append(frozenset([run]) if run else None)
        run = ""
        if kind is op.SUBPATTERN:
            found.append(_needs(arg[-1]))
        elif kind is op.BRANCH:
            each = [_needs(x) for x in arg[1]]
            found.append(frozenset().union(*each) if all(each) else None)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0] >= 1:
            found.append(_needs(arg[2]))
    found.append(frozenset([run]) if run else None)
    return _best(found)


def needed_words(pattern: str) -> frozenset[str] | None:
    """Words of which a text, case-folded, must contain one to match; None if none can be told."""
    return _needs(_parser.parse(pattern))


def folded(text: str) -> str:
    """Case-folded, with one space for each run of white space and around the text; the form that ``needs`` speaks of."""
    if not text.isascii():
        # both match an i where case does not matter
        text = text.replace("\u0131", "i").replace("\u0130", "i")
    return f" {' '.join(text.casefold().split())} "


class Has(dict):
    """Whether strings are in the folded form of a text; each is looked for once."""

    def __init__(self, text: str, form: str | None = None):
        super().__init__()
        self.raw, self.text = text, folded(text) if form is None else form

    def turned(self) -> Has:
        """For the reversed text; characters outside ASCII may fold to several, which have an order."""
        return Has(self.raw[::-1], self.text[::-1] if self.raw.isascii() else None)

    def __missing__(self, word: str) -> bool:
        self[word] = found = word in self.text
        return found


def possible(clauses: tuple, has: Has) -> bool:
    """Whether a pattern with these ``needs`` can match."""
    for clause in clauses:
        for x in clause:
            if has[x] if type(x) is str else possible(x, has):
                break
        else:
            return False
    return True


def _joined(a: str, b: str) -> str:
    return a + b[1:] if a.endswith(" ") and b.startswith(" ") else a + b


def _clause(strings: set[str]) -> list[tuple]:
    if any(not x.strip() for x in strings):
        return []
    return [tuple(sorted((x for x in strings if not any(y != x and y in x for y in strings)), key=lambda x: (-len(x), x)))]


def _one(kind, arg) -> tuple[set[str] | None, list[tuple]]:
    """All strings that an item can match, if they are few, else None; and the clauses it needs by itself."""
    if kind is op.LITERAL:
        c = folded(chr(arg))[1:-1] if not chr(arg).isspace() else " "
        return {c or " "}, []
    if kind is op.IN:
        if arg == [(op.CATEGORY, op.CATEGORY_SPACE)]:
            return {" "}, []
        if len(arg) <= MOST_STRINGS and all(k is op.LITERAL for k, _ in arg):
            return set().union(*(_one(*x)[0] for x in arg)), []
        return None, []
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}, []
    if kind is op.SUBPATTERN:
        return _sequence(arg[-1])
    if kind is op.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in each) and sum(len(e) for e, _ in each) <= MOST_STRINGS:
            return set().union(*(e for e, _ in each)), []
        own = [tuple(_clause(e) if e is not None else c) for e, c in each]
        return None, [tuple(own)] if all(own) else []
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, x = arg
        strings, own = _sequence(x)
        if strings is not None and (most == 1 or strings == {" "}):
            return strings | ({""} if least == 0 else set()), []
        return None, [] if least == 0 else _clause(strings) if strings is not None else own
    return None, []


def _sequence(items) -> tuple[set[str] | None, list[tuple]]:
    run, own, exact = {""}, [], True
    for kind, arg in items:
        strings, clauses = _one(kind, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {_joined(a, b) for a in run for b in strings}
            continue
        own += _clause(run)
        exact, run = False, {""} if strings is None else strings
        own += clauses
    return (run, []) if exact else (None, own + _clause(run))


def needs(pattern: str) -> tuple:
    """Clauses without which ``pattern`` matches no text, neither in Python nor as ``java`` gives it; none if none can be told."""
    strings, own = _sequence(_parser.parse(pattern))
    own = _clause(strings) if strings is not None else own
    # clauses of plain strings and short ones first: they are tested sooner
    return tuple(sorted(own, key=lambda c: (any(type(x) is not str for x in c), len(c))))


def _rarest(clauses: tuple) -> set[str]:
    """The strings of the clause that should hold for the fewest texts: the one whose shortest string is longest."""
    each = [set().union(*({x} if type(x) is str else _rarest(x) for x in clause)) for clause in clauses]
    return max(each, key=lambda s: (min(map(len, s)), -len(s)))


def _plain_class(pattern: str) -> bool:
    """Whether ``pattern`` is one class of plain characters, which Python and Java read alike."""
    items = _parser.parse(pattern)
    if items.state.flags & re.IGNORECASE or len(items) != 1 or items[0][0] is not op.IN:
        return False
    return all(k in (op.LITERAL, op.RANGE) for k, _ in items[0][1])


class Filter:
    """Tells for many texts at once which of some patterns can match them.

    One automaton for each few patterns passes over all texts; only where it stops are
    those patterns' ``needs`` looked at.
    """

    def __init__(self, patterns: Iterable[tuple[str, str]], at_once: int = 4):
        patterns = [p for _, p in patterns]
        self.needs = [needs(p) for p in patterns]
        self.classes = [(k, re.compile(p)) for k, p in enumerate(patterns) if _plain_class(p)]
        self.always = [k for k, x in enumerate(self.needs) if not x and k not in dict(self.classes)]
        some = [k for k, x in enumerate(self.needs) if x]
        self.groups = [some[i : i + at_once] for i in range(0, len(some), at_once)]
        self.sought = ["|".join(re.escape(w) for w in sorted(set().union(*(_rarest(self.needs[k]) for k in g)))) for g in self.groups]

    def of_one(self, has: Has) -> list[int]:
        plain = dict(self.classes)
        return [k for k, x in enumerate(self.needs) if (plain[k].search(has.raw) if k in plain else possible(x, has))]

    def candidates(self, has: list[Has]) -> list[list[int]]:
        """For each text, given as :class:`Has`, the patterns that can match it, in order."""
        out = [list(self.always) for _ in has]
        if self.classes:
            raw = pa.array([x.raw for x in has], pa.large_string())
            for k, p in self.classes:
                for i in pc.indices_nonzero(pc.match_substring_regex(raw, p.pattern)).to_pylist():
                    out[i].append(k)
        texts = pa.array([x.text for x in has], pa.large_string())
        for group, sought in zip(self.groups, self.sought):
            found = pc.indices_nonzero(pc.match_substring_regex(texts, sought))
            for i in found.to_pylist():
                out[i] += [k for k in group if possible(self.needs[k], has[i])]
        return [sorted(x) for x in out]
