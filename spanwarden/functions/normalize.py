"""Text normalisation with a map of offsets.

A text is carried as characters and, for each, the index of the original character it
came from. Every stage is a substitution on that pair. Stages that keep or drop single
characters exist as Spark columns too.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwarden.functions import tables as t

STAGES = ("unicode_tags", "zero_width", "base64", "fullwidth", "enclosed", "homoglyphs", "leet", "spacing", "cross_line", "markdown", "delimiters", "cross_language", "reversed")
#: For texts whose digits matter.
EVASION_STAGES = ("unicode_tags", "zero_width", "fullwidth", "enclosed", "homoglyphs", "spacing", "delimiters")
LARGEST_BLOB = 10_000
SHORTEST_BLOB = 20
BLOB = re.compile(rf"[A-Za-z0-9+/]{{{SHORTEST_BLOB},}}={{0,2}}")
SPACED = re.compile(r"\b([a-zA-Z])((?:\s[a-zA-Z]){2,})\b")
DOTTED = re.compile(r"\b([a-zA-Z])([.\-_|])([a-zA-Z])(?:\2[a-zA-Z]){2,}\b")
#: What every match of ``SPACED`` and of ``DOTTED`` holds; quicker to look for.
ONE_LETTERS = re.compile(r"\s[a-zA-Z]\s[a-zA-Z]\b")
DOTS = re.compile(r"([.\-_|])[a-zA-Z]\1[a-zA-Z]")
LOWER = frozenset("abcdefghijklmnopqrstuvwxyz")
PIPES = (re.compile(r"(?<=[a-zA-Z])\|(?=[a-zA-Z])"), re.compile(r"(?<=[a-zA-Z])\|(?=\s)"), re.compile(r"(?<=\s)\|(?=[a-zA-Z])"))
MARKS = re.compile(r"\*\*|~~|`|(?:(?<=[ \n])|\A)\*(?=[^ ])|^#+ ?", re.M)
VERBS = re.compile(r"\b(" + "|".join(map(re.escape, t.OVERRIDE_VERBS)) + r")\b", re.I)
ENCLOSED = {chr(base + k): chr(ord(first) + k) for base, first in ((0x24B6, "A"), (0x24D0, "a"), (0xFF21, "A"), (0xFF41, "a")) for k in range(26)}
ENCLOSED |= {chr(0xFF10 + k): str(k) for k in range(10)} | {chr(0x2460 + k): str(k + 1) for k in range(10)}
TAGS = {chr(0xE0000 + k): chr(k) if 0x20 <= k <= 0x7E else "" for k in range(0x80)}


@dataclass
class Mapped:
    text: str
    at: list[int]
    original: str
    stages: list[str] = field(default_factory=list)
    _of: str | None = None
    _chars: set[str] = field(default_factory=set)

    @staticmethod
    def of(text: str) -> Mapped:
        return Mapped(text, list(range(len(text))), text)

    def put(self, stage: str, pieces: list[tuple[int, int, str | None]]) -> None:
        """Replaces stretches (start, end, by); what replaces is mapped to the stretch's first character."""
        if not pieces:
            return
        out, at, last = [], [], 0
        for start, end, by in pieces:
            out += [self.text[last:start], by]
            at += self.at[last:start] + [self.at[start]] * len(by)
            last = end
        out.append(self.text[last:])
        at += self.at[last:]
        new = "".join(out)
        if new != self.text:
            self.text, self.at = new, at
            if stage not in self.stages:
                self.stages.append(stage)

    @property
    def chars(self) -> set[str]:
        """The characters of the text, counted anew where it has changed."""
        if self._of is not self.text:
            self._of, self._chars = self.text, set(self.text)
        return self._chars

    def swap(self, stage: str, table: dict[str, str]) -> None:
        if table.keys().isdisjoint(self.chars):
            return
        if all(len(table[c]) == 1 for c in self.chars if c in table):
            new = self.text.translate(str.maketrans(table))
            if new != self.text:
                self.text = new
                if stage not in self.stages:
                    self.stages.append(stage)
            return
        self.put(stage, [(i, i + 1, table[c]) for i, c in enumerate(self.text) if c in table])

    def drop(self, stage: str, pattern: re.Pattern, inside: Callable[[re.Match], list[int]] | None = None) -> None:
        places = [i for m in pattern.finditer(self.text) for i in (inside(m) if inside else range(m.start(), m.end()))]
        self.put(stage, [(i, i + 1, "") for i in places])

    def back(self, start: int, end: int) -> tuple[int, int]:
        """A stretch of the normalised text in the original, with the invisible characters beside it."""
        if not self.at or start >= len(self.at):
            return len(self.original), len(self.original)
        lo, hi = self.at[start], self.at[min(end, len(self.at)) - 1] + 1 if end > start else self.at[start]
        hidden = lambda c: c in t.INVISIBLE or 0xE0000 <= ord(c) <= 0xE007F
        while lo > 0 and hidden(self.original[lo - 1]):
            lo -= 1
        while hi < len(self.original) and hidden(self.original[hi]):
            hi += 1
        return lo, hi


def decoded(blob: str) -> str | None:
    try:
        raw = base64.b64decode(blob, validate=True)
        return raw.decode() if len(raw) <= LARGEST_BLOB else None
    except ValueError:
        return None


@lru_cache(maxsize=4)
def _longest_word(text: str) -> int:
    return max(map(len, text.split()), default=0)


def blobs(text: str) -> Iterator[re.Match]:
    """Matches of ``BLOB``, which has no white space: none in a text of short words only."""
    return BLOB.finditer(text) if _longest_word(text) >= SHORTEST_BLOB else iter(())


def _base64(m: Mapped) -> None:
    found = [(x.start(), x.end(), decoded(x[0])) for x in blobs(m.text)]
    m.put("base64", [x for x in found if x[2] is not None])


def _compatible(m: Mapped) -> None:
    if m.text.isascii():
        return
    whole = unicodedata.normalize("NFKC", m.text)
    if whole == m.text:
        return
    at = [a for c, a in zip(m.text, m.at) for _ in unicodedata.normalize("NFKC", c)]
    at += [at[-1] if at else 0] * (len(whole) - len(at))
    m.text, m.at = whole, at[: len(whole)]
    m.stages.append("fullwidth")


def _spacing(m: Mapped) -> None:
    if ONE_LETTERS.search(m.text):
        m.drop("spacing", SPACED, lambda x: [i for i in range(x.start(), x.end()) if x.string[i] == " "])


def _cross_line(m: Mapped) -> None:
    """Line breaks between two small letters, of which each belongs to one break only."""
    text, places, free = m.text, [], 0
    i = text.find("\n")
    while i >= 0:
        if i > free and text[i - 1] in LOWER and text[i + 1 : i + 2] and text[i + 1] in LOWER:
            places.append(i)
            free = i + 2
        i = text.find("\n", i + 1)
    m.put("cross_line", [(i, i + 1, "") for i in places])


def _delimiters(m: Mapped) -> None:
    while DOTS.search(m.text):
        before = m.text
        m.drop("delimiters", DOTTED, lambda x: [i for i in range(x.start(), x.end()) if x.string[i] == x[2]])
        if m.text == before:
            break
    if "|" in m.text:
        for p in PIPES:
            m.drop("delimiters", p)


def _cross_language(m: Mapped) -> None:
    low = m.text.lower()
    if any(v in low for v in t.OVERRIDE_VERBS):
        m.put("cross_language", [(x.start(), x.end(), t.OVERRIDE_VERBS[x[0].lower()]) for x in VERBS.finditer(m.text) if x[0].lower() in t.OVERRIDE_VERBS])


def _markdown(m: Mapped) -> None:
    if not m.chars.isdisjoint("*~`#"):
        m.drop("markdown", MARKS)


STEPS: dict[str, Callable[[Mapped], None]] = {
    "unicode_tags": lambda m: m.swap("unicode_tags", TAGS),
    "zero_width": lambda m: m.swap("zero_width", dict.fromkeys(t.INVISIBLE, "")),
    "base64": _base64,
    "fullwidth": _compatible,
    "enclosed": lambda m: m.swap("enclosed", ENCLOSED),
    "homoglyphs": lambda m: m.swap("homoglyphs", t.HOMOGLYPHS),
    "leet": lambda m: m.swap("leet", t.LEET),
    "spacing": _spacing,
    "cross_line": _cross_line,
    "markdown": _markdown,
    "delimiters": _delimiters,
    "cross_language": _cross_language,
}


def normalize(text: str, stages=STAGES) -> Mapped:
    m = Mapped.of(text)
    for s in stages:
        if s != "reversed":
            STEPS[s](m)
    return m


def zero_width(c: Column) -> Column:
    return F.translate(c, t.INVISIBLE, "")


def homoglyphs(c: Column) -> Column:
    return F.translate(c, "".join(t.HOMOGLYPHS), "".join(t.HOMOGLYPHS.values()))


def leet(c: Column) -> Column:
    return F.translate(c, "".join(t.LEET), "".join(t.LEET.values()))


def unicode_tags(c: Column) -> Column:
    kept = [k for k, v in TAGS.items() if v]
    return F.translate(c, "".join(kept) + "".join(k for k, v in TAGS.items() if not v), "".join(TAGS[k] for k in kept))


def cross_line(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z])\n([a-z])", "$1$2")


def cross_language(c: Column) -> Column:
    for verb, word in t.OVERRIDE_VERBS.items():
        c = F.regexp_replace(c, rf"(?iuU)\b{verb}\b", word)
    return c
