"""Detection: text and its source to findings.

``detect`` is exact for every text: Arrow batches, offsets mapped back through the
normaliser. Patterns whose needed words a text lacks are never run. ``pattern_counts``
and ``first_hits`` are Spark expressions for tables that need no offset map.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanwarden.functions import normalize as nm
from spanwarden.functions import tables as t
from spanwarden.functions.regexes import Filter, Has, java
from spanwarden.functions.spans import FINDING, FINDINGS

UNTRUSTED = ("retrieved", "tool_output", "external")
TRUST = {"user": "user", "retrieved": "retrieved", "tool_output": "tool_output", "system": "trusted", "external": "external"}
LINK_SCORE = {"data_uri_payload": 0.85, "credentials_in_url": 0.85, "ip_literal_url": 0.7, "punycode_host": 0.75, "homoglyph_host": 0.8, "url_shortener": 0.6}
MANDATORY = ("injection", "destructive")
DEFAULT = ("injection", "destructive", "leakage", "harmful", "urls")


def trust_level(source: Column) -> Column:
    """PF-01: trust of a source, unknown for any other."""
    out = F.when(source == "user", "user")
    for k, v in TRUST.items():
        out = out.when(source == k, v)
    return out.otherwise("unknown")


def java_any(patterns) -> str:
    """One expression that matches where any of ``patterns`` does."""
    return java("|".join(f"(?:{p})" for _, p in patterns))


def pattern_counts(text: Column, patterns) -> Column:
    """Map from pattern name to its number of matches; one native expression for each pattern."""
    return F.create_map(*[x for name, p in patterns for x in (F.lit(name), F.regexp_count(text, F.lit(java(p))))])


#: Rows that a worker holds as Python objects at once.
ROWS_AT_ONCE = 200


def slices(column: pa.Array, rows: int = ROWS_AT_ONCE) -> Iterator[list]:
    """The values of an Arrow column, a few rows at a time."""
    for k in range(0, len(column), rows):
        yield column.slice(k, rows).to_pylist()


def counted(df: DataFrame, patterns, text_col: str = "text") -> DataFrame:
    """A row for each row of ``df`` and pattern that matches it: ``df`` with pattern and n, the number of matches.

    Only patterns whose needed strings a text has are run on it.
    """
    search = Filter(patterns)

    @F.arrow_udf("array<int>")
    def able(texts: pa.Array) -> pa.Array:
        return pa.array([x for part in slices(texts) for x in search.candidates([Has(v or "") for v in part])], pa.list_(pa.int32()))

    # for explode, Spark infers a filter on the array and runs the search twice
    each = df.withColumn("_k", F.explode_outer(able(F.col(text_col)))).filter("_k is not null")
    n, name = F.lit(0), F.lit(None).cast("string")
    for k, (called, p) in reversed(list(enumerate(patterns))):
        here = F.col("_k") == k
        n, name = F.when(here, F.regexp_count(text_col, F.lit(java(p)))).otherwise(n), F.when(here, called).otherwise(name)
    return each.withColumns({"pattern": name, "n": n.cast("long")}).drop("_k").filter("n > 0")


def luhn(digits: str) -> bool:
    if not 13 <= len(digits) <= 19 or not digits.isdigit():
        return False
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def patterns_of(kind: str) -> tuple[tuple[str, str], ...]:
    if kind == "AMOUNT":
        return (("transfer_amount", t.AMOUNT),)
    return tuple(("", p) for p in (*SQL_STRONG, SQL_WORD)) if kind == "SQL" else getattr(t, kind)


@lru_cache(maxsize=None)
def compiled(kind: str) -> tuple[tuple[str, re.Pattern], ...]:
    return tuple((name, re.compile(p)) for name, p in patterns_of(kind))


@lru_cache(maxsize=None)
def searched(kind: str) -> Filter:
    return Filter(patterns_of(kind))


def matches(kind: str, text: str, able: list[int] | None = None) -> Iterator[tuple[str, re.Match]]:
    """Matches of the patterns of a kind, in their order; ``able``: those that can match, where that is known."""
    patterns = compiled(kind)
    for k in searched(kind).of_one(Has(text)) if able is None else able:
        name, p = patterns[k]
        for m in p.finditer(text):
            yield name, m


def finding(category: str, sub: str, stage: str, start: int, end: int, score: float, evidence: str, replacement: str | None = None) -> tuple:
    return category, sub, stage, start, end, float(score), evidence, replacement


@dataclass
class Text:
    """A text with its normal forms, each made once."""

    text: str
    trust: str
    _full: nm.Mapped | None = None
    _plain: nm.Mapped | None = None
    #: By kind of patterns and form of the text, those that can match, where that was told for many texts at once.
    able: dict[tuple[str, str], list[int]] = field(default_factory=dict)

    @property
    def full(self) -> nm.Mapped:
        self._full = self._full or nm.normalize(self.text)
        return self._full

    @property
    def plain(self) -> nm.Mapped:
        self._plain = self._plain or nm.normalize(self.text, nm.EVASION_STAGES)
        return self._plain

    def form(self, name: str) -> str:
        if name == "raw":
            return self.text
        return self.plain.text if name == "plain" else self.full.text[:: -1 if name == "reversed" else 1]

    def matches(self, kind: str, form: str) -> Iterator[tuple[str, re.Match]]:
        return matches(kind, self.form(form), self.able.get((kind, form)))


#: By scanner, the kinds of patterns that it searches and in which form of the text.
SEARCHED = {
    "injection": (("INJECTION", "full"), ("INJECTION", "reversed")),
    "destructive": (("DESTRUCTIVE", "full"),),
    "harmful": (("HARMFUL", "full"),),
    "leakage": (("SECRETS", "plain"), ("PROMPT_LEAK", "plain")),
    "financial": (("FINANCIAL_CRYPTO", "plain"), ("FINANCIAL_PAYMENT", "plain"), ("AMOUNT", "plain")),
    "rules": (("SQL", "full"),),
}


def tell_able(texts: list[Text], scanners: Iterable[str]) -> None:
    """Fills ``able`` of many texts for the given scanners; what fails here fails, and is reported, in its scanner."""
    kinds = [x for name in scanners for x in SEARCHED.get(name, ())]
    made: dict[str, list[Has]] = {}
    for form in sorted({form for _, form in kinds} | {"full"}):
        try:
            if form == "reversed":
                made[form] = [x.turned() for x in made["full"]]
            else:
                made[form] = [Has(x.form(form)) for x in texts]
        except Exception:  # noqa: BLE001
            continue
        has = made[form]
        for kind in dict.fromkeys(k for k, f in kinds if f == form):
            for x, able in zip(texts, searched(kind).candidates(has)):
                x.able[kind, form] = able


def _spans(x: Text, kind: str, category: str) -> list[tuple]:
    score = t.BASE_SCORE[category]
    return [finding(category, name, "regex", *x.full.back(m.start(), m.end()), score, f"{category} pattern: {name}") for name, m in x.matches(kind, "full")]


def evasion_spans(m: nm.Mapped) -> list[tuple[int, int]]:
    """NM-16: runs of invisible, confusable and look-alike characters, joined over gaps of three."""
    found = [x.span() for x in re.finditer(f"[{re.escape(t.INVISIBLE)}\U000e0000-\U000e007f]+", m.original)]
    found += [x.span() for x in re.finditer("[①-⑩Ⓐ-ⓩ０-９Ａ-Ｚａ-ｚ]+", m.original)]
    alike = re.compile(f"[{''.join(t.HOMOGLYPHS)}]+")
    for token in re.finditer(r"\S+", m.original):
        if re.search("[A-Za-z]", token[0]):
            found += [(token.start() + x.start(), token.start() + x.end()) for x in alike.finditer(token[0])]
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1] + 3:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def injection(x: Text) -> list[tuple]:
    out = _spans(x, "INJECTION", "injection")
    if {"unicode_tags", "zero_width", "fullwidth", "enclosed", "homoglyphs"} & set(x.full.stages):
        out += [finding("injection", "invisible_text", "normalize", s, e, t.BASE_SCORE["injection"], "hidden or look-alike characters") for s, e in evasion_spans(x.full)]
    out += [finding("injection", f"{name}_reversed", "regex", 0, len(x.text), t.BASE_SCORE["injection"], f"reversed text: {name}") for name, _ in x.matches("INJECTION", "reversed")]
    return out


def destructive(x: Text) -> list[tuple]:
    return _spans(x, "DESTRUCTIVE", "destructive")


def harmful(x: Text) -> list[tuple]:
    return _spans(x, "HARMFUL", "harmful") if x.trust in ("tool_output", "retrieved", "external") else []


#: What every pattern of a personal number holds.
NUMBER = re.compile(r"\d\d[\s.-]?\d{4}")


def _personal(text: str) -> Iterator[tuple[str, re.Match]]:
    number = NUMBER.search(text)
    for name, p in compiled("PII_REGEX"):
        if "@" in text if name == "email_address" else number:
            for m in p.finditer(text):
                yield name, m


def leakage(x: Text) -> list[tuple]:
    if x.trust == "trusted":
        return []
    out, seen, secret = [], set(), {n for n, _ in t.SECRETS}
    for kind in ("SECRETS", "PII_REGEX", "PROMPT_LEAK"):
        for name, m in _personal(x.plain.text) if kind == "PII_REGEX" else x.matches(kind, "plain"):
            if x.trust == "user" and name not in secret or name == "credit_card" and not luhn(re.sub(r"\D", "", m[0])):
                continue
            span = x.plain.back(m.start(), m.end())
            if (*span, name) not in seen:
                seen.add((*span, name))
                out.append(finding("leakage", name, "regex", *span, t.BASE_SCORE["leakage"], f"leakage pattern: {name}", f"[REDACTED:{name}]"))
    return out


def financial(x: Text) -> list[tuple]:
    boost = 0.10 if x.trust in ("external", "unknown") else 0.0
    form, out = x.plain, []
    for kind, score in (("FINANCIAL_CRYPTO", min(0.80, 0.70 + boost)), ("FINANCIAL_PAYMENT", min(0.95, 0.85 + boost))):
        out += [finding("financial", name, "regex", *form.back(m.start(), m.end()), score, f"financial pattern: {name}") for name, m in x.matches(kind, "plain")]
    for _, m in x.matches("AMOUNT", "plain"):
        try:
            amount = float(m[2].replace(",", ""))
        except ValueError:
            continue
        if amount >= 100:
            score = min(1.0, 0.95 + boost / 2) if amount >= 10_000 else min(0.70, 0.60 + boost)
            out.append(finding("financial", "transfer_amount", "regex", *form.back(m.start(), m.end()), score, f"transfer of {amount:,.2f}"))
    return out


def urls(x: Text) -> list[tuple]:
    if x.trust not in ("tool_output", "retrieved", "external", "unknown"):
        return []
    # without these no pattern of the kind matches
    if not any("http" in v or "data:" in v for v in (x.text.casefold(), x.plain.text.casefold())):
        return []
    out, seen, raw = [], set(), nm.Mapped.of(x.text)
    for name, p in compiled("URLS"):
        form = raw if name in ("punycode_host", "homoglyph_host") else x.plain
        for m in p.finditer(form.text):
            span = form.back(m.start(), m.end())
            if span not in seen:
                seen.add(span)
                out.append(finding("urls", name, "regex", *span, LINK_SCORE.get(name, t.BASE_SCORE["urls"]), f"link pattern: {name}"))
    return out


#: Rules over several strings: name, strings by key, condition on first places (None: absent).
SQL_STRONG = (r"(?i)\bDROP\b\s+TABLE\b", r"(?i)\bUNION\b[\s\S]{0,40}\bSELECT\b", r"(?i)\bEXEC\b\s*\(", r"(?i)'\s*OR\b", r"'\s*--", r"(?i);\s*(DROP|DELETE|UPDATE|INSERT|SELECT|ALTER|CREATE|TRUNCATE)\b")
SQL_WORD = r"(?i)\b(SELECT|ALTER|CREATE|INSERT|DELETE|TRUNCATE|EXEC|UNION|DROP)\b"
SQL_TAIL = (r"--[^\r\n]+", r";[^\r\n]+", r"(?i)cha?r\(\d+\)([,+]|\|\|)?", r"(?i)\b(SELECT|FROM)\s+pg_\w+")
XSS = (r"(?i)<script>[^\n]+?</script>", r"\s?!\[[^\n]+\]\([^\n]+\)", r"\[[^\n]+\]\(javascript[^\^n]+\)")
SHELL_MODULES = ("os", "cmd", "subprocess", "shutil")
NET_MODULES = ("socket", "asyncio", "http", "bs4", "requests", "mechanize", "urllib", "asyncssh")


def _all(pattern: str, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(pattern, text)]


def _imports(text: str, modules) -> list[tuple[int, int]]:
    if "import" not in text:
        return []
    imp, frm = _all("import", text), _all("from", text)
    mods = [_all(re.escape(m), text) for m in modules]
    first = [m[0][0] for m in mods if m]
    if not imp or not first:
        return []
    plain = any(imp[0][0] < p for p in first)
    either = frm and any(frm[0][0] < p for p in first) and any(p < imp[0][0] for p in first)
    return imp + frm + [s for m in mods for s in m] if plain or either else []


def _sqli(text: str) -> list[tuple[int, int]]:
    strong, word, tail = ([s for p in group for s in _all(p, text)] for group in (SQL_STRONG, (SQL_WORD,), SQL_TAIL))
    return strong + word + tail if strong or word and tail else []


def _template(text: str) -> list[tuple[int, int]]:
    if "{{" not in text and "{%" not in text:
        return []
    hits = {k: _all(re.escape(k), text) for k in ("{{", "}}", "{%", "%}")}
    fires = any(hits[a] and hits[b] and hits[a][0] < hits[b][0] for a, b in (("{{", "}}"), ("{%", "%}")))
    return [s for v in hits.values() for s in v] if fires else []


def _xss(text: str) -> list[tuple[int, int]]:
    if "](" not in text and "javascript" not in text and "<" not in text:
        return []
    href, js, strong = _all("href", text), _all("javascript", text), [s for p in XSS for s in _all(p, text)]
    return href + js + strong if strong or href and js and href[0] < js[0] else []


RULES: dict[str, Callable[[str], list[tuple[int, int]]]] = {
    "import_shells": lambda x: _imports(x, SHELL_MODULES),
    "import_networking": lambda x: _imports(x, NET_MODULES),
    "sql_injection": _sqli,
    "jinja_injection": _template,
    "markdown_xss": _xss,
}


def rules(x: Text) -> list[tuple]:
    out = []
    for name, rule in RULES.items():
        # without a strong sign and without a word of SQL there is nothing to find
        if name == "sql_injection" and x.able.get(("SQL", "full")) == []:
            continue
        if hits := rule(x.full.text):
            places = [x.full.back(*h) for h in hits]
            out.append(finding("rules", name, "rule", min(p[0] for p in places), min(len(x.text), max(p[1] for p in places)), t.BASE_SCORE["rules"], f"rule matched: {name}", f"[BLOCKED:{name}]"))
    return out


TOKEN_BEFORE = re.compile(r"(?i)(?:(?:sk|pk|ghp|gho|ghu|ghs|ghr|AKIA|eyJ)[-_]?|(?:api[_-]?key|secret[_-]?key|access[_-]?token)\s*[:=]\s*['\"]?)$")


def blobs(text: str, most: int = 5) -> list[tuple[int, int, str]]:
    """EN-01: start, end and decoded text of the first plausible base64 payloads."""
    out = []
    for m in nm.blobs(text):
        if len(out) >= most:
            break
        plain = None if TOKEN_BEFORE.search(text[max(0, m.start() - 32) : m.start()]) else nm.decoded(m[0])
        if plain and plain.strip() and sum(c.isprintable() or c in "\n\t\r" for c in plain) >= 0.8 * len(plain):
            out.append((m.start(), m.end(), plain))
    return out


def payloads(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with payloads: start, end and plain of all that ``blobs`` finds, not only the first few."""

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("plain", pa.string())]))

    def one(text: str) -> list[dict]:
        return [dict(zip(("start", "end", "plain"), x)) for x in blobs(text, len(text))]

    @F.arrow_udf("array<struct<start: int, end: int, plain: string>>")
    def found(texts: pa.Array) -> pa.Array:
        # a text leaves Arrow by itself, so a worker holds one as a Python object, not a batch of them
        return pa.array((one(v.as_py() or "") for v in texts), kind)

    return df.withColumn("payloads", found(F.col(text_col)))


def encodings(x: Text) -> list[tuple]:
    out = []
    for start, end, plain in blobs(x.text):
        if hit := next(matches("INJECTION", plain), None):
            out.append(finding("injection", "encoded_payload", "encoding", start, end, t.BASE_SCORE["injection"], f"encoded payload: {hit[0]}", "[BLOCKED:injection]"))
    return out


SCANNERS: dict[str, Callable[[Text], list[tuple]]] = {"injection": injection, "destructive": destructive, "leakage": leakage, "harmful": harmful, "financial": financial, "urls": urls, "rules": rules}


def register(name: str, scanner: Callable[[Text], list[tuple]]) -> None:
    """UX-01: a scanner by name; it takes a :class:`Text` and returns findings."""
    SCANNERS[name] = scanner


def chosen(scanners) -> tuple[str, ...]:
    """PF-07: a request's scanners with the mandatory ones."""
    return tuple(dict.fromkeys([*scanners, *MANDATORY]))


def scan_one(text: str | None, trust: str, scanners: tuple[str, ...], known: dict[str, Callable[[Text], list[tuple]]] | None = None) -> list[tuple]:
    """All findings of a text; a failing or unknown scanner gives one finding that blocks (DC-12)."""
    return scanned(Text(text or "", trust), scanners, SCANNERS if known is None else known)


def scanned(x: Text, scanners: tuple[str, ...], known: dict[str, Callable[[Text], list[tuple]]]) -> list[tuple]:
    out = []
    for name in ("encodings", *scanners):
        try:
            out += encodings(x) if name == "encodings" else known[name](x)
        except Exception as e:  # noqa: BLE001
            out.append(finding(name, "scanner_error", "error", 0, len(x.text), 1.0, f"{type(e).__name__}: {e}"))
    return out


def detect(df: DataFrame, text_col: str = "text", source_col: str = "source", scanners=DEFAULT, most_chars: int = 50_000) -> DataFrame:
    """``df`` with findings; texts of more than ``most_chars`` characters are left to the limit check and get none."""
    names = chosen(scanners)
    # what was registered on the driver travels to the workers with the function
    known = {n: SCANNERS[n] for n in names if n in SCANNERS}
    fields = [f.name for f in FINDING.fields]
    kind = to_arrow_type(FINDINGS)

    def scan(texts: list, trust: list) -> list:
        here = [Text(a or "", b) if len(a or "") <= most_chars else None for a, b in zip(texts, trust)]
        tell_able([x for x in here if x], names)
        return [[dict(zip(fields, f)) for f in scanned(x, names, known)] if x else [] for x in here]

    @F.arrow_udf(FINDINGS)
    def found(texts: pa.Array, trust: pa.Array) -> pa.Array:
        parts = [pa.array(scan(a, b), kind) for a, b in zip(slices(texts), slices(trust))]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return df.withColumn("findings", found(F.col(text_col), trust_level(F.col(source_col))))


def compatible(text: str) -> str:
    return unicodedata.normalize("NFKC", text)
