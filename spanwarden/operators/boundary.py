"""Markers around untrusted content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwarden.functions import tables as t

BLOCK = rf'(?is){t.BEGIN}\b[^>]*>>>.*?{t.END}\s+id="[^"]+"\s*>>>'
OPEN, CLOSE = rf"(?i){t.BEGIN}\b[^>]*>>>", rf'(?i){t.END}\s+id="[^"]+"\s*>>>'


def sanitized(text: Column) -> Column:
    """FN-05: forged markers replaced."""
    out = text
    for p in (BLOCK, OPEN, CLOSE):
        out = F.regexp_replace(out, p, t.REMOVED)
    # most texts have no marker at all
    return F.when(text.contains("<<<"), out).otherwise(text)


def spoofed(text: Column) -> Column:
    return sanitized(text) != text


def marker_id(*key: Column) -> Column:
    """FN-09: sixteen hexadecimal digits of the key's SHA-256, so that reruns agree."""
    return F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 16)


def wrapped(text: Column, source: Column, mid: Column) -> Column:
    """FN-06."""
    return F.concat(F.lit(f'{t.BEGIN} source="'), source, F.lit('" id="'), mid, F.lit(f'">>>\n{t.WARNING}\n{t.DELIMITER}'), sanitized(text), F.lit(f'\n{t.DELIMITER}{t.END} id="'), mid, F.lit('">>>'))


def already_wrapped(text: Column) -> Column:
    """PF-21: whole, with one id at both ends and no marker inside."""
    shape = rf'(?s)\A\s*{t.BEGIN} source="[^"]*" id="([0-9a-f]{{16}})">>>\n.*{t.END} id="\1">>>\s*\z'
    return text.rlike(shape) & (F.regexp_count(text, F.lit(t.BEGIN)) == 1) & (F.regexp_count(text, F.lit(t.END)) == 1)


def maybe_wrapped(text: Column, source: Column, mid: Column) -> Column:
    """FN-07: untrusted text that is not wrapped yet."""
    return F.when(source.isin("retrieved", "tool_output", "external") & ~already_wrapped(text), wrapped(text, source, mid)).otherwise(text)


def stripped(text: Column) -> Column:
    """FN-08: what stands between the first and the last delimiter; other text as it is."""
    inner = F.substring_index(F.substring(text, F.locate(t.DELIMITER, text) + len(t.DELIMITER), F.length(text)), f"\n{t.DELIMITER}{t.END}", 1)
    return F.when(already_wrapped(text), inner).otherwise(text)


def with_canary(prompt: Column, token: Column) -> Column:
    """FN-10."""
    return F.concat(prompt, F.lit("\n"), token)


def canary_name(token: Column) -> Column:
    """FN-11."""
    return F.concat(F.lit("canary:"), F.substring(F.sha2(token, 256), 1, 12))
