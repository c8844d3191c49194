"""Tool names: normal form, variants, classes. Spark columns and their Python twins for the session fold."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwarden.functions import tables as t

SEPARATOR, CAMEL = r"__|:|\.|/", r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def normal_name(name: Column) -> Column:
    """FN-30."""
    joined = F.array_join(F.filter(F.split(F.trim(name), SEPARATOR), lambda x: x != ""), "_")
    return F.lower(F.btrim(F.replace(F.regexp_replace(joined, CAMEL, "_"), F.lit("-"), F.lit("_")), F.lit("_")))


def variants(name: Column) -> Column:
    """FN-31: the normal name and its suffixes at underscores."""
    n = normal_name(name)
    parts = F.split(n, "_")
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_")))


def _whole(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _token(patterns) -> str:
    return "|".join(f"(?:{p})(?=_|$)" for p in patterns)


def any_match(name: Column, patterns) -> Column:
    """The name by prefix, its suffixes by whole tokens."""
    if not patterns:
        return F.lit(False)
    v = variants(name)
    return F.coalesce(F.get(v, F.lit(0)).rlike(_whole(patterns)), F.lit(False)) | F.exists(F.slice(v, F.lit(2), F.greatest(F.size(v), F.lit(1))), lambda x: x.rlike(_token(patterns)))


def is_side_effect(name: Column) -> Column:
    return any_match(name, t.SIDE_EFFECT)


def is_taint_source(name: Column) -> Column:
    return any_match(name, t.TAINT_SOURCE)


def is_unclassified(name: Column) -> Column:
    return ~(is_side_effect(name) | is_taint_source(name) | any_match(name, t.READ_ONLY))


def allowed_by_profile(name: Column, profile: str) -> Column:
    """PF-23: not blocked, and allowed where the profile lists what it allows."""
    ok = ~any_match(name, t.PROFILE_BLOCKED[profile])
    return ok & any_match(name, t.PROFILE_ALLOWED[profile]) if t.PROFILE_ALLOWED[profile] else ok


def is_high_risk(name: Column) -> Column:
    return F.lower(F.trim(name)).rlike(_whole(t.HIGH_RISK))


def intent_mismatch(name: Column, intent: Column) -> Column:
    """FN-35: a tool with side effects under a user's wish to be informed."""
    from spanwarden.functions.regexes import java

    told = F.coalesce(intent, F.lit(""))
    return is_side_effect(name) & (F.trim(told) != "") & ~told.rlike(java(t.DESTRUCTIVE_INTENT)) & told.rlike(java(t.BENIGN_INTENT))


def py_variants(name: str) -> list[str]:
    joined = "_".join(x for x in re.split(SEPARATOR, name.strip()) if x)
    n = re.sub(CAMEL, "_", joined).replace("-", "_").strip("_").lower()
    parts = n.split("_")
    return ["_".join(parts[i:]) for i in range(len(parts))] if n else []


def py_any_match(name: str, patterns) -> bool:
    v = py_variants(name)
    return bool(v) and (bool(re.search(_whole(patterns), v[0])) or any(re.search(_token(patterns), x) for x in v[1:]))
