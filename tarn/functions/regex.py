"""Regular-expression functions that need more than RLIKE."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNSUPPORTED = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]")


def check_pattern(pattern: str) -> str:
    """The pattern, refused if it uses look-around or back-references."""
    if _UNSUPPORTED.search(pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern!r}")
    return pattern


def _pick(match: re.Match) -> str | None:
    """The last group that took part, else the whole match, without one pair of quotes."""
    text = next((g for g in reversed(match.groups()) if g is not None), match.group(0))
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'" else text


@F.pandas_udf(T.ArrayType(T.StringType()))
def re_matches(f: pd.Series, p: pd.Series) -> pd.Series:
    """All matches of the pattern; null where there is none."""
    compiled: dict[str, re.Pattern] = {}

    def one(text, pattern):
        if text is None or pattern is None:
            return None
        if pattern not in compiled:
            compiled[pattern] = re.compile(check_pattern(pattern))
        return [_pick(m) for m in compiled[pattern].finditer(text)] or None

    return pd.Series([one(t, q) for t, q in zip(f, p)], dtype=object)


def regexp_match_to_fields(f: Column, pattern: str) -> Column:
    """A struct with a field per named group; null fields where the pattern does not match."""
    compiled = re.compile(check_pattern(pattern).replace("(?<", "(?P<") if "(?P<" not in pattern else pattern)
    java = pattern.replace("(?P<", "(?<")
    fields = []
    for name, index in compiled.groupindex.items():
        fields.append(F.when(f.rlike(java), F.regexp_extract(f, java, index)).alias(name))
    if not fields:
        raise ValueError("the pattern has no named group")
    return F.struct(*fields)


def regexp_match(f: Column, pattern: str) -> Column:
    """The groups of the first match as an array (the whole match if there is none); null without a match."""
    n = re.compile(pattern.replace("(?<", "(?P<") if "(?P<" not in pattern else pattern).groups
    java = pattern.replace("(?P<", "(?<")
    groups = [F.regexp_extract(f, java, i) for i in (range(1, n + 1) if n else [0])]
    return F.when(f.rlike(java), F.array(*groups))
