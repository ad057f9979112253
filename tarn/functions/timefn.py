"""Time buckets, durations and format patterns, resolved when a query is planned."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets are counted from 2001-01-01T00:00:00 UTC.
ORIGIN_US = 978_307_200_000_000
_UNIT_US = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
_SHORT = {"us": "microsecond", "ms": "millisecond", "s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "sec": "second", "min": "minute"}
# Query range in seconds and the bucket used from there on, in seconds.
_AUTO = [(60 * 86400, 86400), (30 * 86400, 43200), (28 * 86400, 21600), (21 * 86400, 10800), (15 * 86400, 7200), (6 * 3600, 3600), (2 * 3600, 60), (3600, 30), (1800, 15)]


def interval_us(text: str) -> int:
    """The width in microseconds of an interval such as '5 minutes' or '1 hour 30 minutes'."""
    parts = re.findall(r"(\d+)\s*([a-zA-Z]+)", text)
    if not parts or re.sub(r"(\d+)\s*([a-zA-Z]+)", "", text).strip():
        raise ValueError(f"an interval needs numbers with units: {text!r}")
    total = 0
    for n, unit in parts:
        unit = unit.lower()
        unit = _SHORT.get(unit, unit[:-1] if unit.endswith("s") and unit[:-1] in _UNIT_US else unit)
        if unit not in _UNIT_US:
            raise ValueError(f"unknown unit {unit!r} in {text!r}")
        total += int(n) * _UNIT_US[unit]
    if total <= 0:
        raise ValueError(f"an interval must be positive: {text!r}")
    return total


def auto_interval_us(start_us: int | None, end_us: int | None) -> int:
    """The bucket for a query range; an hour where no range is known."""
    if not start_us or not end_us or end_us <= start_us:
        return 3600 * 1_000_000
    seconds = (end_us - start_us) / 1_000_000
    return next((w for limit, w in _AUTO if seconds >= limit), 10) * 1_000_000


def parse_milliseconds(text: str) -> int:
    """'1h30m', '10s', '250ms'; a bare number is in seconds."""
    if re.fullmatch(r"\d+", text.strip()):
        return int(text) * 1000
    return interval_us(text) // 1000


def bucket(us: Column, width_us: int) -> Column:
    """The start of the bucket that a time in microseconds falls into, in microseconds."""
    return F.lit(ORIGIN_US) + F.floor((us - F.lit(ORIGIN_US)) / F.lit(width_us)).cast("long") * F.lit(width_us)


_STRFTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "j": "DDD", "p": "a", "I": "hh", "e": "d", "f": "SSSSSS", "3f": "SSS", "6f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "Z": "z", "z": "xx", "%": "%",
}


def java_pattern(strftime: str) -> str:
    """The Java pattern of a strftime format."""
    out, i, literal = [], 0, ""

    def close() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'" if re.search("[A-Za-z']", literal) else literal)
            literal = ""

    while i < len(strftime):
        if strftime[i] != "%":
            literal += strftime[i]
            i += 1
            continue
        name = strftime[i + 1 : i + 3] if strftime[i + 1 : i + 3] in _STRFTIME else strftime[i + 1 : i + 2]
        if name not in _STRFTIME:
            raise ValueError(f"unknown format %{name}")
        close()
        out.append(_STRFTIME[name])
        i += 1 + len(name)
    close()
    return "".join(out)


def zone_of(name: str) -> str:
    """A zone that Spark knows for '+HH:MM', '-HH:MM', 'UTC', 'CST' (+08:00) or ''."""
    if name in ("", "UTC"):
        return "UTC"
    if name == "CST":
        return "+08:00"
    if re.fullmatch(r"[+-]\d{2}:\d{2}", name):
        return name
    raise ValueError(f"unknown zone {name!r}")
