"""Date math texts and histogram intervals."""

from __future__ import annotations

import re
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = {"w": 604800, "d": 86400, "H": 3600, "h": 3600, "m": 60, "s": 1}
_TRUNC = {"y": "YEAR", "M": "MONTH", "w": "WEEK", "d": "DAY", "h": "HOUR", "H": "HOUR", "m": "MINUTE", "s": "SECOND"}

#: The intervals that follow the calendar, by Spark's unit.
CALENDAR = {
    "1y": "YEAR", "year": "YEAR", "1q": "QUARTER", "quarter": "QUARTER", "1M": "MONTH", "month": "MONTH", "1w": "WEEK", "week": "WEEK",
    "1d": "DAY", "day": "DAY", "1h": "HOUR", "hour": "HOUR", "1m": "MINUTE", "minute": "MINUTE", "1s": "SECOND", "second": "SECOND",
}


def date_math(text: str) -> Column | None:
    """now, now-8d, now/d, 2014-08-18||+1M/d as a timestamp; None if the text is none of these."""
    m = re.fullmatch(r"\s*(now|[\d:T.\- Z]+\|\|)((?:[+-]\d+[yMwdhHms])*)(?:/([yMwdhHms]))?\s*", text)
    if not m:
        return None
    at = F.current_timestamp() if m[1] == "now" else F.lit(m[1][:-2]).cast("timestamp")
    for sign, n, unit in re.findall(r"([+-])(\d+)(\w)", m[2]):
        n = int(n) * (1 if sign == "+" else -1)
        if unit in "yM":
            at = at + F.make_ym_interval(F.lit(n if unit == "y" else 0), F.lit(n if unit == "M" else 0))
        else:
            at = F.timestamp_micros(F.unix_micros(at) + F.lit(n * _STEP[unit] * 1_000_000))
    return F.date_trunc(_TRUNC[m[3]], at) if m[3] else at


def moment(text: str, pattern: str | None = None) -> Column:
    """A timestamp from date math, from a text of a pattern, or from an ISO text."""
    found = date_math(text)
    if found is not None:
        return found
    return F.coalesce(F.try_to_timestamp(F.lit(text), F.lit(pattern)), F.lit(text).try_cast("timestamp")) if pattern else F.lit(text).try_cast("timestamp")


def zone(text: str) -> str:
    """A time zone as Spark takes it: an offset as +08:00, or the name of a region; unknown ones are an error."""
    text = text.strip()
    if m := re.fullmatch(r"([+-])(\d{1,2})(?::?(\d{2}))?", text):
        return f"{m[1]}{int(m[2]):02d}:{m[3] or '00'}"
    try:
        zoneinfo.ZoneInfo("UTC" if text.upper() == "Z" else text)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError) as e:
        raise ValueError(f"no time zone {text!r}") from e
    return "UTC" if text.upper() == "Z" else text


def fixed_micros(text: str) -> int:
    """90m, 20d, 500ms, +8h in microseconds."""
    m = re.fullmatch(r"\s*([+-]?\d+)\s*(ms|micros|[wdhms])\s*", text)
    if not m:
        raise ValueError(f"interval {text!r} is not supported")
    return int(m[1]) * {"ms": 1000, "micros": 1}.get(m[2], _STEP.get(m[2], 0) * 1_000_000)
