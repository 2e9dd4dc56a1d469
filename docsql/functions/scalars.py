"""Scalar functions of the dialect as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java date patterns are Spark's; this is the dialect's default.
DATE_PATTERN = "yyyy-MM-dd HH:mm:ss"


def _double(c: Column) -> Column:
    return c.try_cast("double")


def _round(c: Column, digits: Column | None = None) -> Column:
    """Half up towards positive infinity, as the dialect has it."""
    if digits is None:
        return F.floor(_double(c) + 0.5)
    scale = F.pow(F.lit(10.0), digits)
    return F.floor(_double(c) * scale + 0.5) / scale


def _log(*args: Column) -> Column:
    if len(args) == 1:
        return F.ln(_double(args[0]))
    return F.ln(_double(args[1])) / F.ln(_double(args[0]))


def _split(text: Column, pattern: Column, index: Column | None = None) -> Column:
    """Final empty parts go."""
    parts = F.split(text.cast("string"), pattern)
    kept = F.aggregate(
        F.reverse(parts),
        F.struct(F.lit(True).alias("tail"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((acc["tail"] & (p == "")).alias("tail"), F.when(acc["tail"] & (p == ""), acc["n"] + 1).otherwise(acc["n"]).alias("n")),
    )["n"]
    parts = F.slice(parts, F.lit(1), F.size(parts) - kept)
    return parts if index is None else F.get(parts, index.cast("int"))


def _concat_ws(sep: Column, *args: Column) -> Column:
    """Null shows as the text null."""
    shown = [F.coalesce(a.cast("string"), F.lit("null")) for a in args]
    out = [shown[0]] if shown else [F.lit("")]
    for s in shown[1:]:
        out += [sep, s]
    return F.concat(*out)


def _trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")


def _parse(text: Column, pattern: Column, default: Column) -> Column:
    whole = F.concat(F.lit("^(?:"), pattern, F.lit(")$"))
    return F.when(F.coalesce(F.rlike(text, whole), F.lit(False)), F.call_function("regexp_extract", text, whole, F.lit(1))).otherwise(default)


def _case_new(*args: Column) -> Column:
    out = None
    pairs = list(zip(args[0::2], args[1::2], strict=True))
    for test, value in pairs[:-1]:
        out = F.when(test, value) if out is None else out.when(test, value)
    return pairs[-1][1] if out is None else out.otherwise(pairs[-1][1])


def _date_format(date: Column, pattern: Column, zone: Column | None = None) -> Column:
    at = date.try_cast("timestamp")
    return F.call_function("date_format", at if zone is None else F.from_utc_timestamp(at, zone), pattern)


def _from_unixtime(seconds: Column, pattern: Column | None = None, zone: Column | None = None) -> Column:
    at = F.timestamp_seconds(seconds)
    at = at if zone is None else F.from_utc_timestamp(at, zone)
    return F.call_function("date_format", at, F.lit(DATE_PATTERN) if pattern is None else pattern)


def _divide(a: Column, b: Column) -> Column:
    return F.try_divide(_double(a), _double(b))


def _modulus(a: Column, b: Column) -> Column:
    return F.when(b != 0, a % b)


SCALARS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "ceil": lambda c: F.ceil(_double(c)).cast("double"), "floor": lambda c: F.floor(_double(c)).cast("double"), "cbrt": lambda c: F.cbrt(_double(c)), "rint": lambda c: F.rint(_double(c)),
    "exp": lambda c: F.exp(_double(c)), "sqrt": lambda c: F.sqrt(_double(c)), "round": _round, "pow": lambda a, b: F.pow(_double(a), _double(b)), "log": _log,
    "log2": lambda c: F.ln(_double(c)) / F.ln(F.lit(2.0)), "log10": lambda c: F.log10(_double(c)), "random": lambda *_: F.rand(), "rand": lambda *_: F.rand(),
    "max_bw": lambda *a: F.greatest(*a) if len(a) > 1 else a[0], "min_bw": lambda *a: F.least(*a) if len(a) > 1 else a[0],
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": _divide, "modulus": _modulus,
    "split": _split, "concat_ws": _concat_ws, "substring": lambda c, b, e: F.substring(c.cast("string"), b + 1, e - b), "trim": _trim, "field": lambda c: c,
    "lower": F.lower, "upper": F.upper, "coalesce": F.coalesce, "case_new": _case_new, "if": lambda test, a, b: F.when(test, a).otherwise(b), "parse": _parse,
    "date_format": _date_format, "from_unixtime": _from_unixtime, "now": lambda: F.current_timestamp(), "date": lambda c: F.date_trunc("DAY", c.try_cast("timestamp")),
}

#: The units of INTERVAL.
UNITS = {"microsecond", "second", "minute", "hour", "day", "week", "month", "year"}

#: The types of CAST.
CASTS = {"INT": "int", "INTEGER": "int", "LONG": "bigint", "BIGINT": "bigint", "FLOAT": "float", "DOUBLE": "double", "STRING": "string", "CHAR": "string", "VARCHAR": "string"}


def cast(c: Column, kind: str) -> Column:
    """Numbers by way of double; DATETIME from milliseconds since 1970."""
    if kind == "DATETIME":
        return F.timestamp_millis(_double(c).cast("bigint"))
    if kind not in CASTS:
        raise ValueError(f"CAST to {kind} is not supported")
    return c.cast("string") if CASTS[kind] == "string" else _double(c).try_cast(CASTS[kind])


def date_add(c: Column, amount: int, unit: str) -> Column:
    unit = unit.rstrip("s")
    if unit not in UNITS:
        raise ValueError(f"unit {unit} is not supported")
    at = c.try_cast("timestamp")
    if unit in ("month", "year"):
        return at + F.make_ym_interval(F.lit(amount if unit == "year" else 0), F.lit(amount if unit == "month" else 0))
    seconds = {"microsecond": 1e-6, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit] * amount
    return F.timestamp_micros(F.unix_micros(at) + F.lit(int(seconds * 1_000_000)))
