"""Results as rows, JSON envelopes and CSV."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame) -> DataFrame:
    """Structs become dotted columns."""
    out: list[Column] = []

    def walk(c: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(c.getField(f.name), f.dataType, f"{name}.{f.name}")
        else:
            out.append(c.alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    return df.select(*out)


def _cell(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    return json.dumps(value, default=str, ensure_ascii=False) if isinstance(value, (list, dict, tuple)) else str(value)


def csv_lines(df: DataFrame, flat: bool = False, separator: str = ",", quote: str = '"', show_header: bool = True) -> Iterator[str]:
    """Lines of a result, one partition at a time. A cell with the separator, the quote or a line feed is quoted."""
    df = flatten(df) if flat else df

    def line(cells: list[str]) -> str:
        return separator.join(quote + c.replace(quote, quote * 2) + quote if any(x in c for x in (separator, quote, "\n")) else c for c in cells)

    if show_header:
        yield line(df.columns)
    for row in df.toLocalIterator():
        yield line([_cell(v.asDict(True) if isinstance(v, T.Row) else v) for v in row])


def write_csv(df: DataFrame, path: str, flat: bool = True, separator: str = ",", quote: str = '"', header: bool = True) -> None:
    """A distributed CSV sink."""
    df = flatten(df) if flat else df
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested}).write.csv(path, header=header, sep=separator, quote=quote)


def envelope_parts(df: DataFrame, began: float, total: int | None = None) -> Iterator[str]:
    """The JSON answer of a query as pieces of text: hits as they come, what depends on all of them at the end."""
    rows, n, best = (json.loads(x) for x in df.toJSON().toLocalIterator()), 0, None
    first = next(rows, None)  # a query that fails does so before the answer begins
    yield '{"timed_out": false, "hits": {"hits": ['
    while first is not None:
        score = first.get("_score")
        best = score if best is None else max(best, score or 0)
        yield (", " if n else "") + json.dumps({"_id": None, "_score": score, "_source": first}, default=str)
        first, n = next(rows, None), n + 1
    yield "], " + json.dumps({"total": {"value": n if total is None else total, "relation": "eq"}, "max_score": best})[1:] + f', "took": {int(1000 * (time.time() - began))}' + "}"


def envelope(df: DataFrame, took_ms: int = 0, with_id: str | None = None) -> dict:
    """The JSON answer of a query."""
    hits = [json.loads(x) for x in df.toJSON().toLocalIterator()] if hasattr(df, "toJSON") else [r.asDict(True) for r in df.toLocalIterator()]
    return {"took": took_ms, "timed_out": False, "hits": {"total": {"value": len(hits), "relation": "eq"}, "max_score": max((h.get("_score") or 0 for h in hits), default=None), "hits": [{"_id": h.get(with_id) if with_id else None, "_score": h.get("_score"), "_source": h} for h in hits]}}


def pages(df: DataFrame, size: int) -> Iterator[list]:
    """A scroll: lists of rows, fetched partition by partition."""
    page = []
    for row in df.toLocalIterator():
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page
