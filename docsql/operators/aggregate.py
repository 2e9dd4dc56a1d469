"""Queries with buckets: each GROUP BY list is a chain of levels, metrics belong to the innermost.

A level adds a key column to the rows (and may multiply them: array elements, child rows, named filters), and says how
its buckets are ordered, how many of them stay and which exist even when empty. One aggregation gives all buckets.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsql.functions import dates, geo, text
from docsql.operators.expressions import LoweringError, Scope, _as_col, condition, value
from docsql.plans.tree import All, Any_, Between, Binary, Call, Col, Compare, In, IsNull, Item, Like, Lit, Node, Not, Select, Star, plain

METRICS = {"sum", "min", "max", "avg", "count", "stats", "extended_stats", "percentiles", "percentile_ranks", "tophits", "scripted_metric", "movingavg", "rollingstd", "max_bucket", "min_bucket", "geo_bounds", "stddev", "group_concat"}
PIPELINE = {"movingavg", "rollingstd", "max_bucket", "min_bucket"}
BUCKETS = {"terms", "range", "date_range", "month", "date_histogram", "dhg", "histogram", "hg", "filter", "filters", "nested", "reverse_nested", "children", "geohash_grid", "geo_bounds", "significant_text"}
PERCENTS = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)
#: An explicit terms() without a size, as the first level, has this many buckets where defaults apply.
TERMS_SIZE = 10
DATE_PATTERN = "yyyy-MM-dd HH:mm:ss"


def is_metric(node: Node) -> bool:
    return isinstance(node, Call) and node.name.lower() in METRICS


def is_aggregated(select: Select) -> bool:
    return bool(select.groups) or any(is_metric(i.node) for i in select.items)


# ---------------------------------------------------------------- levels


@dataclass
class Level:
    name: str
    key: str = ""  # physical column
    order: tuple[str, bool] = ("key", True)  # 'key', 'count' or '=' and a metric's name; ascending
    size: int | None = None
    least: int = 1  # rows a bucket needs
    domain: list | None = None  # buckets that exist even when empty, in order
    gaps: Callable[[Column, Column], Column] | None = None  # all buckets from the first to the last
    visible: bool = True
    position: dict = field(default_factory=dict)
    extra: list[Column] = field(default_factory=list)


@dataclass
class Rows:
    """The rows of a chain so far; scope follows the array element or child table that was entered."""

    df: DataFrame
    scope: Scope
    home: Scope
    has_id: bool = False
    entered: dict[str, str] = field(default_factory=dict)  # nested path -> column of its element
    once: bool = False  # no row is in a bucket twice


def _text_of(node: Node, fallback: str = "") -> str:
    return node.name if isinstance(node, Col) else (node.text or fallback) if isinstance(node, Call) else fallback or str(node)


def _needs_row_id(group: tuple[Node, ...], select: Select) -> bool:
    words = [n.name.lower() for n in group if isinstance(n, Call)] + [k for n in group if isinstance(n, Call) for k, _ in n.named]
    inner = [a.name.lower() for i in select.items if isinstance(i.node, Call) for a in i.node.args if isinstance(a, Call)]
    return any(w in ("reverse_nested", "nested", "children") for w in words + inner)


def add_level(rows: Rows, node: Node, number: int, select: Select, engine) -> tuple[Rows, Level]:
    key = f"__k{number}"
    aliases = {i.alias: i for i in select.items if i.alias}
    if isinstance(node, Col) and node.name in aliases and rows.scope.find(node.name) is None:
        node, name = aliases[node.name].node, node.name
        if isinstance(node, Call) and node.name.lower() in BUCKETS:
            return _call_level(rows, replace(node, named=(*node.named, ("alias", Lit(name)))), key, number, select, engine)
        return _key_level(rows, value(node, rows.scope), None, name, key, select, engine)
    if isinstance(node, Call) and node.name.lower() in BUCKETS:
        return _call_level(rows, node, key, number, select, engine)
    c = value(node, rows.scope)
    named = next((i for i in select.items if i.node == node and i.alias), None)
    return _key_level(rows, c, rows.scope.kind(node), named.alias if named else _text_of(node), key, select, engine)


def _key_level(rows: Rows, c: Column, kind, name: str, key: str, select: Select, engine, size: int | None = -1) -> tuple[Rows, Level]:
    if isinstance(kind, T.ArrayType):
        c = F.explode(F.array_distinct(c))
    df = rows.df.withColumn(key, c).filter(F.col(key).isNotNull())
    return replace_rows(rows, df), Level(name, key, ("count", False), _limit(select, engine) if size == -1 else size)


def replace_rows(rows: Rows, df: DataFrame, scope: Scope | None = None) -> Rows:
    return Rows(df, scope or rows.scope, rows.home, rows.has_id, dict(rows.entered))


def _limit(select: Select, engine) -> int | None:
    return select.limit if select.limit is not None else engine.default_limit


def enter(rows: Rows, path: str) -> Rows:
    """One row for each element of a nested array (its column is __n_<path>)."""
    path = rows.home.strip(path)
    if path in rows.entered:
        return rows
    c, kind = rows.home.find(path)
    if not isinstance(kind, T.ArrayType):
        return rows
    column = f"__n_{path}"
    df = rows.df.withColumn(column, F.explode(c))
    scope = Scope(df, kind.elementType, rows.home.source, rows.home.engine, rows.home.aliases, root=F.col(f"`{column}`"), prefix=path, semi=rows.home.semi)
    out = replace_rows(rows, df, _either(scope, rows.home))
    out.entered[path] = column
    return out


def _either(inner: Scope, outer: Scope) -> Scope:
    """Names of the entered element first, then of the row."""
    return _Chained(inner.df, inner.schema, inner.source, inner.engine, inner.aliases, root=inner.root, prefix=inner.prefix, semi=inner.semi, extra=outer.extra, outer=outer)


@dataclass
class _Chained(Scope):
    outer: Scope | None = None

    def find(self, name: str):
        name = self.strip(name)
        if name.startswith(f"{self.prefix}."):
            return super().find(name)
        got = self.outer.find(name) if self.outer is not None else None
        return got if got is not None else super().find(name)


def leave(rows: Rows) -> Rows:
    """Back to the rows themselves: each counts once in a bucket, however many of its elements were there."""
    df = rows.df
    if rows.has_id and not rows.once:
        df = df.dropDuplicates(["__row", *[c for c in df.columns if re.fullmatch(r"__k\d+", c)]])
    return Rows(df, rows.home, rows.home, rows.has_id)


def _leaves(node: Node) -> bool:
    return isinstance(node, Call) and (node.name.lower() == "reverse_nested" or node.option("reverse_nested") is not None)


def _simple_run(group: tuple[Node, ...], select: Select) -> int:
    """How many levels, from the first one on, only look at a nested array's elements and are then left for the row; 0 where that is not so."""
    until = next((n for n, g in enumerate(group) if _leaves(g)), len(group))
    run = group[:until]
    if not run or not isinstance(run[0], Call) or run[0].name.lower() != "nested" or not all(isinstance(g, Call) and g.name.lower() in ("nested", "filter") for g in run):
        return 0
    if until < len(group):
        return until
    # No level leaves the elements: the metrics do, if all of them are the row's own.
    args = [i.node.args[0] for i in select.items if is_metric(i.node) and i.node.args]
    own = [isinstance(a, Call) and a.name.lower() == "reverse_nested" and len(a.args) == 1 for a in args]
    return until if any(own) and all(o or isinstance(a, (Star, Lit)) for a, o in zip(args, own, strict=True)) else 0


def within(rows: Rows, nodes: tuple[Node, ...], select: Select, engine) -> tuple[Rows, list[Level]] | None:
    """The levels of a nested array's elements, with each row once in a bucket: told inside the row, without a shuffle. None where that does not do."""
    paths = {rows.home.strip(str(plain(n.args[1])) if len(n.args) > 1 else _as_col(n.args[0]).name.rpartition(".")[0]) for n in nodes if n.name.lower() == "nested"}
    found = rows.home.find(next(iter(paths))) if len(paths) == 1 else None
    if found is None or not isinstance(found[1], T.ArrayType) or not isinstance(found[1].elementType, T.StructType):
        return None
    (path,), (c, kind) = paths, found

    def scope_of(element: Column) -> Scope:
        inner = Scope(rows.df, kind.elementType, rows.home.source, rows.home.engine, rows.home.aliases, root=element, prefix=path)
        return _either(inner, rows.home)

    levels, keys, tests, constants = [], {}, [], {}
    probe = scope_of(F.col(f"`{path}`"))
    for number, node in enumerate(nodes):
        key = f"__k{number}"
        name = str(node.option("alias") or node.text)
        if node.name.lower() == "nested":
            field_ = _as_col(node.args[0])
            if isinstance(probe.kind(field_), T.ArrayType):
                return None
            keys[key] = lambda scope, field_=field_: value(field_, scope)
            tests.append(lambda scope, field_=field_: value(field_, scope).isNotNull())
            levels.append(Level(name, key, ("count", False), _limit(select, engine)))
        else:
            args = list(node.args)
            name = str(plain(args.pop(0))) if len(args) > 1 and isinstance(args[0], (Lit, Col)) else name
            _condition_of(args[-1], probe)
            if probe.semi:  # a subquery or a child table has to be joined
                return None
            tests.append(lambda scope, test=args[-1]: F.coalesce(condition(test, scope), F.lit(False)))
            constants[key] = F.lit(name)
            levels.append(Level(name, key, domain=[name], visible=False))
    fits = F.filter(c, lambda x: reduce(lambda a, b: a & b, [t(scope_of(x)) for t in tests]))
    buckets = F.array_distinct(F.transform(fits, lambda x: F.struct(*[k(scope_of(x)).alias(n) for n, k in keys.items()])))
    df = rows.df.withColumn("__found", F.explode(buckets)).withColumns({**{k: F.col("__found").getField(k) for k in keys}, **constants}).drop("__found")
    return Rows(df, rows.home, rows.home, rows.has_id, once=True), levels


def _option_field(call: Call, rows: Rows) -> tuple[Rows, Column, T.DataType | None, str]:
    """The field or expression a bucket function works on, after entering or leaving what it names."""
    named = call.option("field")
    positional = [a for a in call.args if not (isinstance(a, Lit) and not isinstance(a.value, str))]
    node = Col(str(named)) if named is not None else positional[0] if positional else None
    if node is None:
        raise LoweringError(f"{call.name} needs a field")
    node = _as_col(node)
    if (back := call.option("reverse_nested")) is not None:
        rows = leave(rows)
        if str(back).startswith("~"):
            rows = enter(rows, str(back)[1:])
    if inner := call.option("nested"):
        rows = enter(rows, str(inner))
    if child := call.option("children"):
        rows = enter_children(rows, str(child))
    return rows, value(node, rows.scope), rows.scope.kind(node), _text_of(node)


def enter_children(rows: Rows, name: str) -> Rows:
    child = rows.home.source.children.get(name)
    if child is None:
        raise LoweringError(f"no child table {name}")
    if "__child" in rows.df.columns:
        return rows
    source = rows.home.engine.catalog.one(child.table)
    struct = F.struct(*[F.col(f"`{c}`") for c in source.df.columns]).alias("__child")
    below = source.df.select(F.col(f"`{child.parent}`").cast("string").alias("__parent"), struct)
    df = rows.df.join(below, rows.home.column(rows.home.source.id_col).cast("string") == F.col("__parent"))
    return replace_rows(rows, df, Scope(df, source.df.schema, source, rows.home.engine, root=F.col("__child"), semi=rows.home.semi))


def _call_level(rows: Rows, call: Call, key: str, number: int, select: Select, engine) -> tuple[Rows, Level]:
    low = call.name.lower()
    name = str(call.option("alias") or call.text)
    if low == "nested":
        node = _as_col(call.args[0])
        path = str(plain(call.args[1])) if len(call.args) > 1 else node.name.rpartition(".")[0]
        rows = enter(rows, path)
        return _key_level(rows, value(node, rows.scope), rows.scope.kind(node), name, key, select, engine)
    if low == "reverse_nested":
        node = _as_col(call.args[0])
        rows = leave(rows)
        if len(call.args) > 1 and str(plain(call.args[1])).startswith("~"):
            rows = enter(rows, str(plain(call.args[1]))[1:])
            return _key_level(rows, value(node, rows.scope), rows.scope.kind(node), name, key, select, engine)
        return _key_level(rows, value(node, rows.scope), rows.scope.kind(node), name, key, select, engine)
    if low == "children":
        rows = enter_children(rows, str(plain(call.args[0])))
        node = _as_col(call.args[1])
        return _key_level(rows, value(node, rows.scope), rows.scope.kind(node), name, key, select, engine)
    if low == "filter":
        args = list(call.args)
        name = str(plain(args.pop(0))) if len(args) > 1 and isinstance(args[0], (Lit, Col)) else name
        rows, test = _filter_test(rows, args[-1])
        df = rows.df.filter(F.coalesce(test, F.lit(False))).withColumn(key, F.lit(name))
        return replace_rows(rows, df), Level(name, key, domain=[name], visible=False)
    if low == "filters":
        return _filters(rows, call, key, name)
    if low == "terms":
        return _terms(rows, call, key, number, name, select, engine)
    if low in ("range", "date_range", "month"):
        return _ranges(rows, call, key, name, low)
    if low in ("histogram", "hg"):
        return _histogram(rows, call, key, number, name)
    if low in ("date_histogram", "dhg"):
        return _date_histogram(rows, call, key, number, name)
    if low == "geohash_grid":
        rows, c, kind, _ = _option_field(call, rows)
        cell = geo.geohash(c, int(call.option("precision") or 5))
        size = call.option("size")
        return _key_level(rows, cell, None, name, key, select, engine, int(size) if size else _limit(select, engine))
    raise LoweringError(f"{call.name} is no bucket")


def _condition_of(node: Node, scope: Scope) -> Column:
    if not isinstance(node, (Compare, All, Any_, Not, In, Between, Like, IsNull, Call)):
        raise LoweringError("a filter needs a condition")
    return condition(node, scope)


def _filter_test(rows: Rows, node: Node) -> tuple[Rows, Column]:
    df_before = len(rows.scope.semi)
    test = _condition_of(node, rows.scope)
    fresh = rows.scope.semi[df_before:]
    del rows.scope.semi[df_before:]
    df = rows.df
    for inner, on, _ in fresh:
        df = df.join(inner, on, "left")
    return replace_rows(rows, df), test


def _filters(rows: Rows, call: Call, key: str, name: str) -> tuple[Rows, Level]:
    parts = [a for a in call.args if isinstance(a, Call) and a.name.lower() == "filter"]
    labels = [str(plain(a)) for a in call.args if not (isinstance(a, Call) and a.name.lower() == "filter")]
    name = labels[0] if labels else name
    other = labels[1] if len(labels) > 1 else call.option("other_bucket_key")
    tests, names = [], []
    for p in parts:
        rows, test = _filter_test(rows, p.args[-1])
        tests.append(F.coalesce(test, F.lit(False)))
        names.append(str(plain(p.args[0])) if len(p.args) > 1 else p.text)
    hits = [F.when(t, F.lit(n)) for t, n in zip(tests, names, strict=True)]
    if other:
        hits.append(F.when(~reduce(lambda a, b: a | b, tests), F.lit(other)))
        names.append(other)
    df = rows.df.withColumn(key, F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    return replace_rows(rows, df), Level(name, key, domain=names, position={n: i for i, n in enumerate(names)})


def _order_option(given, default: tuple[str, bool]) -> tuple[str, bool]:
    if given is None:
        return default
    text_ = str(given).strip()
    if text_.startswith(("{", "[")):
        orders = json.loads(text_)
        orders = orders if isinstance(orders, list) else [orders]
        k, v = next(iter(orders[0].items()))
        # Keys are different, so what follows the first order only matters for a count or a metric, whose ties go by key.
        if any(next(iter(o)).lstrip("_") not in ("key", "term") for o in orders[1:]):
            raise LoweringError("the second order of buckets can be their key only")
        known = {"_key": "key", "_term": "key", "_count": "count", "key": "key", "term": "key", "count": "count"}
        return known.get(k, f"={k}"), str(v).lower() == "asc"
    text_ = text_.lower()
    if re.fullmatch(r"(?:count|key|term)_(?:asc|desc)", text_):
        what, _, way = text_.partition("_")
        return "count" if what == "count" else "key", way == "asc"
    return "key", text_ == "asc"


def _terms(rows: Rows, call: Call, key: str, number: int, name: str, select: Select, engine) -> tuple[Rows, Level]:
    rows, c, kind, shown = _option_field(call, rows)
    name = str(call.option("alias") or shown)
    if isinstance(kind, T.ArrayType):
        c = F.explode_outer(F.array_distinct(c))
    if (missing := call.option("missing")) is not None:
        df = rows.df.withColumn(key, c)
        element = kind.elementType if isinstance(kind, T.ArrayType) else kind
        df = df.withColumn(key, F.coalesce(F.col(key), F.lit(missing).cast(element) if element is not None else F.lit(missing)))
    else:
        df = rows.df.withColumn(key, c).filter(F.col(key).isNotNull())
    for option, keep in (("include", True), ("exclude", False)):
        given = call.option(option)
        if given is None:
            continue
        given = str(given).strip()
        if given.startswith("{"):
            part = json.loads(given)
            test = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(int(part["num_partitions"]))) == int(part["partition"])
        elif (listed := _json_list(given)) is not None:
            test = F.col(key).cast("string").isin(listed)
        else:
            test = F.col(key).cast("string").rlike("^(?:" + given.strip('"') + ")$")
        df = df.filter(test if keep else ~test)
    size = call.option("size")
    size = int(size) if size is not None else (TERMS_SIZE if number == 0 and engine.parity else None) if number == 0 else _limit(select, engine)
    return replace_rows(rows, df), Level(name, key, _order_option(call.option("order"), ("count", False)), size, int(call.option("min_doc_count") or 1))


def _json_list(given: str) -> list[str] | None:
    """The values of a JSON list; None for a pattern, which may begin with a bracket too."""
    try:
        found = json.loads(given) if given.startswith("[") else None
    except ValueError:
        return None
    return None if found is None else [str(x) for x in found]


def _bounds(values: list) -> list[tuple]:
    return list(zip(values, values[1:], strict=False))


def _show(v) -> str:
    return "*" if v is None else f"{float(v)}"


def _ranges(rows: Rows, call: Call, key: str, name: str, low: str) -> tuple[Rows, Level]:
    by_date = low != "range"
    values: list = []
    options: dict = {}
    for k, v in call.named:
        options[k.lower()] = plain(v)
    if by_date:
        field_ = Col(str(options["field"])) if "field" in options else _as_col(call.args[0])
        values = [plain(a) for a in (call.args if "field" in options else call.args[1:])]
        if "from" in options or "to" in options:
            pairs = [(options.get("from"), options.get("to"))]
        else:
            pairs = _bounds(values)
        pattern = str(options.get("format") or DATE_PATTERN)
        c = value(field_, rows.scope).cast("timestamp")
        zone = dates.zone(str(options["time_zone"])) if options.get("time_zone") else None
        ends = {v: dates.moment(str(v), pattern) for p in pairs for v in p if v is not None}
        # Bounds are local times, but for those counted from now.
        ends = {v: F.to_utc_timestamp(e, zone) if zone and not str(v).strip().startswith("now") else e for v, e in ends.items()}
        local = lambda e: F.from_utc_timestamp(e, zone) if zone else e
        show = lambda v: F.lit("*") if v is None else F.date_format(local(ends[v]), pattern)
        labels = [F.concat(show(a), F.lit("-"), show(b)) for a, b in pairs]
        limits = [(None if a is None else ends[a], None if b is None else ends[b]) for a, b in pairs]
    else:
        named = options.get("field")
        field_ = Col(str(named)) if named is not None else call.args[0]
        c = value(field_, rows.scope)
        pairs = _bounds([float(plain(a)) for a in (call.args if named is not None else call.args[1:])])
        labels = [F.lit(f"{_show(a)}-{_show(b)}") for a, b in pairs]
        limits = [(F.lit(a), F.lit(b)) for a, b in pairs]
    name = str(options.get("alias") or call.text)
    hits = []
    for i, (a, b) in enumerate(limits):
        inside = F.lit(True)
        inside = inside if a is None else inside & (c >= a)
        inside = inside if b is None else inside & (c < b)
        hits.append(F.when(inside & c.isNotNull(), F.lit(i)))
    df = rows.df.withColumn(key, F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    level = Level(name, key, domain=list(range(len(labels))))
    level.extra = labels
    return replace_rows(rows, df), level


def _histogram(rows: Rows, call: Call, key: str, number: int, name: str) -> tuple[Rows, Level]:
    rows, c, _, _ = _option_field(call, rows)
    step = float(call.option("interval") or 1)
    offset = float(call.option("offset") or 0)
    df = rows.df.withColumn(key, F.floor((c.cast("double") - offset) / step) * step + offset).filter(F.col(key).isNotNull())
    rows = replace_rows(rows, df)
    least = call.option("min_doc_count")
    level = Level(name, key, _order_option(call.option("order"), ("key", True)), least=max(1, int(least or 0)))
    bounds = call.option("extended_bounds")
    if bounds or least is not None and int(least) == 0:
        ends = [F.lit(float(b)) for b in str(bounds).split(":")] if bounds else []
        number_of = lambda c: F.round((c - offset) / step).cast("long")
        widened = lambda lo, hi: (F.least(number_of(lo), *[F.floor((e - offset) / step) for e in ends[:1]]), F.greatest(number_of(hi), *[F.floor((e - offset) / step) for e in ends[1:]])) if ends else (number_of(lo), number_of(hi))
        level.gaps = lambda lo, hi: F.transform(F.sequence(*widened(lo, hi)), lambda i: i * step + offset)
    return rows, level


def _date_histogram(rows: Rows, call: Call, key: str, number: int, name: str) -> tuple[Rows, Level]:
    rows, c, _, _ = _option_field(call, rows)
    at = c.cast("timestamp")
    zone = call.option("time_zone")
    local = F.from_utc_timestamp(at, dates.zone(str(zone))) if zone else at
    calendar, fixed = call.option("calendar_interval"), call.option("fixed_interval")
    plain_ = call.option("interval")
    plain_ = plain_.strip() if isinstance(plain_, str) else plain_
    if calendar is None and fixed is None:
        calendar, fixed = (plain_, None) if plain_ in dates.CALENDAR else (None, plain_ or "1d")
    offset = dates.fixed_micros(str(call.option("offset"))) if call.option("offset") else 0
    micros = F.unix_micros(local) - offset
    if calendar is not None:
        unit = dates.CALENDAR[str(calendar).strip()]
        bucket = F.timestamp_micros(F.unix_micros(F.date_trunc(unit, F.timestamp_micros(micros))) + offset)
        step = F.expr({"YEAR": "interval 1 year", "QUARTER": "interval 3 months", "MONTH": "interval 1 month", "WEEK": "interval 7 days", "DAY": "interval 1 day", "HOUR": "interval 1 hour", "MINUTE": "interval 1 minute", "SECOND": "interval 1 second"}[unit])
    else:
        size = dates.fixed_micros(str(fixed))
        bucket = F.timestamp_micros((micros - F.pmod(micros, F.lit(size))) + offset)
        step = F.expr(f"make_dt_interval(0, 0, 0, {size} / 1e6)")
    df = rows.df.withColumn(key, bucket).filter(F.col(key).isNotNull())
    rows = replace_rows(rows, df)
    least = call.option("min_doc_count")
    level = Level(name, key, _order_option(call.option("order"), ("key", True)), least=max(1, int(least or 0)))
    bounds = call.option("extended_bounds")
    if bounds or least is not None and int(least) == 0:
        ends = [dates.moment(b) for b in re.split(r"(?<=\D):|:(?=\D)|(?<=\d\d):(?=\d{4}-)", str(bounds))] if bounds else []
        level.gaps = lambda lo, hi: F.sequence(F.least(lo, ends[0]) if ends else lo, F.greatest(hi, ends[1]) if ends else hi, step)
    pattern = str(call.option("format") or DATE_PATTERN)
    level.extra = [F.date_format(F.col(key), pattern)]
    return rows, level


# ---------------------------------------------------------------- metrics


def metric_name(i: Item) -> str:
    return i.alias or i.text


def _argument(call: Call, rows: Rows) -> tuple[Column, T.DataType | None, Rows]:
    arg = call.args[0]
    if isinstance(arg, Call) and arg.name.lower() == "nested":
        node = _as_col(arg.args[0])
        path = node.name.rpartition(".")[0]
        if rows.home.strip(path) in rows.entered:
            return value(node, rows.scope), rows.scope.kind(node), rows
        return value(node, rows.home), rows.home.kind(node), rows
    if isinstance(arg, Call) and arg.name.lower() == "reverse_nested":
        node = _as_col(arg.args[0])
        return value(node, rows.home), rows.home.kind(node), rows
    if isinstance(arg, Call) and arg.name.lower() == "children":
        node = _as_col(arg.args[1])
        return value(node, rows.scope), rows.scope.kind(node), rows
    return value(arg, rows.scope), rows.scope.kind(arg), rows


def metrics(i: Item, rows: Rows, engine) -> list[tuple[str, Column]]:
    """Output columns of a metric: one, or one for each of its parts as name.part."""
    call: Call = i.node
    low, name = call.name.lower(), metric_name(i)
    if low == "count":
        if not call.args or isinstance(call.args[0], (Star, Lit)):
            return [(name, F.count(F.lit(1)))]
        c, kind, _ = _argument(call, rows)
        if call.distinct:
            if engine.parity:
                return [(name, F.approx_count_distinct(c, 0.02))]
            return [(name, F.count_distinct(c))]
        return [(name, F.sum(F.coalesce(F.size(c), F.lit(0))).cast("long") if isinstance(kind, T.ArrayType) else F.count(c))]
    if low == "geo_bounds":
        point = value(Col(str(call.option("field") or plain(call.args[0]))), rows.scope)
        return [(f"{name}.topLeft.lon", F.min(point["lon"])), (f"{name}.topLeft.lat", F.max(point["lat"])), (f"{name}.bottomRight.lon", F.max(point["lon"])), (f"{name}.bottomRight.lat", F.min(point["lat"]))]
    if low == "scripted_metric":
        return [(name, _scripted(call, rows))]
    if low == "group_concat":
        return [(name, F.listagg(_argument(call, rows)[0].cast("string"), F.lit(",")))]
    c, kind, _ = _argument(call, rows)
    if isinstance(kind, T.ArrayType):
        whole = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))
        each = {"sum": F.sum(whole), "min": F.min(F.array_min(c)), "max": F.max(F.array_max(c)), "avg": F.sum(whole) / F.sum(F.size(c))}
        if low not in each:
            raise LoweringError(f"{call.name} over an array")
        return [(name, each[low].cast("double"))]
    d = _as_double(c, kind)
    simple = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "stddev": F.stddev_pop}
    if low in simple:
        return [(name, simple[low](d))]
    base = [("count", F.count(d)), ("sum", F.sum(d)), ("avg", F.avg(d)), ("min", F.min(d)), ("max", F.max(d))]
    if low == "stats":
        return [(f"{name}.{k}", x) for k, x in base]
    if low == "extended_stats":
        return [(f"{name}.{k}", x) for k, x in [*base, ("sumOfSquares", F.sum(d * d)), ("variance", F.var_pop(d)), ("stdDeviation", F.stddev_pop(d))]]
    if low == "percentiles":
        points = [float(plain(a)) for a in call.args[1:]] or list(PERCENTS)
        exact = F.percentile(d, F.array(*[F.lit(p / 100) for p in points])) if not engine.parity else F.percentile_approx(d, [p / 100 for p in points], 10_000)
        return [(f"{name}.{p}", exact[n]) for n, p in enumerate(points)]
    if low == "percentile_ranks":
        return [(f"{name}.{float(plain(a))}", 100 * F.avg(F.when(d.isNotNull(), (d <= float(plain(a))).cast("double")))) for a in call.args[1:]]
    raise LoweringError(f"unknown aggregate {call.name}")


def _as_double(c: Column, kind) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_millis(c.cast("timestamp")).cast("double")
    return c.try_cast("double")


def _scripted(call: Call, rows: Rows) -> Column:
    """map_script: a SQL expression of a row; combine_script: the SQL aggregate over it (default collect_list); reduce_script: a SQL expression of `_agg`."""
    options = {k.lower(): str(plain(v)) for k, v in call.named}
    params = {k[1:]: v for k, v in options.items() if k.startswith("@")}
    code = options["map_script"]
    for k, v in params.items():
        code = re.sub(rf"(?<![\w.]){re.escape(k)}(?!\w)", v if re.fullmatch(r"-?\d+(\.\d+)?", v) else f"'{v}'", code)
    code = re.sub(r"doc\[['\"]([^'\"]+)['\"]\]\.value", r"\1", code)
    out = f"{options.get('combine_script') or 'collect_list'}({code})"
    if reduce_ := options.get("reduce_script"):
        out = re.sub(r"\b_agg\b", f"({out})", reduce_)
    return F.expr(out)


def _top_hits(rows: DataFrame, keys: list[str], i: Item, columns: list[str], id_col: str) -> DataFrame:
    """keys and an array of the group's first rows: ranked before they are gathered, so no group is held whole."""
    call: Call = i.node
    size, start = int(call.option("size") or 3), int(call.option("from") or 0)
    take, leave_ = (str(call.option(k) or "") for k in ("include", "exclude"))
    order = [F.col(f"`{k}`").desc_nulls_last() if str(plain(v)).lower() == "desc" else F.col(f"`{k}`").asc_nulls_last() for k, v in call.named if k.lower() not in ("size", "from", "include", "exclude", "alias")]
    shown = [c for c in columns if (not take or c in [t.strip() for t in take.split(",")]) and c not in [t.strip() for t in leave_.split(",")]]
    # Ties go by the key column, so that the scan and the sort hold no column but those shown and sorted by.
    ties = [F.col(f"`{id_col}`")] if id_col in columns else [F.col(f"`{c}`") for c in columns if isinstance(rows.schema[c].dataType, T.AtomicType)] or [F.lit(0)]
    window = Window.partitionBy(*keys).orderBy(*order, *ties)
    ranked = rows.withColumn("__rn", F.row_number().over(window)).filter((F.col("__rn") > start) & (F.col("__rn") <= start + size))
    hit = F.struct("__rn", F.struct(*[F.col(f"`{c}`") for c in shown]).alias("hit"))
    found = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("__hits"))
    return found.select(*keys, F.transform("__hits", lambda h: h["hit"]).alias(metric_name(i)))


# ---------------------------------------------------------------- the query


def aggregate(select: Select, base: DataFrame, scope: Scope, engine) -> DataFrame:
    if any(_is_significant(n) for g in select.groups for n in g):
        return _significant(select, base, scope, engine)
    lists = select.groups or ((),)
    lists = tuple(tuple(n for n in g if not (isinstance(n, Call) and n.name.lower() == "geo_bounds")) for g in lists)
    boxes = [Item(n, n.option("alias") or n.text, n.text) for g in select.groups for n in g if isinstance(n, Call) and n.name.lower() == "geo_bounds"]
    if (once := _grouping_sets(select, lists, boxes, base, scope, engine)) is not None:
        return once
    outs = []
    for number, group in enumerate(lists):
        df = _one_list(select, group, boxes, base, scope, engine)
        outs.append(df.withColumn("_grouping", F.lit(number)) if len(lists) > 1 else df)
    if len(outs) == 1:
        return outs[0]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outs)


def _grouping_sets(select: Select, lists: tuple, boxes: list[Item], base: DataFrame, scope: Scope, engine) -> DataFrame | None:
    """Several lists of plain columns, all buckets of them: one scan and one aggregation. None where that does not do."""
    items = [i for i in select.items if is_metric(i.node)]
    nodes = list(dict.fromkeys(n for g in lists for n in g))
    plain_ = all(isinstance(n, Col) and scope.kind(n) is not None and not isinstance(scope.kind(n), T.ArrayType) for n in nodes) and all(lists)
    if len(lists) < 2 or not plain_ or boxes or select.having is not None or select.orders or _limit(select, engine) is not None:
        return None
    if any(i.node.name.lower() in PIPELINE | {"tophits"} or any(isinstance(a, Call) and a.name.lower() in BUCKETS for a in i.node.args) for i in items):
        return None
    rows = Rows(base.withColumns({f"__k{n}": value(node, scope) for n, node in enumerate(nodes)}), scope, scope)
    named = [(f"__m{n}", name, c) for n, (name, c) in enumerate(x for i in items for x in metrics(i, rows, engine))]
    key = {node: f"__k{n}" for n, node in enumerate(nodes)}
    sets = [[F.col(key[n]) for n in g] for g in lists]
    # A set's bits: which keys it lacks. Rows with a null key vanish from the sets that have the key.
    out = rows.df.groupingSets(sets, *[F.col(k) for k in key.values()]).agg(F.grouping_id(*key.values()).alias("__id"), F.count(F.lit(1)).alias("__count"), *[c.alias(m) for m, _, c in named])
    bits = [sum(1 << (len(nodes) - 1 - i) for i, n in enumerate(nodes) if n not in g) for g in lists]
    if len(set(bits)) < len(bits):
        return None
    number = F.coalesce(*[F.when(F.col("__id") == b, F.lit(n)) for n, b in enumerate(bits)])
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() | (F.col("__id").bitwiseAND(F.lit(1 << (len(nodes) - 1 - i)).cast("long")) != 0) for i, k in enumerate(key.values())])
    out = out.withColumn("_grouping", number).filter(there).orderBy("_grouping", F.desc("__count"), *key.values())
    shown = [F.col(k).alias(_text_of(n)) for n, k in key.items()] + [F.col(m).alias(name) for m, name, _ in named]
    return out.select(*shown, *([] if items else [F.col("__count").alias("doc_count")]), "_grouping")


def _one_list(select: Select, group: tuple[Node, ...], boxes: list[Item], base: DataFrame, scope: Scope, engine) -> DataFrame:
    rows = Rows(base, scope, scope)
    if _needs_row_id(group, select):
        rows = Rows(base.withColumn("__row", F.monotonically_increasing_id()), scope, scope, True)
    levels: list[Level] = []
    if rows.has_id and (run := _simple_run(group, select)) and (done := within(rows, group[:run], select, engine)) is not None:
        rows, levels = done
    for node in group[len(levels) :]:
        rows, level = add_level(rows, node, len(levels), select, engine)
        levels.append(level)
    for i in select.items:  # metrics over children or a nested array that no level has entered
        arg = i.node.args[0] if is_metric(i.node) and i.node.args else None
        if isinstance(arg, Call) and arg.name.lower() == "children":
            rows = enter_children(rows, str(plain(arg.args[0])))
        if isinstance(arg, Call) and arg.name.lower() == "reverse_nested" and len(arg.args) > 1 and str(plain(arg.args[1])).startswith("~"):
            rows = enter(rows, str(plain(arg.args[1]))[1:])
    keys = [lv.key for lv in levels]
    rows = _trim_levels(rows, levels, select)
    items = [i for i in select.items if is_metric(i.node)]
    plain_metrics = [i for i in items if i.node.name.lower() not in PIPELINE | {"tophits"}] + boxes
    columns = [(n, c) for i in plain_metrics for n, c in metrics(i, rows, engine)]
    named = [(f"__m{n}", name, c) for n, (name, c) in enumerate(columns)]
    data = _once_each(rows, items)
    out = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count"), *[c.alias(m) for m, _, c in named])
    for i in items:
        if i.node.name.lower() == "tophits":
            hits = _top_hits(data, keys, i, base.columns, scope.source.id_col)
            cond = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]) if keys else None
            out = out.alias("a").join(hits.alias("b"), cond, "left") if keys else out.crossJoin(hits)
            out = out.select(*[F.col(f"a.{c}") for c in data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count")).columns], *[F.col(m) for m, *_ in named], F.col(f"`{metric_name(i)}`")) if keys else out
    out = _fill_empty(out, levels, [(m, c) for m, _, c in named], columns)
    if levels and levels[-1].least > 1:
        out = out.filter(F.col("__count") >= levels[-1].least)
    shown = {m: name for m, name, _ in named}
    return _finish(out, levels, shown, items, select, engine, boxes)


def _once_each(rows: Rows, items: list[Item]) -> DataFrame:
    """A metric of the row itself counts it once in a bucket, however many of its elements are there."""
    back = any(isinstance(a, Call) and a.name.lower() == "reverse_nested" and len(a.args) == 1 for i in items for a in i.node.args)
    if back and rows.has_id and not rows.once:
        return rows.df.dropDuplicates(["__row", *[c for c in rows.df.columns if re.fullmatch(r"__k\d+", c)]])
    return rows.df


def _trim_levels(rows: Rows, levels: list[Level], select: Select) -> Rows:
    """Every level but the last keeps the buckets with rows enough, and the first of these; they are found by a count over that level."""
    for n, level in enumerate(levels[:-1]):
        if level.order[0].startswith("="):
            raise LoweringError(f"metrics belong to the last level, {level.name} cannot be ordered by one")
        if level.size is None and level.least <= 1:
            continue
        above = [lv.key for lv in levels[:n]]
        kept = rows.df.groupBy(*above, level.key).agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") >= level.least)
        order = [F.col("__c").asc() if level.order[1] else F.col("__c").desc()] if level.order[0] == "count" else []
        order.append(F.col(level.key).asc() if level.order[0] == "count" or level.order[1] else F.col(level.key).desc())
        if level.size is not None and above:
            kept = kept.withColumn("__r", F.row_number().over(Window.partitionBy(*above).orderBy(*order))).filter(F.col("__r") <= level.size)
        elif level.size is not None:
            kept = kept.orderBy(*order).limit(level.size)
        rows = replace_rows(rows, rows.df.join(kept.select(*above, level.key), [*above, level.key], "left_semi"))
    return rows


def _fill_empty(out: DataFrame, levels: list[Level], named: list, columns: list) -> DataFrame:
    """The last level's buckets without rows, below every parent there is."""
    if not levels or (levels[-1].domain is None and levels[-1].gaps is None) or not levels[-1].visible and len(levels) > 1:
        return out
    level = levels[-1]
    spark = out.sparkSession
    kind = out.schema[level.key].dataType
    above = [lv.key for lv in levels[:-1]]
    if level.gaps is not None:
        # From each parent's own first bucket to its last one.
        ends = out.groupBy(*above).agg(F.min(level.key).alias("__lo"), F.max(level.key).alias("__hi"))
        every = ends.select(*above, F.explode(level.gaps(F.col("__lo"), F.col("__hi"))).alias(level.key))
    else:
        domain = spark.range(1).select(F.explode(F.array(*[F.lit(d).cast(kind) for d in level.domain])).alias(level.key))
        # The domain is as small as its definition; parents are buckets, not rows.
        every = out.select(*above).distinct().crossJoin(F.broadcast(domain)) if above else domain
    out = every.join(out, [*above, level.key], "left").withColumn("__count", F.coalesce("__count", F.lit(0)))
    zero = [m for (m, _), (_, c) in zip(named, columns, strict=True) if re.match(r"count\(|Column<'count", str(c)) or "count(" in str(c).split(" ")[0].lower()]
    return out.withColumns({m: F.coalesce(F.col(m), F.lit(0)) for m in zero}) if zero else out


def _finish(out: DataFrame, levels: list[Level], shown: dict[str, str], items: list[Item], select: Select, engine, boxes: list[Item]) -> DataFrame:
    by_name = {name: m for m, name in shown.items()}
    for i in items:
        low = i.node.name.lower()
        if low in ("movingavg", "rollingstd"):
            out, by_name = _moving(out, i, levels, by_name)
            shown[f"__p_{metric_name(i)}"] = metric_name(i)
    siblings = [i for i in items if i.node.name.lower() in ("max_bucket", "min_bucket")]
    if siblings:
        return _extremes(out, siblings, levels, by_name)
    alias_of = {i.alias: i.text for i in select.items if i.alias}

    def named(node: Node, text_: str) -> Column | None:
        name = node.name if isinstance(node, Col) else text_
        for candidate in (name, alias_of.get(name), text_):
            if candidate is None:
                continue
            hit = next((m for n, m in by_name.items() if n.lower() == candidate.lower()), None)
            if hit:
                return F.col(hit)
            lv = next((lv for lv in levels if lv.name == candidate), None)
            if lv:
                return F.col(lv.key)
        if isinstance(node, Call) and node.name.lower() == "count" or isinstance(node, Col) and node.name in ("_count", "doc_count"):
            return F.col("__count")
        if isinstance(node, Col) and node.name in ("_key", "_term") and levels:
            return F.col(levels[-1].key)
        return None

    if select.having is not None:
        out = out.filter(F.coalesce(_having(select.having, named), F.lit(False)))
    sort: list[Column] = []
    given = []
    for o in select.orders:
        c = named(o.node, o.text)
        if c is not None:
            given.append(c.asc_nulls_last() if o.ascending else c.desc_nulls_last())
    for n, lv in enumerate(levels[:-1]):
        if lv.order[0] == "count":
            above = [x.key for x in levels[: n + 1]]
            out = out.withColumn(f"__o{n}", F.sum("__count").over(Window.partitionBy(*above)))
            sort.append(F.col(f"__o{n}").asc() if lv.order[1] else F.col(f"__o{n}").desc())
        sort.append(F.col(lv.key).desc() if lv.order == ("key", False) else F.col(lv.key).asc())
    if levels:
        last = levels[-1]
        own = given or ([F.col("__count").asc() if last.order[1] else F.col("__count").desc()] if last.order[0] == "count" else [])
        if not given and last.order[0].startswith("="):
            c = named(Col(last.order[0][1:]), last.order[0][1:])
            if c is None:
                raise LoweringError(f"no metric {last.order[0][1:]} to order {last.name} by")
            own = [c.asc_nulls_last() if last.order[1] else c.desc_nulls_last()]
        tie = F.col(last.key).desc() if last.order == ("key", False) and not given else F.col(last.key).asc()
        limit = last.size
        if len(levels) == 1:
            out = out.orderBy(*own, tie)
            out = out.limit(limit) if limit is not None else out
        else:
            if limit is not None:
                rank = F.row_number().over(Window.partitionBy(*[lv.key for lv in levels[:-1]]).orderBy(*own, tie))
                out = out.withColumn("__rank", rank).filter(F.col("__rank") <= limit)
            out = out.orderBy(*sort, *own, tie)
    columns = []
    for lv in levels:
        if not lv.visible and len(levels) > 1:
            continue
        c = F.col(lv.key)
        if lv.domain is not None and lv.extra:
            c = F.element_at(F.array(*lv.extra), F.col(lv.key).cast("int") + 1)
        elif lv.extra:
            c = lv.extra[0]
        columns.append(c.alias(lv.name))
    for i in items:
        name = metric_name(i)
        if i.node.name.lower() == "tophits":
            columns.append(F.col(f"`{name}`"))
            continue
        columns += [F.col(m).alias(n) for m, n in shown.items() if n == name or n.startswith(f"{name}.") and n not in [metric_name(x) for x in items if x is not i]]
    for b in boxes:
        columns += [F.col(m).alias(n) for m, n in shown.items() if n.startswith(f"{b.alias}.")]
    if not items and not boxes:
        columns.append(F.col("__count").alias("doc_count"))
    seen: set[str] = set()
    return out.select(*[c for c in columns if not (str(c) in seen or seen.add(str(c)))])


def _having(node: Node, named) -> Column:
    if isinstance(node, All):
        return reduce(lambda a, b: a & b, [_having(x, named) for x in node.items])
    if isinstance(node, Any_):
        return reduce(lambda a, b: a | b, [_having(x, named) for x in node.items])
    if isinstance(node, Not):
        return ~_having(node.item, named)

    def side(x: Node) -> Column:
        if isinstance(x, Lit):
            return F.lit(x.value)
        if isinstance(x, Binary):
            a, b = side(x.left), side(x.right)
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "%": a % b}[x.op]
        c = named(x, _text_of(x))
        if c is None:
            raise LoweringError(f"HAVING knows no {_text_of(x)}")
        return c

    if isinstance(node, Compare):
        a, b = side(node.left), side(node.right)
        return {"=": a == b, "<>": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[node.op]
    if isinstance(node, Between):
        c = side(node.node).between(side(node.low), side(node.high))
        return ~c if node.negated else c
    if isinstance(node, In):
        c = side(node.node).isin([side(x) for x in node.items])
        return ~c if node.negated else c
    raise LoweringError("HAVING takes comparisons, AND, OR and NOT")


def _path_column(call: Call, by_name: dict[str, str]) -> Column:
    """The metric that a pipeline function reads: a>b or a=b names b inside a."""
    path = str(call.named[0][1].name if call.named and isinstance(call.named[0][1], Col) else plain(call.named[0][1]) if call.named else plain(call.args[0]))
    name = path.rpartition(">")[2].strip()
    if name in ("_count", "COUNT(*)", "count(*)"):
        return F.col("__count")
    hit = next((m for n, m in by_name.items() if n.lower() == name.lower()), None)
    if hit is None:
        raise LoweringError(f"no metric {name}")
    return F.col(hit)


def _moving(out: DataFrame, i: Item, levels: list[Level], by_name: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Over the `n` buckets before each one, within its parent; buckets without the metric are skipped."""
    if not levels:
        raise LoweringError(f"{i.node.name} needs a group")
    c = _path_column(i.node, by_name)
    width = int(plain(i.node.args[-1]))
    if width <= 0:
        raise LoweringError("the window must be positive")
    before = Window.partitionBy(*[lv.key for lv in levels[:-1]]).orderBy(levels[-1].key).rowsBetween(-width, -1)
    f = F.avg(c) if i.node.name.lower() == "movingavg" else F.stddev_pop(c)
    name = metric_name(i)
    return out.withColumn(f"__p_{name}", f.over(before)), by_name | {name: f"__p_{name}"}


def _extremes(out: DataFrame, items: list[Item], levels: list[Level], by_name: dict[str, str]) -> DataFrame:
    """One row: of each item the largest or smallest value of its metric over all buckets, and the first key of a bucket that has it.

    The key's column is `keys`, or name.keys where there are several items.
    """
    if not levels:
        raise LoweringError(f"{items[0].node.name} needs a group")
    last = levels[-1]
    key = last.extra[0] if last.extra and last.domain is None else F.col(last.key)
    found, shown = [], []
    for n, i in enumerate(items):
        c = _path_column(i.node, by_name)
        # The best value first, then the least key, in one pass: an array's order is that of its elements.
        if i.node.name.lower() == "max_bucket":
            best, first = F.max(c), F.min(F.when(c.isNotNull(), F.struct((-c).alias("v"), key.cast("string").alias("k"))))
        else:
            best, first = F.min(c), F.min(F.when(c.isNotNull(), F.struct(c.alias("v"), key.cast("string").alias("k"))))
        found += [best.alias(f"__best{n}"), first["k"].alias(f"__keys{n}")]
        shown += [F.col(f"__keys{n}").alias("keys" if len(items) == 1 else f"{metric_name(i)}.keys"), F.col(f"__best{n}").alias(metric_name(i))]
    return out.agg(*found).select(*shown)


def _significant(select: Select, base: DataFrame, scope: Scope, engine) -> DataFrame:
    """Words that are more frequent in a bucket's rows than in all rows, by score: keys of the levels above, word, metrics, doc_count, bg_count, score."""
    if len(select.groups) > 1 or not _is_significant(select.groups[0][-1]) or any(_is_significant(n) for n in select.groups[0][:-1]):
        raise LoweringError("significant_text is the last level of one list")
    call = select.groups[0][-1]
    field_ = Col(str(call.option("field") or plain(call.args[0])))
    rows, levels = Rows(base, scope, scope), []
    for node in select.groups[0][:-1]:
        rows, level = add_level(rows, node, len(levels), select, engine)
        levels.append(level)
    word = Level(str(call.option("alias") or call.text), "__word")
    rows = _trim_levels(rows, [*levels, word], select)
    items = [i for i in select.items if is_metric(i.node)]
    if any(i.node.name.lower() in PIPELINE | {"tophits"} for i in items):
        raise LoweringError("significant_text takes simple metrics")
    columns = [(f"__m{n}", name, c) for n, (name, c) in enumerate(x for i in items for x in metrics(i, rows, engine))]
    above = [lv.key for lv in levels]
    words = lambda df: df.withColumn("__word", F.explode(F.array_distinct(text.tokens(value(field_, scope)))))
    front = words(rows.df).groupBy(*above, "__word").agg(F.count(F.lit(1)).alias("doc_count"), *[c.alias(m) for m, _, c in columns])
    front = front.filter(F.col("doc_count") >= int(call.option("min_doc_count") or 3))
    for option, keep in (("include", True), ("exclude", False)):
        if given := call.option(option):
            test = F.col("__word").rlike(f"^(?:{given})$")
            front = front.filter(test if keep else ~test)
    back = words(scope.df.select(value(field_, scope).alias(field_.name) if "." not in field_.name else F.col("*"))).groupBy("__word").agg(F.count(F.lit(1)).alias("bg_count"))
    sizes = rows.df.groupBy(*above).agg(F.count(F.lit(1)).alias("__f"))
    front = front.join(sizes, above) if above else front.crossJoin(F.broadcast(sizes))
    front = front.join(back, "__word").crossJoin(F.broadcast(scope.df.agg(F.count(F.lit(1)).alias("__b"))))
    fg, bg = F.col("doc_count") / F.col("__f"), F.col("bg_count") / F.col("__b")
    out = front.withColumn("score", (fg - bg) * (fg / bg)).filter("score > 0")
    size = int(call.option("size") or 10)
    if above:
        rank = F.row_number().over(Window.partitionBy(*above).orderBy(F.desc("score"), "__word"))
        out = out.withColumn("__rank", rank).filter(F.col("__rank") <= size).orderBy(*above, F.desc("score"), "__word")
    else:
        out = out.orderBy(F.desc("score"), "__word").limit(size)
    keys = [(F.element_at(F.array(*lv.extra), F.col(lv.key).cast("int") + 1) if lv.domain is not None and lv.extra else lv.extra[0] if lv.extra else F.col(lv.key)).alias(lv.name) for lv in levels if lv.visible]
    return out.select(*keys, F.col("__word").alias(word.name), *[F.col(m).alias(name) for m, name, _ in columns], "doc_count", "bg_count", "score")


def _is_significant(node: Node) -> bool:
    return isinstance(node, Call) and node.name.lower() == "significant_text"
