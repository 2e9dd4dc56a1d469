"""Two-table joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsql.functions import geo
from docsql.operators.aggregate import aggregate, is_aggregated
from docsql.operators.expressions import LoweringError, Scope, condition, value
from docsql.operators.hits import order_columns
from docsql.plans.tree import All, Any_, Call, Col, Compare, Join, Node, Select, Star
from docsql.sources.catalog import Source


def join(select: Select, engine) -> DataFrame:
    """Inner and left joins. Equal keys meet as texts and null keys meet null keys; other conditions are as in WHERE."""
    j: Join = select.join
    left, right = j.left.alias or j.left.name, j.right.alias or j.right.name
    if left == right:
        raise LoweringError("the two tables need different aliases")
    ignore = select.hint("IGNORE_UNAVAILABLE") is not None
    sources = {a: engine.catalog.scan([t.name], ignore) for a, t in ((left, j.left), (right, j.right))}
    limits = _table_limits(select)
    where = _split(select.where)
    scopes, frames = {}, {}
    for n, (alias, source) in enumerate(sources.items()):
        scope = Scope(source.df, source.df.schema, source, engine, (alias,))
        df = source.df
        mine = [c for c in where if _tables(c, sources) == {alias}]
        # What speaks of one table filters that table before the join, also the padded side of a left join.
        for c in mine:
            test = condition(c, scope)
            df = engine.with_marks(df, scope).filter(test).select(*[F.col(f"`{x}`") for x in source.df.columns])
            scope.semi.clear()
        where = [c for c in where if c not in mine]
        if limits[n] is not None:
            df = df.limit(limits[n])
        frames[alias] = df.select(*[F.col(f"`{c}`").alias(f"{alias}.{c}") for c in df.columns])
        scopes[alias] = Scope(frames[alias], source.df.schema, source, engine, (alias,), renamed=f"{alias}.")
    both = Scope(None, sources[left].df.schema, sources[left], engine, others=scopes)
    shapes, ons, where = (None, [], where) if select.hint("USE_NL", "USE_NESTED_LOOPS") else _shapes(j, where, left, right, sources)
    on = None if j.on is None or shapes else _on(j.on, both)
    other = frames[right]
    if select.hint("USE_NL", "USE_NESTED_LOOPS"):
        other = other.hint("shuffle_replicate_nl") if j.kind == "inner" else other
    by_parts = j.kind == "inner" and isinstance(j.on, Any_) and not select.hint("USE_NL", "USE_NESTED_LOOPS") and all(_has_equality(x, sources) for x in j.on.items)
    if shapes:
        df = _by_shapes(frames[left], other, [value(s, both) for s in shapes], [_on(x, both) for x in ons], j.kind, engine)
    elif by_parts:
        # Each pair comes from the first part that it fits, so the parts share none, and each is an equality join.
        parts = [F.coalesce(_on(x, both), F.lit(False)) if not _equality(x, sources) else _on(x, both) for x in j.on.items]
        df = reduce(DataFrame.unionAll, [frames[left].join(other, reduce(lambda a, b: a & ~b, parts[:n], c), "inner") for n, c in enumerate(parts)])
    else:
        df = frames[left].crossJoin(other) if on is None else frames[left].join(other, on, j.kind)
    if where:
        test = condition(All(tuple(where)) if len(where) > 1 else where[0], both)
        df = engine.with_marks(df, both).filter(test)
    if is_aggregated(select):
        return aggregate(select, df, both, engine)
    orders = order_columns(select.orders, both)
    if orders:
        df = df.orderBy(*orders)
    if select.offset:
        df = df.offset(select.offset)
    limit = select.limit if select.limit is not None else 200 if engine.parity else None
    if limit is not None:
        df = df.limit(limit)
    return _project(df, select, both, sources)


def _table_limits(select: Select) -> list[int | None]:
    hint = select.hint("JOIN_TABLES_LIMIT")
    given = [None if a.lower() == "null" else int(a) for a in hint.args] if hint else []
    return [*given, None, None][:2]


def _split(where: Node | None) -> list[Node]:
    return [] if where is None else [x for c in where.items for x in _split(c)] if isinstance(where, All) else [where]


def _tables(node, aliases) -> set[str]:
    """The aliases that a condition mentions."""
    if isinstance(node, Col):
        head = node.name.partition(".")[0]
        return {head} if head in aliases else set(aliases)
    found: set[str] = set()
    if hasattr(node, "__dataclass_fields__"):
        for f in node.__dataclass_fields__:
            found |= _tables(getattr(node, f), aliases)
    elif isinstance(node, tuple):
        for x in node:
            found |= _tables(x, aliases)
    return found


def _equality(node: Node, sources) -> bool:
    """Whether a condition is that a column of one table equals a column of the other."""
    return isinstance(node, Compare) and node.op == "=" and isinstance(node.left, Col) and isinstance(node.right, Col) and {len(_tables(node.left, sources)), len(_tables(node.right, sources))} == {1} and _tables(node, sources) == set(sources)


def _has_equality(node: Node, sources) -> bool:
    return _equality(node, sources) or isinstance(node, All) and any(_equality(x, sources) for x in node.items)


def _shapes(j: Join, where: list[Node], left: str, right: str, sources) -> tuple[tuple[Node, Node] | None, list[Node], list[Node]]:
    """The left and the right shapes that must intersect, the other conditions of ON, and those of WHERE; no shapes where keys are equal or the join does not ask for it."""
    ons = _split(j.on)
    if j.kind == "inner" and any(_equality(x, sources) for x in ons):
        return None, ons, where
    for part in (ons, where) if j.kind == "inner" else (ons,):
        for x in part:
            if isinstance(x, Call) and x.name.upper() == "GEO_INTERSECTS" and len(x.args) == 2:
                tables = [_tables(a, sources) for a in x.args]
                if tables in ([{left}, {right}], [{right}, {left}]):
                    pair = x.args if tables[0] == {left} else x.args[::-1]
                    return tuple(pair), [y for y in ons if y is not x], [y for y in where if y is not x]
    return None, ons, where


def _by_shapes(left: DataFrame, right: DataFrame, shapes: list[Column], ons: list[Column], kind: str, engine) -> DataFrame:
    """Each distinct shape is compared once, with those near it; then the rows meet by equal shapes. What is dealt is small and what comes of it is
    large, so it is dealt to as many tasks as there are, whatever its bytes."""
    tasks = int(engine.spark.conf.get("spark.sql.shuffle.partitions"))
    l_rows, r_rows = left.withColumn("__l_shape", F.to_json(shapes[0])), right.withColumn("__r_shape", F.to_json(shapes[1]))
    pairs = geo.intersecting(l_rows.select("__l_shape"), r_rows.select("__r_shape"), "__l_met", "__r_met")
    met = pairs.join(r_rows, F.col("__r_met") == F.col("__r_shape")).drop("__r_met", "__r_shape").repartition(tasks, "__l_met")
    on = reduce(lambda a, b: a & b, ons, F.col("__l_shape") == F.col("__l_met"))
    return l_rows.join(met, on, kind).drop("__l_shape", "__l_met")


def _on(node: Node, both: Scope) -> Column:
    if isinstance(node, All):
        out = _on(node.items[0], both)
        for x in node.items[1:]:
            out = out & _on(x, both)
        return out
    if isinstance(node, Any_):
        out = _on(node.items[0], both)
        for x in node.items[1:]:
            out = out | _on(x, both)
        return out
    if isinstance(node, Compare) and node.op == "=" and isinstance(node.left, Col) and isinstance(node.right, Col):
        a, b = value(node.left, both), value(node.right, both)
        if both.kind(node.left) != both.kind(node.right):
            a, b = a.cast("string"), b.cast("string")
        return a.eqNullSafe(b)
    return condition(node, both)


def _project(df: DataFrame, select: Select, both: Scope, sources: dict[str, Source]) -> DataFrame:
    out: list[Column] = []
    for i in select.items:
        if isinstance(i.node, Star):
            for alias, source in sources.items():
                if i.node.table in (None, alias):
                    out += [F.col(f"`{alias}.{c}`") for c in source.df.columns]
        else:
            name = i.alias or (i.node.name if isinstance(i.node, Col) else i.text)
            out.append(value(i.node, both).alias(name))
    return df.select(*out)

