"""Queries without buckets: filter, score, collapse, sort, page, project."""

from __future__ import annotations

import fnmatch
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsql.functions import dates, text
from docsql.operators.expressions import LoweringError, Scope, Scored, condition, element_scope, scored_parts, value
from docsql.plans.tree import Call, Col, Item, Lit, Node, Order, Select, Star, plain


def with_score(df: DataFrame, select: Select, scope: Scope) -> DataFrame:
    """Adds _score: the sum over the text predicates, each of BM25 or of a constant. The statistics are one row."""
    parts = scored_parts(select.where, scope)
    wanted = sorted({(f.name, w) for p in parts if p.constant is None for f, _ in p.fields if isinstance(f, Col) for w in p.words})
    fields = sorted({f for f, _ in wanted})
    base = scope.df
    if wanted:
        cut = base.select(*[text.tokens(scope.column(f)).alias(f"t{i}") for i, f in enumerate(fields)])
        stats = [F.avg(F.size(F.col(f"t{i}"))).alias(f"__len_{i}") for i in range(len(fields))]
        stats += [F.sum(F.array_contains(F.col(f"t{fields.index(f)}"), w).cast("long")).alias(f"__df_{i}") for i, (f, w) in enumerate(wanted)]
        one = cut.agg(F.count(F.lit(1)).alias("__docs"), *stats)
        df = df.withColumns({f"__tok_{i}": text.tokens(scope.column(f)) for i, f in enumerate(fields)}).crossJoin(F.broadcast(one))
    total = F.lit(0.0)
    for p in parts:
        if p.constant is not None:
            total = total + F.when(F.coalesce(condition(p.fields[0][0], scope), F.lit(False)), F.lit(p.constant)).otherwise(0.0)
            continue
        each = [_field_score(p, f, w, fields, wanted) for f, w in p.fields]
        joined = each[0] if len(each) == 1 else F.greatest(*each) if p.best else reduce(lambda a, b: a + b, each)
        total = total + joined * p.boost
    df = df.withColumn("_score", total)
    return df.drop("__docs", *[c for c in df.columns if c.startswith(("__len_", "__df_", "__tok_"))])


def _field_score(p: Scored, f: Node, weight: float, fields: list[str], wanted: list[tuple[str, str]]) -> Column:
    toks = F.col(f"__tok_{fields.index(f.name)}")
    each = [text.bm25(toks, w, F.col("__docs"), F.col(f"__df_{wanted.index((f.name, w))}"), F.col(f"__len_{fields.index(f.name)}")) for w in p.words]
    return F.coalesce(reduce(lambda a, b: a + b, each), F.lit(0.0)) * weight


def order_columns(orders: tuple[Order, ...], scope: Scope) -> list[Column]:
    """Nulls come last in either direction."""
    return [_directed(*_sort_key(o, scope), o.ascending) for o in orders]


def _directed(c: Column, nulls_first: bool, ascending: bool) -> Column:
    if ascending:
        return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()
    return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()


def _sort_key(o: Order, scope: Scope) -> tuple[Column, bool]:
    node = o.node
    if isinstance(node, Call):
        low = node.name.lower()
        if low == "field_sort":
            field = node.args[0] if node.args else Col(str(node.option("field")))
            field = Col(field.value) if isinstance(field, Lit) else field
            missing = node.option("missing")
            if scope.find(field.name) is None and node.option("unmapped_type"):
                c: Column = F.lit(None).cast("string")
            else:
                c = value(field, scope)
            if missing in (None, "_last"):
                return c, False
            if missing == "_first":
                return c, True
            kind = scope.kind(field)
            fill = dates.moment(str(missing)).cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.lit(missing).try_cast(kind) if kind is not None else F.lit(missing)
            return F.coalesce(c, fill), False
        if low == "nested":
            c = value(Col(str(plain(node.args[0]))), scope)
            kind = scope.kind(Col(str(plain(node.args[0]))))
            return ((F.array_min(c) if o.ascending else F.array_max(c)) if isinstance(kind, T.ArrayType) else c), False
    if isinstance(node, Col) and node.name == "_score":
        return F.col("_score"), False
    return value(node, scope), False


def search_after(orders: tuple[Order, ...], values: tuple[str, ...], scope: Scope) -> Column:
    """Rows behind these sort values."""
    keys = [_sort_key(o, scope)[0] for o in orders]
    behind, equal = F.lit(False), F.lit(True)
    for o, key, given in zip(orders, keys, values, strict=False):
        kind = scope.kind(o.node) if not isinstance(o.node, Call) else scope.kind(o.node.args[0]) if o.node.args else None
        v = dates.moment(given).cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.lit(given).try_cast(kind) if kind is not None else F.lit(given)
        # A null key comes behind every value.
        behind = behind | (equal & (key.isNull() | ((key > v) if o.ascending else (key < v))))
        equal = equal & F.coalesce(key == v, F.lit(False))
    return behind


def collapse(df: DataFrame, spec: str, orders: list[Column], scope: Scope) -> DataFrame:
    """One row of each value of a field, and the first rows of the group as inner hits."""
    given = json.loads(spec)
    key = scope.column(given["field"])
    first = orders or [F.monotonically_increasing_id()]
    df = df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*first)))
    inner = given.get("inner_hits")
    out = df.filter("__rn = 1").drop("__rn")
    if not inner:
        return out
    size = int(inner.get("size", 3))
    sort = [F.col(f"`{k}`").desc_nulls_last() if (v if isinstance(v, str) else v.get("order", "asc")) == "desc" else F.col(f"`{k}`").asc_nulls_last() for s in inner.get("sort", []) for k, v in (s.items() if isinstance(s, dict) else [(s, "asc")])]
    columns = [c for c in df.columns if c != "__rn"]
    ranked = df.withColumn("__in", F.row_number().over(Window.partitionBy(key).orderBy(*(sort or first)))).filter(F.col("__in") <= size)
    hits = ranked.groupBy(key.alias("__key")).agg(F.array_sort(F.collect_list(F.struct("__in", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")))).alias("__hits"))
    hits = hits.select("__key", F.transform("__hits", lambda h: h["row"]).alias(inner.get("name", "inner_hits")))
    return out.join(hits, key.eqNullSafe(F.col("__key")), "left").drop("__key")


def post_filter(df: DataFrame, spec: str, scope: Scope) -> DataFrame:
    return df.filter(F.coalesce(_dsl(json.loads(spec), scope), F.lit(False)))


def _dsl(q: dict, scope: Scope) -> Column:
    """term, terms, range, exists, match_all and bool."""
    from docsql.plans.tree import Compare, In

    kind, body = next(iter(q.items()))
    if kind == "match_all":
        return F.lit(True)
    if kind == "exists":
        return scope.column(body["field"]).isNotNull()
    if kind == "bool":
        parts = [_dsl(x, scope) for k in ("must", "filter") for x in _list(body.get(k))]
        parts += [~F.coalesce(_dsl(x, scope), F.lit(False)) for x in _list(body.get("must_not"))]
        some = [F.coalesce(_dsl(x, scope), F.lit(False)) for x in _list(body.get("should"))]
        if some and (not parts or body.get("minimum_should_match")):
            parts.append(reduce(lambda a, b: a | b, some))
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
    name, v = next(iter(body.items()))
    if kind in ("term", "match"):
        v = v.get("value", v.get("query")) if isinstance(v, dict) else v
        return condition(Compare("=", Col(name), Call("term", (Lit(v),))) if kind == "term" else Compare("=", Col(name), Call("matchQuery", (Lit(v),))), scope)
    if kind == "terms":
        return condition(In(Col(name), tuple(Lit(x) for x in v)), scope)
    if kind == "range":
        ops = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
        return reduce(lambda a, b: a & b, [condition(Compare(ops[k], Col(name), Lit(x)), scope) for k, x in v.items() if k in ops])
    raise LoweringError(f"POST_FILTER knows no {kind}")


def _list(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def project(df: DataFrame, select: Select, scope: Scope) -> DataFrame:
    items = select.items
    if any(isinstance(i.node, Call) and i.node.name.lower() in ("include", "exclude") for i in items):
        return df.select(*[F.col(f"`{c}`") for c in _chosen(df.columns, items)])
    out: list[Column] = []
    for i in items:
        if isinstance(i.node, Star):
            out += [F.col(f"`{f.name}`") for f in scope.schema.fields]
            out += [F.col(f"`{c}`") for c in df.columns if c not in scope.schema.names and c != "_score" and not c.startswith("__")]
        else:
            out.append(item_column(i, df, scope).alias(item_name(i)))
    if not any(isinstance(i.node, Star) for i in items):
        out += [F.col(f"`{c}`") for c in df.columns if c.endswith(".highlight") and c not in scope.schema.names]
    return df.select(*out)


def item_name(i: Item) -> str:
    if i.alias:
        return i.alias
    if isinstance(i.node, Call) and i.node.name.lower() == "script" and len(i.node.args) > 1:
        return str(plain(i.node.args[0])) or i.text
    if isinstance(i.node, Call) and i.node.name.lower() in ("docvalue", "nested", "field"):
        return str(plain(i.node.args[0]))
    return i.node.name if isinstance(i.node, Col) else i.text


def item_column(i: Item, df: DataFrame, scope: Scope) -> Column:
    if isinstance(i.node, Col) and i.node.name in df.columns and scope.find(i.node.name) is None:
        return F.col(f"`{i.node.name}`")
    if isinstance(i.node, Call) and i.node.name.lower() == "nested" and len(i.node.args) == 2 and not isinstance(i.node.args[1], (Lit, Col)):
        path = str(plain(i.node.args[0]))
        c, kind = scope.find(path)
        return F.filter(c, lambda e: condition(i.node.args[1], element_scope(scope, path, kind, e)))
    return value(i.node, scope)


def _chosen(columns: list[str], items: tuple[Item, ...]) -> list[str]:
    plain_names = [i.node.name for i in items if isinstance(i.node, Col)]
    globs = lambda kind: [str(plain(a)) for i in items if isinstance(i.node, Call) and i.node.name.lower() == kind for a in i.node.args]
    take, leave = globs("include"), globs("exclude")
    fits = lambda c, pats: any(fnmatch.fnmatchcase(c, p) for p in pats)
    return [c for c in columns if not c.startswith("__") and (not take and not plain_names or fits(c, take) or c in plain_names) and not fits(c, leave)]


def highlight(df: DataFrame, hint_text: str, select: Select, scope: Scope) -> DataFrame:
    """Marks the words of the query in a field."""
    import re

    name = hint_text.split(",")[0].strip().strip("'\"")
    tag = lambda key, default: (m[1] if (m := re.search(key + r"\s*:\s*\[\s*['\"]?(.*?)['\"]?\s*\]", hint_text)) else default)
    words = [w for p in scored_parts(select.where, scope) for f, _ in p.fields if isinstance(f, Col) and f.name == name for w in p.words]
    return df.withColumn(f"{name}.highlight", text.highlight(scope.column(name), list(dict.fromkeys(words)), tag("pre_tags", "<em>"), tag("post_tags", "</em>")))
