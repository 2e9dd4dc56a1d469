"""Values and conditions of the tree as Columns.

A condition is three-valued; what the dialect negates as a whole (<>, NOT IN, NOT LIKE, NOT BETWEEN, negated text
and geo predicates) is two-valued, so that rows without the field match; a negated range comparison turns round.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsql.functions import dates, geo, scalars, text
from docsql.plans.tree import All, Any_, Between, Binary, Call, Case, Cast, Col, Compare, In, Interval, IsNull, Like, Lit, Node, Not, Select, SubQuery, plain
from docsql.sources.catalog import Source


class LoweringError(ValueError):
    """The tree has no meaning for these tables."""


@dataclass
class Scope:
    """Where names are looked up: a DataFrame (or an array's element, or another table of a join)."""

    df: DataFrame | None
    schema: T.StructType
    source: Source
    engine: object
    aliases: tuple[str, ...] = ()
    root: Column | None = None  # fields are of this struct instead of df's
    prefix: str = ""  # dotted path of root
    extra: dict[str, Column] = field(default_factory=dict)  # aliases of select items
    others: dict[str, Scope] = field(default_factory=dict)  # the tables of a join by alias
    semi: list = field(default_factory=list)  # subqueries and children met: (marker column, DataFrame to join)
    renamed: str = ""  # prefix of physical columns

    def strip(self, name: str) -> str:
        head, dot, rest = name.partition(".")
        return rest if dot and head in self.aliases else name

    def find(self, name: str) -> tuple[Column, T.DataType] | None:
        if self.others:
            head, dot, rest = name.partition(".")
            if dot and head in self.others:
                return self.others[head].find(rest)
            for scope in self.others.values():
                if (got := scope.find(name)) is not None:
                    return got
            return None
        name = self.strip(name)
        if self.prefix and name.startswith(f"{self.prefix}."):
            name = name[len(self.prefix) + 1 :]
        fields = {f.name: f.dataType for f in self.schema.fields}
        if name in fields:
            return self._top(name), fields[name]
        if name.endswith(".keyword") and (got := self.find(name[:-8])) is not None:
            return got
        parts = name.split(".")
        for n in range(len(parts) - 1, 0, -1):
            top = ".".join(parts[:n])
            if top in fields:
                return _walk(self._top(top), fields[top], parts[n:])
        return None

    def _top(self, name: str) -> Column:
        return F.col(f"`{self.renamed}{name}`") if self.root is None else self.root.getField(name)

    def column(self, name: str) -> Column:
        if name in self.extra and self.find(name) is None:
            return self.extra[name]
        got = self.find(name)
        if got is None:
            if self.engine.missing_columns == "null":
                return F.lit(None).cast("string")
            raise LoweringError(f"no column {name}")
        return got[0]

    def kind(self, node: Node) -> T.DataType | None:
        if isinstance(node, Col):
            got = self.find(node.name)
            return got[1] if got else None
        return None

    def is_text(self, node: Node) -> bool:
        if not isinstance(node, Col):
            return False
        if self.others:
            head, dot, rest = node.name.partition(".")
            return bool(dot) and head in self.others and self.others[head].is_text(Col(rest))
        name = self.strip(node.name)
        full = name if not self.prefix or name.startswith(f"{self.prefix}.") else f"{self.prefix}.{name}"
        return full in self.source.text


def _walk(c: Column, kind: T.DataType, parts: list[str]) -> tuple[Column, T.DataType] | None:
    for i, p in enumerate(parts):
        if isinstance(kind, T.StructType) and p in kind.names:
            c, kind = c.getField(p), kind[p].dataType
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            inner = _walk(F.lit(None), kind.elementType, parts[i:])
            if inner is None:
                return None
            rest = parts[i:]
            element = kind.elementType
            return F.transform(c, lambda e: _walk(e, element, rest)[0]), T.ArrayType(inner[1])
        else:
            return None
    return c, kind


def must_not(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


# ---------------------------------------------------------------- values


def value(node: Node, scope: Scope) -> Column:
    if isinstance(node, Col):
        return F.lit(None) if node.name.lower() == "null" and scope.find(node.name) is None else scope.column(node.name)
    if isinstance(node, Lit):
        return F.lit(node.value)
    if isinstance(node, Binary):
        return _arithmetic(node, scope)
    if isinstance(node, Case):
        values = _alike([then for _, then in node.branches] + ([] if node.default is None else [node.default]), scope)
        out = None
        for (test, _), v in zip(node.branches, values, strict=False):
            out = F.when(condition(test, scope), v) if out is None else out.when(condition(test, scope), v)
        return out if node.default is None else out.otherwise(values[-1])
    if isinstance(node, Cast):
        return scalars.cast(value(node.node, scope), node.kind)
    if isinstance(node, Call):
        return _call(node, scope)
    if isinstance(node, (Compare, All, Any_, Not, In, Between, Like, IsNull)):
        return condition(node, scope)
    raise LoweringError(f"{node} is not a value")


def _alike(nodes: list[Node], scope: Scope) -> list[Column]:
    """Values of one type: where texts and others meet, all are texts."""
    kinds = [T.StringType() if isinstance(n, Lit) and isinstance(n.value, str) else T.DoubleType() if isinstance(n, Lit) and n.value is not None else scope.kind(n) for n in nodes]
    known = [k for k in kinds if k is not None]
    mixed = any(isinstance(k, T.StringType) for k in known) and any(not isinstance(k, T.StringType) for k in known)
    return [value(n, scope).cast("string") if mixed else value(n, scope) for n in nodes]


def _number(node: Node, scope: Scope) -> Column:
    c = value(node, scope)
    if isinstance(node, Lit) and isinstance(node.value, str) or isinstance(scope.kind(node), T.StringType):
        return c.try_cast("double")
    return c


def _arithmetic(node: Binary, scope: Scope) -> Column:
    a, b = _number(node.left, scope), _number(node.right, scope)
    if node.op == "/":
        if scope.engine.parity and all(_integral(x, scope) for x in (node.left, node.right)):
            return F.when(b != 0, F.call_function("div", a, b))
        return F.try_divide(a, b)
    if node.op == "%":
        return F.when(b != 0, a % b)
    return a + b if node.op == "+" else a - b if node.op == "-" else a * b


def _integral(node: Node, scope: Scope) -> bool:
    if isinstance(node, Lit):
        return isinstance(node.value, int)
    if isinstance(node, Binary):
        return _integral(node.left, scope) and _integral(node.right, scope)
    return isinstance(scope.kind(node), (T.IntegerType, T.LongType, T.ShortType))


def _call(node: Call, scope: Scope) -> Column:
    low = node.name.lower()
    if low == "item_at":
        base, index = node.args
        return F.get(value(base, scope), value(index, scope).cast("int"))
    if low == "ts":
        return F.lit(plain(node.args[0])).try_cast("timestamp")
    if low == "date_add" and len(node.args) == 2 and isinstance(node.args[1], Interval):
        return scalars.date_add(value(node.args[0], scope), node.args[1].amount, node.args[1].unit)
    if low == "script":
        return script(node, scope)
    if low == "docvalue":
        c = value(_as_col(node.args[0]), scope)
        return c if len(node.args) == 1 else F.unix_millis(c.cast("timestamp")) if plain(node.args[1]) == "epoch_millis" else F.date_format(c.cast("timestamp"), str(plain(node.args[1])))
    if low in ("nested", "reverse_nested", "children", "field"):
        return value(_as_col(node.args[0]), scope)
    if low in ("if", "case_new"):
        args = [Lit(True) if isinstance(a, Col) and a.name.lower() == "default" else a for a in node.args]
        results = args[1:] if low == "if" else args[1::2]
        alike = iter(_alike(results, scope))
        is_result = (lambda i: i > 0) if low == "if" else (lambda i: i % 2 == 1)
        return scalars.SCALARS[low](*(next(alike) if is_result(i) else value(a, scope) for i, a in enumerate(args)))
    if low == "coalesce":
        return F.coalesce(*_alike(list(node.args), scope))
    if low in scalars.SCALARS:
        return scalars.SCALARS[low](*(value(a, scope) for a in node.args))
    if low in scope.engine.functions:
        return F.call_function(scope.engine.functions[low], *(value(a, scope) for a in node.args))
    if _is_predicate(node):
        return condition(node, scope)
    raise LoweringError(f"unknown function {node.name}")


def _as_col(node: Node) -> Node:
    return Col(node.value) if isinstance(node, Lit) and isinstance(node.value, str) else node


def script(node: Call, scope: Scope) -> Column:
    """A SQL expression over the table's columns; doc['f'].value is f; named arguments are parameters."""
    import re

    code = str(plain(node.args[-1]))
    code = re.sub(r"doc\[['\"]([^'\"]+)['\"]\]\.value", r"\1", code).replace("==", "=").replace("&&", " AND ").replace("||", " OR ")
    for key, v in node.named:
        if key.lower() not in ("script_type", "lang"):
            given = plain(v)
            code = re.sub(rf"(?<![\w.'])(?:params\.)?{re.escape(key)}(?![\w.'])", repr(given) if not isinstance(given, str) else "'" + given.replace("'", "''") + "'", code)
    return F.expr(code)


# ---------------------------------------------------------------- conditions

_TEXT_CALLS = {
    "query", "querystring", "query_string", "matchquery", "match_query", "matchphrase", "match_phrase", "matchphrasequery", "match_phrase_prefix", "matchphraseprefix",
    "matchphraseprefixquery", "multi_match", "multimatch", "multimatchquery", "wildcardquery", "wildcard_query", "span_near", "spannear", "spannearquery", "score", "scorequery", "score_query",
}
_VALUE_CALLS = {"term", "matchterm", "match_term", "in_terms", "terms", "ids_query", "ids", "regexp_query", "regexp"}
_GEO = {"GEO_INTERSECTS", "GEO_BOUNDING_BOX", "GEO_DISTANCE", "GEO_DISTANCE_RANGE", "GEO_POLYGON", "GEO_CELL"}
_TURNED = {">": "<=", ">=": "<", "<": ">=", "<=": ">"}


def _is_predicate(node: Node) -> bool:
    return isinstance(node, Call) and (node.name.upper() in _GEO or node.name.lower() in {"nested", "children", "script"} | _TEXT_CALLS)


def condition(node: Node, scope: Scope, negated: bool = False) -> Column:
    if isinstance(node, Not):
        return condition(node.item, scope, not negated)
    if isinstance(node, (All, Any_)):
        parts = [condition(x, scope, negated) for x in node.items]
        both = isinstance(node, All) != negated
        return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), parts)
    if isinstance(node, Compare):
        return _compare(node, scope, negated)
    if isinstance(node, In):
        turned = node.negated != negated
        if turned and _is_plain(node.node, scope) and not isinstance(node.items, SubQuery):
            c = value(node.node, scope)
            return c.isNull() | ~_in(node, scope)
        return _flip(_in(node, scope), turned)
    if isinstance(node, Between):
        kind = scope.kind(node.node)
        test = lambda c: c.between(_like_field(node.low, c, kind, scope), _like_field(node.high, c, kind, scope))
        return _flip(_each(_field(node.node, scope), kind, test), node.negated != negated)
    if isinstance(node, Like):
        return _flip(_like(node.node, text.wildcard_regex(str(plain(node.pattern)), sql=True), scope), node.negated != negated)
    if isinstance(node, IsNull):
        inner = node.node
        if isinstance(inner, Call) and inner.name.lower() == "nested":
            c, kind = value(_as_col(inner.args[0]), scope), scope.kind(_as_col(inner.args[0]))
        else:
            c, kind = value(inner, scope), scope.kind(inner)
        missing = c.isNull() | (F.size(c) == 0) if isinstance(kind, T.ArrayType) else c.isNull()
        return ~missing if node.negated != negated else missing
    if _is_predicate(node):
        return _flip(_predicate(node, scope), negated)
    c = value(node, scope).cast("boolean")
    return must_not(c) if negated else c


def _is_plain(node: Node, scope: Scope) -> bool:
    """A column with one value, not analysed."""
    return isinstance(node, Col) and not scope.is_text(node) and scope.kind(node) is not None and not isinstance(scope.kind(node), T.ArrayType)


def _flip(c: Column, negated: bool) -> Column:
    return must_not(c) if negated else c


def _field(node: Node, scope: Scope) -> Column:
    return value(node, scope)


def _each(c: Column, kind: T.DataType | None, test) -> Column:
    """The test of a field: of any element if it holds several."""
    return F.exists(c, test) if isinstance(kind, T.ArrayType) else test(c)


def _like_field(node: Node, c: Column, kind: T.DataType | None, scope: Scope) -> Column:
    """A literal in the type of the field it is compared with."""
    if isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if isinstance(node, Lit) and kind is not None:
        v = node.value
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return dates.moment(str(v)).cast(kind) if isinstance(v, str) else F.timestamp_millis(F.lit(int(v))).cast(kind)
        if isinstance(v, str) and isinstance(kind, T.NumericType):
            return F.lit(v).try_cast("double")
        if isinstance(v, (int, float)) and not isinstance(v, bool) and isinstance(kind, T.StringType):
            return F.lit(str(v))
    if isinstance(node, Call) and node.name == "ts" and isinstance(kind, T.StringType):
        return F.lit("{ts '" + str(plain(node.args[0])) + "'}")
    return value(node, scope)


def _compare(node: Compare, scope: Scope, negated: bool) -> Column:
    op, left, right = node.op, node.left, node.right
    if isinstance(left, Call) and left.name.lower() == "nested" and len(left.args) <= 2 and not isinstance(left.args[-1], (Compare, All, Any_, Not, In)):
        path = str(plain(left.args[0]))
        return _flip(_nested(path.rpartition(".")[0] if len(left.args) == 1 else str(plain(left.args[1])), Compare(op if op != "<>" else "=", Col(path), right), scope), negated != (op == "<>"))
    if isinstance(left, Call) and left.name.lower() == "children":
        inner = Compare(op if op != "<>" else "=", _as_col(left.args[1]), right)
        return _flip(_children(str(plain(left.args[0])), inner, scope), negated != (op == "<>"))
    if isinstance(right, Call) and right.name.lower() in _TEXT_CALLS:
        return _flip(_text_call(left, right, scope), negated != (op == "<>"))
    if isinstance(right, Call) and right.name.lower() in _VALUE_CALLS:
        return _flip(_value_call(left, right, scope), negated != (op == "<>"))
    if isinstance(right, SubQuery):
        return _flip(_in(In(left, right), scope), negated != (op == "<>"))
    if op in ("=", "<>"):
        turned = negated != (op == "<>")
        if turned and _is_plain(left, scope) and isinstance(right, Lit) and right.value is not None:
            c = value(left, scope)  # in a form that scans can filter by
            return c.isNull() | (c != _like_field(right, c, scope.kind(left), scope))
        return _flip(_equals(left, right, scope), turned)
    if negated:
        op = _TURNED[op]
    kind = scope.kind(left)
    if isinstance(left, Lit) and scope.kind(right) is not None:
        a, b = _like_field(left, value(right, scope), scope.kind(right), scope), value(right, scope)
        return _ordered(op, a, b)
    return _each(_comparable(left, right, scope), kind, lambda c: _ordered(op, c, _like_field(right, c, kind, scope)))


def _comparable(left: Node, right: Node, scope: Scope) -> Column:
    """The left side; a text field is a number beside a number."""
    c = value(left, scope)
    return c.try_cast("double") if isinstance(scope.kind(left), T.StringType) and isinstance(right, Lit) and isinstance(right.value, (int, float)) and not isinstance(right.value, bool) else c


def _ordered(op: str, a: Column, b: Column) -> Column:
    return a > b if op == ">" else a >= b if op == ">=" else a < b if op == "<" else a <= b


def _equals(left: Node, right: Node, scope: Scope) -> Column:
    kind = scope.kind(left)
    if isinstance(right, Lit) and right.value is None:
        return value(left, scope).isNull()
    if scope.is_text(left) and isinstance(right, (Lit, Col)) and (isinstance(right, Lit) or scope.find(right.name) is None):
        words = text.tokens_of(str(plain(right)))
        return _over(left, scope, lambda t: text.phrase(t, words), words, True)
    if isinstance(left, Lit) and not isinstance(right, Lit):
        left, right, kind = right, left, scope.kind(right)
    if isinstance(right, Col) and scope.find(right.name) is None and right.name not in scope.extra and isinstance(left, Col):
        right = Lit(right.name)
    return _each(value(left, scope), kind, lambda c: c == _like_field(right, c, kind, scope))


def _like(node: Node, regex: str, scope: Scope) -> Column:
    kind = scope.kind(node)
    if scope.is_text(node):
        return _each(value(node, scope), kind, lambda c: F.exists(text.tokens(c), lambda t: t.rlike(regex)))
    return _each(value(node, scope), kind, lambda c: c.cast("string").rlike(regex))


def _in(node: In, scope: Scope) -> Column:
    if isinstance(node.node, Call) and node.node.name.lower() in ("nested", "children"):
        call = node.node
        inner = In(_as_col(call.args[-1] if call.name.lower() == "children" else call.args[0]), node.items)
        if call.name.lower() == "children":
            return _children(str(plain(call.args[0])), inner, scope)
        return _nested(str(plain(call.args[0])).rpartition(".")[0], inner, scope)
    if isinstance(node.items, SubQuery):
        return _member(value(node.node, scope), scope.kind(node.node), node.items.select, scope)
    parts = [_equals(node.node, x, scope) for x in node.items] if scope.is_text(node.node) else None
    if parts:
        return reduce(lambda a, b: a | b, parts)
    kind = scope.kind(node.node)
    return _each(value(node.node, scope), kind, lambda c: c.isin([_like_field(x if not isinstance(x, Col) or scope.find(x.name) else Lit(x.name), c, kind, scope) for x in node.items]))


def _member(c: Column, kind, select: Select, scope: Scope) -> Column:
    """Whether a value is among a subquery's: a mark from a left join with its distinct values (by text, as numbers and texts may meet)."""
    df = scope.engine.select(select)
    if len(df.columns) != 1:
        raise LoweringError("a subquery must have one column")
    mark = scope.engine.fresh("in")
    inner = df.select(_as_text(F.col(f"`{df.columns[0]}`"), df.schema[0].dataType).alias(f"{mark}_v")).filter(F.col(f"{mark}_v").isNotNull()).distinct().withColumn(mark, F.lit(True))
    scope.semi.append((inner, _as_text(c, kind) == F.col(f"{mark}_v"), [mark, f"{mark}_v"]))
    return F.coalesce(F.col(mark), F.lit(False))


def split_members(where: Node | None) -> tuple[list[tuple[Node, bool]], Node | None]:
    """The conjuncts that ask for membership in a subquery or for child rows, each with whether it is negated; and the rest."""
    parts = list(where.items) if isinstance(where, All) else [] if where is None else [where]
    members, rest = [], []
    for x in parts:
        node, negated = (x.item, True) if isinstance(x, Not) else (x, False)
        if (found := _membership(node)) is not None:
            members.append((found[0], negated != found[1]))
        else:
            rest.append(x)
    return members, None if not rest else rest[0] if len(rest) == 1 else All(tuple(rest))


def _membership(node: Node) -> tuple[Node, bool] | None:
    """A condition as membership in a subquery (In) or as children(table, condition), and whether it is negated."""
    if isinstance(node, In) and isinstance(node.items, SubQuery) and not isinstance(node.node, Call):
        return In(node.node, node.items), node.negated
    if isinstance(node, Call) and node.name.lower() == "children":
        return node, False
    if isinstance(node, Compare) and node.op in ("=", "<>"):
        left, right = node.left, node.right
        if isinstance(left, Call) and left.name.lower() == "children" and not isinstance(right, SubQuery):
            return Call(left.name, (left.args[0], Compare("=", _as_col(left.args[1]), right))), node.op == "<>"
        if isinstance(right, Call) and right.name.lower() in ("in_terms", "terms") and right.args and isinstance(right.args[0], SubQuery) and not isinstance(left, Call):
            return In(left, right.args[0]), node.op == "<>"
    return None


def member_join(df: DataFrame, node: Node, negated: bool, scope: Scope) -> DataFrame:
    """Rows whose value is (or is not) among a subquery's, or which have (or have not) such child rows: a semi or anti join by the values' own type."""
    if isinstance(node, In):
        inner = scope.engine.select(node.items.select)
        if len(inner.columns) != 1:
            raise LoweringError("a subquery must have one column")
        left, kind, right = value(node.node, scope), scope.kind(node.node), inner.schema[0].dataType
    else:
        inner, column = _child_rows(str(plain(node.args[0])), node.args[1], scope)
        inner = inner.select(F.col(f"`{column}`"))
        left, kind, right = scope.column(scope.source.id_col), scope.schema[scope.source.id_col].dataType, inner.schema[0].dataType
    name = scope.engine.fresh("member")
    key = F.col(f"`{inner.columns[0]}`")
    if not (kind == right or isinstance(kind, T.IntegralType) and isinstance(right, T.IntegralType)):
        left, key = _as_text(left, kind), _as_text(key, right)
    inner = inner.select(key.alias(name))
    return df.join(inner, left == F.col(name), "left_anti" if negated else "left_semi")


def _as_text(c: Column, kind: T.DataType | None) -> Column:
    """Whole numbers look the same whatever their type."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def _value_call(left: Node, call: Call, scope: Scope) -> Column:
    low, kind = call.name.lower(), scope.kind(left)
    if call.args and isinstance(call.args[0], SubQuery):
        node = Col(scope.source.id_col) if low in ("ids_query", "ids") else left
        return _member(value(node, scope), scope.kind(node), call.args[0].select, scope)
    if low in ("regexp_query", "regexp"):
        return _like(left, f"^(?:{plain(call.args[0])})$", scope)
    values = [plain(a) for a in call.args]
    if low in ("ids_query", "ids"):
        key = Col(scope.source.id_col)
        return value(key, scope).cast("string").isin([str(v) for v in values])
    if scope.is_text(left):
        return _each(value(left, scope), kind, lambda c: F.arrays_overlap(text.tokens(c), F.array(*[F.lit(str(v)) for v in values])))
    return _each(value(left, scope), kind, lambda c: c.isin([_like_field(Lit(v), c, kind, scope) for v in values]))


def _predicate(node: Call, scope: Scope) -> Column:
    low = node.name.lower()
    if node.name.upper() in _GEO:
        return _geo(node, scope)
    if low == "script":
        return script(node, scope)
    if low == "nested":
        if len(node.args) == 1:
            path = _path_of(node.args[0])
            return _nested(path, node.args[0], scope)
        return _nested(str(plain(node.args[0])), node.args[1], scope)
    if low == "children":
        return _children(str(plain(node.args[0])), node.args[1], scope)
    return _text_call(Col("_all"), node, scope)


def _path_of(node: Node) -> str:
    """The nested path of a condition's first field."""
    while not isinstance(node, Col):
        node = node.items[0] if isinstance(node, (All, Any_)) else node.item if isinstance(node, Not) else node.left if isinstance(node, Compare) else node.node
    return node.name.rpartition(".")[0]


def _nested(path: str, inner: Node, scope: Scope) -> Column:
    got = scope.find(path)
    if got is None:
        raise LoweringError(f"no nested column {path}")
    c, kind = got
    if not isinstance(kind, T.ArrayType):
        return condition(inner, scope)
    return F.exists(c, lambda e: condition(inner, element_scope(scope, path, kind, e)))


def element_scope(scope: Scope, path: str, kind: T.ArrayType, element: Column) -> Scope:
    return Scope(None, kind.elementType, scope.source, scope.engine, scope.aliases, root=element, prefix=scope.strip(path), semi=scope.semi)


def _children(name: str, inner: Node, scope: Scope) -> Column:
    """Whether any child row fits: a mark from a left join with the distinct parents of those rows."""
    rows, column = _child_rows(name, inner, scope)
    mark = scope.engine.fresh("child")
    parents = rows.select(F.col(f"`{column}`").cast("string").alias(f"{mark}_v")).distinct().withColumn(mark, F.lit(True))
    scope.semi.append((parents, scope.column(scope.source.id_col).cast("string") == F.col(f"{mark}_v"), [mark, f"{mark}_v"]))
    return F.coalesce(F.col(mark), F.lit(False))


def _child_rows(name: str, inner: Node, scope: Scope) -> tuple[DataFrame, str]:
    """The child rows that fit, and their column with the parent's id."""
    child = scope.source.children.get(name)
    if child is None:
        raise LoweringError(f"no child table {name}")
    source = scope.engine.catalog.one(child.table)
    below = Scope(source.df, source.df.schema, source, scope.engine)
    test = condition(inner, below)
    return scope.engine.with_marks(source.df, below).filter(test), child.parent


# ---------------------------------------------------------------- text and places


@dataclass(frozen=True)
class Scored:
    """A text predicate as words over fields: what it needs for its score."""

    fields: tuple[tuple[Node, float], ...]
    words: tuple[str, ...]
    boost: float
    constant: float | None = None
    best: bool = True


def _arg(call: Call, index: int, *names: str):
    for n in names:
        if (got := call.option(n)) is not None:
            return got
    return plain(call.args[index]) if len(call.args) > index else None


def _fields_of(spec: str) -> list[tuple[Node, float]]:
    out = []
    for part in spec.split(","):
        name, _, weight = part.strip().partition("^")
        out.append((Col(name), float(weight or 1)))
    return out


def _over(node: Node, scope: Scope, test, words: list[str] | None = None, all_of: bool = False) -> Column:
    """A test of a field's tokens. A text without the words as substrings is not cut into tokens at all."""
    if not words:
        return _each(value(node, scope), scope.kind(node), lambda c: test(text.tokens(c)))

    def one(c: Column) -> Column:
        low = F.lower(c.cast("string"))
        may = reduce((lambda a, b: a & b) if all_of else (lambda a, b: a | b), [low.contains(w) for w in dict.fromkeys(words)])
        return F.when(may, test(text.tokens(c))).when(c.isNotNull(), F.lit(False))

    return _each(value(node, scope), scope.kind(node), one)


def _text_call(left: Node, call: Call, scope: Scope) -> Column:
    low = call.name.lower().replace("_", "")
    words = text.tokens_of(str(_arg(call, 0, "query", "value") or "")) if not isinstance(call.args[0] if call.args else None, Call) else []
    slop = int(_arg(call, 9, "slop") or 0)
    if low in ("score", "scorequery"):
        return condition(Compare("=", left, call.args[0]), scope) if isinstance(call.args[0], Call) else condition(call.args[0], scope)
    if low in ("query", "querystring"):
        return _query_string(str(_arg(call, 0, "query")), call, scope)
    if low == "matchquery":
        return _over(left, scope, lambda t: text.match(t, words, call.option("minimum_should_match"), call.option("operator")), words)
    if low.startswith("matchphraseprefix"):
        return _over(left, scope, lambda t: text.phrase(t, words, slop, prefix=True), words, True)
    if low.startswith("matchphrase"):
        return _over(left, scope, lambda t: text.phrase(t, words, slop), words, True)
    if low.startswith("multimatch"):
        fields = _fields_of(str(_arg(call, 1, "fields")))
        parts = [_over(f, scope, lambda t: text.match(t, words, call.option("minimum_should_match"), call.option("operator")), words) for f, _ in fields]
        return reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), parts)
    if low == "wildcardquery":
        regex = text.wildcard_regex(str(_arg(call, 0, "wildcard", "query")).lower())
        return _over(left, scope, lambda t: F.exists(t, lambda w: w.rlike(regex)))
    if low.startswith("spannear"):
        clauses = json.loads(str(_arg(call, 0, "clauses")))
        groups, field_ = [], left
        for c in clauses:
            body = next(iter(c.values()))
            name = body.get("field") or next(k for k in body)
            given = body.get("value", body.get(name))
            groups.append(text.tokens_of(str(given.get("value") if isinstance(given, dict) else given)))
            if scope.find(str(name)) is not None:
                field_ = Col(str(name))
        order = call.option("in_order", True)
        return _over(field_, scope, lambda t: text.span_near(t, groups, slop, order not in (False, "false")))
    raise LoweringError(f"unknown function {call.name}")


def _query_string(query: str, call: Call, scope: Scope) -> Column:
    """field:word, field:(a b), "a phrase", AND, OR, NOT, + and -, wildcards, ranges [a TO b], brackets."""
    import re

    lexer = re.compile(r'\s*(\(|\)|\+|-(?=\S)|AND\b|OR\b|NOT\b|&&|\|\||!|[\w.@*]+:(?=\S)|"[^"]*"|\[[^\]]*\]|\{[^}]*\}|[^\s()"]+)')
    parts = lexer.findall(query)
    both = (call.option("operator") or call.option("default_operator") or "or").lower() == "and"
    at = 0

    def fields(name: str | None) -> list[Node]:
        if name:
            return [Col(name)]
        if spec := call.option("fields"):
            return [f for f, _ in _fields_of(str(spec))]
        if name := call.option("default_field"):
            return [Col(str(name))]
        return [Col(f.name) for f in scope.schema.fields if isinstance(f.dataType, T.StringType)]

    def leaf(word: str, name: str | None) -> Column:
        def one(f: Node) -> Column:
            if word[0] in "[{":
                lo, _, hi = word[1:-1].partition(" TO ")
                kind = scope.kind(f)
                lower = F.lit(True) if lo.strip() == "*" else _ordered(">=" if word[0] == "[" else ">", value(f, scope), _like_field(Lit(lo.strip()), value(f, scope), kind, scope))
                return lower if hi.strip() == "*" else lower & _ordered("<=" if word[-1] == "]" else "<", value(f, scope), _like_field(Lit(hi.strip()), value(f, scope), kind, scope))
            if word[0] == '"':
                return _over(f, scope, lambda t: text.phrase(t, text.tokens_of(word), int(call.option("slop") or 0)), text.tokens_of(word), True)
            if word == "*":
                return value(f, scope).isNotNull()
            if "*" in word or "?" in word:
                regex = text.wildcard_regex(word.lower())
                return _over(f, scope, lambda t: F.exists(t, lambda w: w.rlike(regex)))
            if isinstance(scope.kind(f), (T.NumericType, T.TimestampType, T.TimestampNTZType)):
                return value(f, scope) == _like_field(Lit(word), value(f, scope), scope.kind(f), scope)
            return _over(f, scope, lambda t: text.match(t, text.tokens_of(word)), text.tokens_of(word))

        return reduce(lambda a, b: a | b, [F.coalesce(one(f), F.lit(False)) for f in fields(name)])

    def group(name: str | None) -> Column:
        nonlocal at
        must: list[Column] = []
        may: list[Column] = []
        joined_and = False
        while at < len(parts) and parts[at] != ")":
            p = parts[at]
            if p in ("AND", "&&"):
                if may and not joined_and:
                    must.append(may.pop())
                joined_and, at = True, at + 1
                continue
            if p in ("OR", "||"):
                joined_and, at = False, at + 1
                continue
            sign = ""
            if p in ("+", "-", "NOT", "!"):
                sign, at = p, at + 1
                p = parts[at]
            own = name
            if p.endswith(":") and len(p) > 1:
                own, at = p[:-1], at + 1
                p = parts[at]
            at += 1
            if p == "(":
                c = group(own)
                at += 1
            else:
                c = leaf(p, own)
            if sign in ("-", "NOT", "!"):
                must.append(~c)
            elif sign == "+" or joined_and or both:
                must.append(c)
            else:
                may.append(c)
            joined_and = False
        if must:
            return reduce(lambda a, b: a & b, must)
        return reduce(lambda a, b: a | b, may) if may else F.lit(False)

    return group(None)


def _geo(node: Call, scope: Scope) -> Column:
    name, point = node.name.upper(), value(node.args[0], scope)
    numbers = [plain(a) for a in node.args[1:]]
    if name == "GEO_BOUNDING_BOX":
        return geo.in_box(point, *(float(n) for n in numbers))
    if name == "GEO_DISTANCE":
        return geo.distance(point, float(numbers[1]), float(numbers[2])) <= geo.metres(numbers[0])
    if name == "GEO_DISTANCE_RANGE":
        d = geo.distance(point, float(numbers[2]), float(numbers[3]))
        return (d >= geo.metres(numbers[0])) & (d <= geo.metres(numbers[1]))
    if name == "GEO_POLYGON":
        flat = [float(n) for n in numbers]
        if len(flat) < 6 or len(flat) % 2:
            raise LoweringError("a polygon needs three points")
        return geo.in_polygon(point, list(zip(flat[0::2], flat[1::2], strict=True)))
    if name == "GEO_CELL":
        digits = int(numbers[2])
        here = F.struct(F.lit(float(numbers[0])).alias("lon"), F.lit(float(numbers[1])).alias("lat"))
        return geo.geohash(point, digits) == geo.geohash(here, digits)
    other = node.args[1]
    shape = F.lit(json.dumps(geo.parse_wkt(str(other.value)))) if isinstance(other, Lit) else F.to_json(value(other, scope))
    return geo.intersects(F.to_json(point), shape)


def scored_parts(node: Node | None, scope: Scope) -> list[Scored]:
    """The text predicates of a condition that count for the score."""
    if node is None or isinstance(node, Not):
        return []
    if isinstance(node, (All, Any_)):
        return [s for x in node.items for s in scored_parts(x, scope)]
    if isinstance(node, Compare) and node.op == "=":
        left, right = node.left, node.right
        if isinstance(right, Call):
            low = right.name.lower().replace("_", "")
            boost = float(right.option("boost") or 1)
            if low in ("score", "scorequery"):
                constant = float(plain(right.args[1])) if len(right.args) > 1 else float(right.option("boost") or 1)
                return [Scored(((Compare("=", left, right.args[0]), 1.0),), (), 1.0, constant)]
            if low.startswith("multimatch"):
                return [Scored(tuple(_fields_of(str(_arg(right, 1, "fields")))), tuple(text.tokens_of(str(_arg(right, 0, "query")))), boost, best=right.option("type", "best_fields") == "best_fields")]
            if low.startswith("match"):
                return [Scored(((left, 1.0),), tuple(text.tokens_of(str(_arg(right, 0, "query")))), boost)]
            if low in ("wildcardquery", "query", "querystring") or low.startswith("spannear"):
                return [Scored(((node, 1.0),), (), 1.0, boost)]
        if scope.is_text(left) and isinstance(right, Lit):
            return [Scored(((left, 1.0),), tuple(text.tokens_of(str(right.value))), 1.0)]
        return [Scored(((node, 1.0),), (), 1.0, 1.0)]
    return []
