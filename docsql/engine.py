"""The engine: statements of the dialect over a catalog's tables."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsql.operators import hits, setops
from docsql.operators.aggregate import aggregate, is_aggregated
from docsql.operators.expressions import Scope, condition, member_join, split_members
from docsql.operators.joins import join
from docsql.plans.parser import bind, parse
from docsql.plans.tree import Col, Delete, Item, Select, SetOperation, Show, Star
from docsql.shipping import ship
from docsql.sources import results
from docsql.sources.catalog import Catalog, Source

#: Rows and buckets of a SELECT without LIMIT, in parity mode.
DEFAULT_LIMIT = 1000


class Engine:
    """Runs SELECT, DELETE, SHOW and set operations.

    parity: defaults of the dialect hold (implicit limits, approximate distinct counts and percentiles, integer
    division); else results are exact and whole. missing_columns: 'error', or 'null' for unknown columns.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, parity: bool = False, missing_columns: str = "error"):
        self.spark, self.catalog, self.parity, self.missing_columns = spark, catalog, parity, missing_columns
        self.functions: dict[str, str] = {}
        self._numbers = itertools.count()
        ship(spark)

    @property
    def default_limit(self) -> int | None:
        return DEFAULT_LIMIT if self.parity else None

    def fresh(self, what: str) -> str:
        return f"__{what}{next(self._numbers)}"

    def register_function(self, name: str, f: Callable, kind: str) -> None:
        """A user function: a pandas or Arrow UDF, or a plain function of a result type."""
        self.spark.udf.register(name, f) if hasattr(f, "returnType") else self.spark.udf.register(name, f, kind)
        self.functions[name.lower()] = name

    # ------------------------------------------------------------ statements

    def sql(self, text: str, params: list | None = None) -> DataFrame:
        """The result of a statement; each ? is a parameter."""
        return self.run(parse(bind(text, params) if params else text))

    def run(self, tree) -> DataFrame:
        if isinstance(tree, Show):
            return self.show(tree.pattern)
        if isinstance(tree, Delete):
            return self.delete(tree)
        if isinstance(tree, SetOperation):
            return setops.APPLY[tree.op](self.run(tree.left), self.run(tree.right))
        return self.select(tree)

    def explain(self, text: str, params: list | None = None) -> str:
        """The plan as a text, headed by what the statement is."""
        tree = parse(bind(text, params) if params else text)
        if isinstance(tree, Delete):
            head, df = "delete", self._doomed(tree)[0]
        else:
            df, head = self.run(tree), _head(tree)
        return f"{head}\n{df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString('formatted'))}"

    def csv(self, text: str, with_id: bool = False, with_score: bool = False, **options) -> str:
        """Options: flat, separator, quote, new_line, show_header; the key and the score can be columns in front."""
        return options.pop("new_line", "\n").join(self.csv_parts(text, with_id, with_score, **options))

    def _with_keys(self, tree, with_id: bool, with_score: bool):
        if (with_id or with_score) and isinstance(tree, Select) and tree.join is None and not is_aggregated(tree):
            key = self.catalog.scan([t.name for t in tree.tables], tree.hint("IGNORE_UNAVAILABLE") is not None).id_col
            more = [Item(Col(key), "_id", "_id")] * with_id + [Item(Col("_score"), "_score", "_score")] * with_score
            return replace(tree, items=(*more, *tree.items))
        return tree

    def json(self, text: str) -> dict:
        """The answer as a dict; with TRACK_TOTAL_HITS the total counts all rows that fit, not only those shown."""
        began, tree = time.time(), parse(text)
        out = results.envelope(self.run(tree))
        if (total := self._total(tree)) is not None:
            out["hits"]["total"]["value"] = total
        out["took"] = int(1000 * (time.time() - began))
        return out

    def json_parts(self, text: str) -> Iterator[str]:
        """The same answer as pieces of its text, hit by hit: no more than a partition of it is held."""
        began, tree = time.time(), parse(text)
        total = self._total(tree)
        yield from results.envelope_parts(self.run(tree), began, total)

    def _total(self, tree) -> int | None:
        counted = isinstance(tree, Select) and tree.join is None and tree.hint("TRACK_TOTAL_HITS") and not is_aggregated(tree)
        return self.base(tree)[0].count() if counted else None

    def csv_parts(self, text: str, with_id: bool = False, with_score: bool = False, **options) -> Iterator[str]:
        """Lines of csv(), one by one."""
        options.pop("new_line", None)
        return results.csv_lines(self.run(self._with_keys(parse(text), with_id, with_score)), **options)

    def scroll(self, text: str, size: int | None = None) -> Iterator[list]:
        tree = parse(text)
        hint = tree.hint("USE_SCROLL") if isinstance(tree, Select) else None
        return results.pages(self.run(tree), size or (int(hint.args[0]) if hint and hint.args else 50))

    # ------------------------------------------------------------ SELECT

    def with_marks(self, df: DataFrame, scope: Scope) -> DataFrame:
        """Joins what the conditions' subqueries and child tables have marked."""
        for inner, on, _ in scope.semi:
            df = df.join(inner, on, "left")
        return df

    def base(self, select: Select) -> tuple[DataFrame, Scope]:
        """The scanned and filtered rows, and where names are looked up."""
        source = self.catalog.scan([t.name for t in select.tables], select.hint("IGNORE_UNAVAILABLE") is not None or _lenient(select)) if select.tables else Source(self.spark.range(1).select())
        df = source.df
        if hint := select.hint("RUNTIME_MAPPINGS"):
            df = _runtime(df, hint.text)
        if hint := select.hint("ROUTINGS"):
            if "_routing" in df.columns:
                df = df.filter(F.col("_routing").isin(list(hint.args)))
        source = Source(df, source.id_col if source.id_col in df.columns else next(iter(df.columns), "_id"), source.text, source.children)
        aliases = tuple(a for t in select.tables for a in (t.alias, t.name) if a)
        scope = Scope(df, df.schema, source, self, aliases)
        members, rest = split_members(select.where)
        if rest is not None:
            test = condition(rest, scope)
            df = self.with_marks(df, scope).filter(test)
            if scope.semi:
                df = df.drop(*[c for _, _, cols in scope.semi for c in cols])
            scope.semi.clear()
        for node, negated in members:
            df = member_join(df, node, negated, scope)
        return df, scope

    def select(self, select: Select) -> DataFrame:
        if select.join is not None:
            return join(select, self)
        df, scope = self.base(select)
        if is_aggregated(select):
            return aggregate(select, df, scope, self)
        return self._hits(select, df, scope)

    def hits_of(self, text: str) -> DataFrame:
        """The hits beside an aggregation: DOCS_WITH_AGGREGATION([from,] size) and POST_FILTER apply to them."""
        select = parse(text)
        df, scope = self.base(select)
        hint = select.hint("DOCS_WITH_AGGREGATION")
        numbers = [int(a) for a in hint.args] if hint and hint.args else [0]
        start, size = numbers if len(numbers) == 2 else (0, numbers[0])
        if post := select.hint("POST_FILTER"):
            df = hits.post_filter(df, post.text, scope)
        plain_items = tuple(i for i in select.items if isinstance(i.node, Col)) or (Item(Star(), None, "*"),)
        out = Select(plain_items, select.tables, orders=select.orders, limit=size if hint else select.limit, offset=start)
        return self._hits(out, df, scope)

    def _hits(self, select: Select, df: DataFrame, scope: Scope) -> DataFrame:
        scored = any(isinstance(o.node, Col) and o.node.name == "_score" for o in select.orders) or any(isinstance(i.node, Col) and i.node.name == "_score" for i in select.items) or select.hint("MIN_SCORE")
        if scored and scope.find("_score") is None:
            df = hits.with_score(df, select, scope)
        if hint := select.hint("MIN_SCORE"):
            df = df.filter(F.col("_score") >= float(hint.args[0]))
        if hint := select.hint("POST_FILTER"):
            df = hits.post_filter(df, hint.text, scope)
        if hint := select.hint("HIGHLIGHT"):
            df = hits.highlight(df, hint.text, select, scope)
        scope.extra = {i.alias: hits.item_column(i, df, scope) for i in select.items if i.alias and not isinstance(i.node, Star)}
        if hint := select.hint("SEARCH_AFTER"):
            df = df.filter(hits.search_after(select.orders, hint.args, scope))
        orders = hits.order_columns(select.orders, scope)
        if hint := select.hint("COLLAPSE"):
            df = hits.collapse(df, hint.text, orders, scope)
        if select.distinct:
            out = hits.project(df, select, scope).distinct()
            named = [F.col(f"`{o.node.name}`").asc_nulls_last() if o.ascending else F.col(f"`{o.node.name}`").desc_nulls_last() for o in select.orders if isinstance(o.node, Col)]
            return self._page(out.orderBy(*named) if named else out, select)
        if orders:
            df = df.orderBy(*orders)
        return hits.project(self._page(df, select), select, scope)

    def _page(self, df: DataFrame, select: Select) -> DataFrame:
        if select.offset:
            df = df.offset(select.offset)
        limit = select.limit if select.limit is not None else self.default_limit
        return df if limit is None else df.limit(limit)

    # ------------------------------------------------------------ DELETE, SHOW

    def _doomed(self, tree: Delete) -> tuple[DataFrame, DataFrame]:
        """(rows that stay, rows that go)"""
        source = self.catalog.one(tree.table.name)
        df, scope = source.df, Scope(source.df, source.df.schema, source, self, tuple(a for a in (tree.table.alias, tree.table.name) if a))
        test = F.lit(True) if tree.where is None else F.coalesce(condition(tree.where, scope), F.lit(False))
        marked = self.with_marks(df, scope).withColumn("__doomed", test)
        if tree.limit is not None:
            # The first by content: rows that tie are equal, so what goes and what stays are complements however often they are read.
            columns = [F.col(f"`{c}`") for c in df.columns]
            doomed = marked.filter("__doomed").select(*columns)
            first = doomed.orderBy(F.to_json(F.struct(*columns))).limit(tree.limit)
            return marked.filter(~F.col("__doomed")).select(*columns).union(doomed.exceptAll(first)), first
        columns = [F.col(f"`{c}`") for c in df.columns]
        return marked.filter(~F.col("__doomed")).select(*columns), marked.filter("__doomed").select(*columns)

    def delete(self, tree: Delete) -> DataFrame:
        """The catalog's table loses the rows; the result is their number. Files are left alone: see write_without()."""
        stay, go = self._doomed(tree)
        count = go.agg(F.count(F.lit(1)).alias("deleted"))
        self.catalog.replace(tree.table.name, stay)
        return count

    def write_without(self, text: str, path: str) -> int:
        """DELETE into a new Parquet table at path, which the catalog then reads; the number of deleted rows."""
        tree = parse(text)
        stay, go = self._doomed(tree)
        deleted = go.count()
        stay.write.parquet(path)
        self.catalog.replace(tree.table.name, self.spark.read.schema(stay.schema).parquet(path))
        return deleted

    def show(self, pattern: str) -> DataFrame:
        """Columns of the tables that fit: table, field (dotted), type."""
        import fnmatch

        names = fnmatch.filter(self.catalog.known(), pattern or "*") if "*" in pattern or not pattern else [pattern]
        rows = []
        for name in names:
            source = self.catalog.one(name)
            for path, kind in _fields(source.df.schema):
                rows.append((name, path, "text" if path in source.text else kind))
        return self.spark.createDataFrame(rows, "table string, field string, type string")


def _head(tree) -> str:
    """What kind of statement a plan belongs to."""
    if isinstance(tree, SetOperation):
        return f"performing {tree.op.upper()}"
    if isinstance(tree, Show):
        return "show"
    if tree.join:
        return "nested loops" if tree.hint("USE_NL", "USE_NESTED_LOOPS") else "join"
    return "aggregation" if is_aggregated(tree) else "query"


def _lenient(select: Select) -> bool:
    hint = select.hint("INDICES_OPTIONS")
    return hint is not None and '"ignore_unavailable":true' in hint.text.replace(" ", "").lower()


def _runtime(df: DataFrame, spec: str) -> DataFrame:
    """Computed columns: {"name": {"type": ..., "script": {"source": SQL expression or emit(...)}}}."""
    import json
    import re

    kinds = {"keyword": "string", "long": "bigint", "double": "double", "date": "timestamp", "boolean": "boolean"}
    for name, given in json.loads(spec).items():
        source = given["script"]["source"] if isinstance(given.get("script"), dict) else given.get("script", name)
        m = re.fullmatch(r"\s*emit\((.*)\)\s*;?\s*", source, re.S)
        code = re.sub(r"doc\[['\"]([^'\"]+)['\"]\]\.value", r"\1", m[1] if m else source)
        df = df.withColumn(name, F.expr(code).cast(kinds.get(given.get("type", "keyword"), "string")))
    return df


def _fields(schema: T.StructType, prefix: str = "") -> Iterator[tuple[str, str]]:
    for f in schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(kind, T.StructType):
            yield prefix + f.name, "nested" if isinstance(f.dataType, T.ArrayType) else "object"
            yield from _fields(kind, f"{prefix}{f.name}.")
        else:
            yield prefix + f.name, {"string": "keyword", "bigint": "long", "int": "integer", "timestamp_ntz": "date", "timestamp": "date"}.get(kind.simpleString(), kind.simpleString())

