"""UNION, MINUS and INTERSECT of two queries, by column name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsql.operators.expressions import LoweringError


def _checked(left: DataFrame, right: DataFrame) -> None:
    a, b = set(left.columns), set(right.columns)
    if not (a <= b or b <= a):
        raise LoweringError(f"columns differ: {sorted(a ^ b)}")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both; repeated rows stay. Columns of different types meet as texts."""
    _checked(left, right)
    kinds = dict(right.dtypes)
    clash = [c for c, t in left.dtypes if c in kinds and kinds[c] != t and not _wider(left.schema[c].dataType, right.schema[c].dataType)]
    as_text = lambda df: df.withColumns({c: F.col(f"`{c}`").cast("string") for c in clash if c in df.columns}) if clash else df
    return as_text(left).unionByName(as_text(right), allowMissingColumns=True)


def _wider(a: T.DataType, b: T.DataType) -> bool:
    return isinstance(a, T.NumericType) and isinstance(b, T.NumericType)


def _keys(df: DataFrame, columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string"), F.lit("")) for c in columns]


def _compared(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    _checked(left, right)
    columns = sorted({*left.columns, *right.columns})
    own = left.dropna("all") if left.columns else left
    keyed = own.withColumns({f"__k{i}": k for i, k in enumerate(_keys(own, columns))}).dropDuplicates([f"__k{i}" for i in range(len(columns))])
    other = right.dropna("all").select(*[k.alias(f"__k{i}") for i, k in enumerate(_keys(right, columns))])
    return keyed, other, [f"__k{i}" for i in range(len(columns))]


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the first that are not in the second; values are compared as texts, null as ''; all-null rows go."""
    keyed, other, keys = _compared(left, right)
    return keyed.join(other, keys, "left_anti").select(*[F.col(f"`{c}`") for c in left.columns])


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the first that are in the second, compared as minus() does."""
    keyed, other, keys = _compared(left, right)
    return keyed.join(other, keys, "left_semi").select(*[F.col(f"`{c}`") for c in left.columns])


APPLY = {"union": union, "minus": minus, "intersect": intersect}
