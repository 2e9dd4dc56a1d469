"""Tables by name: what a FROM clause may mention."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TableNotFound(LookupError):
    """No table of this name."""


@dataclass(frozen=True)
class Child:
    """Rows of `table` belong to the row whose id is in their column `parent`."""

    table: str
    parent: str


@dataclass(frozen=True)
class Source:
    """A table: its rows, its key column, its analysed text columns (dotted paths) and its child tables."""

    df: DataFrame
    id_col: str = "_id"
    text: frozenset[str] = frozenset()
    children: dict[str, Child] = field(default_factory=dict)


_UNITS = {"y": 365, "M": 30, "w": 7, "d": 1}


def date_math_name(name: str, now: datetime | None = None) -> str:
    """<logs-{now/d-1d}> to logs-2024.01.31, in UTC."""
    if not name.startswith("<"):
        return name

    def one(m: re.Match) -> str:
        at = now or datetime.now(UTC)
        for sign, n, unit in re.findall(r"([+-])(\d+)([yMwd])", m[1]):
            at += timedelta(days=(1 if sign == "+" else -1) * int(n) * _UNITS[unit])
        if "/M" in m[1]:
            at = at.replace(day=1)
        fmt = (m[2] or "yyyy.MM.dd").replace("yyyy", "%Y").replace("MM", "%m").replace("dd", "%d")
        return at.strftime(fmt)

    return re.sub(r"\{(now[^{}]*)(?:\{([^{}|]*)[^{}]*\})?\}", one, name.strip("<>"))


class Catalog:
    """Registered tables, and Parquet tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, names: list[str] | None = None):
        self.spark, self.folder, self.names = spark, folder, names or []
        self._tables: dict[str, Source] = {}

    def register(self, name: str, df: DataFrame, id_col: str = "_id", text: tuple[str, ...] = (), children: dict[str, Child] | None = None) -> None:
        self._tables[name] = Source(df, id_col, frozenset(text), dict(children or {}))

    def replace(self, name: str, df: DataFrame) -> None:
        self._tables[name] = replace(self.one(name), df=df)

    def known(self) -> list[str]:
        return sorted({*self._tables, *self.names})

    def one(self, name: str) -> Source:
        if name not in self._tables:
            if self.folder is None or self.names and name not in self.names:
                raise TableNotFound(name)
            self._tables[name] = Source(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))
        return self._tables[name]

    def scan(self, names: list[str], ignore_missing: bool = False) -> Source:
        """The union of tables, by column name; missing columns are null. Globs stand for all known names they fit."""
        found: list[str] = []
        for name in names:
            name = date_math_name(name)
            some = fnmatch.filter(self.known(), name) if "*" in name or "?" in name else [name]
            found += [n for n in some if n not in found]
        sources = []
        for name in found:
            try:
                sources.append(self.one(name))
            except TableNotFound:
                if not ignore_missing:
                    raise
        if not sources:
            raise TableNotFound(", ".join(names))
        if len(sources) == 1:
            return sources[0]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.df for s in sources))
        return Source(df, sources[0].id_col, frozenset().union(*(s.text for s in sources)), {k: c for s in sources for k, c in s.children.items()})


def load_json(spark: SparkSession, path: str, schema: T.StructType | str, bulk: bool = True) -> DataFrame:
    """Documents of newline-delimited JSON. bulk: action lines with ids alternate with documents.

    A scalar where the schema has an array is taken as an array of one.
    """
    if not bulk:
        return spark.read.schema(schema).json(path)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    # Lines are read in splits; each file's are put in order by split and place, which pairs an id with the document after it.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    order = Window.partitionBy("file").orderBy("at", "n")
    numbered = lines.filter(F.trim("value") != "").withColumns({"action": F.lag("value").over(order), "line": F.row_number().over(order)})
    pairs = numbered.filter(F.col("line") % 2 == 0).select("action", F.col("value").alias("doc"))
    relaxed = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields if f.name != "_id"])
    doc = F.from_json("doc", relaxed)
    cols = [F.get_json_object("action", "$.index._id").alias("_id")]
    for f in schema.fields:
        if f.name == "_id":
            continue
        raw = doc.getField(f.name)
        if isinstance(f.dataType, T.ArrayType):
            raw = F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
        nested = isinstance(f.dataType, (T.ArrayType, T.StructType))
        cols.append((F.from_json(raw, f.dataType) if nested else raw.try_cast(f.dataType)).alias(f.name))
    return pairs.select(*cols)

