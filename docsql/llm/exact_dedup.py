"""Exact dedup by a distributed content sort, in DataFrame operations only.

Sampled splitters cut the order (first characters, content hash, normalised text, id) into buckets, each
bucket is sorted externally, so that equal texts are neighbours, and neighbours are compared in full. The
splitters contain the id, so a group of copies of any size is spread over several buckets; what touches a
bucket's edge (a few rows for each bucket) is merged afterwards.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsql.llm.common import ascii_lower, materialize, shuffle_partitions

#: Buckets for each shuffle partition, and sampled rows for each bucket.
OVERSPLIT, SAMPLES = 4, 20
_PREFIX = 24


def _splitters(keys: DataFrame, rows: int, buckets: int, seed: int) -> list:
    """At most buckets-1 splitters; the driver gets some SAMPLES rows for each bucket, of fixed width."""
    share = min(1.0, SAMPLES * buckets / max(rows, 1))
    order = lambda r: (r[0], r[1], r[2] is not None, r[2])
    got = sorted((tuple(r) for r in keys.sample(share, seed).collect()), key=order)
    return sorted({got[len(got) * i // buckets] for i in range(1, buckets)}, key=order) if got else []


def _bucket(key, splitters: list, id_type: str):
    """How many splitters are <= key, by binary search."""
    if not splitters:
        return F.lit(0)
    at = lambda acc, lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"), acc["key"].alias("key"))
    # One literal, however many splitters there are; null ids are the smallest, as in the sort.
    table = F.from_json(F.lit(json.dumps([dict(zip("phi", s, strict=True)) for s in splitters], default=str)), f"array<struct<p: string, h: bigint, i: {id_type}>>")
    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & (F.get(table, mid) <= acc["key"])
        left = (acc["lo"] < acc["hi"]) & ~right
        return at(acc, F.when(right, mid + 1).otherwise(acc["lo"]), F.when(left, mid).otherwise(acc["hi"]))

    # The key rides in the accumulator, so that the text is normalised once for a row and not at each step.
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"), key.alias("key")), step)["lo"]


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, seed: int = 5) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256; with carry, also struct __row of the row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest id stays; of repeated rows with that id exactly one stays; a null id counts as smaller than any
    other, whatever the type of ids. An empty table gives an empty result. Columns of df other than the two named are ignored (or carried)
    and may have any names.
    """
    buckets = OVERSPLIT * shuffle_partitions(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    norm = ascii_lower(F.col("__text"))
    base = df.select(
        F.col(f"`{id_col}`").alias("__id"),
        text.alias("__text"),
        *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")] if carry else []),
    )
    key = (F.substring(norm, 1, _PREFIX), F.xxhash64(norm), F.col("__id"))
    splitters = _splitters(base.select(*key), df.count(), buckets, seed)
    dealt = base.withColumn("__bucket", _bucket(F.struct(*[k.alias(a) for k, a in zip(key, "phi")]), splitters, id_type))
    dealt = dealt.repartition(shuffle_partitions(df.sparkSession), "__bucket")
    keyed = dealt.select(
        "__bucket", "__id", norm.alias("__norm"), F.substring(norm, 1, _PREFIX).alias("__p"), F.xxhash64(norm).alias("__h"),
        *(["__row"] if carry else []),
    )
    order = Window.partitionBy("__bucket").orderBy("__p", "__h", "__norm", F.col("__id").asc_nulls_first())
    first = F.row_number().over(order) == 1
    marked = keyed.withColumns({
        "__new": (first | ~F.col("__norm").eqNullSafe(F.lag("__norm").over(order))).cast("int"),
        "__newkey": (first | ~F.struct("__p", "__h").eqNullSafe(F.struct(F.lag("__p").over(order), F.lag("__h").over(order)))).cast("int"),
        "__last": ~F.col("__norm").eqNullSafe(F.lead("__norm").over(order)) | F.lead(F.lit(1)).over(order).isNull(),
    })
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = marked.withColumns({"__run": F.sum("__new").over(running), "__keyno": F.sum("__newkey").over(running)}).select(
        "__bucket", "__id", "__run", "__keyno", "__last", F.sha2(F.col("__norm"), 256).alias("__sha"), *(["__row"] if carry else [])
    )
    run, bucket = Window.partitionBy("__bucket", "__run"), Window.partitionBy("__bucket")
    sized = runs.withColumns({"__n": F.count(F.lit(1)).over(run), "__max": F.max("__id").over(run)})
    sized = sized.withColumn("__edge", (F.col("__keyno") == 1) | (F.col("__keyno") == F.max("__keyno").over(bucket)))
    sized = materialize(sized, "sorted")
    edges = sized.filter(F.col("__edge") & F.col("__last")).groupBy("__sha").agg(
        F.sum("__n").alias("__total"), F.max("__max").alias("__keep"), F.max("__bucket").alias("__home")
    )
    # Two keys for each bucket at most: as many rows as there are splitters, not as there are documents.
    whole = sized.join(F.broadcast(edges.withColumn("__edge", F.lit(True))), ["__edge", "__sha"], "left")
    return whole.select(
        F.col("__id").alias(id_col),
        F.when(F.col("__total").isNotNull(), F.col("__keep")).otherwise(F.col("__max")).alias("keep_id"),
        F.coalesce("__total", "__n").alias("group_size"),
        (F.col("__last") & (F.coalesce("__home", "__bucket") == F.col("__bucket"))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
        *(["__row"] if carry else []),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_dedup() keeps, with df's columns."""
    kept = exact_dedup(df, id_col, text_col, carry=True).filter("kept")
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in df.columns])
