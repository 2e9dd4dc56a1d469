"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsql.llm.common import drop, materialize


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame) -> DataFrame:
    """u, v -> rows (u, v): v is the smallest vertex of u's component, for every u that is not itself the smallest.

    Each step is two aggregations with partial sums and two joins on the vertex; a hub's minimum is taken before
    the shuffle and a hub's edges can be split by the join. Each round is written to the shared folder. Loops and
    repeated edges change nothing; no edges give no rows. The rounds needed grow with the logarithm of the size.
    """
    edges = materialize(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.filter(F.col("u") != F.col("v")).distinct(), "edges")
        drop(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return edges
