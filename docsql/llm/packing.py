"""Conflict-constrained best-fit packing of documents into fixed-length training sequences.

Documents longer than a sequence are cut into full sequences and a rest. The rests are dealt over shards of
bounded size at random; within a shard they go, longest first, into the tightest open bin that is compatible: one
whose source bitmap and duplicate-cluster bitmap have neither bit set. Bins stand in lists ordered by residual; the
search begins at the successor of the length and goes on until a compatible bin is found, or opens one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsql.llm.common import ascii_lower, field_ddl, materialize, slices, tidied
from docsql.llm.token_store import encoder_for

CAPACITY = 2048
#: Tokens and rows in a shard, on average: what one task holds.
SHARD_TOKENS, SHARD_ROWS = 16 << 20, 20_000
#: Bytes of text encoded at a time to count ids.
GROUP = 4 << 20
#: A source with more than this share of a shard has a list of the bins that lack it; others step over their bins.
HOT = 1 / 32


class _Bins:
    """Open bins: lists of (residual, bin) in order, one of all and one for each hot source of those without it."""

    def __init__(self, hot: list[int]):
        self.all: list[tuple[int, int]] = []
        self.lacking: dict[int, list[tuple[int, int]]] = {s: [] for s in hot}
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.residual: list[int] = []

    def candidates(self, source: int) -> list[tuple[int, int]]:
        return self.lacking.get(source, self.all)

    def compatible(self, b: int, source: int, cluster: int) -> bool:
        return not (self.sources[b] >> source & 1 or cluster >= 0 and self.clusters[b] >> cluster & 1)

    def open(self, capacity: int) -> int:
        b = len(self.residual)
        self.sources.append(0)
        self.clusters.append(0)
        self.residual.append(capacity)
        for each in (self.all, *self.lacking.values()):
            insort(each, (capacity, b))
        return b

    def put(self, b: int, length: int, source: int, cluster: int) -> None:
        old, new = (self.residual[b], b), (self.residual[b] - length, b)
        for s, each in ((-1, self.all), *self.lacking.items()):
            if s >= 0 and self.sources[b] >> s & 1:
                continue
            del each[bisect_left(each, old)]
            if s != source and new[0]:
                insort(each, new)
        self.residual[b] = new[0]
        self.sources[b] |= 1 << source
        if cluster >= 0:
            self.clusters[b] |= 1 << cluster


def pack_shard(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(length, source, cluster) in packing order -> (bin, offset) of each. Sources and clusters are numbers from 0; cluster -1 has no other row."""
    n_of = Counter(s for _, s, _ in items)
    bins = _Bins([s for s, n in n_of.items() if n > HOT * len(items)])
    out = []
    run, after = None, (0, -1)  # equal items in a row: bins up to `after` have been found incompatible
    for item in items:
        length, source, cluster = item
        where = bins.candidates(source)
        if item != run:
            run, after = item, (length, -1)
        at = bisect_right(where, after)
        while at < len(where) and not bins.compatible(where[at][1], source, cluster):
            at += 1
        if at < len(where):
            after = where[at]
            b = after[1]
        else:
            after = where[-1] if where and where[-1] > after else after
            b = bins.open(capacity)
            after = max(after, (capacity, b))
        out.append((b, capacity - bins.residual[b]))
        bins.put(b, length, source, cluster)
    return out


def _measured(items: DataFrame, tokenizer: str) -> DataFrame:
    """__words, a text, becomes its number of ids and one end mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for batch in slices(batches, 1, GROUP):
            n = np.array([len(ids) + 1 for ids in encoder.encode(batch.column(1))], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), batch.column(2), batch.column(3)], ["__id", "__words", "source", "cluster"])

    return items.mapInArrow(tidied(run), f"{field_ddl(items, '__id')}, __words long, source string, cluster string")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row for each document and piece: id, piece, n_tokens, bin_id, bin_offset, source, cluster.

    A document's length is the ids that the tokenizer file gives for its whole text, as in token_store, and one end
    mark; without a tokenizer it is the blank-separated words and the end mark, whatever else separates words. Null
    and empty texts have length 1.
    Without cluster_col, documents with equal text up to the case of A-Z are one cluster. A null source is a
    source of its own, as is a null cluster a cluster; no two rests in a bin share a source or a cluster. Repeated
    rows are packed one by one. Other columns may have any names; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.size(F.filter(F.split(text, " "), lambda w: w != "")) + 1
    cluster = F.col(f"`{cluster_col}`").cast("string") if cluster_col else F.md5(ascii_lower(text).cast("binary"))
    items = df.select(
        F.col(f"`{id_col}`").alias("__id"), (text if tokenizer else words.cast("long")).alias("__words"),
        F.col(f"`{source_col}`").cast("string").alias("source"), cluster.alias("cluster"),
    )
    if tokenizer:
        items = _measured(items, tokenizer)
    items = materialize(items.withColumn("__row", F.monotonically_increasing_id()), "lengths")
    total = items.agg(F.coalesce(F.sum("__words"), F.lit(0)).alias("w"), F.count(F.lit(1)).alias("n")).first()
    shards = int(max(1, -(-total.w // SHARD_TOKENS), -(-total.n // SHARD_ROWS)))
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__words") / capacity).cast("int") - 1)))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity), F.col("__words") - F.col("piece") * capacity).cast("int"))
    out = f"{field_ddl(df, id_col)}, piece int, n_tokens int, bin_id string, bin_offset int, source string, cluster string"
    named = lambda part, bin_id, offset: part.select(F.col("__id").alias(id_col), "piece", "n_tokens", bin_id.alias("bin_id"), offset.alias("bin_offset"), "source", "cluster")
    full = named(pieces.filter(F.col("n_tokens") == capacity), F.concat(F.lit("f"), F.col("__row"), F.lit("-"), F.col("piece")), F.lit(0))

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by([("n_tokens", "descending"), ("cluster", "ascending"), ("source", "ascending"), ("__row", "ascending")])
        numbered = [part[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist() for c in ("source", "cluster")]
        rows_of = Counter(numbered[1])
        bit = {c: i for i, c in enumerate(c for c, n in rows_of.items() if n > 1)}
        placed = pack_shard(list(zip(part["n_tokens"].to_pylist(), numbered[0], [bit.get(c, -1) for c in numbered[1]], strict=True)), capacity)
        shard = key[0].as_py()
        bins = pa.array([f"s{shard}-{b}" for b, _ in placed], pa.string())
        return pa.table([part["__id"], part["piece"], part["n_tokens"], bins, pa.array([o for _, o in placed], pa.int32()), part["source"], part["cluster"]], [id_col, "piece", "n_tokens", "bin_id", "bin_offset", "source", "cluster"])

    rests = pieces.filter(F.col("n_tokens") < capacity).withColumn("__shard", F.pmod(F.xxhash64("__row"), F.lit(shards)))
    packed = rests.select("__shard", "__id", "__row", "piece", "n_tokens", "source", "cluster").groupBy("__shard").applyInArrow(run, out)
    return packed.union(full)
