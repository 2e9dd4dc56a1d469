"""SimHash near-dedup with deletion-variant signatures.

Fingerprints that differ in at most two of 64 bits agree up to one bit in one of two 32-bit segments. Every
distinct fingerprint is indexed under both segments as they are and under both with each single bit deleted
(a wildcard); fingerprints that meet under a key are compared in full. Pairs that agree in a segment are
judged under the plain key and pairs that differ in its bit i under wildcard i only, so no pair is judged twice
for one segment. Of each key's fingerprints only a spanning forest of the true links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsql.llm.common import LOWER, drop, drop_since, field_ddl, groups_of, materialize, shuffle_partitions, slices, text_buffer, tidied, written
from docsql.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Fingerprints under one key that are compared directly; more are dealt anew by pieces of their other bits.
RUN = 2048
_GROUP = 2 << 20
_ALL = (1 << 64) - 1


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each text; texts without words have 0."""
    data, off = text_buffer(texts)
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, j in groups_of(off, _GROUP):
        hashes: list[int] = []
        n = np.zeros(j - i, np.int64)
        for k in range(i, j):
            line = b" ".join(data[off[k] : off[k + 1]].tobytes().translate(LOWER).split())
            if not line:
                continue
            blank = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            starts, ends = [0, *(blank + 1).tolist()], [*blank.tolist(), len(line)]
            if len(starts) <= shingle:
                hashes.append(digest(line, seed))
                n[k - i] = 1
            else:
                hashes += [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
                n[k - i] = len(starts) - shingle + 1
        some = np.flatnonzero(n)
        if not len(some):
            continue
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.r_[0, np.cumsum(n[some])[:-1]]
        counts = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[i + some] = np.packbits(2 * counts > n[some, None], axis=1).view(">u8").ravel()
    return out


def _index(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (segment, wildcard or 32, segment's bits without the wildcard) and the fingerprints under them."""
    keys = []
    for segment in (0, 1):
        half = (fp >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
        for wild in range(33):
            left = half if wild == 32 else half & np.uint64(0xFFFFFFFF ^ 1 << wild)
            keys.append(left | np.uint64(segment << 38 | wild << 32))
    return np.concatenate(keys), np.tile(fp, 66)


def _known(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of first-level keys: the mask of bits that their fingerprints share, and the bit in which pairs must differ (or -1)."""
    segment = (keys >> np.uint64(38)).astype(np.int64)
    wild = ((keys >> np.uint64(32)) & np.uint64(63)).astype(np.int64)
    mask = np.where(segment == 1, np.uint64(_ALL ^ 0xFFFFFFFF), np.uint64(0xFFFFFFFF))
    bit = np.where(wild < 32, segment * 32 + wild, -1)
    mask = np.where(bit >= 0, mask & ~(np.uint64(1) << np.maximum(bit, 0).astype(np.uint64)), mask)
    return mask, bit


def _pieces(mask: int, bit: int) -> list[int]:
    """The bits that are neither shared nor the wildcard, in DISTANCE+1 parts: close fingerprints agree in one of them."""
    free = [b for b in range(64) if not mask >> b & 1 and b != bit]
    return [sum(1 << b for b in free[p :: DISTANCE + 1]) for p in range(DISTANCE + 1)]


def _forest(fp: np.ndarray, bit: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among fp (all under one key)."""
    side = (fp >> np.uint64(max(bit, 0))) & np.uint64(1) if bit >= 0 else None
    left = np.arange(len(fp))
    us, vs = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = np.zeros(len(left), bool)
            for f in front.tolist():
                near = ~reached & (np.bitwise_count(fp[left] ^ fp[f]) <= DISTANCE)
                if side is not None:
                    near &= side[left] != side[f]
                us += [int(fp[f])] * int(near.sum())
                vs += fp[left[near]].tolist()
                reached |= near
            front, left = left[reached], left[~reached]
    return us, vs


def _link(batches: Iterator[pa.RecordBatch], first_level: bool) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp[, mask, bit]) sorted by key -> links (a, b) and rows of long runs for the next level (mask set)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64()), ("bit", pa.int32())])
    signed = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))

    def links(us, vs):
        return pa.RecordBatch.from_arrays([signed(us), signed(vs), pa.nulls(len(us), pa.int64()), pa.nulls(len(us), pa.int32())], schema=schema)

    def deal(fp, key, mask, bit):
        for p, piece in enumerate(_pieces(mask, bit)):
            part = (fp & np.uint64(piece)) * np.uint64(0x9E3779B97F4A7C15)
            sub = (part ^ (part >> np.uint64(31)) ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(p)
            yield pa.RecordBatch.from_arrays([signed(sub), signed(fp), signed(np.full(len(fp), mask | piece, np.uint64)), pa.array(np.full(len(fp), bit, np.int32))], schema=schema)

    def finish(parts, key, mask, bit):
        """The run's rows, or what is left of them when some have been dealt."""
        fp = np.unique(np.concatenate(parts))
        if len(fp) > RUN:
            yield from deal(fp, key, mask, bit)
        elif len(fp) > 1:
            us, vs = _forest(fp, bit)
            if us:
                yield links(us, vs)

    held: list[np.ndarray] = []
    held_key, held_mask, held_bit, dealing = None, 0, -1, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy().view(np.uint64)
        fp = batch.column(1).to_numpy().view(np.uint64)
        mask, bit = _known(key) if first_level else (batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy().astype(np.int64))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        # Whole runs of two: all at once.
        inner = np.flatnonzero((ends - starts == 2) & (starts > 0) & (ends < len(key)))
        s = starts[inner]
        x, y, at = fp[s], fp[s + 1], bit[s]
        apart = x ^ y
        near = (np.bitwise_count(apart) <= DISTANCE) & (apart != 0)
        near &= (at < 0) | ((apart >> np.maximum(at, 0).astype(np.uint64)) & np.uint64(1) == 1)
        if near.any():
            yield links(x[near], y[near])
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s <= 2 and s > 0 and e < len(key):
                continue
            if held_key is not None and int(key[s]) != held_key:
                if dealing:
                    yield from deal(np.concatenate(held), held_key, held_mask, held_bit)
                else:
                    yield from finish(held, held_key, held_mask, held_bit)
                held, dealing = [], False
            held_key, held_mask, held_bit = int(key[s]), int(mask[s]), int(bit[s])
            held.append(fp[s:e])
            if sum(map(len, held)) > 8 * RUN:  # rows are distinct under a key but for repeats of a lost task: deal what there is
                yield from deal(np.concatenate(held), held_key, held_mask, held_bit)
                held, dealing = [], True
            if not held:
                held = [np.zeros(0, np.uint64)]
    if held_key is not None:
        if dealing:
            yield from deal(np.concatenate(held), held_key, held_mask, held_bit)
        else:
            yield from finish(held, held_key, held_mask, held_bit)


def near_links(distinct: DataFrame) -> DataFrame:
    """fp (distinct) -> links (u, v) that connect all fingerprints at most DISTANCE bits apart."""
    n = shuffle_partitions(distinct.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 2000):
                key, of = _index(fp[i : i + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(of.view(np.int64))], ["key", "fp"])

    rows = distinct.select("fp").mapInArrow(tidied(index), "key long, fp long")
    found, first = None, True
    while True:
        near = rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(tidied(lambda b, f=first: _link(b, f)), "a long, b long, mask long, bit int")
        near = materialize(near, "links")
        links = near.filter("mask is null").select(F.col("a").alias("u"), F.col("b").alias("v"))
        found = links if found is None else found.union(links)
        rows, first = near.filter("mask is not null").select(F.col("a").alias("key"), F.col("b").alias("fp"), "mask", "bit"), False
        if rows.isEmpty():
            return found


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Words are what ASCII white space separates after lower-casing A-Z; shingles of three words with repeats; fewer
    words are one shingle; null, empty and wordless texts have fingerprint zero, which links like any other. Null
    ids count in no minimum: a component of null ids only has a null component_id. Repeated rows and copies share
    a fingerprint and are indexed once. An empty table gives no rows; other columns may have any names.
    """
    printed = _printed(df, id_col, text_col)
    return printed.join(_components(printed, id_col), "fp").select(F.col(f"`{id_col}`"), _hex("fp").alias("fingerprint"), "component_id")


def _hex(col: str):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def _printed(df: DataFrame, id_col: str, text_col: str, digest: bool = False) -> DataFrame:
    """id, fp and, if asked for, the text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64)), *batch.columns[2:]], [id_col, "fp", "digest"][: batch.num_columns])

    text = F.col(f"`{text_col}`").cast("string")
    slim = df.select(F.col(f"`{id_col}`").alias("__id"), text.alias("__text"), *[_digest(text).alias("__digest")] * digest)
    return materialize(slim.mapInArrow(tidied(run), f"{field_ddl(df, id_col)}, fp long{', digest binary' * digest}"), "fingerprints")


def _digest(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _components(printed: DataFrame, id_col: str) -> DataFrame:
    """fp, root (of the component), component_id."""
    spark, mark = printed.sparkSession, written()
    classes = materialize(printed.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least")), "classes")
    roots = connected_components(near_links(classes)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialize(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "components")
    drop_since(spark, mark, but=(found,))
    return found


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of simhash(): a row with its smallest id (null if it has none); df's columns.

    Components may share that id. Of a component's rows with it the one with the least digest stays, so an id and
    a digest name a component: equal texts are in one. Of rows equal in both an arbitrary one stays.
    """
    printed = _printed(df, id_col, text_col, digest=True)
    key = lambda i, digest: F.concat(F.coalesce(F.concat(F.lit("i"), i.cast("string")), F.lit("n")), F.lit(":"), F.hex(digest))
    found = _components(printed, id_col)
    mine = printed.join(found, "fp").filter(F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")))
    stay = materialize(mine.groupBy("root").agg(F.first("component_id").alias("i"), F.min("digest").alias("d")).select(key(F.col("i"), F.col("d")).alias("__near_key")), "stay")
    drop(printed)
    drop(found)
    # Repeats go within each task before the one shuffle of texts, so that no key's rows gather; the join keeps that partitioning.
    keyed = df.withColumn("__near_key", key(F.col(f"`{id_col}`"), _digest(F.col(f"`{text_col}`").cast("string"))))
    return keyed.dropDuplicates(["__near_key"]).join(stay, "__near_key", "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
