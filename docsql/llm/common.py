"""What the operators of this subpackage share: the shared folder, Arrow text buffers and word hashes."""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    It is set here only where it is unset, and only for a local master.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file:///tmp/checkpoints/docsql-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", own)
    atexit.register(_remove, own.removeprefix("file://"))
    return own


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


#: Tables that materialize() has written and drop() or drop_all() not yet deleted.
_written: list[str] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which cuts its lineage.

    An operator's result may read such tables when it runs, so they stay until drop_all().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docsql/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._docsql_path = path
    return back


def drop(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote, once nothing reads it any more."""
    _delete(df.sparkSession, df._docsql_path)


def written() -> int:
    """A mark for drop_since()."""
    return len(_written)


def drop_since(spark: SparkSession, mark: int, but: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables that materialize() has written since the mark, but those given."""
    for path in [p for p in _written[mark:] if p not in {df._docsql_path for df in but}]:
        _delete(spark, path)


def drop_all(spark: SparkSession, but: tuple[DataFrame, ...] = ()) -> None:
    """Deletes all tables that materialize() wrote in this session, but those given."""
    for path in [p for p in _written if p not in {df._docsql_path for df in but}]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """Lower-cases A-Z only. Pure ASCII text takes the faster built-in path."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER_LETTERS, LOWER_LETTERS))


def field_ddl(df: DataFrame, name: str) -> str:
    """`name type` of a column of df, for the schema of a Python operator."""
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def schema_with(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in more)])


# ---------------------------------------------------------------- Arrow text


def tidied(operator):
    """An operator over Arrow batches that gives its memory back when a partition ends, as workers live on for other tasks."""

    def run(batches):
        try:
            yield from operator(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return run


def slices(batches, column: int | str, most: int = 8 << 20):
    """The batches' rows again, in batches with at most so many bytes in a text column (a longer row stands alone)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for i, j in groups_of(np.r_[0, np.cumsum(size, dtype=np.int64)], most):
            yield batch.slice(i, j - i)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and len(col)+1 offsets. Null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1, 8 * col.offset) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def groups_of(off: np.ndarray, most: int):
    """Consecutive rows [i, j) with at most `most` bytes together; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---------------------------------------------------------------- word hashes

_MULT = 0xC2B2AE3D27D4EB4F
_PIECE = 1 << 18
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)[np.frombuffer(LOWER, np.uint8)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_MULT, _PIECE), _powers(pow(_MULT, -1, 2**64), _PIECE)


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with is_word; runs end where a row ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span after lower-casing A-Z: a polynomial in an odd base, from prefix sums."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = (_POW, _INV) if b - a <= _PIECE else (_powers(_MULT, b - a), _powers(pow(_MULT, -1, 2**64), b - a))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * power[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        h = (sums[e] - sums[s]) * inverse[s]
        out[i:j] = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        i = j
    return out
