"""Text as flat byte buffers: words, hashes and shared-folder helpers in numpy.

A word is a run of bytes other than ASCII white space. Every function works on a whole
slice of documents at once; nothing loops over characters in Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse modulo 2**64 to the powers 0 to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums with which ``span_hash`` gets the hash of any span."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end]; equal for equal content and length wherever it lies."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


try:
    import ctypes

    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library keeps its own house

    def _trim(_: int) -> int:
        return 0


def release() -> None:
    """Give freed memory back to the system: a worker lives on and would hold its peak."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each has at most ``most`` bytes of text, or one row."""
    for batch in batches:
        _, offs = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        del batch, offs
        release()


class Words:
    """Words of a slice: start and end byte of each, and at ``first[d]`` document d's first word."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE):
        self.raw, self.offs = raw, offs
        inside = ~space[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offs] = True
        before = np.concatenate(([False], inside)) & ~edge
        after = np.concatenate((inside, [False]))
        self.starts = np.flatnonzero(after & ~before)
        self.ends = np.flatnonzero(np.concatenate(([False], inside)) & (~after | edge))
        self.first = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix(self.raw), self.starts, self.ends)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each pair, one after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(counts) - counts), counts)
    return skip + np.arange(total)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI, resolved as Spark resolves it: without a scheme, in fs.defaultFS."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only without that setting, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/loomspark-shared"
        spark.sparkContext.setCheckpointDir(root)
    return qualified(spark, f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends, losing an executor costs nothing."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: strings and lists by their length, anything else eight."""

    def size(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return 16 + F.coalesce(F.octet_length(x), F.lit(0))
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            each = 8 * len(inner.fields) + 16 if isinstance(inner, T.StructType) else 8
            if isinstance(inner, (T.StringType, T.BinaryType)):
                return 24 + F.coalesce(F.aggregate(x, F.lit(0), lambda a, y: a + size(y, inner)), F.lit(0))
            return 24 + each * F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))
        return F.lit(8)

    return reduce(lambda a, b: a + b, (size(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")


def sized_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", most_bytes: int = 64 << 20) -> DataFrame:
    """Join; ``small`` is broadcast only if its measured bytes are at most ``most_bytes``, else both sides are shuffled."""
    measured = small.agg(F.sum(row_bytes(small))).first()[0] or 0
    return big.join(F.broadcast(small) if measured <= most_bytes else small.hint("merge"), on, how)
