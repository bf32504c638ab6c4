"""Shared pieces of the operators: Arrow text buffers, word hashes, keyed joins.

Texts arrive as Arrow batches and are cut into blocks of whole documents of about
``BLOCK_BYTES``, so memory follows the block (or one longer document), not the batch.
Hashes are 64-bit and vectorised over a block's bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode.session import cut_lineage, scratch_path

BLOCK_BYTES = 1 << 18
NO_ID = -(1 << 63)
_U = np.uint64
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_BASE = _U(0xD6E8FEB86659FD93)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so other columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Join key of a row: its id (NULL has a value of its own) and its text's hash.

    Repeated rows share the key and the result; one id with two texts has two keys.
    """
    return [F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("k_id"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k_tx")]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared scratch folder and read back: cuts lineage, survives losses."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    # Shuffle files of the finished job go once the driver has collected its garbage.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small tables that several jobs read."""
    return cut_lineage(df)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict] | None],
              schema: str) -> DataFrame:
    """``mapInArrow`` for a function from one batch to dicts of equally long columns."""
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        for batch in batches:
            for part in function(batch):
                yield pa.record_batch([pa.array(part[f.name], f.type) for f in target],
                                      schema=target)

    return df.mapInArrow(run, fields)


def map_stream(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]],
               schema: str) -> DataFrame:
    """As ``map_arrow``, for a function over all batches of a task."""
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        for part in function(batches):
            yield pa.record_batch([pa.array(part[f.name], f.type) for f in target],
                                  schema=target)

    return df.mapInArrow(run, fields)


def byte_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Blocks (first row, end row, bytes, offsets) of a string or binary column; NULL is empty."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    width = np.int64 if large else np.int32
    rows = len(column)
    if not rows:
        return
    raw = np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + rows + 1]
    offsets = raw.astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    first = 0
    total = np.cumsum(lengths)
    while first < rows:
        done = total[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(total, done + limit, "right")))
        local = np.zeros(end - first + 1, np.int64)
        np.cumsum(lengths[first:end], out=local[1:])
        low, high = offsets[first], offsets[end]
        if high - low == local[-1]:
            block = data[low:high]
        else:
            block = np.concatenate([data[offsets[i]:offsets[i] + lengths[i]]
                                    for i in range(first, end)] or [data[:0]])
        yield first, end, block, local
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _M1
        x = x ^ (x >> _U(27))
        x = x * _M2
        return x ^ (x >> _U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """First powers of the hash base and of its inverse modulo 2**64; grown on demand."""
    if len(_POWERS[0]) < count:
        size = 1 << max(12, int(count - 1).bit_length())
        for at, base in ((0, _BASE), (1, _BASE_INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[at] = np.cumprod(grown, dtype=np.uint64)
    return _POWERS[0][:count], _POWERS[1][:count]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times rising powers: any run's hash is one subtraction."""
    up, _ = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[:-1], out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run [start, end), alike wherever the run stands."""
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        value = (sums[ends] - sums[starts]) * down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * _GOLD)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of a block of documents: byte spans, first word of each document, hashes."""

    def __init__(self, block: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
        inside = ~separator[block]
        edge = np.zeros(len(block) + 1, bool)
        edge[offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.block = block

    def hashes(self) -> np.ndarray:
        return run_hashes(prefix_sums(_BYTE_VALUE[self.block]), self.starts, self.ends)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, by its first word."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        value = words[:count].copy()
        for i in range(1, size):
            value = value * _BASE + words[i:i + count]
        return mix(value)


def packed_rows(data: bytes | memoryview, dtype) -> np.ndarray:
    return np.frombuffer(data, dtype)


def binary_column(chunks: list[np.ndarray]) -> pa.Array:
    """Binary column from arrays, one value each, without Python bytes objects."""
    ends = np.zeros(len(chunks) + 1, np.int32)
    if chunks:
        np.cumsum([c.nbytes for c in chunks], out=ends[1:])
        data = np.concatenate([np.ascontiguousarray(c).view(np.uint8) for c in chunks])
    else:
        data = np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(chunks),
                                 [None, pa.py_buffer(ends), pa.py_buffer(data)])


def list_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
