"""Text helpers that work on whole Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; bounds a Python worker's memory.
CHUNK_BYTES = 2_000_000
#: Bytes that a job hands a Python worker at a time, where the job runs at once.
BATCH_BYTES = 8_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64's), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def text_or_empty(column: str = "text"):
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def doc_id(column: str = "doc_id"):
    """The document's id as a long, null read as -1, under the column's own name."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-1).cast("long")).alias(column)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``limit`` bytes of ``column``, one row at least.
    No row is cut, however long its text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def lower_ascii(column: pa.Array) -> pa.Array:
    """Lower-case A-Z only; every other character keeps its form."""
    return pc.ascii_lower(column)


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts, A-Z in lower case unless asked otherwise: each word's code, the distinct words,
    and the offsets at which the rows' words begin (one more than rows)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat = parts.flatten()
    full = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
    keep = np.not_equal(pc.binary_length(flat).to_numpy(zero_copy_only=False), 0)
    before = np.concatenate([[0], np.cumsum(keep)])
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, before[full.astype(np.int64)]


def hash_words(distinct: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)


def shingle_hashes(codes: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct 64-bit hashes of its ``k``-word shingles. A row of fewer
    words has one shingle, the whole sequence; a row without words has none."""
    h = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    odd = [np.uint64(2 * 0x9E3779B97F4A7C15 * (j + 1) + 1 & (1 << 64) - 1) for j in range(k)]
    with np.errstate(over="ignore"):
        n = len(h) - k + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for j in range(k):
            if n > 0:
                rolled += mix64(h[j : j + n] + odd[j]) * odd[j]
        rolled = mix64(rolled)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                own = np.uint64(b - a)
                for j, x in enumerate(h[a:b]):
                    own += (mix64(np.array([x + odd[j]]))[0]) * odd[j]
                yield mix64(np.array([own], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


@contextmanager
def arrow_bytes(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Within this block, jobs hand Python about ``most`` bytes at a time: for rows that carry long
    texts or sets. A single longer row is handed over whole."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the named columns in the schema's order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
