"""Small shared pieces of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has been counted and has at most this many narrow rows.
BROADCAST_ROWS = 1_000_000
#: White space that separates words: U+0020 and U+0009 to U+000D.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(column: pa.Array, rows: int = 256, size: int = 4 << 20) -> Iterator[list[str | None]]:
    """The values of an Arrow column of texts, as lists of at most ``rows`` values and about ``size`` bytes; one value at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield column.slice(at, upto - at).to_pylist()
        at = upto


def give_back() -> None:
    """Return the memory that this worker has freed to the machine: workers live through many stages, and allocators keep what they had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024, size: int = 16 << 20) -> Iterator[None]:
    """For actions inside: Arrow batches of few rows and bytes, as texts may be long.  The session's own settings come back after."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``rows`` rows, else leave the join to shuffle.

    ``df`` should be a written table or otherwise cheap to count.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes of id and text, ``r1`` and ``r2``: 128 bits that name a row; rows alike in both are one."""
    return [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)).alias(f"r{k}") for k in (1, 2)]


def words(text: Column) -> Column:
    """Words of a text as an array, without empty ones; null gives an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_SPACE))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (a written, narrow table of distinct ids)."""
    return docs.join(if_small(ids.select(id_col)), id_col, "left_anti")
