"""Shared folder, reading and text helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, fresh_path, materialise

__all__ = ["crc_fold", "discard", "fresh_path", "in_batches", "materialise", "slices", "table", "unused"]

#: Bytes of an Arrow batch between Spark and a worker, a longer row aside.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trim() -> None:
    """Ask the C library to give freed memory back to the system, where it knows how."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker, which outlives its task, gives back the memory of tables and batches."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return wrapped


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with tidy workers and Arrow batches of at most about ``BATCH_BYTES``.

    Spark takes the size of batches from the session when the plan runs, so the session's setting is lowered, never raised.
    """
    spark = df.sparkSession
    told = spark.conf.get(_BATCHES, None)
    number = re.fullmatch(r"(\d+)b?", told or "")
    if number is None or int(number[1]) > BATCH_BYTES:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    return df.mapInArrow(tidy(run), schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (text or binary) holds at most ``limit`` bytes in each, a single longer row aside."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        ends = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + batch.num_rows + 1] if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            after = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + limit, "right")) - 1)
            yield batch.slice(at, after - at)
            at = after


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def crc_fold(id_col: str, folds: int = 5) -> "F.Column":
    """crc32 of the id's decimal text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
