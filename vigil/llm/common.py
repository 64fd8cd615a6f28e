"""What the operators share: row identity, scratch tables and Arrow helpers."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import fresh_folder, settle

__all__ = [
    "NO_ID",
    "batch_rows",
    "batches_of",
    "collect_garbage",
    "doc_key",
    "fold",
    "fresh_folder",
    "pack",
    "read_table",
    "restore_id",
    "settle",
    "texts_of",
    "whole_texts",
]

# stands for a null doc_id while rows are joined; sorts before every other id
NO_ID = -(1 << 63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def restore_id(name: str = "did") -> Column:
    """The doc_id for a key made by ``doc_key``."""
    return F.when(F.col(name) != F.lit(NO_ID), F.col(name)).alias("doc_id")


def fold(parts: int) -> Column:
    """crc32 of the doc_id as text modulo ``parts``; a null id is in fold 0."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(parts))


def whole_texts(docs: DataFrame, *more: str) -> DataFrame:
    """(did, text): the key and the whole text of every row, a null text being empty.

    Of the other columns only those named are taken, so the rest may bear any names.
    """
    return docs.select(doc_key().alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def batches_of(batches: Iterator[pa.RecordBatch], limit: int = 256 << 10, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece has about ``limit`` bytes of text."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        column = batch.column(batch.schema.get_field_index(name))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand rows to Python in smaller batches in what runs inside; the setting is put back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more."""
    for _ in range(2):  # what the first round lets go of, the second can collect
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def pack(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch from numpy arrays or lists in the order of ``schema``."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
