"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.session import cut, table

__all__ = ["append_columns", "claim", "crc_fold", "cut", "map_arrow", "read_documents", "table", "texts_of", "free_name"]


#: What each operator keeps in a Python worker between tasks, as the function that drops it.
_kept: dict[str, Callable[[], None]] = {}


def claim(owner: str, drop: Callable[[], None]) -> None:
    """Called by an operator's task: what other operators have kept in this worker is dropped, so that memory holds the caches of one only."""
    _lean()
    others = [o for o in _kept if o != owner]
    for other in others:
        _kept.pop(other)()
    _kept[owner] = drop
    if others:
        _give_back()


@functools.cache
def _lean() -> None:
    """Once a worker: batches are taken from the system and go back to it when they are done, rather than to a pool that keeps them."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD: blocks from here on, as whole batches, are mapped alone
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD


def _give_back() -> None:
    """Hand freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


CHUNK_ROWS, CHUNK_BYTES = 1000, 4 << 20  # rows and text of a batch that are worked on at once, about


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices, so that what is made of them in Python stays small; a row is never cut."""
    at, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for k, n in enumerate(lengths):
        if k > at and (k - at == CHUNK_ROWS or size + n > CHUNK_BYTES):
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += n
    if at < len(lengths):
        yield batch.slice(at)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def crc_fold(col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty string."""
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch with nulls as empty strings."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case of its names."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    return df.mapInArrow(fn, schema)


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[list[str]], list[pa.Array]]]) -> DataFrame:
    """df with further columns computed from its text column, a slice of an Arrow batch at a time.

    make() runs once per task and returns a function from the texts of a batch to the new columns. Columns of df
    with a clashing name are replaced. Rows, their order inside a partition and their multiplicity stay as they are.
    """
    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType([*keep, *fields])
    names = [f.name for f in keep]
    src = df if text_col in names else df.withColumn(text_col, F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for b in chunks(batch, text_col):
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *fn(texts_of(b, text_col))], names=schema.names)

    return src.mapInArrow(run, schema)
