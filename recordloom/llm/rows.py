"""Small helpers that the operators share: Arrow columns in and out of Python workers, and joins on keys of which a few are hot."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding it."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


#: Rows that a worker turns into Python objects at a time; Spark bounds an Arrow batch by its bytes, not what becomes of it.
ROWS = 512


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list] | None], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with one dict of columns for each ``ROWS`` rows; a call may give no rows."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = fn(b)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows ``ROWS`` at a time; what a task's buffers held goes back to the system when it ends."""
    try:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                yield whole.slice(at, ROWS)
    finally:
        trim()


def trim() -> None:
    """Gives freed memory back, as an idle worker stays alive beside those of the next operator."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


_held: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks, one thing at a time: a worker outlives an operator, and the tables of the
    next one take the place of its own."""
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = make()
    return _held[key]


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by their exact names; others of the table, whatever they are called, go."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


#: A list of keys up to this length is sent to the tasks instead of shuffling rows to it (some tens of MB).
BROADCAST_ROWS = 500_000
#: A key is hot if more than one row in so many has it, so there are never more hot keys than this.
HOT_SHARE = 10_000


def few(keys: DataFrame, n: int | None = None) -> DataFrame:
    """For a broadcast while the list is short."""
    return F.broadcast(keys) if (keys.count() if n is None else n) <= BROADCAST_ROWS else keys


def join_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row a key at most; all rows of ``left`` stay. Keys that more than
    one row in ``HOT_SHARE`` of ``left`` has are at most that many; their rows meet ``right`` by a broadcast where they are, and
    only the others are shuffled. ``left`` is read three times, so it should be a written table."""
    counts = left.groupBy(key).agg(F.count("*").alias("__n"))
    total = left.count()
    hot = F.broadcast(counts.where((F.col("__n") * HOT_SHARE > total) & F.col(key).isNotNull()).select(key))
    near = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, "left")
    return near.unionByName(left.join(hot, key, "left_anti").join(right, key, "left"))
