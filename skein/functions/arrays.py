"""Numpy views of vectors in Arrow columns, without Python lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


PIECE = 4_000_000  #: bytes of a batch that are worked on at once in Python


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about ``most`` bytes, one row at least, so that Python objects are made of few rows at a time."""
    for batch in batches:
        if batch.num_rows <= 1 or batch.nbytes <= most:
            yield batch
        else:
            middle = batch.num_rows // 2
            yield from pieces((batch.slice(0, middle), batch.slice(middle)), most)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite(e: Column) -> Column:
    """True for a vector with components, none of them null or non-finite; never null."""
    return F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def kind_of(vectors: DataFrame, column: str = "embedding") -> str:
    """The numpy type of a vector column's components: float stays float, the rest is taken as double."""
    return "<f4" if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else "<f8"


def as_kind(e: Column, kind: str) -> Column:
    return e.cast("array<float>" if kind == "<f4" else "array<double>")


def lengths(raw: pa.Array) -> np.ndarray:
    """Bytes of each value of a binary column."""
    return np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1])


def binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of the bytes of ``values``, cut into ``sizes`` bytes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def rows_of(x: np.ndarray) -> pa.Array:
    """A matrix's rows as a binary column."""
    return binary(x, np.full(len(x), x.shape[1] * x.itemsize))


def packed(lists: pa.Array, kind: str) -> pa.Array:
    """A column of lists without nulls as their components' bytes."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return binary(flat + flat.dtype.type(0), lists.value_lengths().to_numpy(zero_copy_only=False) * flat.itemsize)  # -0 becomes 0


def matrix(raw: pa.Array, kind: str) -> np.ndarray:
    """Rows of a binary column of one length as a matrix."""
    if not len(raw):
        return np.zeros((0, 0), kind)
    ends = np.frombuffer(raw.buffers()[1], np.int32)[[raw.offset, raw.offset + len(raw)]]
    return np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[1]].view(kind).reshape(len(raw), -1)


def by_length(raw: pa.Array):
    """(bytes, places) for each length that a binary column holds."""
    n = lengths(raw)
    for size in np.unique(n):
        yield int(size), np.flatnonzero(n == size)


def spread(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, components, places of the first ones, usable) of a column of lists; usable are those with a direction and no null or non-finite component."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)  # null becomes NaN
    begin = np.cumsum(size) - size
    upto = lambda x: np.concatenate([[0], np.cumsum(x)])
    good, other = upto(np.isfinite(flat)), upto(flat != 0)
    return size, flat, begin, (good[begin + size] - good[begin] == size) & (other[begin + size] > other[begin])


def raws(rows: DataFrame, kind: str, *keys: str, checked: bool = False) -> DataFrame:
    """``rows`` (keys, embedding) with the embedding's bytes as ``raw``; no shuffle. ``checked``: null where it isn't usable, as ``spread`` says."""

    def run(batches):
        for batch in pieces(batches) if checked else batches:
            lists = batch.columns[-1]
            if checked:
                usable = spread(lists)[3]
                raw = packed(lists.filter(pa.array(usable)), kind).take(pa.array(np.cumsum(usable) - 1, mask=~usable))
            else:
                raw = packed(lists, kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], raw], names=[*keys, "raw"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, as_kind(F.col("embedding"), kind).alias("embedding")).mapInArrow(run, f"{kinds}{', ' if keys else ''}raw binary")
