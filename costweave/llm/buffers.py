"""Arrow string buffers as numpy arrays: kernels that handle all rows of a batch together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that a gather moves at once; its index arrays take eight times as much.
_BLOCK = 1 << 20


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array, end to end, and the row bounds in them; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = array.buffers()
    at = np.frombuffer(bounds, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    held = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces ``source[start : start + length]`` end to end, block by block, so that the index stays small."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, source.dtype)
    shift = starts - (ends - lengths)
    for low in range(0, total, _BLOCK):
        high = min(low + _BLOCK, total)
        first, last = np.searchsorted(ends, [low, high - 1], "right")
        inside = np.minimum(ends[first : last + 1], high) - np.maximum(ends[first : last + 1] - lengths[first : last + 1], low)
        out[low:high] = source[np.arange(low, high) + np.repeat(shift[first : last + 1], inside)]
    return out


def bounds_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def as_strings(data: np.ndarray, bounds: np.ndarray, kind: pa.DataType, valid: np.ndarray | None = None) -> pa.Array:
    """An Arrow array of strings or binaries over the bytes; rows that are not ``valid`` are null."""
    large = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}[kind]
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    made = pa.Array.from_buffers(large, len(bounds) - 1, [mask, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return made.cast(kind)


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch in order, each of about ``size`` bytes or one row."""
    weight = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            weight += np.diff(bytes_of(column)[1])
    part = (np.cumsum(weight + 64) - 1) // size
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def with_kernel(df: DataFrame, columns: list[str], make: Callable[[], Callable], added: str, size: int = 4 << 20) -> DataFrame:
    """All columns of ``df`` and those of the schema ``added``, made by an array kernel.

    ``make()`` is called once a task; what it gives takes the Arrow arrays of ``columns`` (some
    ``size`` bytes at a time) and returns a dict of Arrow arrays. Added names must not be among those of ``df``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string(added)
    names = to_arrow_schema(extra).names
    if taken := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(taken)} are there already")
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in slices(batch, size):
                made = kernel(*(part.column(i) for i in places))
                yield pa.RecordBatch.from_arrays([*part.columns, *(made[n] for n in names)], names=[*part.schema.names, *names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *extra.fields]))
