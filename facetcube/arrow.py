"""Small helpers for kernels that run inside ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def chunks(batches: Iterator[pa.RecordBatch], rows: int, exactly: bool = False) -> Iterator[pa.Table]:
    """Batches as tables of about ``rows`` rows (``exactly``: never more), each with one chunk a column."""
    held: list[pa.RecordBatch] = []
    n = 0
    for whole in batches:
        for at in range(0, whole.num_rows, rows if exactly else max(whole.num_rows, 1)):
            b = whole.slice(at, rows) if exactly else whole
            if exactly and n + b.num_rows > rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def folded(batches: Iterator[pa.RecordBatch], reduce: Callable[[pa.Table], pa.Table], rows: int = 1 << 14, size: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Sorted batches reduced to one row a key, while they are read.

    ``reduce`` gives one row for each key of a sorted table, in order, and takes
    its own results. A key that goes on in the next table is held as one row, so
    memory does not grow with the rows of a key.
    """
    held: list[pa.RecordBatch] = []
    n = taken = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n, taken = n + b.num_rows, taken + b.nbytes
        if n < rows and taken < size:
            continue
        t = reduce(pa.Table.from_batches(held).combine_chunks())
        yield from t.slice(0, t.num_rows - 1).to_batches()
        last = t.take(pa.array([t.num_rows - 1])).combine_chunks()
        held, n, taken = last.to_batches(), 1, last.nbytes
    if held:
        yield from reduce(pa.Table.from_batches(held).combine_chunks()).to_batches()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` as tables of whole groups, of about ``rows`` rows at least."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cut = pc.sum(pc.not_equal(t[key], t[key][-1])).as_py()  # sorted: the last group is the end
        if cut:
            yield t.slice(0, cut).combine_chunks()
        rest = t.slice(cut)
        held, n = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(t: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    c = t[name]
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() if c.num_chunks else pa.array([], c.type)


def runs(array: pa.Array) -> np.ndarray:
    """Number of the run that each row of a sorted array belongs to, from 0."""
    ends = pc.run_end_encode(array).run_ends.to_numpy()
    return np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))


def binary_rows(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary or string array with each row's start and end in them (nulls: empty)."""
    wide = pa.types.is_large_binary(a.type) or pa.types.is_large_string(a.type)
    offsets = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32, len(a) + a.offset + 1)[a.offset :].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each row, one row after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before, lengths) + np.repeat(starts, lengths)
