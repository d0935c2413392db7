"""Facts from serialised protobuf messages, without a jar: flat messages of scalar fields.

All messages of a batch are read together: in each round every message that is
not at its end gives its next field, so the rounds are the fields of a message,
not the messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetcube.arrow import binary_rows, chunks, column, ragged

#: Kinds of fields: type in Spark, wire type.
KINDS = {"int64": ("bigint", 0), "uint64": ("bigint", 0), "sint64": ("bigint", 0), "bool": ("boolean", 0), "double": ("double", 1), "float": ("double", 5), "bytes": ("binary", 2), "string": ("string", 2)}


class BrokenMessage(ValueError):
    """Bytes that are no message."""


def _varints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the varints at the positions, and the positions behind them."""
    value, at, going = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at))
    for k in range(10):
        b = data[at[going]]
        value[going] |= (b & 0x7F).astype(np.uint64) << np.uint64(7 * k)
        at[going] += 1
        going = going[b >= 0x80]
        if not len(going):
            return value, at
    raise BrokenMessage("a varint of more than ten bytes")


def parse(messages: pa.Array, fields: dict[str, tuple[int, str]]) -> list[pa.Array]:
    """One array for each field of (name -> number, kind). Absent fields are null; of repeated ones the last counts; others are skipped."""
    data, start, end = binary_rows(messages)
    data = np.r_[data, np.zeros(16, np.uint8)]
    n, at = len(start), start.copy()
    values = {k: np.zeros(n, np.uint64) for k in fields}
    ends = {k: np.zeros(n, np.int64) for k, (_, kind) in fields.items() if KINDS[kind][1] == 2}
    there = {k: np.zeros(n, bool) for k in fields}
    while len(rows := np.flatnonzero(at < end)):
        tag, at[rows] = _varints(data, at[rows])
        number, wire = (tag >> np.uint64(3)).astype(np.int64), (tag & np.uint64(7)).astype(np.int64)
        value = np.zeros(len(rows), np.uint64)
        for w in np.unique(wire):
            of = np.flatnonzero(wire == w)
            r = rows[of]
            if w == 0:
                value[of], at[r] = _varints(data, at[r])
            elif w == 2:
                size, at[r] = _varints(data, at[r])
                value[of] = at[r].astype(np.uint64)
                at[r] += np.minimum(size, np.uint64(1 << 40)).astype(np.int64)
            elif w in (1, 5):
                width = 8 if w == 1 else 4
                fits = at[r] + width <= end[r]
                if not fits.all():
                    raise BrokenMessage("a message ends inside a field")
                raw = data[at[r][:, None] + np.arange(width)]
                value[of] = np.ascontiguousarray(raw).view(np.uint64 if w == 1 else np.uint32)[:, 0]
                at[r] += width
            else:
                raise BrokenMessage(f"wire type {w}")
        if (at[rows] > end[rows]).any() or (number < 1).any():
            raise BrokenMessage("a message ends inside a field")
        for k, (f, kind) in fields.items():
            mine = number == f
            if mine.any():
                if (wire[mine] != KINDS[kind][1]).any():
                    raise BrokenMessage(f"field {k} is no {kind}")
                r = rows[mine]
                values[k][r], there[k][r] = value[mine], True
                if k in ends:
                    ends[k][r] = at[r]
    out = []
    for k, (_, kind) in fields.items():
        v, gone = values[k], ~there[k]
        if kind in ("bytes", "string"):
            begin = np.where(gone, 0, v.astype(np.int64))
            size = np.where(gone, 0, ends[k] - begin)
            raw = data[ragged(begin, size)]
            buffers = [pa.py_buffer(np.packbits(there[k], bitorder="little")), pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(raw)]
            out.append(pa.Array.from_buffers(pa.string() if kind == "string" else pa.binary(), n, buffers))
        elif kind == "double":
            out.append(pa.array(v.view(np.float64), mask=gone))
        elif kind == "float":
            out.append(pa.array(v.astype(np.uint32).view(np.float32).astype(np.float64), mask=gone))
        elif kind == "bool":
            out.append(pa.array(v > 0, mask=gone))
        else:
            signed = v.view(np.int64) if kind != "sint64" else ((v >> np.uint64(1)) ^ (np.uint64(0) - (v & np.uint64(1)))).view(np.int64)
            out.append(pa.array(signed, mask=gone))
    return out


def read_messages(records: DataFrame, fields: dict[str, tuple[int, str]], column_name: str = "value") -> DataFrame:
    """Facts from messages in a binary column. ``fields``: name -> (number, kind of KINDS). A null or empty message has only nulls; broken ones are an error."""
    if unknown := [k for _, k in fields.values() if k not in KINDS]:
        raise ValueError(f"unknown kinds of fields: {unknown}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, 1 << 16):
            yield pa.RecordBatch.from_arrays(parse(column(t, column_name), fields), list(fields))

    return records.select(column_name).mapInArrow(run, ", ".join(f"`{k}` {KINDS[kind][0]}" for k, (_, kind) in fields.items()))
