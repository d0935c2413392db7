"""Texts as arrays of code points, so that text operators run on whole batches instead of single strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from facetcube.arrow import binary_rows, column

#: Code points worked on at once; bounds the memory of a kernel. A longer text makes a chunk of its own.
CHARS_A_CHUNK = 1 << 20
MULT = np.uint64(0xD6E8FEB86659FD93)  # odd: its powers have inverses modulo 2 ** 64
INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))


class Codes:
    """Code points of several texts, one after the other. ``starts`` has each text's first position and the end."""

    def __init__(self, texts: pa.Array):
        data, begin, end = binary_rows(texts)
        low, high = (int(begin[0]), int(end[-1])) if len(begin) else (0, 0)
        self.bytes = data[low:high]
        lead = (self.bytes & 0xC0) != 0x80
        self.at = np.r_[np.flatnonzero(lead), len(self.bytes)]  # byte position of each code point
        count = np.r_[0, np.cumsum(lead)]
        self.starts = np.r_[count[begin - low], count[high - low]].astype(np.int64)
        self.codes = np.frombuffer(self.bytes.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)

    def slice(self, start: int, end: int) -> bytes:
        """UTF-8 of the code points from ``start`` to ``end``."""
        return self.bytes[self.at[start] : self.at[end]].tobytes()

    def first_of_text(self) -> np.ndarray:
        """Mask of the positions at which a text begins."""
        m = np.zeros(len(self.codes) + 1, bool)
        m[self.starts[:-1]] = True
        return m[:-1]


def text_chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, Codes]]:
    """Slices of the batches with the code points of their texts; nulls are empty texts."""
    for b in batches:
        if not b.num_rows:
            continue
        t = column(pa.Table.from_batches([b]), text)
        _, begin, end = binary_rows(t)
        size = np.cumsum(end - begin)
        s = 0
        while s < b.num_rows:
            base = size[s - 1] if s else 0
            e = max(s + 1, int(np.searchsorted(size, base + CHARS_A_CHUNK, side="right")))
            yield b.slice(s, e - s), Codes(t.slice(s, e - s))
            s = e


class Table:
    """A value for each code point, worked out when the code point is first met."""

    def __init__(self, of: Callable[[str], int], dtype: type = np.int32):
        self.of, self.values, self.known = of, np.zeros(0x110000, dtype), np.zeros(0x110000, bool)

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        if len(codes):
            top = int(codes.max()) + 1
            present = np.zeros(top, bool)
            present[codes] = True
            for c in np.flatnonzero(present & ~self.known[:top]):
                self.values[c] = self.of(chr(c))
            self.known[:top] |= present
        return self.values[codes]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all their bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15)
    return x ^ (x >> np.uint64(29))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of MULT and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHARS_A_CHUNK + 1)
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, m)]) for m in (MULT, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for many spans at once, from one running polynomial sum.

    Equal spans have equal hashes. Values and length go through ``mix``; for a
    million different words the chance of any collision is about 3e-8.
    """
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values) * up[:-1], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def uniques(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each hash among the different ones, these hashes, and where each occurs first."""
    import pandas as pd

    number, different = pd.factorize(hashes)
    seen = np.maximum.accumulate(number) if len(number) else number
    first = np.flatnonzero(np.r_[True, number[1:] > seen[:-1]]) if len(number) else number
    return number, different, first
