"""Little-endian fields of binary columns, read and written for all rows of an Arrow batch at once.

A column's bytes are one buffer with an offset for each row, so a field is the same few bytes at each row's start plus
its place there: places and values are arrays, and no row is looked at by itself. Columns keep their lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Records:
    """The rows of a binary column, null as empty, open to changes in place."""

    def __init__(self, column: pa.Array):
        lengths = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64) if column.null_count else np.diff(_offsets(column))
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.lengths = lengths
        if column.null_count:
            self.bytes = np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), np.uint8).copy()
        else:
            at = _offsets(column)
            self.bytes = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].copy()

    def __len__(self) -> int:
        return len(self.lengths)

    def _places(self, at, width: int, rows: np.ndarray | None) -> np.ndarray:
        rows = np.arange(len(self)) if rows is None else np.flatnonzero(rows)
        at = np.broadcast_to(at, len(self))[rows]
        if ((at < 0) | (at + width > self.lengths[rows])).any():
            raise ValueError(f"a field of {width} bytes lies outside its record")
        return (self.starts[rows] + at)[:, None] + np.arange(width)

    def get(self, at, width: int, rows: np.ndarray | None = None) -> np.ndarray:
        """The field at a place, one for all rows or one for each, of the rows that a mask picks."""
        return (self.bytes[self._places(at, width, rows)].astype(np.uint64) << (np.arange(width, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)

    def put(self, at, width: int, values, rows: np.ndarray | None = None) -> None:
        """values, one for all rows or one for each, written where the mask holds. They must fit the field."""
        chosen = np.broadcast_to(values, len(self)) if rows is None else np.broadcast_to(values, len(self))[rows]
        chosen = chosen.astype(np.int64) if chosen.dtype.kind != "u" else chosen
        if len(chosen) and (chosen.min() < 0 or width < 8 and int(chosen.max()) >> (8 * width)):
            raise ValueError(f"a value doesn't fit {width} bytes")
        self.bytes[self._places(at, width, rows)] = (chosen.astype(np.uint64)[:, None] >> (np.arange(width, dtype=np.uint64) * np.uint64(8))) & np.uint64(255)

    def clear(self, lo, hi, rows: np.ndarray | None = None) -> None:
        """Zeros from lo up to hi in each row."""
        rows = np.arange(len(self)) if rows is None else np.flatnonzero(rows)
        lo, hi = (np.minimum(np.broadcast_to(x, len(self))[rows], self.lengths[rows]) for x in (lo, hi))
        size = np.maximum(hi - lo, 0)
        at = np.repeat(self.starts[rows] + lo - (np.cumsum(size) - size), size)
        self.bytes[at + np.arange(len(at))] = 0

    def column(self) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(self.starts.astype(np.int32).tobytes()), pa.py_buffer(self.bytes.tobytes())])

    def find(self, pattern: bytes) -> np.ndarray:
        """Where the pattern first stands in each row, -1 where it doesn't."""
        n = len(self.bytes) - len(pattern) + 1
        hit = np.ones(max(n, 0), bool)
        for i, b in enumerate(pattern):
            hit &= self.bytes[i : n + i] == b
        at = np.flatnonzero(hit)
        first = np.searchsorted(at, self.starts[:-1])
        place = np.append(at, np.iinfo(np.int64).max)[first]
        return np.where(place + len(pattern) <= self.starts[1:], place - self.starts[:-1], -1)


def _offsets(column: pa.Array) -> np.ndarray:
    if pa.types.is_large_binary(column.type):
        raise TypeError("records are columns of binary")
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
