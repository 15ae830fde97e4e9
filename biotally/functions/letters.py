"""Arrow columns of sequences as arrays of letters, for passes over all texts of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = 1 << 22  # in a pass


def passes(batches: Iterator[pa.RecordBatch], column: str, most: int = LETTERS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` letters, or of one row where that has more."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte a letter of all texts, and the start and end of each text. Letters beyond ASCII become a question mark."""
    joined = b"".join(t.encode("ascii", "replace") for t in pc.fill_null(texts, "").to_pylist())
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    return np.frombuffer(joined, np.uint8), ends - lengths, ends


def inside(at: np.ndarray, k: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions whose next ``k`` letters are of one text, and the number of that text."""
    row = np.searchsorted(starts, at, side="right") - 1
    whole = at + k <= ends[row]
    return at[whole], row[whole]


def words(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` letters from each position on, a row each."""
    return np.lib.stride_tricks.sliding_window_view(data, k)[at] if len(at) else np.zeros((0, k), np.uint8)


def as_strings(rows: np.ndarray) -> pa.Array:
    """Rows of letters as strings of one length."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes()))
