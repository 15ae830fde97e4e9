"""Words of many texts at once: numpy passes over the UTF-8 bytes of an Arrow column, and Arrow task helpers.

A word is a run of bytes outside the six separators space and U+0009 to U+000D. All arrays of a chunk lie in one
task and cover ``CHUNK`` bytes, or one text if that is longer; nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
SEPARATORS = (9, 10, 11, 12, 13, 32)
WORD = r"[^\x20\x09-\x0D]+"

_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK + 2)
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = _BASE, pow(_BASE, -1, 1 << 64)
        if n > 8 * CHUNK:  # one very long text: not kept
            return np.cumprod(up), np.cumprod(down)
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


class Hashes:
    """64-bit hashes of any byte ranges of ``data``, from one running sum."""

    def __init__(self, data: np.ndarray):
        self._up, self._down = _power_table(len(data) + 1)
        self._sum = np.empty(len(data) + 1, np.uint64)
        self._sum[0] = 0
        np.cumsum(_LETTER[data] * self._up[: len(data)], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sum[end] - self._sum[start]) * self._down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Texts:
    """The bytes of the texts of one chunk and the words in them; ``doc`` is the row of each word in the chunk.

    ``lower`` folds A-Z, and with "latin" the accented capitals of Latin-1 too.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, separators: np.ndarray = _SEP, lower: bool | str = False):
        self.first, self.n = first, len(bounds) - 1
        self.bounds = bounds
        self.data = _LOWER[data] if lower else data
        if lower == "latin" and len(data) > 1:  # capitals of two bytes, U+00C0 to U+00DE without U+00D7
            capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            self.data[1:][capital] += 0x20
        inside = ~separators[self.data]
        edge = np.empty(len(data) + 1, bool)
        edge[:-1], edge[-1] = inside, False
        starts = edge.copy()
        starts[1:] &= ~edge[:-1]
        ends = np.zeros(len(data) + 1, bool)
        ends[1:] = edge[:-1] & ~edge[1:]
        cut = bounds[1:-1]  # texts lie side by side: a word never crosses a bound
        cut = cut[(cut > 0) & (cut < len(data))]
        both = cut[edge[cut] & edge[cut - 1]] if len(cut) else cut
        starts[both] = True
        ends[both] = True
        self.inside = inside
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        self.doc = np.searchsorted(bounds, self.start, side="right") - 1

    def per_doc(self, of_words: np.ndarray | None = None) -> np.ndarray:
        """Words of each text, or the sum of a value of its words."""
        return np.bincount(self.doc, of_words, self.n) if of_words is not None else np.bincount(self.doc, minlength=self.n)

    def byte_sums(self, flags: np.ndarray) -> np.ndarray:
        """How many of each text's bytes are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def chunks(column: pa.Array, separators: np.ndarray = _SEP, lower: bool | str = False, size: int = CHUNK) -> Iterator[Texts]:
    """Cut a text column into chunks of whole texts; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        hi = min(hi, len(column))
        yield Texts(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lo, separators, lower)
        lo = hi


def separators_but(keep: Callable[[int], bool]) -> np.ndarray:
    """A separator table: every byte below 128 that ``keep`` rejects parts words."""
    table = np.zeros(256, bool)
    table[:128] = [not keep(b) for b in range(128)]
    return table


def id_column(df: DataFrame, name: str) -> Column:
    """The column as long, null where the table lacks it."""
    return F.col(name).cast("long") if name in df.columns else F.lit(None).cast("long")


def text_column(df: DataFrame, name: str) -> Column:
    """The column as string, null where the table lacks it."""
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collected(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a small table, brought to the driver as Arrow: a row object for each row would take far more."""
    table = df.toArrow()
    return {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in table.column_names}
