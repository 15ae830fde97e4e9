"""Hairpins and dimers of short oligos, computed on Arrow batches with array operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_CODE = np.full(256, 4, dtype=np.int8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i  # complement of code c is 3 - c


def _matrix(words: pd.Series) -> np.ndarray:
    return _CODE[np.frombuffer("".join(words).encode(), dtype=np.uint8)].reshape(len(words), -1)


def _by_length(words: pd.Series, fn) -> pd.Series:
    out = np.zeros(len(words))
    lengths = words.str.len().to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        if n > 0:
            out[at] = fn(_matrix(words.iloc[at]))
    return pd.Series(out)


def _hairpin(m: np.ndarray) -> np.ndarray:
    """Longest inward run of paired bases from any (i, j >= i + 4); 1.5 per pair from three pairs on."""
    n = m.shape[1]
    best = np.zeros(len(m), dtype=np.int16)
    runs: dict[tuple[int, int], np.ndarray] = {}
    for gap in range(1, n):
        for i in range(n - gap):
            pair = (m[:, i] + m[:, i + gap]) == 3
            run = np.where(pair, 1 + runs.get((gap - 2, i + 1), 0), 0).astype(np.int16)
            runs[gap, i] = run
            if gap >= 4:
                best = np.maximum(best, run)
    return np.where(best >= 3, -1.5 * best, 0.0)


def _self_dimer(m: np.ndarray) -> np.ndarray:
    """Most matches of the oligo against its reverse complement over all offsets; 1 per pair from four on."""
    n = m.shape[1]
    other = 3 - m[:, ::-1]
    return _slide(m, other, range(-n + 3, n - 3))


def _slide(a: np.ndarray, b: np.ndarray, offsets) -> np.ndarray:
    best = np.zeros(len(a), dtype=np.int16)
    for off in offsets:
        lo, hi = max(0, off), min(a.shape[1], b.shape[1] + off)
        if hi > lo:
            best = np.maximum(best, (a[:, lo:hi] == b[:, lo - off : hi - off]).sum(axis=1, dtype=np.int16))
    return np.where(best >= 4, -1.0 * best, 0.0)


@pandas_udf(DoubleType())
def best_hairpin(words: pd.Series) -> pd.Series:
    return _by_length(words, _hairpin)


@pandas_udf(DoubleType())
def best_self_dimer(words: pd.Series) -> pd.Series:
    return _by_length(words, _self_dimer)


@pandas_udf(DoubleType())
def best_cross_dimer(fwd: pd.Series, rev: pd.Series) -> pd.Series:
    """Most complementary pairs of the two oligos over all offsets; 1 per pair from four on."""
    out = np.zeros(len(fwd))
    lf, lr = fwd.str.len().to_numpy(), rev.str.len().to_numpy()
    for nf, nr in {*zip(lf, lr)}:
        at = np.flatnonzero((lf == nf) & (lr == nr))
        out[at] = _slide(_matrix(fwd.iloc[at]), 3 - _matrix(rev.iloc[at]), range(-nf + 3, nr - 3))
    return pd.Series(out)
