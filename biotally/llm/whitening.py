"""Whitening of embeddings from exact cross-products, counted on bit planes.

Entries become whole numbers; less the smallest of its dimension, each is some bits wide. A task packs every bit of every
dimension, across rows, into 64-bit words: the AND of two planes has as many ones as there are rows with both bits, and
those counts, weighted by the powers of two of their planes, are the cross-products. They are added as limbs of 40 bits,
so nothing rounds, centred as integers, and only then divided and given to the eigensolver, one task a vector length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotally.llm.vectors import finite

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LIMB = 40  # sums of limbs stay below 2^63 over 2^23 tasks
ROWS = 8192  # rows whose planes a task holds at once
MODEL_BYTES = 256 << 20  # what the models of all vector lengths may take in a task


def whole_numbers(vector: str | Column) -> Column:
    """floor(64 c) + 1,000,000 of each entry; entries beyond a long's range make the array null."""
    scaled = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE))
    fits = F.forall(vector, lambda v: F.abs(v.cast("double")) < 2.0**55)
    return F.when(fits, F.transform(scaled, lambda v: v + F.lit(SHIFT).cast("long")))


def _integers(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def plane_counts(y: np.ndarray, width: int) -> np.ndarray:
    """(d*width, d*width) rows that have both bits; plane k of dimension i is at i * width + k. ``y`` is unsigned."""
    n, d = y.shape
    padded = np.zeros((d, -(-n // 64) * 64), np.uint64)
    padded[:, :n] = y.T
    planes = np.empty((d, width, padded.shape[1] // 64), np.uint64)
    for k in range(width):
        bits = ((padded >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)
        planes[:, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    planes = planes.reshape(d * width, -1)
    out = np.zeros((d * width, d * width), np.int64)
    for a in range(d * width):
        out[a, a:] = np.bitwise_count(planes[a] & planes[a:]).sum(axis=1, dtype=np.int64)
    return out


def _limbs(value: int) -> list[int]:
    out = []
    while value:
        out.append(value & (1 << LIMB) - 1)
        value >>= LIMB
    return out


def _folded(counts: np.ndarray, d: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, sum over planes of 2^(p+q) counts) for i <= j, and (i, -1, sum of dimension i)."""
    four = counts.reshape(d, width, d, width)
    by_weight = np.zeros((2 * width - 1, d, d), np.int64)
    for p in range(width):
        for q in range(width):
            by_weight[p + q] += four[:, p, :, q]
    # Planes of one dimension were counted in one order only; the other order is the same count.
    own = np.arange(d)
    for p in range(width):
        for q in range(p + 1, width):
            by_weight[p + q, own, own] += four[own, p, own, q]
    for i in range(d):
        yield i, -1, sum(int(four[i, p, i, p]) << p for p in range(width))
        for j in range(i, d):
            yield i, j, sum(int(c) << w for w, c in enumerate(by_weight[:, i, j].tolist()))


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, i, least, most, n) of the task's rows."""
    seen: dict[int, list] = {}
    for b in batches:
        lengths = b.column("d").to_numpy()
        for d in np.unique(lengths):
            x = _integers(b.column("x").filter(pa.array(lengths == d)))
            if not d:
                continue
            s = seen.setdefault(int(d), [x.min(axis=0), x.max(axis=0), 0])
            s[0], s[1], s[2] = np.minimum(s[0], x.min(axis=0)), np.maximum(s[1], x.max(axis=0)), s[2] + len(x)
    for d, (least, most, n) in seen.items():
        yield pa.RecordBatch.from_pydict({"d": np.full(d, d, np.int32), "i": np.arange(d, dtype=np.int32), "least": least, "most": most, "n": np.full(d, n, np.int64)})


@dataclass
class Range:
    """A vector length's smallest entries, the bits that cover its widest dimension, and its rows."""

    least: np.ndarray
    width: int
    n: int


def _ranges(whole: DataFrame) -> dict[int, Range]:
    """A row a dimension comes to the driver, not one a vector."""
    rows = whole.mapInArrow(_least, "d int, i int, least long, most long, n long").groupBy("d", "i").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))
    out = {}
    for d, group in rows.toPandas().groupby("d"):
        group = group.sort_values("i")
        least, most = group["least"].to_numpy(np.int64), group["most"].to_numpy(np.int64)
        width = max(1, max((int(b) - int(a)).bit_length() for a, b in zip(least, most, strict=True)))
        out[int(d)] = Range(least, width, int(group["n"].iloc[0]))
    return out


def cross_products(whole: DataFrame, ranges: dict[int, Range]) -> DataFrame:
    """(d, i, j, limb, part): sums over all rows of the products of dimensions i <= j less their smallest entries; j is -1 for plain sums."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}

        def flush(d: int) -> None:
            held = np.concatenate(waiting.pop(d))
            r = ranges[d]
            for a in range(0, len(held), ROWS):
                y = (held[a : a + ROWS].view(np.uint64) - r.least.view(np.uint64)).reshape(-1, d)
                c = plane_counts(y, r.width)
                totals[d] = totals[d] + c if d in totals else c

        for b in batches:
            lengths = b.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                if not d:
                    continue
                waiting.setdefault(d, []).append(np.ascontiguousarray(_integers(b.column("x").filter(pa.array(lengths == d)))))
                if sum(map(len, waiting[d])) >= ROWS:
                    flush(d)
        for d in list(waiting):
            flush(d)
        for d, counts in totals.items():
            rows = [(d, i, j, k, part) for i, j, value in _folded(counts, d, ranges[d].width) for k, part in enumerate(_limbs(value) or [0])]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns[:4]] + [pa.array(columns[4], pa.int64())], names=["d", "i", "j", "limb", "part"])

    parts = whole.mapInArrow(counted, "d int, i int, j int, limb int, part long")
    return parts.groupBy("d", "i", "j", "limb").agg(F.sum("part").alias("part"))


@dataclass
class Model:
    """Of one vector length: rows, exact sums of x, eigenvalues by falling size, unit vectors as columns, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def solve(d: int, r: Range, parts: pd.DataFrame, components: int) -> Model:
    """Centres the cross-products as integers, divides, and solves."""
    total: dict[tuple[int, int], int] = {}
    for i, j, limb, part in zip(parts["i"].tolist(), parts["j"].tolist(), parts["limb"].tolist(), parts["part"].tolist(), strict=True):
        total[i, j] = total.get((i, j), 0) + (part << LIMB * limb)
    low = [total.get((i, -1), 0) for i in range(d)]
    v = np.zeros((d, d))
    trace, square = Fraction(0), r.n * r.n
    for i in range(d):
        for j in range(i, d):
            top = r.n * total.get((i, j), 0) - low[i] * low[j]
            v[i, j] = v[j, i] = top / square
            if i == j:
                trace += Fraction(top, square)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    # Either sign would do: the largest entry of a vector is positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    sums = [s + r.n * int(least) for s, least in zip(low, r.least.tolist(), strict=True)]
    return Model(r.n, sums, values, vectors, float(trace))


def fit(whole: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each vector length of (d, x); the eigensolver runs in tasks, and ``components`` vectors a length come back."""
    ranges = _ranges(whole)
    if sum(16 * d * d for d in ranges) > MODEL_BYTES:
        raise ValueError(f"models of these vector lengths would take over {MODEL_BYTES} bytes: {sorted(ranges)}")

    def solved(keys: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        d = int(keys[0])
        m = solve(d, ranges[d], parts, components)
        return pd.DataFrame({"d": [d], "sums": [[str(s) for s in m.sums]], "eigenvalues": [m.values.tolist()], "flat": [m.vectors.reshape(-1).tolist()], "trace": [m.trace]})

    rows = cross_products(whole, ranges).groupBy("d").applyInPandas(solved, "d int, sums array<string>, eigenvalues array<double>, flat array<double>, trace double").collect()
    out = {}
    for row in rows:
        values = np.array(row["eigenvalues"])
        out[row["d"]] = Model(ranges[row["d"]].n, [int(s) for s in row["sums"]], values, np.array(row["flat"]).reshape(row["d"], len(values)), row["trace"])
    return out


def _from_centre(x: np.ndarray, m: Model) -> tuple[np.ndarray, list[int]]:
    """(x - S/n in double precision, exact sum of (n x - S)^2) of each row."""
    reach = max((abs(m.n * int(v) - s) for e in (x.min(axis=0), x.max(axis=0)) for v, s in zip(e.tolist(), m.sums, strict=True)), default=0)
    small = reach * reach * max(1, x.shape[1]) < 1 << 62 and m.n * max(1, int(np.abs(x).max(initial=0))) < 1 << 62 and all(abs(s) < 1 << 62 for s in m.sums)
    kind = np.int64 if small else object
    off = m.n * x.astype(kind) - np.array(m.sums, dtype=kind)
    squares = (off * off).sum(axis=1)
    return off.astype(np.float64) / m.n, [int(s) for s in squares]


def _whitened(x: np.ndarray, m: Model) -> tuple[np.ndarray, list[int]]:
    centred, squares = _from_centre(x, m)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m.values > 0, centred @ m.vectors / np.sqrt(m.values), np.nan), squares


def _spread_of(batches: Iterator[pa.RecordBatch], models: dict[int, Model]) -> Iterator[pa.RecordBatch]:
    """(d, i, j, s) sums of the products of whitened values, one row a pair of components."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        lengths = b.column("d").to_numpy()
        for d in np.unique(lengths).tolist():
            if d:
                w, _ = _whitened(_integers(b.column("x").filter(pa.array(lengths == d))), models[d])
                sums[d] = sums.get(d, 0) + w.T @ w
    for d, s in sums.items():
        i, j = np.indices(s.shape)
        yield pa.RecordBatch.from_pydict({"d": np.full(s.size, d, np.int32), "i": i.reshape(-1).astype(np.int32), "j": j.reshape(-1).astype(np.int32), "s": s.reshape(-1)})


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each kept vector and component.

    Rows whose vector is null, or holds null or non-finite entries or ones of 2^55 and more, are dropped; empty vectors
    have no component. Vectors of different lengths are fitted apart. Components without variance have null ``whitened``
    and take no part in identity_error, which is measured on the values returned, over all of a length's rows; one vector
    alone has no variance at all. deviation beyond 38 digits is null. Repeated rows and ids are rows of their own; null
    ids stay null. An empty table gives no rows. Other columns are not read.
    """
    good = vectors.where(finite(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(vector_col).alias("x"))
    good = good.where("x is not null").withColumn("d", F.size("x"))
    whole = good.select("d", "x")
    models = fit(whole, components)

    def spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _spread_of(batches, models)

    errors: dict[int, float] = {}
    for d, group in whole.mapInArrow(spreads, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas().groupby("d"):
        live = models[d].values > 0
        full = np.zeros((len(live), len(live)))
        full[group["i"], group["j"]] = group["s"] / models[d].n
        own = full[np.ix_(live, live)] - np.eye(int(live.sum()))
        errors[d] = float(np.abs(own).max(initial=0.0))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                if not d:
                    continue
                here = pa.array(lengths == d)
                m = models[d]
                w, squares = _whitened(_integers(b.column("x").filter(here)), m)
                n, k = w.shape
                explained = m.values / m.trace if m.trace else np.full(k, np.nan)
                each = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").filter(here).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, m.n, np.int64)),
                        pa.array([str(s) if s < 10**38 else None for s in squares], pa.string()).take(each),
                        pa.array(w.reshape(-1), from_pandas=True),
                        pa.array(np.tile(explained, n), from_pandas=True),
                        pa.array(np.full(n * k, errors[d])),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    out = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"
    return good.mapInArrow(projected, out).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
