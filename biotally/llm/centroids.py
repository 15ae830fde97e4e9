"""Centroid clustering of whole-number vectors with Orchard's search, exact at every step.

Each centroid has a list of the others by distance from it. A vector walks its centroid's list: the first one that is
closer (or as close with a smaller number) becomes its centroid, and the walk goes on in that one's list, past those it
has measured already; it ends at the first entry strictly beyond twice the vector's own distance, as none after that can
be as close. All vectors of a batch walk in step. Sums and counts are added by Spark; a round brings one row a centroid
and dimension to the driver, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biotally.llm.vectors import finite
from biotally.session import cut_lineage

LENGTH, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
EXACT = 1 << 28  # entries below this have squared distances within a long; larger ones are Python integers


def _integers(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=-1)


def orchard(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number), squared distance, and how many distances were measured."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) >= EXACT:
        x, centroids = x.astype(object), centroids.astype(object)
    n, k = len(x), len(centroids)
    apart = _squared(centroids[:, None], centroids[None])
    # A list starts with its centroid; equal distances in order of number.
    order = np.array([sorted((j for j in range(k) if j != i), key=lambda j, i=i: (apart[i, j], j)) for i in range(k)], np.int64).reshape(k, k - 1)
    own = np.zeros(n, np.int64)
    best = _squared(x, centroids[0])
    marked = np.zeros((n, k), bool)
    marked[:, 0] = True
    at = np.zeros(n, np.int64)
    active, measured = np.arange(n), n
    while k > 1 and len(active):
        candidate = order[own[active], at[active]]
        go = (apart[own[active], candidate] <= 4 * best[active]).astype(bool)
        active, candidate = active[go], candidate[go]
        new = ~marked[active, candidate]
        rows, to = active[new], candidate[new]
        marked[rows, to] = True
        far = _squared(x[rows], centroids[to])
        measured += len(rows)
        at[active] += 1
        closer = ((far < best[rows]) | ((far == best[rows]) & (to < own[rows]))).astype(bool)
        jump = rows[closer]
        own[jump], best[jump], at[jump] = to[closer], far[closer], 0
        active = active[at[active] < k - 1]
    return own, best, measured


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cluster, i, total, n): the task's sums by centroid and dimension, as decimal text."""
    k, d = centroids.shape
    totals, counts = np.zeros((k, d), object), np.zeros(k, np.int64)
    for b in batches:
        x = _integers(b.column("x"), d)
        if not len(x):
            continue
        own, _, _ = orchard(x, centroids)
        counts += np.bincount(own, minlength=k)
        wide = int(np.abs(x).max()) * len(x) >= 1 << 62
        for c in np.unique(own).tolist():
            part = x[own == c]
            totals[c] += (part.astype(object) if wide else part).sum(axis=0).astype(object)
    for c in np.flatnonzero(counts).tolist():
        yield pa.RecordBatch.from_pydict({"cluster": np.full(d, c, np.int32), "i": np.arange(d, dtype=np.int32), "total": pa.array([str(int(v)) for v in totals[c]], pa.string()), "n": np.full(d, counts[c], np.int64)})


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, salt: str = "1:") -> np.ndarray:
    """The vectors whose ids hash lowest, by hash and then by vector; null ids come last."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = kept.select("x", digest.alias("digest")).orderBy(F.col("digest").asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.int64)


def refined(kept: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds``: each the floor of the mean of its vectors; those without a vector stay."""
    centroids = centroids.copy()
    for _ in range(rounds):
        now = centroids.copy()

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            return _sums(batches, now)

        parts = kept.select("x").mapInArrow(sums, "cluster int, i int, total string, n long")
        for r in parts.groupBy("cluster", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            centroids[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
    return centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, one row per kept vector.

    Kept are vectors with exactly ``length`` entries, none of them null, non-finite or of 2^47 and more. Fewer kept
    vectors than ``clusters`` start as many clusters. Repeated rows and ids are vectors of their own; null ids stay null
    and start no cluster while others can. Squared distances or inertia beyond a long are null. An empty table gives no
    rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    good = finite(vector_col) & (F.size(vector_col) == length) & F.coalesce(F.forall(vector_col, lambda v: F.abs(v.cast("double")) < 2.0**47), F.lit(False))
    kept = vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda v: F.floor(v.cast("double") * SCALE)).alias("x"))
    centroids = first_centroids(kept, clusters)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    centroids = refined(kept, centroids, rounds)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, far, _ = orchard(_integers(b.column("x"), length), centroids) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own.astype(np.int32)), pa.array([str(v) for v in far.tolist()], pa.string())], names=["vec_id", "cluster", "far"])

    placed = cut_lineage(kept.mapInArrow(assigned, "vec_id long, cluster int, far string").withColumn("far", F.col("far").cast("decimal(38,0)")))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    inertia = placed.groupBy("cluster").agg(F.sum("far").alias("cluster_inertia")).withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    inertia = inertia.withColumnRenamed("cluster", "c").withColumn("centroid_sha256", F.array(*map(F.lit, digests))[F.col("c")])
    rows = placed.join(F.broadcast(inertia), F.col("cluster") == F.col("c"))  # one row a centroid
    longs = [F.expr(f"try_cast({c} as long)").alias(name) for c, name in (("far", "distance"), ("cluster_inertia", "cluster_inertia"), ("inertia", "inertia"))]
    return rows.select("vec_id", "cluster", *longs, "centroid_sha256")
