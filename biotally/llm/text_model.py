"""Hashed text features, their screening against labels, and linear models on the screened ones.

A model is learnt from about ``FIT_ROWS`` labelled rows, all if there are fewer: those whose ids have the smallest
hashes. Their labels are few enough to go to every task, so no text is shuffled to meet its label. A feature is
present in a document or not; presence is counted by label, and the ``MAX_FEATURES`` most telling buckets go into the
model. Scoring reads every text once. What leaves the tasks is bounded by ``BUCKETS`` and ``FIT_ROWS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotally.llm.words import Hashes, Texts, collected, mix

BUCKETS = 1 << 20
MAX_FEATURES = 2000
FIT_ROWS = 20000
LEAST_SIGNAL = 12.0  # twice the log likelihood ratio that a feature needs, about 3.5 standard deviations

# (document in the chunk, bucket) pairs of a text column's chunk, repeats allowed
Featuriser = Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]


def bucket(hashes: np.ndarray, family: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(family * 0x5851F42D4C957F2D & (1 << 64) - 1)) >> np.uint64(44)).astype(np.int64)


def word_features(t: Texts, hashes: Hashes, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whole words, and the first bytes of longer words."""
    doc, found = [t.doc], [bucket(hashes.of(t.start, t.end), 1)]
    for k in prefixes:
        long = t.end - t.start > k
        s = t.start[long]
        doc.append(t.doc[long])
        found.append(bucket(hashes.of(s, s + k), 1 + k))
    return np.concatenate(doc), np.concatenate(found)


def _distinct(doc: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(doc * BUCKETS + found)
    return pairs // BUCKETS, pairs % BUCKETS


def fit_row(doc_id: Column) -> Column:
    """Whether labels of a row may be learnt: crc32 of its id as text, mod 5, is not 0. Null ids are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: Column, limit: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, label) of about ``limit`` rows that may be learnt; an id with several labels has its largest."""
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), label.cast("int").alias("label")).where(F.col("_id").isNotNull() & F.col("label").isNotNull() & fit_row(F.col("_id")))
    marks = marks.groupBy("_id").agg(F.max("label").alias("label"))
    share = int((1 << 30) * min(1.0, limit / max(marks.count(), 1)))
    few = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share)
    return docs.join(F.broadcast(few), docs["doc_id"] == few["_id"]).select("doc_id", "text", "label")


def presence(rows: DataFrame, featurise: Featuriser, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class, and of each class with each bucket: (classes,), (classes, BUCKETS)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, hits = np.zeros(classes, np.int64), np.zeros(classes * BUCKETS, np.int32)
        for b in batches:
            y = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            docs += np.bincount(y, minlength=classes)
            for first, n, doc, found in featurise(b.column("text")):
                doc, found = _distinct(doc, found)
                hits += np.bincount(y[first : first + n][doc] * BUCKETS + found, minlength=classes * BUCKETS).astype(np.int32)
        at = np.flatnonzero(hits)
        key, n = np.concatenate((at, -1 - np.arange(classes))), np.concatenate((hits[at].astype(np.int64), docs))
        for lo in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + (1 << 16)]), pa.array(n[lo : lo + (1 << 16)])], names=["key", "n"])

    total = collected(rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    key, n = total["key"], total["n"]
    docs, hits = np.zeros(classes, np.int64), np.zeros(classes * BUCKETS, np.int64)
    docs[-1 - key[key < 0]] = n[key < 0]
    hits[key[key >= 0]] = n[key >= 0]
    return docs, hits.reshape(classes, BUCKETS)


def screen(docs: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The buckets whose presence tells most about the class, by the likelihood ratio of their counts."""
    n, have = docs.sum(), hits.sum(axis=0)
    if not n:
        return np.zeros(0, np.int64)

    def part(k: np.ndarray, of: np.ndarray | int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(k > 0, k * np.log(k / of), 0.0)
            return a + np.where(of - k > 0, (of - k) * np.log((of - k) / of), 0.0)

    gain = -2 * part(have, n)
    for c in range(len(docs)):
        gain += 2 * part(hits[c], docs[c]) if docs[c] else 0
    order = np.lexsort((np.arange(BUCKETS), -np.round(gain, 6)))[:MAX_FEATURES]
    return np.sort(order[gain[order] >= LEAST_SIGNAL])


def design(rows: DataFrame, featurise: Featuriser, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The labels of the rows, and the (row, feature) pairs in them."""
    slot = np.full(BUCKETS, -1, np.int32)
    slot[features] = np.arange(len(features), dtype=np.int32)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists: list[np.ndarray] = []
            for _, n, doc, found in featurise(b.column("text")):
                s = slot[found]
                d, s = _distinct(doc[s >= 0], s[s >= 0].astype(np.int64))
                cuts = np.searchsorted(d, np.arange(n + 1))
                lists.extend(s[a:z] for a, z in zip(cuts, cuts[1:], strict=False))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "label", "held"])

    got = collected(rows.mapInArrow(held, "doc_id long, label int, held array<long>"))
    order = np.argsort(got["doc_id"], kind="stable")
    held_by = [got["held"][k] for k in order]
    y = got["label"][order].astype(np.int64)
    row = np.repeat(np.arange(len(y)), [len(h) for h in held_by])
    return y, row, np.concatenate([np.asarray(h, np.int64) for h in held_by]) if len(row) else np.zeros(0, np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Full-batch Adam with a falling step."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return x


def linear_scores(text: pa.Array, featurise: Featuriser, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of each text's features, each counted once. ``weights`` has one value a bucket."""
    out = np.zeros(len(text))
    for first, n, doc, found in featurise(text):
        hit = weights[found] != 0
        d, f = _distinct(doc[hit], found[hit])
        out[first : first + n] = np.bincount(d, weights[f], n)
    return out
