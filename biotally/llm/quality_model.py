"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k | text) = sigmoid(w . x - t_k) with one weight vector w on hashed text features shared by all grades and
ordered thresholds t_1 < t_2 < ... The model gives the expected grade and the tail probability of a grade, by which
documents are selected. The features are words, their beginnings, the shapes of tokens, and bins of text statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotally.llm import text_model as M
from biotally.llm.words import _LOWER, Hashes, Texts, chunks, id_column, mix, text_column

GRADES = 3
RIDGE = 2.0  # penalty on the weights, in documents
SELECT_GRADE, SELECT_AT = 1, 0.5

_KIND = np.zeros(256, np.int64)  # letters 0, capitals 1, digits 2, any other byte its own
_KIND[:128] = np.arange(128) + 3
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_MARK = np.array([not (chr(b).isalnum() or b >= 128 or b in (9, 10, 11, 12, 13, 32)) for b in range(256)])


def grade(labels: DataFrame) -> Column:
    """Graded rating of a labelled row: 0 low quality, 1 good but toxic, 2 good. Null quality: no rating."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))


def _statistics(t: Texts, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Binned statistics of each text, as features."""
    words = np.maximum(t.per_doc(), 1)
    size = np.maximum(t.bounds[1:] - t.bounds[:-1], 1)
    w = hashes.of(t.start, t.end) ^ mix(t.doc.astype(np.uint64))
    distinct = np.bincount(t.doc[np.unique(w, return_index=True)[1]], minlength=t.n) if len(w) else np.zeros(t.n)
    upper = t.byte_sums((t.data >= 65) & (t.data <= 90))
    marks = t.byte_sums(_MARK[t.data])
    digits = t.byte_sums((t.data >= 48) & (t.data <= 57))
    letters = np.bincount(t.doc, t.end - t.start, t.n)
    bins = [np.log(words) * 2, 20 * upper / size, 8 * marks / words, 40 * digits / size, 10 * distinct / words, letters / words]
    ids = [np.uint64(1000 * (k + 1)) + np.minimum(np.floor(b), 99).astype(np.uint64) for k, b in enumerate(bins)]
    return np.tile(np.arange(t.n), len(ids)), M.bucket(np.concatenate(ids) if t.n else np.zeros(0, np.uint64), 40)


def featurise(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for t in chunks(text):
        hashes = Hashes(_LOWER[t.data])
        doc, found = M.word_features(t, hashes, (4,))
        last = np.maximum(t.end - 1, 0)
        shape = _KIND[t.data[t.start]] * 1000003 + _KIND[t.data[last]] * 1009 + np.minimum(t.end - t.start, 3) if len(t.start) else np.zeros(0, np.int64)
        stat_doc, stat = _statistics(t, hashes)
        yield t.first, t.n, np.concatenate((doc, t.doc, stat_doc)), np.concatenate((found, M.bucket(shape.astype(np.uint64), 41), stat))


def fit_cumulative(y: np.ndarray, row: np.ndarray, col: np.ndarray, n_features: int, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by maximum penalised likelihood."""
    n, cuts = len(y), grades - 1
    share = np.array([(y >= k).mean() if n else 0.5 for k in range(1, grades)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 0.05))

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.concatenate((p[:1], p[0] + np.cumsum(np.exp(p[1:cuts]))))

    def gradient(p: np.ndarray) -> np.ndarray:
        w, t = p[cuts:], thresholds(p)
        score = np.bincount(row, w[col], n)
        upper = np.concatenate((np.full((n, 1), 1.0), M.sigmoid(score[:, None] - t)), axis=1)  # P(grade >= k), k = 0 .. grades - 1
        lower = np.concatenate((upper[:, 1:], np.zeros((n, 1))), axis=1)
        at = np.arange(n)
        a, b = upper[at, y], lower[at, y]
        p_y = np.maximum(a - b, 1e-12)
        da, db = np.where(y > 0, a * (1 - a), 0) / p_y, np.where(y < grades - 1, b * (1 - b), 0) / p_y
        by_score = -(da - db)
        by_t = np.bincount(y, da, grades)[1:] - np.bincount(y, db, grades)[:-1]
        out = np.empty_like(p)
        out[0] = by_t.sum()
        for k in range(1, cuts):
            out[k] = by_t[k:].sum() * np.exp(p[k])
        out[cuts:] = np.bincount(col, by_score[row], n_features) + RIDGE * w
        return out / max(n, 1)

    p = M.adam(gradient, np.concatenate((first[:1], gaps, np.zeros(n_features))))
    return p[cuts:], thresholds(p)


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, p_grade_1, p_grade_2 (tail probabilities), grade and selected, one row per row.

    Learns from rows of ``labels`` (doc_id, quality, toxic) with crc32(doc_id) mod 5 not 0; held_out marks the others.
    Without any label the prior 0.5 at each threshold is given. Null or blank text is scored by its statistics;
    repeated rows are scored alike; other columns are not read.
    """
    base = docs.select(id_column(docs, "doc_id").alias("doc_id"), text_column(docs, "text").alias("text"))
    rows = M.labelled(base, labels, grade(labels))
    counts, hits = M.presence(rows, featurise, GRADES)
    features = M.screen(counts, hits)
    y, row, col = M.design(rows, featurise, features)
    w, t = fit_cumulative(y, row, col, len(features)) if len(y) else (np.zeros(len(features)), np.arange(GRADES - 1) * 1e-3)
    weights = np.zeros(M.BUCKETS, np.float32)
    weights[features] = w
    at = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS values, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tail = M.sigmoid(M.linear_scores(b.column("text"), featurise, at.value)[:, None] - t)
            expected = tail.sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(expected), *(pa.array(tail[:, k]) for k in range(GRADES - 1)), pa.array(np.rint(expected).astype(np.int32)), pa.array(tail[:, SELECT_GRADE - 1] >= SELECT_AT)], names=["doc_id", "expected_grade", "p_grade_1", "p_grade_2", "grade", "selected"])

    scored = base.mapInArrow(score, "doc_id long, expected_grade double, p_grade_1 double, p_grade_2 double, grade int, selected boolean")
    return scored.withColumn("held_out", ~M.fit_row(F.col("doc_id")))
