"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Counts of every text become a vector of five transformed statistics. For each group of one language and source the
minimum covariance determinant is approached by concentration steps: distances to the present centre and scatter,
the closest ``COVERAGE`` of the group, its mean and covariance, and again. A last reweighted estimate gives the
Mahalanobis distances that decide. Each step reads the small statistics table once and sums moments per group and
distance bin, so a group of any size spreads over all tasks and only (group, bin) sums move.

Defined cases: null or blank text has no words and fails the base rules; groups under ``MIN_GROUP`` rows pool by
language, then all together, and a pool still below it rejects nothing; repeated rows count as often as they occur;
null language and source are groups of their own; extra columns are ignored by ``quality_rules``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biotally.llm.words import Hashes, chunks, id_column, mix, text_column
from biotally.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

COVERAGE = 0.75  # share of a group that the determinant is minimised over
STEPS = 5  # concentration steps
MIN_GROUP = 60
KEEP, REJECT = 0.975, 0.999999  # chi-square levels of the reweighting and of the verdict
UNIT = 1024  # statistics are whole numbers of 1/UNIT: their sums do not depend on the order of addition
# Smallest standard deviations that count: words (log), characters a word (log), symbols a word (log), repeated lines, repeated words (shares).
FLOORS = (1.2, 0.25, 0.06, 0.12, 0.1)
P = len(FLOORS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_BIN = 16  # bins of squared distance to an octave

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Values that occur twice or more."""
    s = np.sort(keys)
    return np.unique(s[1:][s[1:] == s[:-1]])


def _counts(text: pa.Array) -> dict[str, np.ndarray]:
    found: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
    for t in chunks(text):
        hashes = Hashes(t.data)
        words = t.per_doc()
        starts_point = (t.data & 0xC0) != 0x80
        found["n_words"].append(words)
        found["word_chars"].append(t.byte_sums(starts_point & t.inside))
        found["n_symbols"].append(t.byte_sums(_IS_SYMBOL[t.data]))

        # Lines with a word; a text's end closes its last line.
        salt = mix(np.arange(1, t.n + 1, dtype=np.uint64))
        ends = np.union1d(np.flatnonzero(t.data == 10), t.bounds[1:])
        ends = ends[np.searchsorted(t.start, ends) > 0] if len(ends) else ends
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        begins = np.where((begins < len(t.data)) & (t.data[np.minimum(begins, max(len(t.data) - 1, 0))] == 10) if len(t.data) else False, begins + 1, begins)
        doc = np.searchsorted(t.bounds, begins, side="right") - 1
        begins = np.maximum(begins, t.bounds[np.clip(doc, 0, t.n)])
        worded = np.searchsorted(t.start, ends) > np.searchsorted(t.start, begins)
        begins, ends, doc = begins[worded], ends[worded], doc[worded]
        found["n_lines"].append(np.bincount(doc, minlength=t.n))
        key = hashes.of(begins, ends) ^ salt[doc]
        order = np.argsort(key, kind="stable")
        again = order[1:][key[order][1:] == key[order][:-1]]
        found["n_dup_lines"].append(np.bincount(doc[again], minlength=t.n))

        covered = np.zeros(len(t.start) + 1, np.int64)
        if len(t.start) >= WINDOW:
            w = hashes.of(t.start, t.end)
            last = len(w) - WINDOW + 1
            key = np.zeros(last, np.uint64)
            for k in range(WINDOW):
                key = key * np.uint64(0x9E3779B97F4A7C15) + w[k : k + last]
            same = t.doc[:last] == t.doc[WINDOW - 1 :]
            at = np.flatnonzero(same)
            key = mix(key[at]) ^ salt[t.doc[at]]
            twice = _repeats(key)
            if len(twice):
                found_at = np.searchsorted(twice, key)
                hit = at[twice[np.minimum(found_at, len(twice) - 1)] == key]
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + WINDOW, -1)
        inside = np.cumsum(covered)[:-1] > 0
        found["n_repeat_words"].append(np.bincount(t.doc[inside], minlength=t.n))
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in found.items()}


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, language, source and the counts of its whole text."""
    base = docs.select(id_column(docs, id_col).alias("doc_id"), text_column(docs, lang_col).alias("lang"), text_column(docs, source_col).alias("source"), text_column(docs, text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _counts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(c[k]) for k in COUNTS)], names=["doc_id", "lang", "source", *COUNTS])

    return base.mapInArrow(count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, term, total, n = k / 2, 2 / k, 2 / k, 0
    while term > 1e-16 * total:
        n += 1
        term *= x / 2 / (a + n)
        total += term
    return min(1.0, total * math.exp(-x / 2 + a * math.log(x / 2) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 500.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """Scales the covariance of the closest ``share`` of normal data to that of all."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    raw = [
        F.log1p(F.col("n_words")),
        F.log1p(F.col("word_chars") / words),
        F.log1p(F.col("n_symbols") / words),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / words,
    ]
    return [F.round(x * UNIT).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _grouped(counts: DataFrame) -> DataFrame:
    """Statistics vectors with their group: language and source, or the pool that small groups fall into."""
    fine = counts.groupBy("lang", "source").agg(F.count("*").alias("n"))
    rest = fine.where(F.col("n") < MIN_GROUP).groupBy("lang").agg(F.sum("n").alias("pooled"))
    keys = fine.alias("f").join(rest.alias("r"), F.col("f.lang").eqNullSafe(F.col("r.lang")), "left").select(
        F.col("f.lang").alias("k_lang"), F.col("f.source").alias("k_source"),
        F.when(F.col("n") >= MIN_GROUP, F.to_json(F.struct(F.lit(2).alias("level"), F.col("f.lang").alias("a"), F.col("f.source").alias("b"))))
        .when(F.col("pooled") >= MIN_GROUP, F.to_json(F.struct(F.lit(1).alias("level"), F.col("f.lang").alias("a"))))
        .otherwise(F.lit("all")).alias("grp"))
    return counts.join(keys, F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source")), "left").drop("k_lang", "k_source").withColumns({f"x{i}": c for i, c in enumerate(_vector())})


def _start(vectors: DataFrame) -> DataFrame:
    """First estimates of each group: medians and interquartile widths, from exact counts of coarse values."""
    cells = vectors.select("grp", F.posexplode(F.array(*(F.shiftright(f"x{i}", 4) for i in range(P)))).alias("i", "v")).groupBy("grp", "i", "v").agg(F.count("*").alias("n"))
    cells = cut_lineage(cells)  # else the grouping is dealt by (grp, i) too, and a task gets a large group's parts from all others
    w = Window.partitionBy("grp", "i")
    run = cells.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
    reach = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("v") * 16))
    spread = run.groupBy("grp", "i").agg(reach(0.5).alias("m"), ((reach(0.75) - reach(0.25)) / 1.349).alias("s"), F.max("all").alias("n"))
    wide = spread.groupBy("grp").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"m{i}") for i in range(P)), *(F.max(F.when(F.col("i") == i, F.col("s"))).alias(f"s{i}") for i in range(P)))
    columns = ["grp", "n", *(F.col(f"m{i}").cast("double").alias(f"m{i}") for i in range(P))]
    for i, j in _PAIRS:
        floor = (FLOORS[i] * UNIT) ** 2
        columns.append((1 / (F.col(f"s{i}") * F.col(f"s{i}") + floor) if i == j else F.lit(0.0)).cast("double").alias(f"q{i}{j}"))
    return wide.select(*columns)


def _distance() -> Column:
    """Squared Mahalanobis distance of the vector x under centre m and precision q."""
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    terms = [(d[i] * d[j] * F.col(f"q{i}{j}")) * (1 if i == j else 2) for i, j in _PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    """Centre and precision of each group from its sums (one row per group, in any task)."""
    schema = "grp string, n long, " + ", ".join(f"m{i} double" for i in range(P)) + ", " + ", ".join(f"q{i}{j} double" for i, j in _PAIRS)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                h = r["h"]
                m = [r[f"s{i}"] / h for i in range(P)]
                cov = np.empty((P, P))
                for i, j in _PAIRS:  # whole-number sums: exact in Python
                    cov[i, j] = cov[j, i] = float(int(r[f"p{i}{j}"]) * int(h) - int(r[f"s{i}"]) * int(r[f"s{j}"])) / float(h) ** 2
                cov = cov * factor + np.diag([(x * UNIT) ** 2 for x in FLOORS])
                q = np.linalg.inv(cov)
                rows.append([r["grp"], r["n"], *m, *(float(q[i, j]) for i, j in _PAIRS)])
            yield pd.DataFrame(rows, columns=["grp", "n", *(f"m{i}" for i in range(P)), *(f"q{i}{j}" for i, j in _PAIRS)])

    return moments.mapInPandas(solve, schema)


def _step(vectors: DataFrame, now: DataFrame, closest: bool) -> DataFrame:
    """One concentration step (``closest``: the nearest COVERAGE of each group), or the reweighting (all within KEEP)."""
    near = vectors.join(now.withColumnRenamed("grp", "g"), F.col("grp") == F.col("g")).withColumn("d2", _distance())
    octave = F.when(F.col("d2") < 2.0**-10, -10 * _BIN).otherwise(F.floor(F.log2("d2") * _BIN)).cast("int")
    sums = [F.count("*").alias("h"), F.max("n").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS)]
    if closest:
        bins = cut_lineage(near.withColumn("bin", octave).groupBy("grp", "bin").agg(*sums))  # dealt by both columns
        before = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("below", F.coalesce(F.sum("h").over(before), F.lit(0))).where(F.col("below") < COVERAGE * F.col("n"))
        factor = consistency(COVERAGE)
    else:
        bins = near.where(F.col("d2") <= chi2_quantile(KEEP, P)).groupBy("grp").agg(*sums)
        factor = consistency(KEEP)
    names = ["h", *(f"s{i}" for i in range(P)), *(f"p{i}{j}" for i, j in _PAIRS)]
    return _estimates(bins.groupBy("grp").agg(F.max("n").alias("n"), *(F.sum(c).alias(c) for c in names)), factor)


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """Centre and precision of every group with MIN_GROUP rows or more."""
    now = cut_lineage(_start(vectors).where(F.col("n") >= MIN_GROUP))
    for k in range(STEPS + 1):
        now = cut_lineage(_step(vectors, now, closest=k < STEPS))
    return now


def quality_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, lang, source, the counts, ``base_failed``, ``distance`` (squared, null where no estimate is made) and ``kept``."""
    counts = cut_lineage(text_counts(docs, **columns))
    vectors = _grouped(counts)
    fit = robust_estimates(cut_lineage(vectors.where(~base_failed()).select("grp", *(f"x{i}" for i in range(P)))))
    cut = chi2_quantile(REJECT, P)
    scored = vectors.join(fit.drop("n").withColumnRenamed("grp", "g"), F.col("grp") == F.col("g"), "left").withColumn("distance", _distance())
    return scored.select("doc_id", "lang", "source", *COUNTS, base_failed().alias("base_failed"), "distance", (~base_failed() & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"))
