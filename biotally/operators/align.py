"""Gapped pair alignment over candidate pairs in bounded memory, and statistics of aligned strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotally.functions.sequence import substitution_score
from biotally.reference_tables import DNA_MATCH, DNA_MISMATCH, GAP, UNKNOWN_PAIR_SCORE, blosum62


def _score_table(alphabet: str) -> np.ndarray:
    if alphabet == "dna":
        table = np.full((128, 128), DNA_MISMATCH, dtype=np.int32)
        np.fill_diagonal(table, DNA_MATCH)
        return table
    table = np.full((128, 128), UNKNOWN_PAIR_SCORE, dtype=np.int32)
    for (a, b), v in blosum62().items():
        table[ord(a), ord(b)] = v
    return table


def _next_row(prev: np.ndarray, letter: int, i: int, b: np.ndarray, table: np.ndarray, gap: int, cost: np.ndarray, local: bool) -> np.ndarray:
    """Scores of row ``i`` from those of the row before. With a linear gap a row is settled at once: a gap run from column
    k to j costs gap * (j - k), so the best of all starts is a running maximum of (cell - gap * k)."""
    row = np.empty_like(prev)
    row[0] = 0 if local else gap * i
    np.maximum(prev[:-1] + table[letter, b], prev[1:] + gap, out=row[1:])
    if local:
        np.maximum(row, 0, out=row)
    row -= cost
    np.maximum.accumulate(row, out=row)
    row += cost
    return row


def _stride(rows: int) -> int:
    """Rows between two kept ones: the kept rows (4 bytes a cell) and a block's codes (3 bits a cell) then take alike."""
    return max(1, int(np.sqrt(rows * 32 / 3)))


def align_texts(a: np.ndarray, b: np.ndarray, table: np.ndarray, gap: int, local: bool) -> tuple[int, str, str]:
    """Score and aligned texts of two arrays of letter codes, in memory of about ``sqrt(rows)`` rows of scores.

    The first pass keeps the score and every few rows. The path then goes back from the end (local: the first best cell)
    block by block: a block's rows are filled once more from the kept row above it, and of each cell only three bits
    stay, whether a pair or a gap in b leads to its score and whether that is above zero. A pair is preferred, then a
    gap in b, then a gap in a, so the texts are those of the whole grid.
    """
    m, n = len(a), len(b)
    cost = gap * np.arange(n + 1, dtype=np.int32)
    start = np.zeros(n + 1, np.int32) if local else cost.copy()
    step = _stride(m)
    kept, row = {0: start}, start
    best, end_i, end_j = 0, 0, 0
    for i in range(1, m + 1):
        row = _next_row(row, a[i - 1], i, b, table, gap, cost, local)
        if i % step == 0 and i < m:
            kept[i] = row
        if local and (top := int(row.max())) > best:
            best, end_i, end_j = top, i, int(row.argmax())
    score, i, j = (best, end_i, end_j) if local else (int(row[n]), m, n)
    left, right = bytearray(), bytearray()
    while (i > 0 and j > 0) if local else (i > 0 or j > 0):
        if i == 0:
            left += b"-" * j
            right += b[:j][::-1].tobytes()
            break
        base = (i - 1) // step * step
        prev, codes = kept.pop(base)[: j + 1], []
        short, short_cost = b[:j], cost[: j + 1]
        for k in range(base + 1, i + 1):
            here = _next_row(prev, a[k - 1], k, short, table, gap, short_cost, local)
            paired = np.zeros(j + 1, bool)
            paired[1:] = here[1:] == prev[:-1] + table[a[k - 1], short]
            codes.append((np.packbits(paired), np.packbits(here == prev + gap), np.packbits(here > 0)))
            prev = here
        at, stopped = base, False
        while i > at and (j > 0 or not local):
            pair, down, above = codes[i - at - 1]
            byte, bit = j >> 3, 128 >> (j & 7)
            if local and not above[byte] & bit:
                stopped = True
                break
            if pair[byte] & bit:
                i, j = i - 1, j - 1
                left.append(a[i])
                right.append(b[j])
            elif down[byte] & bit:
                i -= 1
                left.append(a[i])
                right.append(45)
            else:
                j -= 1
                left.append(45)
                right.append(b[j])
        if stopped:
            break
    return score, left[::-1].decode("ascii"), right[::-1].decode("ascii")


def align_pairs(pairs: DataFrame, mode: str = "global", alphabet: str = "dna", gap: int = GAP) -> DataFrame:
    """Score and aligned strings of each pair (pair_id, a, b); pairs are independent and stay in their partitions."""
    local, table = mode == "local", _score_table(alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (np.frombuffer((batch.column(c)[k].as_py() or "").upper().encode("ascii", "replace"), dtype=np.uint8) for c in ("a", "b"))
                done = [pa.array([x]) for x in align_texts(a, b, table, gap, local)]
                yield pa.RecordBatch.from_arrays([batch.column("pair_id").slice(k, 1), done[0].cast(pa.int32()), *done[1:]], names=["pair_id", "score", "aligned_a", "aligned_b"])

    schema = f"pair_id {dict(pairs.dtypes)['pair_id']}, score int, aligned_a string, aligned_b string"
    return pairs.select("pair_id", "a", "b").mapInArrow(run, schema)


def rescored(a: Column, b: Column, alphabet: str = "dna", gap: int = GAP) -> Column:
    """The score that two aligned strings add up to."""
    letter = (lambda x, y: substitution_score(x, y)) if alphabet == "protein" else (lambda x, y: F.when(x == y, DNA_MATCH).otherwise(DNA_MISMATCH))
    column = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x == "-") | (y == "-"), gap).otherwise(letter(x, y)))
    return F.when(F.length(a) == 0, 0).otherwise(F.aggregate(column, F.lit(0), lambda s, v: s + v.cast("int")))


def alignment_stats(a: Column, b: Column, alphabet: str = "protein") -> dict[str, Column]:
    """Identical, similar and gap positions, match line, identity and similarity percent of two aligned strings."""

    def mark(x: Column, y: Column) -> Column:
        similar = substitution_score(x, y) > 0 if alphabet == "protein" else F.lit(False)
        return F.when((x == "-") | (y == "-"), " ").when(x == y, "|").when(similar, ":").otherwise(".")

    line = F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), mark), "")
    count = lambda keep: F.length(F.regexp_replace(line, f"[^{keep}]", ""))
    n = F.nullif(F.length(a), F.lit(0))
    return {
        "match_line": line, "identical": count("|"), "similar": count("|:"), "gaps": count(" "),
        "identity": F.coalesce(count("|") * 100.0 / n, F.lit(0.0)), "similarity": F.coalesce(count("|:") * 100.0 / n, F.lit(0.0)),
    }
