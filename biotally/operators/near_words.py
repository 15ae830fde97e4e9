"""Words within a few mismatches: exact neighbour counts and exact neighbour pairs over distinct words.

A word of k DNA letters is an integer of 2k bits, so both sides shrink to at most 4**k distinct words before any
comparison, however large the text tables are and however often one word repeats.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotally.functions.sequence import words_at

_HALF = 6  # letters in a prefix or suffix
_SIDE = 4**_HALF
HALF_WORDS = _SIDE  # suffixes of a 12-letter word
_BLOCK = 64  # prefixes or suffixes handled together


def word_code(word: Column) -> Column:
    """A, C, G, T word as a base-4 number."""
    return F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("bigint")


def word_counts(seqs: DataFrame, k: int) -> DataFrame:
    """Distinct words with their number of occurrences: (code, n)."""
    return words_at(seqs, (), F.col("seq"), k).groupBy(word_code(F.col("w")).alias("code")).agg(F.count("*").alias("n"))


def _spread_mismatches(counts: np.ndarray, first_axis: int) -> np.ndarray:
    """counts[..., letter axes ..., mismatches]: allow each of the six letters to change once."""
    for axis in range(first_axis, first_axis + _HALF):
        others = counts.sum(axis=axis, keepdims=True) - counts
        counts = counts.copy()
        counts[..., 1:] += others[..., :-1]
    return counts


def _suffix_spread(targets: DataFrame, levels: int) -> DataFrame:
    """Counts with the mismatches of suffixes spread, by prefix and block of 64 suffixes: (prefix, suffix_block, counts)."""
    letters = (4,) * _HALF

    def suffix_side(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((_BLOCK, _SIDE, levels), dtype=np.int64)
        code = pdf["code"].to_numpy()
        np.add.at(grid, ((code // _SIDE) % _BLOCK, code % _SIDE, 0), pdf["n"].to_numpy())
        grid = _spread_mismatches(grid.reshape(_BLOCK, *letters, levels), 1).reshape(_BLOCK, _SIDE // _BLOCK, _BLOCK * levels)
        used = grid.any(axis=2)
        prefix, block = np.nonzero(used)
        return pd.DataFrame({"prefix": key[0] * _BLOCK + prefix, "suffix_block": block, "counts": [grid[p, b].tobytes() for p, b in zip(prefix, block)]})

    return (
        targets.withColumn("prefix_block", F.expr(f"code div {_SIDE * _BLOCK}"))
        .groupBy("prefix_block")
        .applyInPandas(suffix_side, "prefix bigint, suffix_block bigint, counts binary")
    )


def _prefix_spread(parts: pd.DataFrame, levels: int) -> np.ndarray:
    """Counts of a block of suffixes with all mismatches spread: (prefix, suffix of the block, mismatches)."""
    grid = np.zeros((_SIDE, _BLOCK, levels), dtype=np.int64)
    for prefix, raw in zip(parts["prefix"], parts["counts"]):
        grid[prefix] = np.frombuffer(raw, dtype=np.int64).reshape(_BLOCK, levels)
    return _spread_mismatches(grid.reshape(*(4,) * _HALF, _BLOCK, levels), 0).reshape(_SIDE, _BLOCK, levels)


def ball_counts(queries: DataFrame, targets: DataFrame, radius: int = 3) -> DataFrame:
    """For each distinct 12-letter query word the number of target words at 0..radius mismatches.

    ``queries`` holds (code), ``targets`` (code, n). Mismatches are spread letter by letter: the suffix letters within
    groups of 64 prefixes, then the prefix letters within groups of 64 suffixes. A group never exceeds 64 x 4096
    words, and there are two exchanges whatever the size of the inputs.
    """
    levels = radius + 1

    def prefix_side(key: tuple, parts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return pd.DataFrame({"code": pd.Series(dtype="int64"), **{f"mm{m}": pd.Series(dtype="int64") for m in range(levels)}})
        grid = _prefix_spread(parts, levels)
        code = asked["code"].to_numpy()
        found = grid[code // _SIDE, code % _BLOCK]
        return pd.DataFrame({"code": code, **{f"mm{m}": found[:, m] for m in range(levels)}})

    asked = queries.select("code").distinct().withColumn("suffix_block", F.expr(f"(code % {_SIDE}) div {_BLOCK}"))
    schema = "code bigint, " + ", ".join(f"mm{m} bigint" for m in range(levels))
    return _suffix_spread(targets, levels).groupBy("suffix_block").cogroup(asked.groupBy("suffix_block")).applyInPandas(prefix_side, schema)


def ball_values(targets: DataFrame, value: Callable[[np.ndarray], np.ndarray], radius: int = 3) -> DataFrame:
    """A value of one byte for every 12-letter word: (suffix, values), the values by the code of the prefix.

    ``value`` makes it of the target words at 0..radius mismatches (last axis). Suffixes without a target word in reach
    may have no row. There are 4**6 rows of 4**6 bytes at most, whatever the size of the targets.
    """
    levels = radius + 1

    def prefix_side(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        values = value(_prefix_spread(parts, levels)).astype(np.int8)
        return pd.DataFrame({"suffix": key[0] * _BLOCK + np.arange(_BLOCK), "values": list(np.ascontiguousarray(values.T))})

    return _suffix_spread(targets, levels).groupBy("suffix_block").applyInPandas(prefix_side, "suffix bigint, values array<tinyint>")


def _masks(k: int, radius: int, blocks: int) -> list[int]:
    """Bit masks of every choice of (blocks - radius) letter blocks."""
    edges = [round(i * k / blocks) for i in range(blocks + 1)]
    parts = [sum(3 << (2 * (k - 1 - p)) for p in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [reduce(int.__or__, c) for c in itertools.combinations(parts, blocks - radius)]


def mismatches(a: Column, b: Column, k: int) -> Column:
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(sum(1 << (2 * i) for i in range(k))).cast("bigint")))


def near_pairs(queries: DataFrame, targets: DataFrame, k: int, radius: int, blocks: int = 6) -> DataFrame:
    """All (query code, target code) within ``radius`` mismatches, exact.

    With ``radius`` mismatches at least ``blocks - radius`` of the letter blocks are untouched, so some choice of that
    many blocks agrees in both words. Words meet by an equi-join on (choice, agreeing letters); a pair is kept only at
    its first agreeing choice, which needs no later dedupe. Both sides are distinct words.
    """
    masks = _masks(k, radius, blocks)
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(m).cast("bigint").alias("mask")) for i, m in enumerate(masks)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("code").alias(name), F.inline(choices)).select(name, "choice", F.col(name).bitwiseAND(F.col("mask")).alias("part"))

    q = keyed(queries.select("code").distinct(), "query")
    t = keyed(targets.select("code").distinct(), "target")
    x = F.col("query").bitwiseXOR(F.col("target"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m).cast("bigint")) == 0, F.lit(i)) for i, m in enumerate(masks)])
    mm = mismatches(F.col("query"), F.col("target"), k)
    return q.join(t, ["choice", "part"]).filter((mm <= radius) & (first == F.col("choice"))).select("query", "target", mm.alias("mismatches"))
