"""Restriction digests: cut sites, fragments and per-enzyme summaries over many sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biotally.functions.letters import as_strings, inside, letters, passes, words
from biotally.functions.sequence import TILE, sequence_tiles
from biotally.session import spread
from biotally.reference_tables import (
    COMPLEMENT_FROM,
    COMPLEMENT_TO,
    ENZYME_COLUMNS,
    ENZYMES,
    IUPAC_CLASSES,
    fixed_table,
)

_BITS = np.zeros(256, np.uint8)
_BITS[list(b"ACGT")] = (1, 2, 4, 8)


def enzyme_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, ENZYME_COLUMNS, ENZYMES)


def select_enzymes(enzymes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The named enzymes, or those with a recognition word of 4 to 6 letters."""
    if names:
        return enzymes.filter(F.col("name").isin(names))
    return enzymes.filter(F.length("recognition").between(4, 6))


def frequent_cutters(enzymes: DataFrame) -> DataFrame:
    return enzymes.filter(F.length("recognition") <= 5)


def rare_cutters(enzymes: DataFrame) -> DataFrame:
    return enzymes.filter(F.length("recognition") >= 6)


def _recognition_turns(rows) -> list[tuple]:
    """(enzyme, letters allowed at each place, those of the forward word or none, cuts, kind), one for each orientation."""
    out = []
    for name, word, top, bottom, kind, palindromic in rows:
        flipped = word.translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))[::-1]
        turns = [("+", word)] + ([("-", flipped)] if not palindromic and flipped != word else [])
        for strand, w in turns:
            k = len(w)
            cuts = (top, bottom) if strand == "+" else (k - bottom, k - top)
            out.append((name, _allowed(w), _allowed(word) if strand == "-" else None, *cuts, kind))
    return out


def _allowed(word: str) -> list[int]:
    return [int(_BITS[list(IUPAC_CLASSES[c].encode())].sum()) for c in word]


def _tile_sites(key: str, enzymes, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sites of tiles, each where it begins."""
    turns = _recognition_turns(enzymes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in passes(batches, "_text"):
            data, starts, ends = letters(b.column("_text"))
            tiles = b.column("_tile").to_numpy()
            bits = _BITS[data]
            pairs: dict[tuple[int, int], np.ndarray] = {}

            def fits(at: np.ndarray, allowed: list[int]) -> np.ndarray:
                for j, mask in enumerate(allowed):
                    at = at[(bits[at + j] & mask) != 0]
                return at

            for name, allowed, forward, top, bottom, kind in turns:
                k = len(allowed)
                if len(data) < k:
                    continue
                begin = tuple(allowed[:2])
                if begin not in pairs:
                    pairs[begin] = np.flatnonzero(((bits[:-1] & begin[0]) != 0) & ((bits[1:] & begin[1]) != 0))
                at = fits(inside(pairs[begin], k, starts, ends)[0], allowed)
                if forward:
                    at = np.setdiff1d(at, fits(at, forward), assume_unique=True)
                at, row = inside(at, k, starts, ends)
                off = at - starts[row]
                at, row, off = at[off < tile], row[off < tile], off[off < tile]
                if not len(at):
                    continue
                i = tiles[row].astype(np.int64) * tile + off
                columns = [pa.array(c, pa.int32()) for c in (i + 1, i + k, i + top, i + bottom)]
                same = [pa.array([x] * len(at), pa.string()) for x in (name, kind)]
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row)), same[0], *columns, as_strings(words(data, at, k)), same[1]], names=[key, "enzyme", "position", "end", "top_cut", "bottom_cut", "match_seq", "cut_type"])

    return run


def find_cut_sites(seqs: DataFrame, key: str = "seq_id", enzymes=ENZYMES, tile: int = TILE) -> DataFrame:
    """Every recognition site of every enzyme; cuts are 0-based bond offsets on the top strand.

    Tiles are dealt over tasks. A pass over the letters of a batch of tiles compares sets of letters as bits; enzymes whose words
    begin alike share the search for the first two letters, and further ones are tested where these fit.
    """
    width = max(len(e[1]) for e in enzymes)
    tiles = spread(sequence_tiles(seqs, (key,), F.col("seq"), width, tile), key, "_tile")
    kind = seqs.schema[key].dataType.simpleString()
    return tiles.mapInArrow(_tile_sites(key, enzymes, tile), f"{key} {kind}, enzyme string, position int, end int, top_cut int, bottom_cut int, match_seq string, cut_type string")


def fragment_sizes(sites: DataFrame, lengths: DataFrame, key: str = "seq_id") -> DataFrame:
    """Distances between consecutive cuts, with both sequence ends; sizes sum to the sequence length."""
    # The rows of a sequence and enzyme grow with the table and look small to a plan: they are never broadcast.
    cut_by = sites.select(key, "enzyme").distinct()
    ends = cut_by.hint("merge").join(lengths, key).select(key, "enzyme", F.col("length").alias("cut"), F.lit(1).alias("is_end"))
    cuts = sites.select(key, "enzyme", F.col("top_cut").alias("cut"), F.lit(0).alias("is_end")).unionByName(ends)
    w = Window.partitionBy(key, "enzyme").orderBy("cut", "is_end")
    return cuts.select(
        key,
        "enzyme",
        F.row_number().over(w).alias("fragment_no"),
        (F.col("cut") - F.lag("cut", 1, 0).over(w)).alias("size"),
    )


def digest_summary(sites: DataFrame, lengths: DataFrame, key: str = "seq_id") -> DataFrame:
    """Sites, fragments and sorted sizes per sequence and enzyme."""
    sizes = fragment_sizes(sites, lengths, key)
    return sizes.groupBy(key, "enzyme").agg(
        (F.count("*") - 1).alias("sites"),
        F.count("*").alias("fragments"),
        F.max("size").alias("largest"),
        F.min("size").alias("smallest"),
        F.sort_array(F.collect_list("size"), asc=False).alias("sizes"),
    )


def cutting_enzymes(sites: DataFrame, key: str = "seq_id") -> DataFrame:
    return sites.groupBy(key, "enzyme").agg(F.count("*").alias("sites"))


def top_cutting_enzymes(sites: DataFrame, key: str = "seq_id", n: int = 10) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("sites"), "enzyme")
    return cutting_enzymes(sites, key).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def contains_any(seq: Column, words) -> Column:
    """The listed words that occur in the sequence, in list order."""
    return F.array_compact(F.array(*[F.when(F.contains(seq, F.lit(w)), F.lit(w)) for w in words]))
