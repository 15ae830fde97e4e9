"""Codon usage, preferred codons, adaptation index and codon swapping."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotally.functions.sequence import codon_residue, codons, gc_content
from biotally.operators.restriction import contains_any
from biotally.reference_tables import CLONING_SITES, CODON_BASES, CODON_RESIDUES, DEFAULT_SPECIES, SPECIES_ALIASES, UNKNOWN_CODON_FRACTION, fixed_table
from biotally.session import cut_lineage, spread


def species_alias_join(rows: DataFrame, name: str = "species") -> DataFrame:
    """Short species names to full ones; unknown names take the default table."""
    alias = fixed_table(rows.sparkSession, ("alias", "full_name"), SPECIES_ALIASES.items())
    full = set(SPECIES_ALIASES.values())
    known = F.when(F.col(name).isin(*full), F.col(name))
    return rows.join(F.broadcast(alias), F.col(name) == F.col("alias"), "left").withColumn(
        "usage_species", F.coalesce("full_name", known, F.lit(DEFAULT_SPECIES))
    ).drop("alias", "full_name")


def codon_counts(seqs: DataFrame, *keys: str) -> DataFrame:
    """Codons of the first frame counted per key; partial counts are at most 64 rows per key and task."""
    return (
        seqs.select(*keys, F.explode(codons(F.col("seq"))).alias("codon"))
        .groupBy(*keys, "codon")
        .agg(F.count("*").alias("n"))
        .withColumn("aa", codon_residue(F.col("codon")))
    )


def codon_usage(seqs: DataFrame, species: str = "species") -> DataFrame:
    """Fraction of each codon within its amino acid per species."""
    return usage_of_counts(codon_counts(seqs, species), species)


def usage_of_counts(counts: DataFrame, species: str = "species") -> DataFrame:
    total = counts.groupBy(species, "aa", "codon").agg(F.sum("n").alias("n"))
    return total.select(species, "codon", "n", "aa", (F.col("n") / F.sum("n").over(Window.partitionBy(species, "aa"))).alias("fraction"))


def preferred_codon(usage: DataFrame, species: str = "species") -> DataFrame:
    """Codon with the highest fraction per species and amino acid; ties go to the later codon in letters."""
    return usage.groupBy(species, "aa").agg(
        F.max_by("codon", F.struct("fraction", "codon")).alias("codon"), F.max("fraction").alias("fraction")
    )


def adaptation_index(counts: DataFrame, usage: DataFrame, key: str, species: str = "species") -> DataFrame:
    """exp of the mean ln(fraction / best fraction of the residue); stops are skipped.

    ``counts`` holds the codon counts of each sequence, so at most 64 rows per sequence meet the usage table.
    """
    best = usage.withColumn("best", F.max("fraction").over(Window.partitionBy(species, "aa"))).filter("aa != '*'")
    counts = counts.filter("aa != '*'")
    weight = F.coalesce("fraction", F.lit(UNKNOWN_CODON_FRACTION)) / F.coalesce("best", F.lit(1.0))
    joined = counts.join(best.select(species, "codon", "fraction", "best"), [species, "codon"], "left")
    return joined.groupBy(key).agg(F.exp(F.sum(F.col("n") * F.ln(weight)) / F.sum("n")).alias("cai"))


def swap_table(usage: DataFrame, species: str = "species") -> DataFrame:
    """One row per species: for each of the 64 codons in their fixed order the preferred codon of its residue, joined.

    A residue that does not occur keeps its codons.
    """
    chosen = preferred_codon(usage, species).groupBy(species).agg(F.map_from_entries(F.collect_list(F.struct("aa", "codon"))).alias("preferred"))  # at most 21 entries
    each = [F.coalesce(F.try_element_at("preferred", F.lit(aa)), F.lit("".join(c))) for c, aa in zip(itertools.product(CODON_BASES, repeat=3), CODON_RESIDUES, strict=True)]
    return chosen.select(species, F.concat(*each).alias("codon_table"))


_CODE = np.full(128, 64, np.uint8)  # two bits a base; 64 and more: no base
_CODE[[ord(x) for x in CODON_BASES]] = range(4)


def _swapped(text: str, table: str) -> str:
    """The whole codons of a text through a table of 64 triples; codons with other letters stay."""
    letters = np.frombuffer(text[: len(text) // 3 * 3].encode("ascii", "replace"), np.uint8).reshape(-1, 3)
    code = _CODE[np.minimum(letters, 127)].astype(np.int64)
    place = code[:, 0] * 16 + code[:, 1] * 4 + code[:, 2]
    known = code.max(axis=1, initial=0) < 4
    triples = np.frombuffer(table.encode("ascii"), np.uint8).reshape(64, 3)
    return np.where(known[:, None], triples[np.where(known, place, 0)], letters).tobytes().decode("ascii")


def swap_codons(seqs: DataFrame, usage: DataFrame, species: str = "species", seq: str = "seq") -> DataFrame:
    """``seqs`` with ``adapted``: every codon replaced by the preferred codon of its residue, the incomplete last one left out.

    A sequence is packed to two bits a base and goes through its species' table of 64 entries in one pass. Sequences of a
    species without usage keep their codons; null stays null.
    """
    joined = seqs.join(swap_table(usage, species), species, "left")
    itself = "".join("".join(c) for c in itertools.product(CODON_BASES, repeat=3))
    columns = seqs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(seq).to_pylist(), b.column("codon_table").to_pylist(), strict=True)
            adapted = pa.array([None if text is None else _swapped(text, table or itself) for text, table in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), adapted], names=[*columns, "adapted"])

    return joined.select(*columns, "codon_table").mapInArrow(run, seqs.withColumn("adapted", F.lit(None).cast("string")).schema)


def palindromic_words(seq: Column, k: int = 6) -> Column:
    """Number of positions whose k-letter word equals its reverse complement: one regex pass over the 4^(k/2) words."""

    def words(half: int, tail: str) -> str:
        if half == 0:
            return tail
        return "(?:" + "|".join(a + words(half - 1, b + tail) for a, b in zip("ACGT", "TGCA")) + ")"

    return F.regexp_count(seq, F.lit(f"(?={words(k // 2, '')})"))


def codon_adapt(seqs: DataFrame, key: str, species: str = "species") -> DataFrame:
    """Adaptation report: index before, GC before and after, sites introduced by the swap, palindromic words."""
    rows = spread(seqs.select(key, species, "seq"), key)
    counts = codon_counts(rows, key, species)
    # Written out once: the table is small, and its file size lets Spark decide to broadcast it.
    usage = cut_lineage(usage_of_counts(counts, species))
    index = adaptation_index(counts, usage, key, species)
    swapped = swap_codons(rows, usage, species)
    introduced = F.array_distinct(F.array_except(contains_any(F.col("adapted"), CLONING_SITES), contains_any(F.col("seq"), CLONING_SITES)))
    report = swapped.select(
        key, species, F.length("adapted").alias("length"), F.md5("adapted").alias("adapted_md5"),
        gc_content(F.col("seq")).alias("gc_before"), gc_content(F.col("adapted")).alias("gc_after"),
        F.array_join(introduced, ",").alias("introduced_sites"), palindromic_words(F.col("adapted")).alias("palindromic_6mers"),
    )
    return report.join(index, key, "left")
