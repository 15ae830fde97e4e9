"""Composite digests and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotally.functions.sequence import gc_content
from biotally.operators import orfs, restriction
from biotally.reference_tables import ENZYMES


def digest(seqs: DataFrame, key: str = "seq_id", enzymes=ENZYMES) -> DataFrame:
    sites = restriction.find_cut_sites(seqs, key, enzymes)
    return restriction.digest_summary(sites, seqs.select(key, F.length("seq").alias("length")), key)


def plasmid_annotation(seqs: DataFrame, key: str = "seq_id", names: list[str] | None = None, min_orf: int = 60) -> DataFrame:
    """Per sequence: length, GC, reading frames of at least 20 residues, cut sites and how many enzymes cut."""
    chosen = [e for e in ENZYMES if (e[0] in names if names else 4 <= len(e[1]) <= 6)]
    # Partial counts per enzyme first: the distinct count then sees one row per sequence and enzyme.
    cuts = (
        restriction.cutting_enzymes(restriction.find_cut_sites(seqs, key, chosen), key)
        .groupBy(key)
        .agg(F.sum("sites").alias("cut_sites"), F.count("*").alias("enzymes_cutting"))
    )
    frames = orfs.find_orfs(seqs, key, min_orf).groupBy(key).agg(F.count("*").alias("orfs"), F.max("length").alias("longest_orf"))
    base = seqs.select(key, F.length("seq").alias("length"), gc_content(F.col("seq")).alias("gc"))
    return (
        base.join(frames, key, "left")
        .join(cuts, key, "left")
        .na.fill(0, ["orfs", "longest_orf", "cut_sites", "enzymes_cutting"])
    )
