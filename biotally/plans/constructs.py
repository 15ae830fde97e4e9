"""Multi-epitope constructs: select, interleave, link and measure, one construct per protein."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotally.functions.sequence import overlapping_words, substitution_score
from biotally.operators import epitopes
from biotally.operators.codons import swap_codons
from biotally.reference_tables import HIS_TAG, LINKER, REVERSE_CODONS, SIGNAL_PEPTIDE


def sequence_summary(proteins: DataFrame, key: str = "protein_id") -> DataFrame:
    """Length, antigenicity and how many epitopes of each kind a protein has."""
    b = epitopes.predict_b_epitopes(proteins, key).groupBy(key).agg(F.count("*").alias("b_epitopes"), F.max("score").alias("best_b"))
    t = epitopes.predict_t_epitopes(proteins, key).groupBy(key).agg(F.count("*").alias("t_epitopes"), F.min("ic50").alias("best_ic50"))
    base = proteins.select(key, F.length("seq").alias("length"), epitopes.antigenicity(F.col("seq")).alias("antigenicity"))
    return base.join(b, key, "left").join(t, key, "left").na.fill(0, ["b_epitopes", "t_epitopes"])


def per_allele(peptides: DataFrame, alleles: list[str], key: str = "protein_id", top: int = 5) -> DataFrame:
    """The same ranked peptides for each allele of a short list, kept as one table."""
    with_allele = peptides.select("*", F.posexplode(F.array(*[F.lit(a) for a in alleles])).alias("allele_no", "allele"))
    w = Window.partitionBy(key, "allele_no").orderBy("ic50", "start")
    return with_allele.withColumn("allele_rank", F.row_number().over(w)).filter(F.col("allele_rank") <= top)


def dedup_peptides(peptides: DataFrame, key: str = "protein_id") -> DataFrame:
    """First occurrence of each peptide sequence within a protein, in allele and rank order."""
    w = Window.partitionBy(key, "sequence").orderBy("allele_no", "allele_rank")
    return peptides.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def interleave(b: DataFrame, t: DataFrame, key: str = "protein_id") -> DataFrame:
    """B rank 1, T rank 1, B rank 2, ... as a part number per protein."""
    parts = b.select(key, F.lit("B-cell").alias("kind"), "rank", "sequence", "score").unionByName(
        t.select(key, F.lit("T-cell-MHC-I").alias("kind"), "rank", "sequence", "score")
    )
    return parts.withColumn("part", F.row_number().over(Window.partitionBy(key).orderBy("rank", "kind")))


def feature_offsets(parts: DataFrame, key: str = "protein_id", linker: str = LINKER, signal: str = SIGNAL_PEPTIDE) -> DataFrame:
    """1-based start and end of each part in the assembled protein, linkers counted."""
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("sequence") + len(linker)).over(before), F.lit(0))
    return parts.withColumn("feature_start", (offset + len(signal) + 1).cast("int")).withColumn(
        "feature_end", F.col("feature_start") + F.length("sequence") - 1
    )


def adjacent_naturalness(seq: Column) -> Column:
    """Mean substitution score of neighbouring residues, mapped to (x + 4) / 8 and floored at 0."""
    pairs = overlapping_words(seq, 2)
    total = F.aggregate(pairs, F.lit(0), lambda a, p: a + substitution_score(F.substring(p, 1, 1), F.substring(p, 2, 1)))
    return F.when(F.size(pairs) > 0, F.greatest(F.lit(0.0), (total / F.size(pairs) + 4) / 8)).otherwise(F.lit(0.0))


def reverse_translate(seq: Column) -> Column:
    """One fixed codon per residue, NNN for anything else."""
    letters = F.split(seq, "")
    table = F.create_map(*[F.lit(x) for kv in REVERSE_CODONS.items() for x in kv])
    return F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("NNN"))), "")


def molecular_weight(seq: Column) -> Column:
    """Estimate in kDa at 110 Da per residue."""
    return F.length(seq) * 110 / 1000


def select_parts(proteins: DataFrame, alleles: list[str], key: str = "protein_id", max_b: int = 5, max_t: int = 5) -> DataFrame:
    b = epitopes.predict_b_epitopes(proteins, key, 8, 20, max_b)
    t = dedup_peptides(per_allele(epitopes.predict_t_epitopes(proteins, key, max_t), alleles, key, max_t), key)
    ranked = t.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("allele_no", "allele_rank"))).filter(F.col("rank") <= max_t)
    return interleave(b, ranked, key)


def assemble_construct(proteins: DataFrame, alleles: list[str], key: str = "protein_id", linker: str = LINKER, usage: DataFrame | None = None, species: str = "species") -> DataFrame:
    """One construct per protein: signal, ranked parts with linkers, tag, its measures and its DNA in fixed codons.

    With a codon ``usage`` table also ``adapted_dna``, in the codons that the protein's own ``species`` prefers.
    """
    parts = select_parts(proteins, alleles, key)
    # At most ten parts per protein, so the list of a group is bounded.
    grouped = parts.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("part", "sequence"))).alias("parts"),
        F.count_if(F.col("kind") == "B-cell").alias("b_count"),
        F.count_if(F.col("kind") != "B-cell").alias("t_count"),
    )
    body = F.array_join(F.col("parts.sequence"), linker)
    built = grouped.withColumn("construct", F.concat(F.lit(SIGNAL_PEPTIDE), body, F.lit(HIS_TAG + "*")))
    c = F.col("construct")
    out = built.select(
        key, "construct", F.length(c).alias("length"), "b_count", "t_count",
        adjacent_naturalness(c).alias("naturalness"), molecular_weight(c).alias("kda"),
        reverse_translate(F.replace(c, F.lit("*"), F.lit(""))).alias("dna"),
    )
    if usage is None:
        return out
    hosted = out.join(proteins.select(key, species), key)
    return swap_codons(hosted, usage, species, "dna").drop(species).withColumnRenamed("adapted", "adapted_dna")
