"""Resistance rules: motifs, mutations in context, class scores and affected drugs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotally.functions.letters import inside, letters, passes
from biotally.functions.sequence import iupac_regex, round_half_up
from biotally.reference_tables import CONTEXT_RULES, MOTIF_RULES, fixed_table

def bin_resistance(score: Column) -> Column:
    return F.when(score < 25, "susceptible").when(score < 60, "intermediate").otherwise("resistant")


def motif_hits(seqs: DataFrame, key: str, motifs=MOTIF_RULES, dna: bool = True) -> DataFrame:
    """First position of each motif present. One regex scan per motif within the row; motifs are IUPAC words for DNA."""
    seq = F.col("seq")
    probes = [
        F.struct(
            F.lit(gene).alias("gene"), F.lit(cls).alias("class"), F.lit(conf).alias("confidence"),
            (F.regexp_instr(seq, F.lit(iupac_regex(word))) if dna else F.instr(seq, F.lit(word))).alias("position"),
        )
        for word, gene, cls, conf in motifs
    ]
    return seqs.select(key, F.inline(F.array(*probes))).filter("position > 0")


def _patterns(rules) -> list[tuple]:
    return [(before + mutant + after, len(before), gene, cls, wild, mutant, pos, conf) for cls, gene, pos, wild, mutants, before, after, conf in rules for mutant in mutants]


def context_mutation_hits(seqs: DataFrame, key: str, rules=CONTEXT_RULES) -> DataFrame:
    """Every occurrence of before + mutant + after, overlaps included, from one pass over the letters of a batch."""
    patterns = _patterns(rules)
    words = [np.frombuffer(p[0].encode(), np.uint8) for p in patterns]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in passes(batches, "seq"):
            data, starts, ends = letters(b.column("seq"))
            first = {w[0]: np.flatnonzero(data == w[0]) for w in words}
            for k, w in enumerate(words):
                at, row = inside(first[w[0]], len(w), starts, ends)
                for n, x in enumerate(w[1:], 1):
                    fits = data[at + n] == x
                    at, row = at[fits], row[fits]
                if len(at):
                    yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row)), pa.array(np.full(len(at), k, np.int32)), pa.array((at - starts[row]).astype(np.int32))], names=[key, "rule", "i"])

    columns = ("before", "gene", "class", "wild_type", "mutant", "reference_position", "confidence", "of")
    table = fixed_table(seqs.sparkSession, columns, [(*p[1:], k) for k, p in enumerate(patterns)])
    rows = seqs.select(key, "seq").mapInArrow(found, f"`{key}` {seqs.schema[key].dataType.simpleString()}, rule int, i int")
    return rows.join(F.broadcast(table), F.col("rule") == F.col("of")).select(
        key, "gene", "class", "wild_type", "mutant", "reference_position", "confidence", (F.col("i") + F.col("before") + 1).alias("position")
    )


def all_hits(seqs: DataFrame, key: str, motifs=MOTIF_RULES, rules=CONTEXT_RULES) -> DataFrame:
    m = motif_hits(seqs, key, motifs).select(key, "gene", "class", "confidence", "position", F.lit("motif").alias("kind"))
    c = context_mutation_hits(seqs, key, rules).select(key, "gene", "class", "confidence", "position", F.lit("mutation").alias("kind"))
    return m.unionByName(c)


def class_scores(hits: DataFrame, key: str) -> DataFrame:
    """40 points per hit scaled by confidence, capped at 100; the level is read from the uncapped sum."""
    total = F.sum(F.col("confidence") * 40) / 100
    return hits.groupBy(key, "class").agg(total.alias("raw"), F.count("*").alias("hits")).select(
        key, "class", "hits", F.least(F.lit(100), round_half_up(F.col("raw")).cast("int")).alias("score"), bin_resistance(F.col("raw")).alias("level")
    )


def overall_resistance(scores: DataFrame, key: str) -> DataFrame:
    return scores.groupBy(key).agg(F.least(F.lit(100), round_half_up(F.avg("score")).cast("int")).alias("overall_score"))


def recommendation_classes(scores: DataFrame, key: str) -> DataFrame:
    """Resistant and intermediate classes of each sequence as comma lists."""
    listed = lambda level: F.array_join(F.sort_array(F.collect_list(F.when(F.col("level") == level, F.col("class")))), ", ")
    return scores.groupBy(key).agg(listed("resistant").alias("resistant"), listed("intermediate").alias("intermediate"))


def resistance_genes(hits: DataFrame, key: str) -> DataFrame:
    return hits.filter("kind = 'motif'").groupBy(key).agg(F.sort_array(F.collect_set("gene")).alias("genes"))


def predict_resistance(seqs: DataFrame, key: str, motifs=MOTIF_RULES, rules=CONTEXT_RULES) -> DataFrame:
    """One row per sequence: hits, overall score, genes and class lists."""
    hits = all_hits(seqs, key, motifs, rules)
    scores = class_scores(hits, key)
    per_seq = scores.groupBy(key).agg(
        F.sum("hits").alias("hits"),
        F.least(F.lit(100), round_half_up(F.avg("score")).cast("int")).alias("overall_score"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("level") == "resistant", F.col("class")))), ", ").alias("resistant"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("level") == "intermediate", F.col("class")))), ", ").alias("intermediate"),
    )
    genes = resistance_genes(hits, key)
    return (
        seqs.select(key, F.length("seq").alias("length"))
        .join(per_seq, key, "left")
        .join(genes, key, "left")
        .withColumn("genes", F.coalesce("genes", F.array().cast("array<string>")))
        .na.fill(0, ["hits", "overall_score"])
        .na.fill("", ["resistant", "intermediate"])
    )


def affected_drugs(drugs: DataFrame, hits: DataFrame, group_classes: dict[str, str]) -> DataFrame:
    """Drugs whose group belongs to a class with a hit: group to class by a fixed map, then a semi join."""
    mapping = fixed_table(drugs.sparkSession, ("pharm_group", "class"), group_classes.items())
    return drugs.join(F.broadcast(mapping), "pharm_group").join(hits.select("class").distinct(), "class", "left_semi")
