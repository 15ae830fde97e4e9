"""Primer thermodynamics, candidates, pairs and mispriming."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotally.functions.sequence import gc_content, is_palindromic, overlapping_words, reverse_complement, words_at
from biotally.operators.folding import best_cross_dimer, best_hairpin, best_self_dimer
from biotally.operators.near_words import near_pairs, word_code, word_counts
from biotally.reference_tables import (
    GAS_CONSTANT,
    INIT_AT_DH,
    INIT_AT_DS,
    INIT_GC_DH,
    INIT_GC_DS,
    SODIUM,
    STACK_DH,
    STACK_DS,
    STRAND_CONC,
    SYMMETRY_DS,
)
from biotally.session import spread

SEED = 15
LONGEST = 22  # letters of the primers that are designed here


def dinucleotide_stacks(seq: Column, table: dict[str, float]) -> Column:
    """Sum of a neighbour-pair table over the sequence, in exact tenths."""
    tenths = F.array(*[F.lit(round(table[a + b] * 10)) for a in "ACGT" for b in "ACGT"])
    slot = lambda w: (F.instr(F.lit("ACGT"), F.substring(w, 1, 1)) - 1) * 4 + F.instr(F.lit("ACGT"), F.substring(w, 2, 1)) - 1
    return F.aggregate(overlapping_words(seq, 2), F.lit(0), lambda acc, w: acc + F.coalesce(F.get(tenths, slot(w)), F.lit(0)))


def melting_temp(seq: Column) -> Column:
    """Nearest-neighbour melting temperature with salt and symmetry terms, one decimal."""
    strong = [F.left(seq, F.lit(1)).isin("G", "C"), F.right(seq, F.lit(1)).isin("G", "C")]
    ends = lambda gc, at: sum(F.when(s, F.lit(round(gc * 10))).otherwise(F.lit(round(at * 10))) for s in strong)
    symmetric = is_palindromic(seq)
    dh = (dinucleotide_stacks(seq, STACK_DH) + ends(INIT_GC_DH, INIT_AT_DH)) / 10
    ds = (dinucleotide_stacks(seq, STACK_DS) + ends(INIT_GC_DS, INIT_AT_DS) + F.when(symmetric, round(SYMMETRY_DS * 10)).otherwise(0)) / 10
    conc = F.when(symmetric, GAS_CONSTANT * math.log(STRAND_CONC)).otherwise(GAS_CONSTANT * math.log(STRAND_CONC / 4))
    return F.round(dh * 1000 / (ds + conc) - 273.15 + 16.6 * math.log10(SODIUM), 1)


def three_prime_dg(seq: Column) -> Column:
    last = F.right(seq, F.lit(5))
    return F.round(dinucleotide_stacks(last, STACK_DH) / 10 - 298.15 * dinucleotide_stacks(last, STACK_DS) / 10000, 1)


def gc_clamp(seq: Column) -> Column:
    return F.length(F.regexp_replace(F.right(seq, F.lit(5)), "[^GC]", ""))


def primer_score(target_tm: float = 58.0) -> Column:
    """Penalties from 100 for temperature, GC, length, folding and the 3' end."""
    score = 100 - F.abs(F.col("tm") - target_tm) * 2
    for bad, points in (
        (~F.col("gc").between(40, 60), 10), (~F.length("primer").between(18, 25), 5), (F.col("hairpin") < -3, 8), (F.col("hairpin") < -5, 12),
        (F.col("self_dimer") < -3, 6), (F.col("self_dimer") < -5, 10), (~F.col("gc_clamp").between(1, 3), 8), (F.col("three_prime") < -8, 5),
    ):
        score = score - F.when(bad, points).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.round(score, 6) + 0.5).cast("int")))


def primer_words(templates: DataFrame, key: str, min_len: int = 18, max_len: int = 22) -> DataFrame:
    """Every template window of each primer length with its start (0-based)."""
    padded = F.concat(F.col("seq"), F.lit("#" * (max_len - min_len)))
    words = words_at(spread(templates.select(key, "seq"), key), (key,), padded, max_len)
    sizes = F.explode(F.array(*[F.lit(n) for n in range(min_len, max_len + 1)])).alias("len")
    cut = words.select(key, "i", "w", sizes).withColumn("word", F.expr("substr(w, 1, len)"))
    return cut.filter(~F.contains("word", F.lit("#"))).select(key, "i", "len", "word")


def primer_thermo(words: DataFrame) -> DataFrame:
    p = F.col("primer")
    return words.withColumn("gc", gc_content(p)).withColumn("tm", melting_temp(p)).withColumn("three_prime", three_prime_dg(p)).withColumn("gc_clamp", gc_clamp(p))


def candidates(templates: DataFrame, key: str, orientation: str, target_tm: float = 58.0) -> DataFrame:
    """Primers passing GC, temperature and folding limits; folding is computed only for those passing the cheap limits."""
    word = F.col("word") if orientation == "forward" else reverse_complement(F.col("word"))
    rows = primer_thermo(primer_words(templates, key).withColumn("primer", word)).filter(
        F.col("gc").between(40, 60) & (F.abs(F.col("tm") - target_tm) <= 10)
    )
    folded = rows.withColumn("hairpin", best_hairpin("primer")).withColumn("self_dimer", best_self_dimer("primer")).filter("hairpin >= -6")
    if orientation == "forward":
        folded = folded.filter("self_dimer >= -6")
    return folded.select(
        key, (F.col("i") + 1).alias("position"), "len", "primer", "tm", "gc", "hairpin", "self_dimer", "three_prime", "gc_clamp", primer_score(target_tm).alias("score")
    )


def primer_pairs(fwd: DataFrame, rev: DataFrame, key: str, min_product: int = 150, max_product: int = 800, max_dtm: float = 5.0) -> DataFrame:
    """Forward and reverse primers of a template with product size and temperature difference in range.

    The range is met through position buckets of one range width, so a very long template spreads over many keys.
    """
    width = max_product - min_product
    f = fwd.select(key, *[F.col(c).alias(f"f_{c}") for c in ("position", "primer", "tm", "score")])
    first, last = F.floor((F.col("f_position") + min_product) / width), F.floor((F.col("f_position") + max_product) / width)
    f = f.withColumn("bucket", F.explode(F.sequence(first, last)))
    r = rev.select(key, *[F.col(c).alias(f"r_{c}") for c in ("position", "primer", "tm", "score")], (F.col("position") + F.col("len")).alias("r_end"))
    r = r.withColumn("bucket", F.floor(F.col("r_end") / width))
    size = F.col("r_end") - F.col("f_position")
    dtm = F.round(F.abs(F.col("f_tm") - F.col("r_tm")), 1)
    joined = f.join(r, [key, "bucket"]).filter(size.between(min_product, max_product) & (dtm <= max_dtm))
    return joined.select(key, "f_position", "r_position", "f_primer", "r_primer", "f_score", "r_score", size.alias("product"), dtm.alias("tm_difference"))


def pair_score() -> Column:
    dimer = F.when(F.col("cross_dimer") > -3, 100).when(F.col("cross_dimer") > -5, 60).otherwise(30)
    raw = F.col("f_score") * 0.35 + F.col("r_score") * 0.35 + (100 - F.col("tm_difference") * 10) * 0.15 + dimer * 0.15
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.round(raw, 6) + 0.5).cast("int")))


def design_primers(templates: DataFrame, key: str, top: int = 15, top_forward: int = 30) -> DataFrame:
    """The best pairs of each template: its 30 best forward primers against every reverse primer in range."""
    long_enough = templates.filter(F.length("seq") >= 100)
    w = Window.partitionBy(key).orderBy(F.desc("score"), "position", "len")
    fwd = candidates(long_enough, key, "forward").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_forward)
    pairs = primer_pairs(fwd, candidates(long_enough, key, "reverse"), key)
    scored = pairs.withColumn("cross_dimer", best_cross_dimer("f_primer", "r_primer")).withColumn("score", pair_score())
    best = Window.partitionBy(key).orderBy(F.desc("score"), "f_position", "r_position", "f_primer", "r_primer")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def mispriming_hits(primers: DataFrame, genome: DataFrame, genome_key: str = "seq_id", longest: int = LONGEST) -> DataFrame:
    """Genome windows within 3 mismatches of the last 15 letters of a primer or of its reverse complement, extended
    backwards letter by letter over the rest of the primer.

    Seeds and windows meet as distinct words; only matching words go back to their places in the genome. ``longest``
    says how far windows are carried back; a primer beyond it is an error, never compared on a part of it.
    """
    turns = F.array(F.struct(F.lit("+").alias("turn"), F.col("primer").alias("query")), F.struct(F.lit("-").alias("turn"), reverse_complement(F.col("primer")).alias("query")))
    fits = F.when(F.length("primer") <= longest, F.col("primer")).otherwise(F.raise_error(F.concat(F.lit(f"primer longer than {longest} letters: "), "primer")).cast("string"))
    queries = primers.select(fits.alias("primer")).distinct().filter(F.length("primer") >= SEED).select("primer", F.inline(turns))
    queries = queries.withColumn("seed", word_code(F.right("query", F.lit(SEED))))
    near = near_pairs(queries.select(F.col("seed").alias("code")), word_counts(genome, SEED), SEED, 3)
    # Each place carries the letters before it, as far back as the longest primer reaches.
    reach = longest - SEED
    padded = F.concat(F.lit("#" * reach), F.col("seq"))
    places = words_at(spread(genome.select(genome_key, "seq"), genome_key), (genome_key,), padded, reach + SEED)
    places = places.select(genome_key, (F.col("i") + 1).alias("position"), F.substring("w", 1, reach).alias("before"), word_code(F.substring("w", reach + 1, SEED)).alias("target"))
    hits = queries.join(near.withColumnRenamed("query", "seed"), "seed").join(places, "target")
    rest = F.length("query") - SEED
    usable = F.length(F.regexp_replace("before", "#", ""))
    ext = F.least(rest, usable)
    # Compare the letters next to the seed, read away from it.
    mine = F.expr(f"reverse(substr(query, 1, length(query) - {SEED}))")
    theirs = F.reverse("before")
    wrong = F.aggregate(
        F.sequence(F.lit(1), F.lit(reach)), F.lit(0),
        lambda acc, j: acc + F.when((j <= ext) & (mine.substr(j, F.lit(1)) != theirs.substr(j, F.lit(1))), 1).otherwise(0),
    )
    out = hits.withColumn("match_length", F.lit(SEED) + ext).withColumn("total_mismatches", F.col("mismatches") + wrong)
    return out.select(
        "primer", "turn", genome_key, "position", F.col("mismatches").alias("seed_mismatches"), "total_mismatches", "match_length",
        ((1 - F.col("total_mismatches") / F.col("match_length")) * 100).alias("match_percent"),
    )


def top_mispriming_hits(hits: DataFrame, genome_key: str = "seq_id", top: int = 10) -> DataFrame:
    w = Window.partitionBy("primer").orderBy("total_mismatches", F.desc("match_length"), genome_key, "position", "turn")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def pair_specificity(pairs: DataFrame, hits: DataFrame, genome_key: str = "seq_id") -> DataFrame:
    """100 - 5 per hit - 15 per hit with at most one mismatch, floored at 0, with a warning class per pair and the
    distinct genomes of its strong hits, comma-joined."""
    close = F.col("total_mismatches") <= 1
    per = hits.groupBy("primer").agg(F.count("*").alias("hits"), F.count_if(close).alias("strong"), F.collect_set(F.when(close, F.col(genome_key))).alias("genomes"))
    f = per.select(F.col("primer").alias("f_primer"), F.col("hits").alias("fh"), F.col("strong").alias("fs"), F.col("genomes").alias("fg"))
    r = per.select(F.col("primer").alias("r_primer"), F.col("hits").alias("rh"), F.col("strong").alias("rs"), F.col("genomes").alias("rg"))
    joined = pairs.join(f, "f_primer", "left").join(r, "r_primer", "left").na.fill(0, ["fh", "fs", "rh", "rs"])
    total, strong = F.col("fh") + F.col("rh"), F.col("fs") + F.col("rs")
    return joined.withColumn("hits", total).withColumn("strong_hits", strong).withColumn(
        "specificity", F.greatest(F.lit(0), 100 - 5 * total - 15 * strong)
    ).withColumn("warning", F.when(strong > 0, "high").when(total > 5, "moderate")).withColumn(
        "strong_sources", F.array_join(F.array_sort(F.array_union(F.coalesce("fg", F.array()), F.coalesce("rg", F.array()))), ",")
    ).drop("fh", "fs", "rh", "rs", "fg", "rg")
