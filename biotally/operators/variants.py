"""Variant effects, residue propensity and toxicity panels from probability and prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotally.functions.sequence import round_half_up
from biotally.reference_tables import TOX_ENDPOINTS, fixed_table


def parse_variants(text: Column) -> Column:
    """Variant notations of a free text: ``H103Y``, ``103 Y`` and ``103H>Y``, as an array of (pos, mutant)."""
    items = F.transform(F.split(text, "[\\n,;]"), lambda x: F.trim(x))
    forms = ("^[A-Za-z]([0-9]+)([A-Za-z])$", "^([0-9]+)\\s+([A-Za-z])$", "^([0-9]+)[A-Za-z]>([A-Za-z])$")

    def one(item: Column) -> Column:
        found = [
            F.when(F.regexp_like(item, F.lit(p)), F.struct(F.regexp_extract(item, p, 1).cast("int").alias("pos"), F.regexp_extract(item, p, 2).alias("mutant")))
            for p in forms
        ]
        return F.coalesce(*found)

    return F.filter(F.transform(items, one), lambda v: v.isNotNull())


def bin_effect(delta: Column) -> Column:
    return F.when(delta > 2, "deleterious").when(delta < -2, "beneficial").otherwise("neutral")


def variant_prob_join(variants: DataFrame, wild: DataFrame, probs: DataFrame) -> DataFrame:
    """Probabilities of the wild-type and the mutant residue; 0.001 where the table has none."""
    p = probs.select("protein_id", "pos", "residue", "prob")
    w = wild.select("protein_id", "pos", F.col("residue").alias("wild_type"))
    j = variants.join(w, ["protein_id", "pos"])
    j = j.join(p.withColumnsRenamed({"residue": "wild_type", "prob": "wt_prob"}), ["protein_id", "pos", "wild_type"], "left")
    j = j.join(p.withColumnsRenamed({"residue": "mutant", "prob": "mut_prob"}), ["protein_id", "pos", "mutant"], "left")
    return j.na.fill(0.001, ["wt_prob", "mut_prob"])


def delta_log_likelihood(wt: Column, mut: Column) -> Column:
    return F.ln(F.greatest(wt, F.lit(1e-10))) - F.ln(F.greatest(mut, F.lit(1e-10)))


def score_variants(variants: DataFrame, wild: DataFrame, probs: DataFrame) -> DataFrame:
    j = variant_prob_join(variants, wild, probs)
    same = F.col("wild_type") == F.col("mutant")
    delta = F.when(same, 0.0).otherwise(delta_log_likelihood(F.col("wt_prob"), F.col("mut_prob")))
    return j.withColumn("delta", F.round(delta, 9)).withColumn("effect", bin_effect(F.col("delta")))


def variant_summary(scored: DataFrame) -> DataFrame:
    """Counts by effect, mean change and which effect exceeds 30 % of a protein's variants."""
    s = scored.groupBy("protein_id").agg(
        F.count("*").alias("variants"), F.count_if(F.col("effect") == "deleterious").alias("deleterious"),
        F.count_if(F.col("effect") == "beneficial").alias("beneficial"), F.avg("delta").alias("mean_delta"),
    )
    verdict = F.when(F.col("deleterious") > F.col("variants") * 0.3, "loss of function").when(F.col("beneficial") > F.col("variants") * 0.3, "adaptive").otherwise("mostly neutral")
    return s.withColumn("verdict", verdict)


def residue_propensity(wild: DataFrame, probs: DataFrame, width: int = 9) -> DataFrame:
    """Surprise of the actual residue, smoothed over a centred window and scaled by the protein's range."""
    j = wild.join(probs, ["protein_id", "pos", "residue"], "left").na.fill(0.0, ["prob"])
    s = j.withColumn("surprise", -F.ln(F.greatest(F.col("prob"), F.lit(0.001))))
    half = width // 2
    near = Window.partitionBy("protein_id").orderBy("pos").rowsBetween(-half, half)
    whole = Window.partitionBy("protein_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low, high = F.min("surprise").over(whole), F.max("surprise").over(whole)
    propensity = (F.avg("surprise").over(near) - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
    confidence = F.least(F.lit(1.0), F.abs(F.col("prob") - 0.05) * 5)
    return s.select("protein_id", "pos", "residue", "prob", "surprise", F.round(propensity, 9).alias("propensity"), confidence.alias("confidence"))


def top_residues(propensity: DataFrame, top: int = 5, context: int = 5) -> DataFrame:
    """Highest positions of each protein with the residues around them (neighbours by self-join on position)."""
    w = Window.partitionBy("protein_id").orderBy(F.desc("propensity"), "pos")
    best = propensity.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("protein_id", "pos", "rank", "propensity")
    around = best.withColumn("near", F.explode(F.sequence(F.col("pos") - context, F.col("pos") + context)))
    letters = propensity.select("protein_id", F.col("pos").alias("near"), "residue")
    return (
        around.join(letters, ["protein_id", "near"])
        .groupBy("protein_id", "pos", "rank", "propensity")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("near", "residue"))), lambda s: s["residue"]), "").alias("span"))
    )


def mean_propensity(propensity: DataFrame) -> DataFrame:
    return propensity.groupBy("protein_id").agg(F.avg("propensity").alias("mean_propensity"), F.avg("prob").alias("mean_prob"))


def top_label(predictions: DataFrame) -> DataFrame:
    """Label with the highest score per molecule and endpoint; ties go to the later label in letters."""
    return predictions.groupBy("mol_id", "endpoint").agg(F.max_by("label", F.struct("score", "label")).alias("label"), F.max("score").alias("score"))


def endpoint_table(spark) -> DataFrame:
    return fixed_table(spark, ("endpoint", "endpoint_name", "model"), TOX_ENDPOINTS)


def vote_positive(label: Column) -> Column:
    return F.lower(label).isin("toxic", "1")


def bin_risk(pct: Column) -> Column:
    return F.when(pct >= 60, "high").when(pct >= 30, "moderate").when(pct > 0, "low").otherwise("none")


def tox_panel(predictions: DataFrame) -> DataFrame:
    """Positive and answered endpoints of each molecule and the share as a rounded percent."""
    top = top_label(predictions)
    known = top.join(F.broadcast(endpoint_table(predictions.sparkSession)), "endpoint")
    p = known.groupBy("mol_id").agg(F.count_if(vote_positive(F.col("label"))).alias("positives"), F.count_if(~F.upper("label").isin("UNKNOWN", "ERROR")).alias("answered"))
    risk = F.coalesce(round_half_up(F.col("positives") * 100.0 / F.nullif(F.col("answered"), F.lit(0))), F.lit(0)).cast("int")
    return p.withColumn("risk", risk).withColumn("band", bin_risk(F.col("risk")))
