"""Plate statistics, cut-offs, ROC curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotally.functions.sequence import number
from biotally.session import cut_lineage


def read_readings(text: Column) -> Column:
    """Numbers of a free text split at commas, blanks and line breaks; other tokens are dropped."""
    tokens = F.split(text, "[\\n,\\s]+")
    return F.filter(F.transform(tokens, number), lambda v: v.isNotNull())


def plate_stats(wells: DataFrame, plate: str = "plate") -> DataFrame:
    """Mean, sample SD (0 below two wells) and CV % of the negative controls."""
    s = wells.filter("control = 'neg'").groupBy(plate).agg(F.avg("od").alias("mean_neg"), F.coalesce(F.stddev_samp("od"), F.lit(0.0)).alias("sd_neg"))
    return s.withColumn("cv_percent", F.when(F.col("mean_neg") > 0, F.col("sd_neg") / F.col("mean_neg") * 100).otherwise(0.0))


def plate_cutoffs(stats: DataFrame, method: str = "2SD") -> DataFrame:
    two, three = F.col("mean_neg") + F.col("sd_neg") * 2, F.col("mean_neg") + F.col("sd_neg") * 3
    return stats.withColumn("cutoff_2sd", two).withColumn("cutoff_3sd", three).withColumn("cutoff", two if method == "2SD" else three)


def all_wells(negatives: DataFrame, positives: DataFrame) -> DataFrame:
    return negatives.withColumn("control", F.lit("neg")).unionByName(positives.withColumn("control", F.lit("pos")))


def classify_wells(wells: DataFrame, cutoffs: DataFrame, plate: str = "plate") -> DataFrame:
    """Counts at or above and below the cut-off over controls, with sensitivity and specificity.

    Only one row per plate joins back, so a plate with very many wells stays spread over its tasks.
    """
    j = wells.filter("control in ('neg', 'pos')").join(cutoffs.select(plate, "cutoff"), plate)
    pos, neg, above = F.col("control") == "pos", F.col("control") == "neg", F.col("od") >= F.col("cutoff")
    share = lambda hit, of: F.count_if(hit) * 100.0 / F.nullif(F.count_if(of), F.lit(0))
    return j.groupBy(plate).agg(
        F.count_if(above).alias("positive"), F.count_if(~above).alias("negative"),
        share(pos & above, pos).alias("sensitivity"), share(neg & ~above, neg).alias("specificity"),
    )


def roc_points(wells: DataFrame, plate: str = "plate", value: str = "od", label: str = "control") -> DataFrame:
    """True and false positive rate at every distinct cut-off, one pass over the distinct values.

    Wells collapse to distinct values, which are dealt by ranges of (plate, value) cut at quantiles of the values that
    occur, so ranges hold about as many whatever the values are. The running count above a value is a carried sum of the
    higher ranges of its plate, a row each, plus a sum inside the range. The ranges are written: ``slice`` stays the same.
    """
    w = wells.filter(F.col(label).isin("pos", "neg"))
    counts = w.groupBy(plate, F.col(value).alias("cutoff")).agg(F.count_if(F.col(label) == "pos").alias("p"), F.count_if(F.col(label) == "neg").alias("n"))
    cut = cut_lineage(counts.repartitionByRange(plate, "cutoff").withColumn("slice", F.spark_partition_id()))
    per_slice = cut.groupBy(plate, "slice").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    every, higher = Window.partitionBy(plate), Window.partitionBy(plate).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"bp": F.coalesce(F.sum("sp").over(higher), F.lit(0)), "bn": F.coalesce(F.sum("sn").over(higher), F.lit(0)), "np": F.sum("sp").over(every), "nn": F.sum("sn").over(every)}
    before = per_slice.select(plate, "slice", *[c.alias(n) for n, c in sums.items()])
    inside = Window.partitionBy(plate, "slice").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.join(before, [plate, "slice"])
    tpr = (F.sum("p").over(inside) + F.col("bp")) / F.nullif(F.col("np"), F.lit(0))
    fpr = (F.sum("n").over(inside) + F.col("bn")) / F.nullif(F.col("nn"), F.lit(0))
    return run.select(plate, "slice", "cutoff", tpr.alias("tpr"), fpr.alias("fpr"))


def roc_auc(points: DataFrame, plate: str = "plate") -> DataFrame:
    """Trapezoids over the curve from (0, 0): within the ranges of values, then one step between the ends of the ranges."""
    step = lambda w: (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    inside = Window.partitionBy(plate, "slice").orderBy("fpr", "tpr")
    parts = points.withColumn("area", step(inside)).groupBy(plate, "slice").agg(
        F.sum("area").alias("area"), F.min(F.struct("fpr", "tpr")).alias("first"), F.max(F.struct("fpr", "tpr")).alias("last")
    )
    across = Window.partitionBy(plate).orderBy(F.desc("slice"))
    prev_f, prev_t = F.coalesce(F.lag("last.fpr").over(across), F.lit(0.0)), F.coalesce(F.lag("last.tpr").over(across), F.lit(0.0))
    joint = (F.col("first.fpr") - prev_f) * (F.col("first.tpr") + prev_t) / 2
    return parts.withColumn("joint", joint).groupBy(plate).agg((F.coalesce(F.sum("area"), F.lit(0.0)) + F.sum("joint")).alias("auc"))


def plate_report(wells: DataFrame, plate: str = "plate", method: str = "2SD") -> DataFrame:
    cutoffs = plate_cutoffs(plate_stats(wells, plate), method)
    return cutoffs.join(classify_wells(wells, cutoffs, plate), plate).join(roc_auc(roc_points(wells, plate), plate), plate, "left")
