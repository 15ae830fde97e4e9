"""Outbreak report of every cluster at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotally.operators import clock, pairs, resistance, tree
from biotally.reference_tables import MOTIF_RULES
from biotally.session import cut_lineage


def label_clusters(isolates: DataFrame, cluster: str = "cluster", name: str = "label") -> DataFrame:
    """Pathogen guess and clock rate per cluster from the first rule that matches any isolate's label."""
    # Priority of the best rule per cluster: the joined labels of a cluster never meet in one string.
    from biotally.reference_tables import PATHOGEN_RULES

    lowered = F.lower(F.col(name))
    prio = F.coalesce(*[F.when(F.regexp_like(lowered, F.lit(p)), F.lit(i)) for i, (_, p) in enumerate(PATHOGEN_RULES)])
    names = F.array(*[F.lit(n) for n, _ in PATHOGEN_RULES])
    best = isolates.groupBy(cluster).agg(F.min(prio).alias("prio")).select(cluster, F.get(names, F.col("prio")).alias("pathogen"))
    return clock.clock_rate_join(best, cluster)


def timed_pairs(isolates: DataFrame, cluster: str = "cluster", key: str = "isolate_id", min_length: int = 10, each: tuple[str, ...] = ()) -> DataFrame:
    """Pair distances with identity and divergence time at the cluster's clock rate."""
    labelled = isolates.select(cluster, key, "seq", *each).join(label_clusters(isolates, cluster), cluster)
    d = pairs.pair_distances(labelled, cluster, key, min_length, carry=("pathogen", "rate"), each=each)
    return d.withColumn("identity", (1 - F.col("d")) * 100).withColumn("years", F.col("d") / (2 * F.col("rate")))


MIN_LENGTH = 10  # shorter isolates are leaves of the tree and take no part in the pair list


def outbreak_pairs(isolates: DataFrame, cluster: str = "cluster", key: str = "isolate_id") -> DataFrame:
    """The pair list of every cluster, closest pairs first: rows, sorted by ranges of the whole table."""
    d = timed_pairs(isolates, cluster, key, MIN_LENGTH)
    return d.select(cluster, "a", "b", "d", "identity", "years", "pathogen").orderBy(cluster, "d", "a", "b")


def outbreak_report(isolates: DataFrame, cluster: str = "cluster", key: str = "isolate_id", motifs=MOTIF_RULES) -> DataFrame:
    """Per cluster: isolates, pairs, closest pair, time to the nearest common ancestor, resistance counts and the tree.

    Isolates and then pairs are written once and read for each part. The tree joins all isolates by average linkage;
    isolates shorter than ``MIN_LENGTH`` are left out of the pair list only. A cluster of one isolate has no pair: its
    distances are null, its tree is one leaf.
    """
    isolates = cut_lineage(isolates.select(cluster, key, "label", "seq").withColumn("long_enough", F.length("seq") >= MIN_LENGTH))
    timed = timed_pairs(isolates, cluster, key, 0, each=("long_enough",))
    listed = cut_lineage(timed.select(cluster, "a", "b", "d", "identity", "years", "a_long_enough", "b_long_enough"))
    pair_part = listed.filter("a_long_enough and b_long_enough").groupBy(cluster).agg(
        F.count("*").alias("pairs"),
        F.min(F.when(F.col("years") > 0, F.col("years"))).alias("tmrca"),
        F.min(F.struct("d", "a", "b", "identity", "years")).alias("closest"),
    )
    trees = tree.cluster_tree(listed, cluster)[0].select(cluster, F.col("leaves").alias("tree_leaves"), F.col("max_depth").alias("tree_depth"), "newick")
    lone = F.concat(F.min(F.col(key).cast("string")), F.lit(":0.000;"))
    alone = isolates.groupBy(cluster).agg(F.count("*").alias("n"), lone.alias("lone")).filter("n = 1").select(cluster, "lone")
    counted = outbreak_counts(isolates, cluster, key, motifs).join(label_clusters(isolates, cluster), cluster)
    report = counted.join(pair_part, cluster, "left").join(trees, cluster, "left").join(alone, cluster, "left")
    return report.na.fill(0, ["pairs"]).select(
        cluster, "isolates", "pairs", "pathogen", "rate", "tmrca", F.when(F.col("pairs") > 0, clock.bin_divergence(F.col("tmrca"))).alias("divergence"),
        F.col("closest.a").alias("closest_a"), F.col("closest.b").alias("closest_b"), F.col("closest.d").alias("closest_d"),
        F.col("closest.identity").alias("closest_identity"), F.col("closest.years").alias("closest_years"), "resistant_isolates", "motif_hits", "mutation_hits",
        F.coalesce("tree_leaves", F.lit(1)).cast("long").alias("tree_leaves"), F.coalesce("tree_depth", F.lit(0.0)).alias("tree_depth"), F.coalesce("newick", "lone").alias("newick"),
    )


def outbreak_counts(isolates: DataFrame, cluster: str = "cluster", key: str = "isolate_id", motifs=MOTIF_RULES) -> DataFrame:
    """Isolates of each cluster and their resistance hits; no pair is looked at."""
    hits = resistance.all_hits(isolates.select(key, "seq"), key, motifs).groupBy(key).agg(
        F.count_if(F.col("kind") == "motif").alias("motifs"), F.count_if(F.col("kind") == "mutation").alias("mutations")
    )
    return (
        isolates.select(cluster, key)
        .join(hits, key, "left")
        .na.fill(0, ["motifs", "mutations"])
        .groupBy(cluster)
        .agg(
            F.count("*").alias("isolates"),
            F.count_if(F.col("motifs") > 0).alias("resistant_isolates"),
            F.sum("motifs").alias("motif_hits"),
            F.sum("mutations").alias("mutation_hits"),
        )
    )


def report_lines(report: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Summary messages of a report, one row per line."""
    tm = F.col("tmrca")
    lines = F.array_compact(
        F.array(
            F.when(tm.isNotNull(), F.concat(F.lit("TMRCA ~"), F.format_string("%.1f", clock.half_up(tm, 1)), F.lit(" years: "), "divergence")),
            F.when(
                F.col("resistant_isolates") > 0,
                F.concat("resistant_isolates", F.lit(" of "), "isolates", F.lit(" isolates carry resistance genes ("), "motif_hits", F.lit(" in total)")),
            ).otherwise("no resistance genes found"),
            F.concat(F.lit("tree: "), "tree_leaves", F.lit(" leaves")),
            F.concat(F.lit("closest pair: "), "closest_a", F.lit(" - "), "closest_b", F.lit(" (identity "), F.format_string("%.1f", clock.half_up(F.col("closest_identity"), 1)), F.lit("%, ~"), F.format_string("%.1f", clock.half_up(F.col("closest_years"), 1)), F.lit(" years)")),
        )
    )
    return report.select(cluster, F.posexplode(lines).alias("line_no", "line"))
