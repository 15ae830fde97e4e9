"""Pathogen names, clock rates and divergence times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotally.reference_tables import CLOCK_RATES, DEFAULT_CLOCK_RATE, PATHOGEN_RULES, fixed_table


def first_match_rule(rows: DataFrame, key: str, text: str, rules=PATHOGEN_RULES, out: str = "label") -> DataFrame:
    """Label of the first rule whose pattern occurs in the text; null without a match."""
    lowered = F.lower(F.col(text))
    tests = [F.when(F.regexp_like(lowered, F.lit(pattern)), F.lit(name)) for name, pattern in rules]
    return rows.withColumn(out, F.coalesce(*tests))


def clock_rate_join(rows: DataFrame, key: str, label: str = "pathogen") -> DataFrame:
    """First rate whose organism contains the label's first word; the default rate otherwise."""
    rates = fixed_table(rows.sparkSession, ("ord", "organism", "rate"), [(i, o, r) for i, (_, o, r) in enumerate(CLOCK_RATES)])
    word = F.lower(F.substring_index(F.col(label), " ", 1))
    labels = rows.select(label).distinct()
    matched = (
        labels.join(F.broadcast(rates), F.contains(F.lower("organism"), word), "left")
        .groupBy(label)
        .agg(F.min_by("rate", "ord").alias("found"))
    )
    joined = rows.join(matched, rows[label].eqNullSafe(matched[label]), "left").drop(matched[label])
    return joined.withColumn("rate", F.coalesce("found", F.lit(DEFAULT_CLOCK_RATE))).drop("found")


def divergence_time(d: Column, rate: Column, se: Column) -> dict[str, Column]:
    """Years since the split, with the 95 % bounds of a distance's standard error, floored at 0."""
    years, half = d / (2 * rate), 1.96 * se / (2 * rate)
    return {"years": years, "upper": years + half, "lower": F.greatest(F.lit(0.0), years - half)}


def half_up(x: Column, digits: int) -> Column:
    """Halves go up before formatting, whatever the binary value of the decimal is."""
    return F.floor(x * 10**digits + F.lit(0.5)) / 10**digits


def human_duration(years: Column) -> Column:
    f = lambda x, unit, digits=1: F.concat(F.format_string(f"%.{digits}f", half_up(x, digits)), F.lit(unit))
    return (
        F.when(years < 1, f(years * 365, " days"))
        .when(years < 100, f(years, " years"))
        .when(years < 1000, F.concat(f(years, " years (~", 0), f(years / 30, " generations)", 0)))
        .when(years < 1e6, f(years / 1e3, " thousand years"))
        .when(years < 1e9, f(years / 1e6, " million years"))
        .otherwise(f(years / 1e9, " billion years"))
    )


def bin_divergence(years: Column) -> Column:
    return F.when(years < 0.5, "recent outbreak").when(years < 2, "recent introduction").otherwise("separate lineages")
