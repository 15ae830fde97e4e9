"""Sinks: ranked CSV and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotally.reference_tables import TARGETS

CSV_COLUMNS = (
    "rank", "drug_name", "inn", "pharm_group", "mechanism", "target", "pdb_id", "score", "shape", "electrostatic", "hydrophobic", "dg_kcal_mol",
    "lipinski_pass", "lipinski_violations", "selectivity", "mw", "logp", "hbd", "hba", "charge", "ru_registered",
)


def csv_field(c: Column) -> Column:
    """Quoted only when it holds a comma, a quote or a line break; quotes doubled."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.regexp_like(s, F.lit('[,"\n]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def ranked_table(ranked: DataFrame) -> DataFrame:
    """The 21 export columns of a ranked screening table; flags as pass/fail and yes/no.

    A target goes by its name and has the PDB id of its structure; one that is not in the fixed table keeps its id and has none.
    """
    c = F.col
    fixed = lambda k: F.create_map(*[F.lit(x) for row in TARGETS for x in (row[0], row[k])])
    of_target = lambda k: F.try_element_at(fixed(k), c("target_id"))
    whole = lambda n: F.floor(c(n) + 0.5)
    values = {
        "drug_name": c("name"), "target": F.coalesce(of_target(1), c("target_id")), "pdb_id": F.coalesce(of_target(2), F.lit("")), "shape": whole("shape"), "electrostatic": whole("electrostatic"),
        "hydrophobic": whole("hydrophobic"), "dg_kcal_mol": c("binding_affinity"), "lipinski_pass": F.when(c("lipinski_pass"), "pass").otherwise("fail"),
        "lipinski_violations": c("violations"), "mechanism": F.coalesce("mechanism", F.lit("")), "ru_registered": F.when(c("registered"), "yes").otherwise("no"),
    }
    return ranked.select("pathogen_id", *[values.get(n, c(n)).alias(n) for n in CSV_COLUMNS])


def csv_lines(table: DataFrame, key: str = "pathogen_id") -> DataFrame:
    return table.select(key, "rank", F.concat_ws(",", *[csv_field(F.col(n)) for n in CSV_COLUMNS]).alias("line"))


def write_ranked_csv(table: DataFrame, path: str) -> None:
    """One folder per pathogen, header in each file."""
    table.write.partitionBy("pathogen_id").option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_text_report(lines: DataFrame, path: str, key: str) -> None:
    """Text lines, one folder per key."""
    lines.select(key, "value").write.partitionBy(key).mode("overwrite").text(path)
