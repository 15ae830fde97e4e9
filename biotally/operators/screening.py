"""Compound screening against a pocket panel, fingerprints and text filters over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biotally.functions import chem
from biotally.functions.sequence import round_half_up
from biotally.reference_tables import MECHANISM_RULES, PANEL_COLUMNS, POCKET_PANEL, fixed_table
from biotally.session import spread


def pathogen_table(spark: SparkSession) -> DataFrame:
    """The panel as pathogen rows with nested targets and pockets."""
    flat = fixed_table(spark, PANEL_COLUMNS, POCKET_PANEL)
    pocket = F.struct(F.col("pocket_radius").alias("radius"), F.col("pocket_charge").alias("charge"), F.col("pocket_hydrophobicity").alias("hydrophobicity"))
    targets = flat.groupBy("pathogen_id", "kind", "target_id", "function", "essential").agg(F.collect_list(pocket).alias("pockets"))
    return targets.groupBy("pathogen_id", "kind").agg(F.collect_list(F.struct("target_id", "function", "essential", "pockets")).alias("targets"))


def flatten_panel(pathogens: DataFrame) -> DataFrame:
    """Pathogen -> targets -> pockets, one row per pocket."""
    t = pathogens.select("pathogen_id", "kind", F.inline("targets"))
    return t.select("pathogen_id", "kind", "target_id", "function", "essential", F.inline("pockets")).withColumnsRenamed(
        {"radius": "pocket_radius", "charge": "pocket_charge", "hydrophobicity": "pocket_hydrophobicity"}
    )


def lookup_by_id(pathogens: DataFrame, pathogen_id: str) -> DataFrame:
    return pathogens.filter(F.col("pathogen_id") == pathogen_id)


def mechanism_mask(mechanism: Column) -> Column:
    """A bit for each mechanism rule whose pattern occurs in a compound's mechanism."""
    text = F.lower(F.coalesce(mechanism, F.lit("")))
    return _mask([F.regexp_like(text, F.lit(pattern)) for pattern, _, _, _ in MECHANISM_RULES])


def target_mask(target: Column, function: Column) -> Column:
    """A bit for each mechanism rule whose target pattern, or function pattern, occurs in a pocket's target."""
    function = F.lower(function)
    on = [F.regexp_like(function, F.lit(func)) | (F.regexp_like(target, F.lit(name)) if name else F.lit(False)) for _, name, func, _ in MECHANISM_RULES]
    return _mask(on)


def _mask(bits: list[Column]) -> Column:
    total = F.lit(0)
    for k, bit in enumerate(bits):
        total = total + F.when(bit, 1 << k).otherwise(0)
    return total


def rule_points(mask: Column) -> Column:
    """Points of the mechanism rules whose bits are set."""
    total = F.lit(0)
    for k, (_, _, _, points) in enumerate(MECHANISM_RULES):
        total = total + F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, points).otherwise(0)
    return total


def mechanism_boost(mechanism: Column, target: Column, function: Column) -> Column:
    """Points of every rule whose mechanism pattern and target (or function) pattern both occur."""
    return rule_points(mechanism_mask(mechanism).bitwiseAND(target_mask(target, function)))


def with_panel(compounds: DataFrame, panel: DataFrame) -> DataFrame:
    """Each compound with every pocket of the panel.

    The panel is a fixed table: it is carried as one array value (a scalar subquery) that every compound row unfolds,
    so compounds stay where they are and nothing runs while the query is built.
    """
    cols = [c for c in panel.columns if c not in compounds.columns]
    packed = panel.agg(F.collect_list(F.struct(*cols)).alias("pockets"))
    return compounds.withColumn("pockets", packed.scalar()).select(*compounds.columns, F.inline("pockets"))


def compound_side(compounds: DataFrame) -> DataFrame:
    """What a screening score takes from the compound alone, found once a compound: rules, polar surface, mechanism bits."""
    violations = chem.lipinski_violations()
    return compounds.select(
        "*", (F.col("hbd") + F.col("hba")).alias("donors"), violations.alias("violations"), (violations <= 1).alias("lipinski_pass"), chem.tpsa_score(chem.tpsa()).alias("tpsa_score"),
        mechanism_mask(F.col("mechanism")).alias("mechanism_bits"), chem.compound_selectivity().alias("compound_selectivity"),
    )


def pocket_side(panel: DataFrame) -> DataFrame:
    """What a screening score takes from the pocket alone."""
    return panel.select("*", target_mask(F.col("target_id"), F.col("function")).alias("target_bits"), chem.target_selectivity().alias("target_selectivity"))


def score_pockets(pairs: DataFrame) -> DataFrame:
    """Five weighted scores, mechanism boost and rule penalty of pairs of `compound_side` and `pocket_side`: arithmetic only."""
    c = F.col
    scored = pairs.select(
        "*",
        chem.shape_score(c("radius"), c("pocket_radius")).alias("shape"),
        chem.electrostatic_score(c("charge"), c("pocket_charge")).alias("electrostatic"),
        chem.hydrophobic_score(c("hydrophobicity"), c("donors"), c("pocket_hydrophobicity")).alias("hydrophobic"),
        chem.hbond_score(c("donors"), c("pocket_hydrophobicity")).alias("hbond"),
        rule_points(c("mechanism_bits").bitwiseAND(c("target_bits"))).alias("boost"),
        chem.selectivity_index(c("compound_selectivity"), c("target_selectivity")).alias("selectivity"),
    )
    raw = c("shape") * 0.25 + c("electrostatic") * 0.2 + c("hydrophobic") * 0.2 + c("hbond") * 0.15 + c("tpsa_score") * 0.1 + c("boost") - c("violations") * 5
    score = round_half_up(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 6)).cast("int")
    return scored.withColumn("score", score).withColumn("binding_affinity", chem.binding_affinity(c("score")))


def virtual_screening(compounds: DataFrame, panel: DataFrame, key: str = "drug_id") -> DataFrame:
    """Every compound against every pocket; compounds are dealt evenly before each becomes as many rows as there are pockets."""
    compounds = spread(compounds, key)
    return score_pockets(with_panel(compound_side(compounds), pocket_side(panel)))


def top_results(results: DataFrame, n: int = 20, lipinski_only: bool = False, by: str = "pathogen_id") -> DataFrame:
    """The n best rows of each pathogen; each task keeps at most n per pathogen before anything is exchanged."""
    rows = results.filter("lipinski_pass") if lipinski_only else results
    w = Window.partitionBy(by).orderBy(F.desc("score"), "drug_id", "target_id", "pocket_radius")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def text_filter(rows: DataFrame, query: str, cols: list[str], order: str, limit: int = 50) -> DataFrame:
    """Case-insensitive substring over several columns, first 50 in key order."""
    q = query.lower().strip()
    hit = F.lit(q == "")
    for c in cols:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(q))
    return rows.filter(hit).orderBy(order).limit(limit)


def text_filter_array(rows: DataFrame, query: str, cols: list[str], array: str) -> DataFrame:
    """The same, also on any element of a string array; no limit."""
    q = query.lower()
    hit = F.exists(array, lambda x: F.contains(F.lower(x), F.lit(q)))
    for c in cols:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(q))
    return rows.filter(hit)


def pack_fingerprint(bits: DataFrame, *keys: str) -> DataFrame:
    """Set bits (1..64) of a molecule as one long and their number."""
    one = F.when(F.col("bit") == 64, F.lit(-(2**63))).otherwise(F.expr("shiftleft(1L, bit - 1)"))
    return bits.groupBy(*keys).agg(F.bit_or(one).alias("fp"), F.count("*").alias("n_bits"))


def tanimoto(a: Column, b: Column) -> Column:
    both = F.bit_count(a.bitwiseAND(b))
    either = F.bit_count(a.bitwiseOR(b))
    return F.when(either > 0, both / either).otherwise(0.0)


def tanimoto_to_references(packed: DataFrame, references: DataFrame, block: int = 256) -> DataFrame:
    """Similarity of every molecule to each known ligand: as many rows as there are pairs.

    Ligands are dealt by hash over blocks of about ``block``; a block is one array value that a molecule unfolds. The
    number of blocks is a subquery of the plan: nothing runs while the query is built.
    """
    blocks = references.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks")).scalar()
    held = references.select(F.pmod(F.xxhash64("mol_id"), blocks).cast("int").alias("block"), F.struct(F.col("mol_id").alias("ref_id"), F.col("fp").alias("ref_fp")).alias("ref"))
    held = held.groupBy("block").agg(F.collect_list("ref").alias("refs"))
    rows = packed.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).join(held, "block").select(*packed.columns, F.inline("refs"))
    return rows.withColumn("tanimoto", tanimoto(F.col("fp"), F.col("ref_fp")))


def _rare_first(bits: DataFrame, references: DataFrame) -> DataFrame:
    """(mol_id, n_bits, rare): a molecule's bits, the rarest among the references first; a row has no more than there are bits."""
    rank = references.groupBy("bit").agg(F.count("*").alias("n"))
    ranked = bits.join(rank, "bit", "left").withColumn("order", F.struct(F.coalesce("n", F.lit(0)), "bit"))
    return ranked.groupBy("mol_id").agg(F.count("*").cast("int").alias("n_bits"), F.transform(F.array_sort(F.collect_list("order")), lambda x: x["bit"]).alias("rare"))


def similar_references(bits: DataFrame, references: DataFrame, threshold: float, k: int | None = None) -> DataFrame:
    """(mol_id, ref_id, tanimoto) of every molecule and reference at ``threshold`` or more, or the best ``k`` of a molecule.

    ``bits`` and ``references`` hold (mol_id, bit), a row a set bit. An inverted index: two sets of a and b bits that are
    that similar share a bit among the first a - ceil(t * a) + 1 of one and b - ceil(t * b) + 1 of the other, rarest
    first, and t * a <= b <= a / t. References wait under (bit, number of bits), molecules ask for each bit of theirs and
    each number in reach. A pair counts where it meets first, so no pair is made twice. Molecules without a bit have none.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is 1 at most")
    t = F.lit(threshold)
    least = lambda n: F.greatest(F.lit(1), F.ceil(t * n - 1e-9)).cast("int")
    prefix = lambda rare, n: F.slice(rare, 1, n - least(n) + 1)
    index = _rare_first(references, references).select(F.col("mol_id").alias("ref_id"), F.col("n_bits").alias("ref_bits"), F.col("rare").alias("ref_rare"))
    index = index.withColumn("key", F.explode(prefix(F.col("ref_rare"), F.col("ref_bits"))))
    asked = _rare_first(bits, references).withColumn("key", F.explode(prefix(F.col("rare"), F.col("n_bits"))))
    asked = asked.withColumn("ref_bits", F.explode(F.sequence(least(F.col("n_bits")), F.floor(F.col("n_bits") / t + 1e-9).cast("int"))))
    met = asked.join(index, ["key", "ref_bits"])
    shared = F.array_intersect("rare", "ref_rare")
    first = F.element_at(F.array_intersect(prefix(F.col("rare"), F.col("n_bits")), prefix(F.col("ref_rare"), F.col("ref_bits"))), 1)
    met = met.withColumn("both", F.size(shared)).filter(F.col("key") == first)
    found = met.select("mol_id", "ref_id", (F.col("both") / (F.col("n_bits") + F.col("ref_bits") - F.col("both"))).alias("tanimoto")).filter(F.col("tanimoto") >= t)
    if k is None:
        return found
    place = F.row_number().over(Window.partitionBy("mol_id").orderBy(F.desc("tanimoto"), "ref_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def ligand_alerts() -> Column:
    """Messages for the limits that a ligand fails, over descriptor columns; unknown values fail none."""
    tests = (
        (F.col("logp") > 5, "LogP > 5: poor solubility"), (chem.tpsa() > 140, "TPSA > 140: poor bioavailability"),
        (F.col("rotatable_bonds") > 10, "rotatable bonds > 10: low oral bioavailability"), (F.col("aromatic_rings") > 4, "aromatic rings > 4: may interfere with assays"),
    )
    return F.array_compact(F.array(*[F.when(failed, F.lit(text)) for failed, text in tests]))


def ligand_score(similarity: Column) -> dict[str, Column]:
    """Similarity .4, drug-likeness .3, strict rules .3, over descriptor columns."""
    c = F.col
    t = chem.tpsa()
    likeness = 100.0 + chem._points(
        (c("mw") > 500, (c("mw") - 500) / -10), (c("logp") > 5, (c("logp") - 5) * -8), (c("logp") < -1, (c("logp") + 1) * 8), (c("hbd") > 5, (c("hbd") - 5) * -5.0),
        (c("hba") > 10, (c("hba") - 10) * -3.0), (t > 140, (t - 140) / -5),
    )
    likeness = F.greatest(F.lit(0.0), F.least(F.lit(100.0), round_half_up(F.round(likeness, 9)).cast("double")))
    passed = chem.lipinski_violations(strict=True) <= 1
    score = similarity * 40 + likeness * 0.3 + F.when(passed, 30.0).otherwise(15.0)
    return {
        "likeness": likeness, "strict_pass": passed, "affinity": -5 - similarity * 5 - likeness / 100 * 3,
        "ligand_score": F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(F.round(score, 6)).cast("int"))),
    }
