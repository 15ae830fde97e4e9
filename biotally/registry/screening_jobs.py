"""Registered jobs: compound rules, screening, property panel, fingerprints, catalog filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotally.functions import chem
from biotally.operators import screening as s
from biotally.reference_tables import MECHANISM_RULES, PANEL_COLUMNS, POCKET_PANEL, TARGET_COLUMNS, TARGETS, sql_values
from biotally.registry.core import job
from biotally.sources import reports
from biotally.sources import tables as t

_PANEL = sql_values("p", PANEL_COLUMNS, POCKET_PANEL)
_VIOL = "(mw > 600)::int + (logp > 5)::int + (hbd > 5)::int + (hba > 10)::int + (rotatable_bonds > 12)::int"
_STRICT = "(mw > 500)::int + (logp > 5)::int + (hbd > 5)::int + (hba > 10)::int + (rotatable_bonds > 10)::int"
_D = "::double"
_TARGETS = sql_values("ta", TARGET_COLUMNS, TARGETS)


def _boost() -> str:
    parts = []
    for mech, target, func, points in MECHANISM_RULES:
        on = f"regexp_matches(function, '{func}')" + (f" or regexp_matches(target_id, '{target}')" if target else "")
        parts.append(f"case when regexp_matches(lower(coalesce(mechanism, '')), '{mech}') and ({on}) then {points} else 0 end")
    return " + ".join(parts)


_TPSA = "12 * (hbd + 0.4::double * hba)"
_SCREEN = f"""x as (select *, radius / pocket_radius as rr, hbd + hba as donors, {_TPSA} as tp, {_VIOL} as violations, {_boost()} as boost from compounds cross join {_PANEL}),
y as (select *, round(case when rr > 1.2::double then greatest(0.0::double, 30 - (rr - 1.2::double) * 50) when rr < 0.3::double then greatest(0.0::double, rr * 100)
    when rr between 0.6::double and 0.9::double then 90 + (1 - abs(rr - 0.75::double) / 0.15::double) * 10 else 50 + (1 - abs(rr - 0.75::double) / 0.45::double) * 40 end, 9) as shape,
  cast(case when charge = 0 then 70 when charge = -pocket_charge then 100 else greatest(10, 40 - abs(charge - pocket_charge) * 20) end as double) as electrostatic,
  least(100.0::double, floor(round((1 - abs(hydrophobicity - pocket_hydrophobicity)) * 80 + case when pocket_hydrophobicity < 0.4::double then least(20.0::double, donors * 2.0::double) else 0 end
    + case when pocket_hydrophobicity > 0.6::double and hydrophobicity > 0.6::double then 10 else 0 end, 9) + 0.5)) as hydrophobic,
  cast(case when pocket_hydrophobicity > 0.7::double then case when donors <= 4 then 90 when donors <= 8 then 60 else 30 end
    when pocket_hydrophobicity < 0.3::double then case when donors between 4 and 12 then 90 when donors >= 2 then 70 else 40 end
    when donors between 3 and 8 then 80 else 60 end as double) as hbond,
  round(case when tp <= 60 then 100.0::double when tp <= 140 then 80 - (tp - 60) * 0.25::double else greatest(20.0::double, 60 - (tp - 140) * 0.3::double) end, 9) as tpsa_score,
  cast(greatest(0, least(100, 50 + case when essential then 20 else 0 end + case when contains(target_id, 'fabI') or contains(target_id, '3c') then 15 else 0 end
    + case when activity = 'antiviral' then 10 else 0 end + case when mw > 1000 then -20 else 0 end + case when mw < 250 and logp > 3 then -10 else 0 end)) as int) as selectivity from x),
z as materialized (select *, cast(floor(round(greatest(0.0::double, least(100.0::double, shape * 0.25::double + electrostatic * 0.2::double + hydrophobic * 0.2::double + hbond * 0.15::double + tpsa_score * 0.1::double
    + boost - violations * 5)), 6) + 0.5) as int) as score, violations <= 1 as lipinski_pass from y),
res as (select *, floor(round((-2 - 0.6::double * ln(1 + score * score / 10.0::double)) * 10, 9) + 0.5) / 10 as binding_affinity from z)"""
_COLS = "pathogen_id, target_id, drug_id, score, shape, electrostatic, hydrophobic, hbond, tpsa_score, boost, violations, lipinski_pass, selectivity, binding_affinity"


def _results(spark, sf):
    return s.virtual_screening(t.compounds(spark, sf), s.flatten_panel(s.pathogen_table(spark)))


@job("virtual_screening", f"with {_SCREEN} select {_COLS} from res", "compounds")
def virtual_screening(spark, sf):
    return _results(spark, sf).select(*_COLS.split(", "))


_TOP = """top as (select *, cast(row_number() over (partition by pathogen_id order by score desc, drug_id, target_id, pocket_radius) as int) as rank from res{where})"""


@job("top_results", f"with {_SCREEN}, {_TOP.format(where='')} select pathogen_id, rank, drug_id, target_id, score from top where rank <= 20", "compounds")
def top_results(spark, sf):
    return s.top_results(_results(spark, sf)).select("pathogen_id", "rank", "drug_id", "target_id", "score")


_FIELDS = {
    "drug_name": "name", "target": "target_name", "shape": "cast(floor(shape + 0.5) as bigint)", "electrostatic": "cast(floor(electrostatic + 0.5) as bigint)",
    "hydrophobic": "cast(floor(hydrophobic + 0.5) as bigint)", "dg_kcal_mol": "binding_affinity", "lipinski_pass": "case when lipinski_pass then 'pass' else 'fail' end",
    "lipinski_violations": "violations", "mechanism": "coalesce(mechanism, '')", "ru_registered": "case when registered then 'yes' else 'no' end",
}


def _field(n):
    e = f"cast({_FIELDS.get(n, n)} as varchar)"
    return f"case when regexp_matches({e}, '[,\"\\n]') then '\"' || replace({e}, '\"', '\"\"') || '\"' else {e} end"


@job(
    "screen_compounds",
    f"with {_SCREEN}, {_TOP.format(where=' where lipinski_pass')} select pathogen_id, rank, concat_ws(',', {', '.join(_field(n) for n in reports.CSV_COLUMNS)}) as line from top join {_TARGETS} using (target_id) where rank <= 50",
    "compounds",
)
def screen_compounds(spark, sf):
    """The ranked export of every pathogen: 50 best passing rows as CSV lines."""
    return reports.csv_lines(reports.ranked_table(s.top_results(_results(spark, sf), 50, lipinski_only=True)))


@job(
    "mechanism_boost",
    f"select mechanism, target_id, {_boost()} as boost, count(*) as compounds from compounds cross join {_PANEL} group by all",
    "compounds",
)
def mechanism_boost(spark, sf):
    kinds = t.compounds(spark, sf).groupBy("mechanism").agg(F.count("*").alias("compounds"))
    rows = s.with_panel(kinds, s.flatten_panel(s.pathogen_table(spark)))
    return rows.select("mechanism", "target_id", s.mechanism_boost(F.col("mechanism"), F.col("target_id"), F.col("function")).alias("boost"), "compounds")


@job(
    "check_lipinski",
    f"select drug_id, {_VIOL} as violations, {_VIOL} <= 1 as lipinski_pass, {_STRICT} as strict_violations, {_STRICT} <= 1 as strict_pass, {_TPSA} as tpsa from compounds",
    "compounds",
)
def check_lipinski(spark, sf):
    v, x = chem.lipinski_violations(), chem.lipinski_violations(strict=True)
    return t.compounds(spark, sf).select(
        "drug_id", v.alias("violations"), (v <= 1).alias("lipinski_pass"), x.alias("strict_violations"), (x <= 1).alias("strict_pass"), chem.tpsa().alias("tpsa")
    )


@job(
    "lookup_by_id",
    f"with {_SCREEN} select target_id, count(*) as compounds, max(score) as best, avg(score) as mean_score from res where pathogen_id = 'hpai' group by 1",
    "compounds",
)
def lookup_by_id(spark, sf):
    """One pathogen's panel looked up by id, screened over all compounds."""
    panel = s.flatten_panel(s.lookup_by_id(s.pathogen_table(spark), "hpai"))
    r = s.virtual_screening(t.compounds(spark, sf), panel)
    return r.groupBy("target_id").agg(F.count("*").alias("compounds"), F.max("score").alias("best"), F.avg("score").alias("mean_score"))


def _pts(*terms):
    return " + ".join(f"case when {c} then {v} else 0.0::double end" for c, v in terms)


def _cl(x, low, high):
    return f"greatest({low}::double, least({high}::double, {x}))"


_G = "contains(lower(pharm_group), '{}')"
_HERG = "round(" + _cl(_pts(("charge > 0", "0.3::double"), ("logp > 3", "0.25::double"), ("logp > 5", "0.15::double"), ("mw > 400", "0.1::double"), ("hba > 4", "0.1::double")), 0, 0.95) + ", 9)"
_AMES = "round(" + _cl("0.1::double + " + _pts((_G.format("нитро"), "0.4::double"), (_G.format("алкил"), "0.3::double"), ("logp > 4", "0.1::double"), ("charge > 0 and mw < 300", "0.15::double")), 0, 0.9) + ", 9)"
_HEPA = "round(" + _cl("0.15::double + " + _pts(("logp > 3", "0.2::double"), (_G.format("сульфан"), "0.25::double"), (_G.format("макролид"), "0.1::double"), ("mw > 500", "0.1::double")), 0, 0.9) + ", 9)"


def _whole(x, low, high):
    return _cl(f"floor(round({x}, 9) + 0.5)", low, high)


_ADMET = {
    "oral": _whole("80 + " + _pts(("mw > 500", "(mw - 500) / -10"), ("logp > 5", "(logp - 5) * -6"), ("logp < 0", "logp * 4"), ("hbd > 5", "(hbd - 5) * -4.0::double"), ("hba > 10", "(hba - 10) * -2.0::double"),
        ("rotatable_bonds > 10", "(rotatable_bonds - 10) * -3.0::double"), ("abs(charge) = 2", -15), ("abs(charge) >= 3", -30), ("mw > 1000", -20)), 5, 95),
    "bbb": "round(" + _cl(_pts(("mw < 400", 1), ("mw >= 400", "(mw - 400) / -200"), ("logp between 1 and 3", 1), ("logp > 3 and logp <= 5", "0.3::double"), ("logp < 1", "-0.5::double"), ("logp > 5", -1), ("charge <> 0", "-1.5::double"), ("hbd > 3", "-0.5::double")), -2, 2) + ", 9)",
    "caco2": "round(" + _cl(f"8 - {_TPSA} * 0.04::double + logp * 0.5::double + " + _pts(("mw > 500", -1), ("charge <> 0", -2)), 0.1, 30) + ", 9)",
    "ppb": _whole("30 + logp * 12 + " + _pts(("charge < 0", 10), ("charge > 0", -5), ("mw > 500", 5)), 5, 99),
    "vd": "round(" + _cl("case when charge < 0 then 0.2::double + logp * 0.02::double when charge > 0 then 2.0::double + logp * 0.5::double else 0.5::double + logp * 0.2::double end", 0.1, 15) + ", 9)",
    "hepatic": "round(" + _cl("0.3::double + logp * 0.1::double + " + _pts(("charge <> 0", "-0.1::double")), 0.05, 0.9) + ", 9)",
    "renal": "round(" + _cl("0.7::double - logp * 0.1::double + " + _pts(("charge <> 0", "0.15::double")), 0.05, 0.9) + ", 9)",
    "log_s": "round(0.5::double - (mw - 20) * 0.01::double - logp + " + _pts(("charge <> 0", 2)) + ", 9)",
    "herg": _HERG, "ames": _AMES, "hepatotox": _HEPA,
    "skin": "round(" + _cl("0.1::double + " + _pts(("logp > 3", "0.15::double"), ("charge > 0", "0.1::double"), (_G.format("фенол"), "0.25::double")), 0, 0.9) + ", 9)",
    "cyp_substrate": "round(" + _cl("0.2::double + " + _pts(("logp > 2 and mw > 300", "0.4::double"), ("charge > 0", "0.15::double")), 0, 0.95) + ", 9)",
    "cyp_inhibitor": "round(" + _cl("0.1::double + " + _pts(("logp > 4", "0.3::double"), (_G.format("макролид"), "0.3::double"), (_G.format("имидазол"), "0.4::double")), 0, 0.95) + ", 9)",
    "bioaccumulation": "round(" + _cl("0.05::double + logp * 0.15::double + " + _pts(("logp > 5", "0.2::double")), 0, 0.95) + ", 9)",
    "drug_likeness": _whole("100 + " + _pts(("mw > 500", "(mw - 500) / -20"), ("logp > 5", "(logp - 5) * -8"), ("logp < -1", "(logp + 1) * 8"), ("hbd > 5", "(hbd - 5) * -5.0::double"), ("hba > 10", "(hba - 10) * -3.0::double"),
        ("rotatable_bonds > 10", "(rotatable_bonds - 10) * -3.0::double"), ("abs(charge) >= 2", -10)) + f" - ({_HERG} * 20 + {_HEPA} * 15 + {_AMES} * 15)", 0, 100),
}
_PAN = "pan as materialized (select *, " + ", ".join(f"{e} as {n}" for n, e in _ADMET.items()) + " from compounds)"
_LV = {n: f"case when {'-' if n == 'log_s' else ''}{n} < {lo}::double then 'low' when {'-' if n == 'log_s' else ''}{n} > {hi}::double then 'high' else 'moderate' end" for n, (lo, hi) in chem.LEVEL_LIMITS.items()}
_ALERTS = """list_filter([case when mw > 500 then 'MW > 500' end, case when logp > 5 then 'LogP > 5' end, case when hbd > 5 then 'HBD > 5' end, case when rotatable_bonds > 10 then 'rotatable bonds > 10' end,
  case when herg > 0.5 then 'hERG risk' end, case when hepatotox > 0.5 then 'hepatotoxicity' end, case when cyp_inhibitor > 0.5 then 'CYP3A4 inhibitor' end, case when bioaccumulation > 0.6 then 'bioaccumulation' end], lambda x: x is not null)"""


def _panel(spark, sf):
    p = t.compounds(spark, sf).select("*", *[e.alias(n) for n, e in chem.admet_panel().items()])
    return p


@job("admet_panel", f"with {_PAN} select drug_id, {', '.join(_ADMET)} from pan", "compounds")
def admet_panel(spark, sf):
    return _panel(spark, sf).select("drug_id", *_ADMET)


@job("admet_report", f"with {_PAN} select drug_id, {', '.join(f'{e} as {n}_level' for n, e in _LV.items())}, drug_likeness, array_to_string({_ALERTS}, '; ') as alerts from pan", "compounds")
def admet_report(spark, sf):
    return _panel(spark, sf).select("drug_id", *[chem.panel_level(n).alias(f"{n}_level") for n in chem.LEVEL_LIMITS], "drug_likeness", F.array_join(chem.alerts(), "; ").alias("alerts"))


@job("bin_level", f"with {_PAN} select {', '.join(f'{_LV[n]} as {n}_level' for n in ('oral', 'bbb', 'herg'))}, count(*) as compounds from pan group by all", "compounds")
def bin_level(spark, sf):
    keys = [chem.panel_level(n).alias(f"{n}_level") for n in ("oral", "bbb", "herg")]
    return _panel(spark, sf).groupBy(*keys).agg(F.count("*").alias("compounds"))


@job(
    "panel_to_rows",
    f"with {_PAN}, l as (select * from {sql_values('v', ('property', 'label'), chem.PANEL_LABELS.items())}), u as (" + " union all ".join(f"select drug_id, '{n}' as property, {n} as value, {_LV[n]} as level from pan" for n in _LV) + ") select drug_id, property, label, value, level from u join l using (property)",
    "compounds",
)
def panel_to_rows(spark, sf):
    from biotally.reference_tables import fixed_table

    p = _panel(spark, sf)
    pairs = [F.struct(F.lit(n).alias("property"), F.col(n).alias("value"), chem.panel_level(n).alias("level")) for n in chem.LEVEL_LIMITS]
    labels = fixed_table(spark, ("property", "label"), chem.PANEL_LABELS.items())
    return p.select("drug_id", F.inline(F.array(*pairs))).join(F.broadcast(labels), "property")


@job("text_filter", "select drug_id, name, pharm_group from compounds where contains(lower(name), 'ring') or contains(lower(pharm_group), 'ring') order by drug_id limit 50", "compounds")
def text_filter(spark, sf):
    rows = t.compounds(spark, sf).select("drug_id", "name", "pharm_group")
    return s.text_filter(rows, "Ring ", ["name", "pharm_group"], "drug_id")


@job(
    "text_filter_array",
    "select doc_id, lang, source from (select doc_id, lang, source, string_split(text, chr(10)) as lines from documents) where contains(lower(source), 'license') or len(list_filter(lines, lambda x: contains(lower(x), 'license'))) > 0",
)
def text_filter_array(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", "lang", "source", F.split("text", "\n").alias("lines"))
    return s.text_filter_array(d, "license", ["source"], "lines").drop("lines")


@job(
    "drop_empty_groups",
    "select p_type, count(*) as parts, list_sort(list(distinct p_brand)) as brands from part where contains(lower(p_name), 'ring') group by 1",
)
def drop_empty_groups(spark, sf):
    hit = t.table(spark, sf, "part").filter(F.contains(F.lower("p_name"), F.lit("ring")))
    return hit.groupBy("p_type").agg(F.count("*").alias("parts"), F.sort_array(F.collect_set("p_brand")).alias("brands"))


@job("has_optional", "select drug_id, mechanism from compounds where mechanism is not null", "compounds")
def has_optional(spark, sf):
    return t.compounds(spark, sf).filter(F.col("mechanism").isNotNull()).select("drug_id", "mechanism")


@job("catalog_counts", "select activity, count(*) as compounds, count(mechanism) as with_mechanism from compounds group by 1", "compounds")
def catalog_counts(spark, sf):
    return t.compounds(spark, sf).groupBy("activity").agg(F.count("*").alias("compounds"), F.count("mechanism").alias("with_mechanism"))


_FP = """fp as (select mol_id, label, list_sort(list(bit)) as bits, count(*) as n_bits from fingerprints group by 1, 2),
refs as (select mol_id as ref_id, bits as ref_bits from (select *, row_number() over (partition by label order by mol_id) as r from fp) where r = 1),
tan as (select mol_id, ref_id, n_bits, case when len(list_distinct(list_concat(bits, ref_bits))) > 0 then len(list_intersect(bits, ref_bits)) / len(list_distinct(list_concat(bits, ref_bits))) else 0.0::double end as tanimoto from fp cross join refs)"""


def _references(bits):
    """The known ligand of a family is its first molecule."""
    first = bits.groupBy("label").agg(F.min("mol_id").alias("mol_id")).select("mol_id").distinct()
    return bits.join(first, "mol_id", "left_semi").select("mol_id", "bit")


@job("similar_ligands", f"with {_FP} select mol_id, ref_id, tanimoto from tan where tanimoto >= 0.4", "fingerprints")
def similar_ligands(spark, sf):
    """Known ligands at a similarity of 0.4 or more."""
    bits = t.fingerprints(spark, sf)
    return s.similar_references(bits.select("mol_id", "bit"), _references(bits), 0.4)


@job("nearest_ligands", f"with {_FP} select mol_id, ref_id, tanimoto, cast(rank as int) as rank from (select *, row_number() over (partition by mol_id order by tanimoto desc, ref_id) as rank from tan where tanimoto >= 0.3::double) where rank <= 3", "fingerprints")
def nearest_ligands(spark, sf):
    """The three most similar known ligands from 0.3 upwards."""
    bits = t.fingerprints(spark, sf)
    return s.similar_references(bits.select("mol_id", "bit"), _references(bits), 0.3, 3)


def _tanimoto(spark, sf):
    packed = s.pack_fingerprint(t.fingerprints(spark, sf), "mol_id", "label")
    first = packed.groupBy("label").agg(F.min(F.struct("mol_id", "fp")).alias("m")).select("m.mol_id", "m.fp")
    return s.tanimoto_to_references(packed, first)


@job("tanimoto_join", f"with {_FP} select mol_id, ref_id, n_bits, tanimoto from tan", "fingerprints")
def tanimoto_join(spark, sf):
    return _tanimoto(spark, sf).select("mol_id", "ref_id", "n_bits", "tanimoto")


@job("tanimoto_pairs", f"with {_FP} select mol_id, ref_id, n_bits, tanimoto from tan", "fingerprints")
def tanimoto_pairs(spark, sf):
    """Every molecule against every known ligand."""
    return _tanimoto(spark, sf).select("mol_id", "ref_id", "n_bits", "tanimoto")


_LIK = "greatest(0.0::double, least(100.0::double, floor(round(100.0::double + " + _pts(("mw > 500", "(mw - 500) / -10"), ("logp > 5", "(logp - 5) * -8"), ("logp < -1", "(logp + 1) * 8"), ("hbd > 5", "(hbd - 5) * -5.0::double"), ("hba > 10", "(hba - 10) * -3.0::double"), (f"{_TPSA} > 140", f"({_TPSA} - 140) / -5")) + ", 9) + 0.5)))"


@job(
    "ligand_score",
    f"""with {_FP}, bt as (select mol_id, max(tanimoto) as tanimoto from tan group by 1), k as (select drug_id, tanimoto, {_LIK} as likeness, {_STRICT} <= 1 as strict_pass from compounds join bt on bt.mol_id = drug_id)
    select drug_id, tanimoto, likeness, strict_pass, -5 - tanimoto * 5 - likeness / 100 * 3 as affinity,
    cast(greatest(0, least(100, floor(round(tanimoto * 40 + likeness * 0.3::double + case when strict_pass then 30.0::double else 15.0::double end, 6) + 0.5))) as int) as ligand_score from k""",
    "compounds fingerprints",
)
def ligand_score(spark, sf):
    best = _tanimoto(spark, sf).groupBy(F.col("mol_id").alias("drug_id")).agg(F.max("tanimoto").alias("tanimoto"))
    d = t.compounds(spark, sf).join(best, "drug_id")
    return d.select("drug_id", "tanimoto", *[c.alias(n) for n, c in s.ligand_score(F.col("tanimoto")).items()])


_RINGS = "cast((drug_id * 3) % 7 as int)"  # the tables have no rings
_ALERTS = {"logp > 5": "LogP > 5: poor solubility", f"{_TPSA} > 140": "TPSA > 140: poor bioavailability", "rotatable_bonds > 10": "rotatable bonds > 10: low oral bioavailability", f"{_RINGS} > 4": "aromatic rings > 4: may interfere with assays"}


@job("ligand_alerts", "select drug_id, array_to_string(list_filter([" + ", ".join(f"case when {test} then '{text}' end" for test, text in _ALERTS.items()) + "], lambda x: x is not null), '; ') as alerts from compounds", "compounds")
def ligand_alerts(spark, sf):
    d = t.compounds(spark, sf).withColumn("aromatic_rings", F.expr(_RINGS))
    return d.select("drug_id", F.array_join(s.ligand_alerts(), "; ").alias("alerts"))
