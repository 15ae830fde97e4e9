"""Registered jobs: codon usage, adaptation and species names."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotally.operators import codons
from biotally.reference_tables import CLONING_SITES, CODON_RESIDUES, DEFAULT_SPECIES, SPECIES_ALIASES, sql_values
from biotally.registry.core import job
from biotally.registry.oracle_views import windows_sql
from biotally.session import cut_lineage, spread
from biotally.sources import tables as t


def _cds(spark, sf):
    return t.isolates(spark, sf).select("isolate_id", F.col("location").alias("species"), "seq")


def _aa(c: str) -> str:
    return f"substr('{CODON_RESIDUES}', cast((instr('TCAG', substr({c}, 1, 1)) - 1) * 16 + (instr('TCAG', substr({c}, 2, 1)) - 1) * 4 + instr('TCAG', substr({c}, 3, 1)) as int), 1)"


_COD = (
    windows_sql("w3", "isolates", "isolate_id", 3, extra="location")
    + f""",
cod as materialized (select isolate_id, location as species, i, w as codon, {_aa('w')} as aa from w3 where (i - 1) % 3 = 0),
usage as materialized (select species, codon, aa, n, n / sum(n) over (partition by species, aa) as fraction from
  (select species, codon, aa, count(*) as n from cod group by 1, 2, 3)),
pref as materialized (select species, aa, codon, fraction from (select *, row_number() over (partition by species, aa order by fraction desc, codon desc) as r from usage) where r = 1)"""
)


@job("codon_usage", f"with {_COD} select species, codon, aa, n, fraction from usage", "isolates")
def codon_usage(spark, sf):
    return codons.codon_usage(_cds(spark, sf))


@job("preferred_codon", f"with {_COD} select * from pref", "isolates")
def preferred_codon(spark, sf):
    return codons.preferred_codon(codons.codon_usage(_cds(spark, sf)))


_CAI = """cai as (select isolate_id, exp(avg(ln(u.fraction / p.fraction))) as cai from cod c join usage u using (species, codon) join pref p on p.species = c.species and p.aa = c.aa
  where c.aa <> '*' group by 1)"""


@job("cai", f"with {_COD}, {_CAI} select * from cai", "isolates")
def cai(spark, sf):
    counts = codons.codon_counts(spread(_cds(spark, sf), "isolate_id"), "isolate_id", "species")
    return codons.adaptation_index(counts, cut_lineage(codons.usage_of_counts(counts)), "isolate_id")


def _sites(col: str) -> str:
    return "list_filter([" + ", ".join(f"case when contains({col}, '{w}') then '{w}' end" for w in CLONING_SITES) + "], lambda x: x is not null)"


@job(
    "codon_adapt",
    f"""with {_COD}, {_CAI},
    ad as materialized (select isolate_id, c.species, string_agg(p.codon, '' order by i) as adapted from cod c join pref p on p.species = c.species and p.aa = c.aa group by 1, 2),
    {windows_sql('w6', 'ad', 'isolate_id', 6, seq='adapted')},
    pal as (select isolate_id, count(*) as k from w6 where w = reverse(translate(w, 'ACGT', 'TGCA')) group by 1)
    select isolate_id, ad.species, cast(length(adapted) as int) as length, md5(adapted) as adapted_md5,
      length(regexp_replace(seq, '[^GC]', '', 'g')) * 100.0::double / length(seq) as gc_before,
      length(regexp_replace(adapted, '[^GC]', '', 'g')) * 100.0::double / length(adapted) as gc_after,
      array_to_string(list_filter({_sites('adapted')}, lambda x: not list_contains({_sites('seq')}, x)), ',') as introduced_sites,
      cast(coalesce(k, 0) as int) as palindromic_6mers, cai
    from ad join isolates using (isolate_id) left join pal using (isolate_id) left join cai using (isolate_id)""",
    "isolates",
)
def codon_adapt(spark, sf):
    return codons.codon_adapt(_cds(spark, sf), "isolate_id")


@job(
    "palindromic_6mer_count",
    f"""with {windows_sql('w6', 'isolates', 'isolate_id', 6)}
    select isolate_id, cast(coalesce(count_if(w = reverse(translate(w, 'ACGT', 'TGCA'))), 0) as int) as palindromic_6mers from isolates left join w6 using (isolate_id) group by 1""",
    "isolates",
)
def palindromic_6mer_count(spark, sf):
    return t.isolates(spark, sf).select("isolate_id", codons.palindromic_words(F.col("seq")).alias("palindromic_6mers"))


@job("distinct_sites", f"select isolate_id, {_sites('seq')} as sites from isolates", "isolates")
def distinct_sites(spark, sf):
    from biotally.operators.restriction import contains_any

    return t.isolates(spark, sf).select("isolate_id", F.array_distinct(contains_any(F.col("seq"), CLONING_SITES)).alias("sites"))


_NAMES = list(SPECIES_ALIASES) + ["Gallus gallus", "unknown bird"]
_PICK = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


@job(
    "species_alias_join",
    f"""with c as (select {_PICK}[cast(c_custkey % {len(_NAMES)} as int) + 1] as species, count(*) as n from customer group by 1)
    select c.species, n, coalesce(a.full_name, case when c.species in ({", ".join(f"'{v}'" for v in sorted(set(SPECIES_ALIASES.values())))}) then c.species end, '{DEFAULT_SPECIES}') as usage_species
    from c left join {sql_values('a', ('alias', 'full_name'), SPECIES_ALIASES.items())} on a.alias = c.species""",
)
def species_alias_join(spark, sf):
    """Species names given by owners, resolved to a usage table."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    c = t.table(spark, sf, "customer").select(F.element_at(names, (F.col("c_custkey") % len(_NAMES)).cast("int") + 1).alias("species"))
    return codons.species_alias_join(c.groupBy("species").agg(F.count("*").alias("n")))
