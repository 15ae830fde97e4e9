"""Registered jobs: residue scales, epitopes, constructs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from biotally.functions.sequence import letter_value
from biotally.operators import codons, epitopes
from biotally.plans import constructs
from biotally.reference_tables import (
    ANCHOR_P2,
    ANCHOR_P9,
    ANTIGENIC_RESIDUES,
    HIS_TAG,
    KNOWN_BINDERS,
    LINKER,
    REVERSE_CODONS,
    SCALES,
    SIGNAL_PEPTIDE,
    UNKNOWN_PAIR_SCORE,
    blosum62,
)
from biotally.registry.codon_jobs import _COD, _cds
from biotally.registry.core import job
from biotally.registry.oracle_views import windows_sql
from biotally.session import cut_lineage, spread
from biotally.sources import tables as t

ALLELES = ["HLA-A*02:01", "HLA-A*02:06"]


def _proteins(spark, sf):
    return t.proteins(spark, sf).select("protein_id", "seq")


def _list(values: dict[str, float]) -> str:
    return "[" + ", ".join(f"{float(values.get(chr(65 + i), 0.0))!r}::double" for i in range(26)) + "]"


def _val(letter: str, values: dict[str, float]) -> str:
    return f"coalesce({_list(values)}[ascii({letter}) - 64], 0.0::double)"


def _thousandths(letter: str, values: dict[str, float]) -> str:
    return "coalesce([" + ", ".join(str(round(values.get(chr(65 + i), 0.0) * 1000)) for i in range(26)) + f"][ascii({letter}) - 64], 0)"


_SCORES = (
    windows_sql("w7", "proteins", "protein_id", 7)
    + """,
res as materialized (select protein_id, i as pos, w from w7),
sc as materialized (select protein_id, pos, w, """
    + ", ".join("(" + " + ".join(_thousandths(f"substr(w, {j}, 1)", s) for j in range(1, 8)) + f") / 7000.0::double as {n}" for n, s in SCALES.items())
    + " from res)"
)
_NORM = (
    "nm as materialized (select *, round(0.30::double * hydro_n + 0.20::double * flex_n + 0.30::double * surf_n + 0.20::double * turn_n, 9) as composite from (select *, "
    + ", ".join(f"({n} - min({n}) over p) / coalesce(nullif(max({n}) over p - min({n}) over p, 0), 1.0::double) as {n}_n" for n in SCALES)
    + " from sc window p as (partition by protein_id)))"
)
_RUNS = """runs as (select protein_id, min(pos) as start, max(pos) + 6 as "end", avg(composite) as mean_composite, avg(hydro) as hydro, avg(flex) as flex,
  avg(surf) as surf, avg(turn) as turn from (select *, pos - row_number() over (partition by protein_id order by pos) as island from nm where composite >= 0.5)
  group by protein_id, island)"""


def _b_sql(name, low, high, top):
    return f"""{name} as (select protein_id, start, "end", sequence, score, hydro, flex, surf, turn, cast(r as int) as rank from (select *,
      row_number() over (partition by protein_id order by score desc, start) as r from (select protein_id, start, "end",
      substr(seq, start, "end" - start + 1) as sequence, cast(least(100, greatest(0, floor(mean_composite * 100 + 0.5))) as int) as score, hydro, flex, surf, turn
      from runs join proteins using (protein_id) where "end" - start + 1 between {low} and {high})) where r <= {top})"""


_PEP = (
    windows_sql("w9", "proteins", "protein_id", 9)
    + f""",
pep as materialized (select protein_id, i as start, i + 8 as "end", w as sequence, p2, p9, round(p2 * 0.4::double + p9 * 0.4::double + ("""
    + " + ".join(
        [f"case when instr('AILMVFYW', substr(w, {j}, 1)) > 0 then 0.1::double else 0 end" for j in (1, 3, 6)]
        + [f"case when instr('STNQDEKR', substr(w, {j}, 1)) > 0 then 0.05::double else 0 end" for j in (4, 5, 7)]
    )
    + f"""), 9) as total from (select *, {_val('substr(w, 2, 1)', ANCHOR_P2)} as p2, {_val('substr(w, 9, 1)', ANCHOR_P9)} as p9 from w9)),
bind as (select protein_id, start, "end", sequence, cast(least(100, greatest(0, floor(total * 100 + 0.5))) as int) as score,
  cast(greatest(5, floor((1 - total) * 5000 + 50 + 0.5)) as int) as ic50, cast((p2 > 0.5)::int + (p9 > 0.5)::int as int) as anchor_match from pep)"""
)


def _t_sql(name, top):
    return f"{name} as (select * exclude (r), cast(r as int) as rank from (select *, row_number() over (partition by protein_id order by ic50, start) as r from bind) where r <= {top})"


@job(
    "sliding_score",
    f"with {_SCORES} select protein_id, count(*) as windows, "
    + ", ".join(f"avg({n}) as {n}, arg_max(pos, {n} * 1000000 - pos / 1000.0::double) as {n}_peak" for n in SCALES)
    + " from sc group by 1",
    "proteins",
)
def sliding_score(spark, sf):
    """Window means of the four scales, reported as the mean and the first peak position of each protein."""
    s = epitopes.sliding_scores(_proteins(spark, sf))
    cols = [c for n in SCALES for c in (F.avg(n).alias(n), F.max_by("pos", F.col(n) * 1000000 - F.col("pos") / 1000.0).alias(f"{n}_peak"))]
    return s.groupBy("protein_id").agg(F.count("*").alias("windows"), *cols)


@job(
    "scale_join",
    "with c as (select unnest(string_split(seq, '')) as residue from proteins)\n select residue, count(*) as n, "
    + ", ".join(f"any_value({_val('residue', s)}) as {n}" for n, s in SCALES.items())
    + " from c group by 1",
    "proteins",
)
def scale_join(spark, sf):
    """Every residue occurrence with its value on the four scales, counted per residue."""
    residues = _proteins(spark, sf).select(F.explode(F.split("seq", "")).alias("residue")).groupBy("residue").agg(F.count("*").alias("n"))
    return residues.select("*", *[letter_value(F.col("residue"), s).alias(n) for n, s in SCALES.items()])


@job(
    "composite_score",
    f"with {_SCORES}, {_NORM} select protein_id, "
    + ", ".join(f"avg({n}_n) as {n}_n" for n in SCALES)
    + ", avg(composite) as mean_composite, max(composite) as max_composite, cast(count_if(composite >= 0.5) as bigint) as above from nm group by 1",
    "proteins",
)
def composite_score(spark, sf):
    """Normalised scales and composite of every window, averaged per protein."""
    out = epitopes.composite_scores(_proteins(spark, sf))
    return out.groupBy("protein_id").agg(
        *[F.avg(f"{n}_n").alias(f"{n}_n") for n in SCALES],
        F.avg("composite").alias("mean_composite"),
        F.max("composite").alias("max_composite"),
        F.count_if(F.col("composite") >= 0.5).alias("above"),
    )


@job("runs_above", f"with {_SCORES}, {_NORM}, {_RUNS} select * from runs", "proteins")
def runs_above(spark, sf):
    return epitopes.runs_above(epitopes.scored_tiles(_proteins(spark, sf))).drop("w")


@job("predict_b_epitopes", f"with {_SCORES}, {_NORM}, {_RUNS}, {_b_sql('b', 6, 20, 15)} select * from b", "proteins")
def predict_b_epitopes(spark, sf):
    return epitopes.predict_b_epitopes(_proteins(spark, sf))


@job("predict_t_epitopes", f"with {_PEP}, {_t_sql('tt', 20)} select * from tt", "proteins")
def predict_t_epitopes(spark, sf):
    return epitopes.predict_t_epitopes(_proteins(spark, sf))


@job(
    "bin_ic50",
    f"with {_PEP} select case when ic50 < 50 then 'High' when ic50 < 500 then 'Moderate' when ic50 < 1000 then 'Low' else 'Very Low' end as band, "
    "anchor_match, count(*) as peptides from bind group by 1, 2",
    "proteins",
)
def bin_ic50(spark, sf):
    b = epitopes.binding_peptides(_proteins(spark, sf))
    return b.groupBy(epitopes.bin_ic50(F.col("ic50")).alias("band"), "anchor_match").agg(F.count("*").alias("peptides"))


@job(
    "min_score",
    f"with {_PEP} select protein_id, start, score from bind where score >= 90",
    "proteins",
)
def min_score(spark, sf):
    return epitopes.binding_peptides(_proteins(spark, sf)).filter(F.col("score") >= 90).select("protein_id", "start", "score")


_ANT = f"length(regexp_replace(seq, '[^{ANTIGENIC_RESIDUES}]', '', 'g'))::double / length(seq)"


@job("antigenicity", f"select protein_id, {_ANT} as antigenicity from proteins", "proteins")
def antigenicity(spark, sf):
    return _proteins(spark, sf).select("protein_id", epitopes.antigenicity(F.col("seq")).alias("antigenicity"))


@job(
    "sequence_summary",
    f"""with {_SCORES}, {_NORM}, {_RUNS}, {_b_sql('b', 6, 20, 15)}, {_PEP}, {_t_sql('tt', 20)},
    bc as (select protein_id, count(*) as b_epitopes, max(score) as best_b from b group by 1),
    tc as (select protein_id, count(*) as t_epitopes, min(ic50) as best_ic50 from tt group by 1)
    select protein_id, cast(length(seq) as int) as length, {_ANT} as antigenicity, coalesce(b_epitopes, 0) as b_epitopes, best_b, coalesce(t_epitopes, 0) as t_epitopes, best_ic50
    from proteins left join bc using (protein_id) left join tc using (protein_id)""",
    "proteins",
)
def sequence_summary(spark, sf):
    return constructs.sequence_summary(_proteins(spark, sf))


_ALLELE_ROWS = ", ".join(f"({i}, '{a}')" for i, a in enumerate(ALLELES))
_PARTS = f"""{_SCORES}, {_NORM}, {_RUNS}, {_b_sql('b', 8, 20, 5)}, {_PEP}, {_t_sql('tt', 5)},
al as (select tt.*, a.no as allele_no, row_number() over (partition by protein_id, a.no order by ic50, start) as allele_rank from tt cross join (values {_ALLELE_ROWS}) as a(no, name)),
dd as (select * from (select *, row_number() over (partition by protein_id, sequence order by allele_no, allele_rank) as r from al) where r = 1),
tr as (select * from (select protein_id, sequence, score, row_number() over (partition by protein_id order by allele_no, allele_rank) as rk from dd) where rk <= 5),
parts as (select *, cast(row_number() over (partition by protein_id order by rank, kind) as int) as part from
  (select protein_id, 'B-cell' as kind, rank, sequence, score from b union all select protein_id, 'T-cell-MHC-I', cast(rk as int), sequence, score from tr))"""


@job(
    "dedup_peptides",
    f"""with {_PEP}, {_t_sql('tt', 20)}, d as (select *, row_number() over (partition by protein_id, sequence order by rank) as r from tt)
    select protein_id, sequence, rank, ic50 from d where r = 1""",
    "proteins",
)
def dedup_peptides(spark, sf):
    p = epitopes.predict_t_epitopes(_proteins(spark, sf)).withColumn("allele_no", F.lit(0)).withColumn("allele_rank", F.col("rank"))
    return constructs.dedup_peptides(p).select("protein_id", "sequence", "rank", "ic50")


@job(
    "per_allele_union",
    f"""with {_PEP}, {_t_sql('tt', 5)} select protein_id, a.name as allele, sequence, ic50,
    cast(row_number() over (partition by protein_id, a.no order by ic50, start) as int) as allele_rank from tt cross join (values {_ALLELE_ROWS}) as a(no, name)""",
    "proteins",
)
def per_allele_union(spark, sf):
    out = constructs.per_allele(epitopes.predict_t_epitopes(_proteins(spark, sf), top=5), ALLELES)
    return out.select("protein_id", "allele", "sequence", "ic50", "allele_rank")


@job(
    "interleave",
    f"""with {_PARTS} select protein_id, kind, rank, sequence, score, part,
    cast(coalesce(sum(length(sequence) + {len(LINKER)}) over (partition by protein_id order by part rows between unbounded preceding and 1 preceding), 0) + {len(SIGNAL_PEPTIDE)} + 1 as int) as feature_start,
    cast(coalesce(sum(length(sequence) + {len(LINKER)}) over (partition by protein_id order by part rows between unbounded preceding and 1 preceding), 0) + {len(SIGNAL_PEPTIDE)} + length(sequence) as int) as feature_end from parts""",
    "proteins",
)
def interleave(spark, sf):
    return constructs.feature_offsets(constructs.select_parts(_proteins(spark, sf), ALLELES))


_PAIR_LIST = "[" + ", ".join(str(blosum62().get((chr(65 + i), chr(65 + j)), UNKNOWN_PAIR_SCORE)) for i in range(26) for j in range(26)) + "]"


def _pair(a: str, b: str) -> str:
    return (
        f"(case when ascii({a}) between 65 and 90 and ascii({b}) between 65 and 90 then {_PAIR_LIST}[(ascii({a}) - 65) * 26 + ascii({b}) - 64] else {UNKNOWN_PAIR_SCORE} end)"
    )


_REV = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in REVERSE_CODONS.items()) + "}"


@job(
    "assemble_construct",
    f"""with {_COD}, pm as (select species, map_from_entries(list((aa, codon))) as pick from pref group by 1), {_PARTS}, g as (select protein_id, '{SIGNAL_PEPTIDE}' || string_agg(sequence, '{LINKER}' order by part) || '{HIS_TAG}*' as construct,
      count_if(kind = 'B-cell') as b_count, count_if(kind <> 'B-cell') as t_count from parts group by 1),
    nb as (select protein_id, avg({_pair("substr(construct, i, 1)", "substr(construct, i + 1, 1)")}) as m from (select protein_id, construct, cast(unnest(range(1, length(construct))) as int) as i from g) group by 1)
    select protein_id, construct, cast(length(construct) as int) as length, cast(b_count as bigint) as b_count, cast(t_count as bigint) as t_count, greatest(0.0::double, (m + 4) / 8) as naturalness,
      length(construct) * 110 / 1000.0::double as kda,
      array_to_string(list_transform(string_split(replace(construct, '*', ''), ''), lambda c: coalesce({_REV}[c], 'NNN')), '') as dna,
      array_to_string(list_transform(string_split(replace(construct, '*', ''), ''), lambda c: coalesce(case when {_REV}[c] is not null then pick[c] end, {_REV}[c], 'NNN')), '') as adapted_dna
    from g join nb using (protein_id) join proteins using (protein_id) left join pm on pm.species = proteins.species""",
    "proteins isolates",
)
def assemble_construct(spark, sf):
    """With the codons that the species of each protein prefers, counted on the isolates of the same species."""
    usage = cut_lineage(codons.codon_usage(_cds(spark, sf)))
    return constructs.assemble_construct(t.proteins(spark, sf).select("protein_id", "species", "seq"), ALLELES, usage=usage)


@job(
    "adjacent_naturalness",
    f"""with {windows_sql('w2', 'proteins', 'protein_id', 2)}
    select protein_id, greatest(0.0::double, (avg({_pair("substr(w, 1, 1)", "substr(w, 2, 1)")}) + 4) / 8) as naturalness from w2 group by 1""",
    "proteins",
)
def adjacent_naturalness(spark, sf):
    return _proteins(spark, sf).select("protein_id", constructs.adjacent_naturalness(F.col("seq")).alias("naturalness"))


@job(
    "substitution_score",
    f"""with {windows_sql('w2', 'proteins', 'protein_id', 2)}, c as (select substr(w, 1, 1) as a, substr(w, 2, 1) as b, count(*) as n from w2 group by 1, 2)
    select a, b, n, {_pair('a', 'b')} as score, case when a = b then 2 else -1 end as dna_score from c""",
    "proteins",
)
def substitution_score(spark, sf):
    from biotally.functions.sequence import overlapping_words
    from biotally.functions.sequence import substitution_score as score

    w = _proteins(spark, sf).select(F.explode(overlapping_words(F.col("seq"), 2)).alias("w"))
    pairs = w.groupBy(F.substring("w", 1, 1).alias("a"), F.substring("w", 2, 1).alias("b")).agg(F.count("*").alias("n"))
    return pairs.select("*", score(F.col("a"), F.col("b")).alias("score"), score(F.col("a"), F.col("b"), "dna").alias("dna_score"))


_SELF = " + ".join(_pair(f"substr(sequence, {i}, 1)", f"substr(sequence, {i}, 1)") for i in range(1, 10))
_SIM = ", ".join(
    "(" + " + ".join(_pair(f"substr(sequence, {i + 1}, 1)", f"'{r[i]}'") for i in range(9)) + ")::double / self" for r in KNOWN_BINDERS
)
_BINDING = f"""{_PEP}, {_t_sql('tt', 20)}, u as (select distinct sequence, ic50 as base_ic50, score from tt),
s as (select *, least(1.0::double, greatest(0.0::double, {_SIM})) as similarity from (select *, {_SELF} as self,
  {_val('substr(sequence, 2, 1)', ANCHOR_P2)} * 0.5 + {_val('substr(sequence, 9, 1)', ANCHOR_P9)} * 0.5 as anchor from u))"""


@job("max_reference_similarity", f"with {_BINDING} select sequence, similarity from s", "proteins")
def max_reference_similarity(spark, sf):
    p = spread(epitopes.predict_t_epitopes(_proteins(spark, sf)).select("sequence"), "sequence").distinct()
    return p.select("sequence", epitopes.max_reference_similarity(F.col("sequence")).alias("similarity"))


@job(
    "combined_binding",
    f"""with {_BINDING}, k as (select *, score / 100.0::double as nat, anchor * 0.4::double + score / 100.0::double * 0.3::double + similarity * 0.3::double as combined from s)
    select sequence, anchor, similarity, combined, cast(greatest(5, floor((1 - combined) * 5000 + 50 + 0.5)) as int) as ic50,
    exp((1 - combined) * 5) - 1 as rank_proxy, anchor * 0.5::double + least(1.0::double, nat * 5) * 0.5::double as confidence from k""",
    "proteins",
)
def combined_binding(spark, sf):
    """Binding of the top peptides; the peptide score stands in for the naturalness a model would give."""
    p = spread(epitopes.predict_t_epitopes(_proteins(spark, sf)).select("sequence", "score"), "sequence").distinct()
    pep = F.col("sequence")
    anchor = letter_value(F.substring(pep, 2, 1), ANCHOR_P2) * 0.5 + letter_value(F.substring(pep, 9, 1), ANCHOR_P9) * 0.5
    q = p.select("sequence", anchor.alias("anchor"), (F.col("score") / 100.0).alias("nat"), epitopes.max_reference_similarity(pep).alias("similarity"))
    return q.select("sequence", "anchor", "similarity", *[c.alias(n) for n, c in epitopes.combined_binding(F.col("anchor"), F.col("nat"), F.col("similarity")).items()])
