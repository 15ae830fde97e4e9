"""Registered jobs: variants, propensity, toxicity."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotally.operators import variants as v
from biotally.reference_tables import AMINO_ACIDS, TOX_ENDPOINTS, sql_values
from biotally.registry.core import job
from biotally.sources import tables as t

# Variant lists written in all notations, one text per protein position of the embeddings table.
_POS = "cast(vec_id % 25 + 1 as int)"
_LETTER = "substr('" + AMINO_ACIDS + "', cast((vec_id * {m}) % 20 + 1 as int), 1)"
_A, _B, _C = (_LETTER.format(m=m) for m in (3, 11, 13))
_TEXT = f"concat('S', {_POS}, {_A}, ';', {_POS}, ' ', {_B}, ',', {_POS}, 'H>', {_C}, ', bad ,', vec_id)"


def _texts(spark, sf):
    return t.table(spark, sf, "embeddings").select(F.expr("vec_id div 25").alias("protein_id"), "vec_id", F.expr(_TEXT).alias("text"))


def _variants(spark, sf):
    return _texts(spark, sf).select("protein_id", F.inline(v.parse_variants(F.col("text"))))


_PV = f"""tx as (select vec_id // 25 as protein_id, vec_id, {_TEXT} as text from embeddings),
it as (select protein_id, trim(unnest(regexp_split_to_array(text, '[\\n,;]'))) as x from tx),
pv as materialized (select protein_id, cast(pos as int) as pos, mutant from (select protein_id,
  case when regexp_full_match(x, '[A-Za-z][0-9]+[A-Za-z]') then regexp_extract(x, '[0-9]+') when regexp_full_match(x, '[0-9]+\\s+[A-Za-z]') then regexp_extract(x, '[0-9]+') when regexp_full_match(x, '[0-9]+[A-Za-z]>[A-Za-z]') then regexp_extract(x, '[0-9]+') end as pos,
  right(x, 1) as mutant from it) where pos is not null)"""
_SV = f"""{_PV}, sv as materialized (select protein_id, pos, mutant, wild_type, coalesce(w.prob, 0.001::double) as wt_prob, coalesce(m.prob, 0.001::double) as mut_prob
  from pv join (select protein_id, pos, residue as wild_type from wild_types) wt using (protein_id, pos)
  left join (select protein_id, pos, residue as wild_type, prob from residue_probs) w using (protein_id, pos, wild_type)
  left join (select protein_id, pos, residue as mutant, prob from residue_probs) m using (protein_id, pos, mutant)),
sc as materialized (select *, round(case when wild_type = mutant then 0.0::double else ln(greatest(wt_prob, 1e-10)) - ln(greatest(mut_prob, 1e-10)) end, 9) as delta from sv),
ef as materialized (select *, case when delta > 2 then 'deleterious' when delta < -2 then 'beneficial' else 'neutral' end as effect from sc)"""


@job("parse_variants", f"with {_PV} select protein_id, pos, mutant from pv")
def parse_variants(spark, sf):
    return _variants(spark, sf)


def _scored(spark, sf):
    return v.score_variants(_variants(spark, sf), t.wild_types(spark, sf), t.residue_probs(spark, sf))


@job("score_variants", f"with {_SV} select protein_id, pos, wild_type, mutant, wt_prob, mut_prob, delta, effect from ef", "wild_types residue_probs")
def score_variants(spark, sf):
    return _scored(spark, sf).select("protein_id", "pos", "wild_type", "mutant", "wt_prob", "mut_prob", "delta", "effect").orderBy(F.desc("delta"), "protein_id", "pos", "mutant")


@job(
    "variant_summary",
    f"""with {_SV}, s as (select protein_id, count(*) as variants, count_if(effect = 'deleterious')::bigint as deleterious, count_if(effect = 'beneficial')::bigint as beneficial, avg(delta) as mean_delta from ef group by 1)
    select *, case when deleterious > variants * 0.3 then 'loss of function' when beneficial > variants * 0.3 then 'adaptive' else 'mostly neutral' end as verdict from s""",
    "wild_types residue_probs",
)
def variant_summary(spark, sf):
    return v.variant_summary(_scored(spark, sf))


_PROP = """su as (select protein_id, pos, residue, coalesce(prob, 0.0::double) as prob, -ln(greatest(coalesce(prob, 0.0::double), 0.001::double)) as surprise from wild_types left join residue_probs using (protein_id, pos, residue)),
pp as materialized (select protein_id, pos, residue, prob, surprise, round((avg(surprise) over (partition by protein_id order by pos rows between 4 preceding and 4 following) - min(surprise) over (partition by protein_id))
  / coalesce(nullif(max(surprise) over (partition by protein_id) - min(surprise) over (partition by protein_id), 0), 1.0::double), 9) as propensity, least(1.0::double, abs(prob - 0.05::double) * 5) as confidence from su)"""


def _propensity(spark, sf):
    return v.residue_propensity(t.wild_types(spark, sf), t.residue_probs(spark, sf))


@job("residue_propensity", f"with {_PROP} select * from pp", "wild_types residue_probs")
def residue_propensity(spark, sf):
    return _propensity(spark, sf)


@job(
    "top_residues",
    f"""with {_PROP}, b as (select * from (select *, cast(row_number() over (partition by protein_id order by propensity desc, pos) as int) as rank from pp) where rank <= 5)
    select b.protein_id, b.pos, b.rank, b.propensity, string_agg(p.residue, '' order by p.pos) as span from b join pp p on p.protein_id = b.protein_id and p.pos between b.pos - 5 and b.pos + 5 group by 1, 2, 3, 4""",
    "wild_types residue_probs",
)
def top_residues(spark, sf):
    return v.top_residues(_propensity(spark, sf))


@job("mean_propensity", f"with {_PROP} select protein_id, avg(propensity) as mean_propensity, avg(prob) as mean_prob from pp group by 1", "wild_types residue_probs")
def mean_propensity(spark, sf):
    return v.mean_propensity(_propensity(spark, sf))


_TOP = "tl as materialized (select mol_id, endpoint, arg_max(label, score * 1000 + case label when 'toxic' then 1 else 0 end) as label, max(score) as score from tox_predictions group by 1, 2)"


@job("top_label", f"with {_TOP} select * from tl", "tox_predictions")
def top_label(spark, sf):
    return v.top_label(t.tox_predictions(spark, sf))


@job(
    "toxicity_panel",
    f"""with {_TOP}, p as (select mol_id, count_if(label = 'toxic')::bigint as positives, count(*) as answered from tl group by 1),
    r as (select *, cast(floor(positives * 100.0::double / answered + 0.5) as int) as risk from p)
    select *, case when risk >= 60 then 'high' when risk >= 30 then 'moderate' when risk > 0 then 'low' else 'none' end as band from r""",
    "tox_predictions",
)
def toxicity_panel(spark, sf):
    return v.tox_panel(t.tox_predictions(spark, sf))


_EP = sql_values("e", ("endpoint", "endpoint_name", "model"), TOX_ENDPOINTS)


@job("endpoint_list", f"with {_TOP} select endpoint, endpoint_name, count(*) as molecules, count_if(label = 'toxic')::bigint as positives from tl join {_EP} using (endpoint) group by 1, 2", "tox_predictions")
def endpoint_list(spark, sf):
    """Endpoints with the number of molecules answered and positive."""
    top = v.top_label(t.tox_predictions(spark, sf)).groupBy("endpoint").agg(F.count("*").alias("molecules"), F.count_if(v.vote_positive(F.col("label"))).alias("positives"))
    return top.join(F.broadcast(v.endpoint_table(spark).select("endpoint", "endpoint_name")), "endpoint")


@job("vote_positive", "select label, endpoint, label in ('toxic', '1') as positive, count(*) as n from tox_predictions group by all", "tox_predictions")
def vote_positive(spark, sf):
    return t.tox_predictions(spark, sf).groupBy("label", "endpoint").agg(F.count("*").alias("n")).withColumn("positive", v.vote_positive(F.col("label")))
