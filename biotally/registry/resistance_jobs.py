"""Registered jobs: resistance rules over isolates."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotally.functions.sequence import iupac_regex
from biotally.operators import resistance as r
from biotally.reference_tables import CONTEXT_RULES, MOTIF_RULES, SCREEN_MOTIFS, sql_values
from biotally.registry.core import job
from biotally.registry.oracle_views import windows_sql
from biotally.sources import tables as t

_KEY = "isolate_id"
# The published motifs are 12-14 letters and rare in the driver tables; the short panel gives hits.
PANEL = MOTIF_RULES + SCREEN_MOTIFS
GROUPS = {"ECONOMY": "class-a", "SMALL": "class-b", "MEDIUM": "class-c", "PROMO": "Макролиды", "STANDARD": "Аминогликозиды", "LARGE": "Рифамицины"}


def _seqs(spark, sf):
    return t.isolates(spark, sf).select(_KEY, "seq")


_MOTIF = "motif as materialized (" + " union all ".join(
    f"select isolate_id, '{g}' as gene, '{c}' as class, {conf} as confidence, cast(length(regexp_extract(seq, '^(.*?){iupac_regex(w)}', 1)) + 1 as int) as position from isolates where regexp_matches(seq, '{iupac_regex(w)}')"
    for w, g, c, conf in PANEL
) + ")"
_PATS = sql_values(
    "p", ("pattern", "before", "gene", "class", "wild_type", "mutant", "reference_position", "confidence"),
    [(b + m + a, len(b), g, c, wt, m, pos, conf) for c, g, pos, wt, ms, b, a, conf in CONTEXT_RULES for m in ms],
)
_K = sorted({len(r_[5]) + 1 + len(r_[6]) for r_ in CONTEXT_RULES})
_CTX = windows_sql("wc", "isolates", "isolate_id", max(_K), partial=True) + """,
ctx as materialized (""" + " union all ".join(
    f"select isolate_id, gene, class, wild_type, mutant, reference_position, confidence, cast(i + before as int) as position from wc join (select * from {_PATS} where length(pattern) = {k}) p on substr(w, 1, {k}) = p.pattern"
    for k in _K
) + ")"
_HITS = f"""{_MOTIF}, {_CTX}, hits as (select isolate_id, gene, class, confidence, position, 'motif' as kind from motif union all
  select isolate_id, gene, class, confidence, position, 'mutation' from ctx)"""
_SCORES = """raw as (select isolate_id, class, count(*) as hits, sum(confidence * 40) / 100.0::double as raw from hits group by 1, 2),
scores as (select isolate_id, class, hits, cast(least(100, floor(raw + 0.5)) as int) as score,
  case when raw < 25 then 'susceptible' when raw < 60 then 'intermediate' else 'resistant' end as level from raw)"""


@job("motif_hits", f"with {_MOTIF} select * from motif", "isolates")
def motif_hits(spark, sf):
    return r.motif_hits(_seqs(spark, sf), _KEY, PANEL)


@job("context_mutation_hits", f"with {_CTX} select * from ctx", "isolates")
def context_mutation_hits(spark, sf):
    return r.context_mutation_hits(_seqs(spark, sf), _KEY)


@job("class_scores", f"with {_HITS}, {_SCORES} select * from scores", "isolates")
def class_scores(spark, sf):
    return r.class_scores(r.all_hits(_seqs(spark, sf), _KEY, PANEL), _KEY)


@job("bin_resistance", f"with {_HITS}, {_SCORES} select class, level, count(*) as sequences from scores group by 1, 2", "isolates")
def bin_resistance(spark, sf):
    s = r.class_scores(r.all_hits(_seqs(spark, sf), _KEY, PANEL), _KEY)
    return s.groupBy("class", "level").agg(F.count("*").alias("sequences"))


@job(
    "overall_resistance",
    f"with {_HITS}, {_SCORES} select isolate_id, cast(least(100, floor(avg(score) + 0.5)) as int) as overall_score from scores group by 1",
    "isolates",
)
def overall_resistance(spark, sf):
    return r.overall_resistance(r.class_scores(r.all_hits(_seqs(spark, sf), _KEY, PANEL), _KEY), _KEY)


@job("resistance_genes", f"with {_MOTIF} select isolate_id, list_sort(list(distinct gene)) as genes from motif group by 1", "isolates")
def resistance_genes(spark, sf):
    return r.resistance_genes(r.motif_hits(_seqs(spark, sf), _KEY, PANEL).withColumn("kind", F.lit("motif")), _KEY)


_LISTS = """coalesce(string_agg(class, ', ' order by class) filter (level = 'resistant'), '') as resistant,
  coalesce(string_agg(class, ', ' order by class) filter (level = 'intermediate'), '') as intermediate"""


@job("recommendation_classes", f"with {_HITS}, {_SCORES} select isolate_id, {_LISTS} from scores group by 1", "isolates")
def recommendation_classes(spark, sf):
    return r.recommendation_classes(r.class_scores(r.all_hits(_seqs(spark, sf), _KEY, PANEL), _KEY), _KEY)


@job(
    "predict_resistance",
    f"""with {_HITS}, {_SCORES}, g as (select isolate_id, list_sort(list(distinct gene)) as genes from motif group by 1),
    s as (select isolate_id, cast(sum(hits) as bigint) as hits, cast(least(100, floor(avg(score) + 0.5)) as int) as overall_score, {_LISTS} from scores group by 1)
    select isolate_id, cast(length(seq) as int) as length, coalesce(hits, 0) as hits, coalesce(overall_score, 0) as overall_score, coalesce(resistant, '') as resistant,
    coalesce(intermediate, '') as intermediate, coalesce(genes, []::varchar[]) as genes from isolates left join s using (isolate_id) left join g using (isolate_id)""",
    "isolates",
)
def predict_resistance(spark, sf):
    return r.predict_resistance(_seqs(spark, sf), _KEY, PANEL)


@job(
    "affected_drugs",
    f"""with {_HITS}, m as (select * from {sql_values('v', ('pharm_group', 'class'), GROUPS.items())})
    select drug_id, name, pharm_group, class from compounds join m using (pharm_group) where class in (select class from hits)""",
    "isolates compounds",
)
def affected_drugs(spark, sf):
    hits = r.all_hits(_seqs(spark, sf), _KEY, PANEL)
    return r.affected_drugs(t.compounds(spark, sf).select("drug_id", "name", "pharm_group"), hits, GROUPS)
