"""Registered jobs: pair distances, clock, trees and the outbreak report."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotally.operators import clock, pairs, tree
from biotally.plans import outbreaks
from biotally.reference_tables import CLOCK_RATES, DEFAULT_CLOCK_RATE, PATHOGEN_RULES, SCREEN_MOTIFS, sql_values
from biotally.registry.core import job
from biotally.registry.resistance_jobs import PANEL, _HITS
from biotally.sources import tables as t

# Field labels given to the batches of the driver tables.
LABELS = ("ASFV field", "fmd swab", "H5N1 swab", "rabies brain", "Brucella milk", "E. coli fecal", "peste des petits", "unlabelled")
_LABEL_SQL = "[" + ", ".join(f"'{x}'" for x in LABELS) + f"][cast(batch % {len(LABELS)} as int) + 1]"


def _isolates(spark, sf):
    names = F.array(*[F.lit(x) for x in LABELS])
    return t.isolates(spark, sf).withColumn("label", F.get(names, (F.col("batch") % len(LABELS)).cast("int")))


_DISTANCES = """{p}pr as materialized (select a.cluster, a.isolate_id as a, b.isolate_id as b, a.seq as sa, b.seq as sb, least(length(a.seq), length(b.seq)) as n
  from isolates a join isolates b on a.cluster = b.cluster and a.isolate_id < b.isolate_id{long}),
{p}ch as materialized (select isolate_id, b as c, string_split(substr(seq, cast(b * 512 + 1 as int), 512), '') as letters from
  (select isolate_id, seq, unnest(range(0, (length(seq) + 511) // 512)) as b from isolates)),
{p}ds as (select cluster, a, b, sum(len(x)) as valid, sum(len(list_filter(x, lambda p: p in ('AG', 'GA', 'CT', 'TC')))) as transitions,
  sum(len(list_filter(x, lambda p: p in ('AC', 'CA', 'AT', 'TA', 'CG', 'GC', 'GT', 'TG')))) as transversions
  from (select pr.cluster, pr.a, pr.b, list_transform(list_zip(list_slice(l.letters, 1, least(len(l.letters), len(r.letters))), list_slice(r.letters, 1, least(len(l.letters), len(r.letters)))), lambda z: z[1] || z[2]) as x
    from {p}pr pr join {p}ch l on l.isolate_id = pr.a join {p}ch r on r.isolate_id = pr.b and r.c = l.c) group by 1, 2, 3),
{p}dist as materialized (select cluster, a, b, cast(valid as int) as valid, cast(transitions as int) as transitions, cast(transversions as int) as transversions,
  cast(valid - transitions - transversions as int) as matches,
  round(case when 1 - 2 * transitions / valid - transversions / valid > 0 and 1 - 2 * transversions / valid > 0
    then -0.5::double * ln(1 - 2 * transitions / valid - transversions / valid) - 0.25::double * ln(1 - 2 * transversions / valid)
    else (transitions + transversions) / valid end, 9) as d, (transitions + transversions) / valid as p from {p}ds)"""
_DIST = _DISTANCES.format(p="", long=" and length(a.seq) >= 10 and length(b.seq) >= 10")
_ALL_DIST = _DISTANCES.format(p="all_", long="")


@job("substitution_counts", f"with {_DIST} select cluster, a, b, valid, matches, transitions, transversions from dist", "isolates")
def substitution_counts(spark, sf):
    return pairs.pair_distances(t.isolates(spark, sf)).select("cluster", "a", "b", "valid", "matches", "transitions", "transversions")


@job("pair_distances", f"with {_DIST} select cluster, a, b, d as k2p, p as p_distance, (1 - d) * 100 as identity from dist", "isolates")
def pair_distances(spark, sf):
    d = pairs.pair_distances(t.isolates(spark, sf))
    return d.select("cluster", "a", "b", F.col("d").alias("k2p"), F.col("p").alias("p_distance"), ((1 - F.col("d")) * 100).alias("identity"))


@job("nearest_pair", f"with {_DIST} select cluster, a, b, d from (select *, row_number() over (partition by cluster order by d, a, b) as r from dist) where r = 1", "isolates")
def nearest_pair(spark, sf):
    return tree.nearest_pair(pairs.pair_distances(t.isolates(spark, sf)))


@job(
    "length_guard",
    "select cluster, count(*) as isolates, count(*) between 2 and 20 as accepted from isolates where length(seq) between 120 and 5000 group by 1",
    "isolates",
)
def length_guard(spark, sf):
    """Sequence lengths and cluster sizes against the limits of the single-input tools."""
    from biotally.functions.sequence import length_guard as guard

    ok = t.isolates(spark, sf).filter(guard(F.col("seq"), 120, 5000))
    return ok.groupBy("cluster").agg(F.count("*").alias("isolates")).withColumn("accepted", F.col("isolates").between(2, 20))


# Average linkage and neighbour joining, a merge of every cluster a step. A pair carries what is known of both its ends.
_UPGMA = """up as (select cluster, 0 as step, a, b, d, 1 as sa, 1 as sb, 0::double as ha, 0::double as hb, a::varchar as na, b::varchar as nb from {dist}
  union all
  select cluster, step + 1, least(ta, tb), greatest(ta, tb), round(sum(sa * sb * d) / sum(sa * sb), 12), any_value(case when ta < tb then wa else wb end), any_value(case when ta < tb then wb else wa end),
    any_value(case when ta < tb then ga else gb end), any_value(case when ta < tb then gb else ga end), any_value(case when ta < tb then xa else xb end), any_value(case when ta < tb then xb else xa end)
  from (select *, case when a = mb then ma else a end as ta, case when b = mb then ma else b end as tb,
      case when a in (ma, mb) then msa + msb else sa end as wa, case when b in (ma, mb) then msa + msb else sb end as wb, case when a in (ma, mb) then md / 2 else ha end as ga, case when b in (ma, mb) then md / 2 else hb end as gb,
      case when a in (ma, mb) then made else na end as xa, case when b in (ma, mb) then made else nb end as xb
    from (select *, '(' || mna || format(':{{:.3f}},', greatest(0::double, md / 2 - mha)) || mnb || format(':{{:.3f}})', greatest(0::double, md / 2 - mhb)) as made
      from (select *, first_value(a) over w as ma, first_value(b) over w as mb, first_value(d) over w as md, first_value(sa) over w as msa, first_value(sb) over w as msb,
        first_value(ha) over w as mha, first_value(hb) over w as mhb, first_value(na) over w as mna, first_value(nb) over w as mnb from up window w as (partition by cluster order by d, a, b))))
  where ta <> tb group by cluster, step, least(ta, tb), greatest(ta, tb)),
up_tree as (select cluster, sa + sb as leaves, d / 2 as max_depth, '(' || na || format(':{{:.3f}},', greatest(0::double, d / 2 - ha)) || nb || format(':{{:.3f}}):0.000;', greatest(0::double, d / 2 - hb)) as newick
  from (select *, count(*) over (partition by cluster, step) as open from up) where open = 1)"""
_NJ = """nj as (select cluster, 0 as step, a, b, d, 1 as sa, 1 as sb, 0::double as ha, 0::double as hb, a::varchar as na, b::varchar as nb from dist
  union all select cluster, 0, b, a, d, 1, 1, 0, 0, b::varchar, a::varchar from dist
  union all
  select cluster, step + 1, ta, tb, case when count(*) = 2 then (sum(d) - any_value(md)) / 2 else sum(d) end, any_value(wa), any_value(wb), any_value(ga), any_value(gb), any_value(xa), any_value(xb)
  from (select *, case when a = mb then ma else a end as ta, case when b = mb then ma else b end as tb, case when a in (ma, mb) then msa + msb else sa end as wa, case when b in (ma, mb) then msa + msb else sb end as wb,
      case when a in (ma, mb) then deep else ha end as ga, case when b in (ma, mb) then deep else hb end as gb, case when a in (ma, mb) then made else na end as xa, case when b in (ma, mb) then made else nb end as xb
    from (select *, greatest(mha + la, mhb + lb) as deep, '(' || mna || format(':{{:.3f}},', la) || mnb || format(':{{:.3f}})', lb) as made
      from (select *, greatest(0::double, md / 2 + (mra - mrb) / 2) as la, greatest(0::double, md - (md / 2 + (mra - mrb) / 2)) as lb
        from (select *, first_value(a) over w as ma, first_value(b) over w as mb, first_value(d) over w as md, first_value(ra) over w as mra, first_value(rb) over w as mrb, first_value(sa) over w as msa, first_value(sb) over w as msb,
            first_value(ha) over w as mha, first_value(hb) over w as mhb, first_value(na) over w as mna, first_value(nb) over w as mnb
          from (select *, round(d - ra - rb + 1.37e-10::double, 9) as q from (select *, sum(d) over (partition by cluster, a) / (n - 2) as ra, sum(d) over (partition by cluster, b) / (n - 2) as rb
            from (select *, count(*) over (partition by cluster, a) + 1 as n from nj) where n > 2))
          window w as (partition by cluster order by q, least(a, b), greatest(a, b), a)))))
  where ta <> tb group by cluster, step, ta, tb),
nj_tree as (select cluster, sa + sb as leaves, greatest(0::double, d / 2) + greatest(ha, hb) as max_depth, '(' || na || format(':{{:.3f}},', greatest(0::double, d / 2)) || nb || format(':{{:.3f}}):0.000;', greatest(0::double, d / 2)) as newick
  from (select *, count(*) over (partition by cluster, step) as open from nj) where open = 2 and a < b)"""

_LAB = f"lab as (select isolate_id, cluster, {_LABEL_SQL} as label from isolates)"
_CASE = "case " + " ".join(f"when regexp_matches(lower(label), '{p}') then {i}" for i, (_, p) in enumerate(PATHOGEN_RULES)) + " end"
_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in PATHOGEN_RULES) + "]"
_RATES = f"""{_LAB}, best as (select cluster, {_NAMES}[min({_CASE}) + 1] as pathogen from lab group by 1),
rates as (select cluster, pathogen, coalesce((select arg_min(rate, ord) from {sql_values('c', ('ord', 'organism', 'rate'), [(i, o, r) for i, (_, o, r) in enumerate(CLOCK_RATES)])}
  where contains(lower(organism), lower(split_part(pathogen, ' ', 1)))), {DEFAULT_CLOCK_RATE}::double) as rate from best)"""


@job("first_match_rule", f"with {_LAB} select label, {_NAMES}[{_CASE} + 1] as pathogen, count(*) as isolates from lab group by 1, 2", "isolates")
def first_match_rule(spark, sf):
    labelled = clock.first_match_rule(_isolates(spark, sf).select("isolate_id", "label"), "isolate_id", "label", out="pathogen")
    return labelled.groupBy("label", "pathogen").agg(F.count("*").alias("isolates"))


@job("clock_rate_join", f"with {_RATES} select * from rates", "isolates")
def clock_rate_join(spark, sf):
    return outbreaks.label_clusters(_isolates(spark, sf))


def _f(x, d=1):
    return f"format('{{:.{d}f}}', floor(({x}) * {10**d} + 0.5) / {10**d}::double)"


_DUR = f"""case when years < 1 then {_f('years * 365')} || ' days' when years < 100 then {_f('years')} || ' years'
  when years < 1000 then {_f('years', 0)} || ' years (~' || {_f('years / 30', 0)} || ' generations)' when years < 1e6 then {_f('years / 1e3')} || ' thousand years'
  when years < 1e9 then {_f('years / 1e6')} || ' million years' else {_f('years / 1e9')} || ' billion years' end"""


@job(
    "divergence_time",
    f"""with {_DIST}, {_RATES}, y as (select cluster, a, b, d, rate, d / (2 * rate) as years, 1.96::double * sqrt(p * (1 - p) / valid) / (2 * rate) as half from dist join rates using (cluster))
    select cluster, a, b, years, years + half as upper, greatest(0.0::double, years - half) as lower from y""",
    "isolates",
)
def divergence_time(spark, sf):
    iso = _isolates(spark, sf)
    d = outbreaks.timed_pairs(iso)
    se = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("valid"))
    return d.select("cluster", "a", "b", *[c.alias(n) for n, c in clock.divergence_time(F.col("d"), F.col("rate"), se).items()])


@job(
    "human_duration",
    f"with y as (select o_orderkey, o_totalprice * pow(10.0, o_orderkey % 9 - 6) + 0.0123::double as years from orders) select o_orderkey, {_DUR} as duration from y",
)
def human_duration(spark, sf):
    years = F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 9 - 6) + 0.0123
    return t.table(spark, sf, "orders").select("o_orderkey", clock.human_duration(years).alias("duration"))


_YEARS = f"""{_DIST}, {_RATES}, tm as (select cluster, any_value(pathogen) as pathogen, any_value(rate) as rate, count(*) as pairs, min(case when d > 0 then d / (2 * rate) end) as tmrca from dist join rates using (cluster) group by 1)"""
_BIN = "case when tmrca < 0.5 then 'recent outbreak' when tmrca < 2 then 'recent introduction' else 'separate lineages' end"


@job("tmrca", f"with {_YEARS} select cluster, pairs, tmrca, {_BIN} as divergence from tm", "isolates")
def tmrca(spark, sf):
    tp = outbreaks.timed_pairs(_isolates(spark, sf))
    out = tp.groupBy("cluster").agg(F.count("*").alias("pairs"), F.min(F.when(F.col("years") > 0, F.col("years"))).alias("tmrca"))
    return out.withColumn("divergence", clock.bin_divergence(F.col("tmrca")))


_REPORT = f"""{_YEARS}, {_HITS},
cl as (select cluster, a as closest_a, b as closest_b, d as closest_d, (1 - d) * 100 as closest_identity, d / (2 * rate) as closest_years from (select *, row_number() over (partition by cluster order by d, a, b) as r from dist) join rates using (cluster) where r = 1),
hi as (select isolate_id, count_if(kind = 'motif') as motifs, count_if(kind = 'mutation') as mutations from hits group by 1),
ic as (select cluster, count(*) as isolates, cast(coalesce(count_if(motifs > 0), 0) as bigint) as resistant_isolates, cast(coalesce(sum(motifs), 0) as bigint) as motif_hits, cast(coalesce(sum(mutations), 0) as bigint) as mutation_hits
  from isolates left join hi using (isolate_id) group by 1),
rep as (select cluster, isolates, coalesce(tm.pairs, 0) as pairs, rates.pathogen, rates.rate, tmrca, case when tmrca is null and tm.pairs is null then null else {_BIN} end as divergence,
  closest_a, closest_b, closest_d, closest_identity, closest_years, resistant_isolates, motif_hits, mutation_hits
  from ic join rates using (cluster) left join tm using (cluster) left join cl using (cluster))"""
# The report's tree joins isolates of any length.
_WITH_TREE = f"""{_REPORT}, {_ALL_DIST}, {_UPGMA.format(dist='all_dist')}, lone as (select cluster, min(isolate_id)::varchar || ':0.000;' as lone from isolates group by 1)
select rep.*, cast(coalesce(leaves, 1) as bigint) as tree_leaves, coalesce(max_depth, 0::double) as tree_depth, coalesce(newick, lone) as newick from rep left join up_tree using (cluster) left join lone using (cluster)"""


@job("outbreak_report", f"with recursive {_WITH_TREE}", "isolates")
def outbreak_report(spark, sf):
    return outbreaks.outbreak_report(_isolates(spark, sf), motifs=PANEL)


@job("outbreak_counts", f"with {_REPORT} select cluster, isolates, resistant_isolates, motif_hits, mutation_hits from rep", "isolates")
def outbreak_counts(spark, sf):
    return outbreaks.outbreak_counts(_isolates(spark, sf), motifs=PANEL)


@job(
    "report_lines",
    f"""with recursive {_WITH_TREE.rsplit('select rep.*', 1)[0]}, rt as (select rep.*{_WITH_TREE.rsplit('select rep.*', 1)[1]}), l as (select cluster, list_filter([case when tmrca is not null then 'TMRCA ~' || format('{{:.1f}}', floor(tmrca * 10 + 0.5) / 10) || ' years: ' || divergence end,
      case when resistant_isolates > 0 then resistant_isolates || ' of ' || isolates || ' isolates carry resistance genes (' || motif_hits || ' in total)' else 'no resistance genes found' end,
      'tree: ' || tree_leaves || ' leaves', 'closest pair: ' || closest_a || ' - ' || closest_b || ' (identity ' || format('{{:.1f}}', floor(closest_identity * 10 + 0.5) / 10) || '%, ~' || format('{{:.1f}}', floor(closest_years * 10 + 0.5) / 10) || ' years)'], lambda x: x is not null) as lines from rt)
    select cluster, cast(i - 1 as int) as line_no, lines[i] as line from (select cluster, lines, unnest(range(1, len(lines) + 1)) as i from l)""",
    "isolates",
)
def report_lines(spark, sf):
    return outbreaks.report_lines(outbreaks.outbreak_report(_isolates(spark, sf), motifs=PANEL))


@job(
    "q_criterion",
    f"""with {_DIST}, sy as (select cluster, a as node, d from dist union all select cluster, b, d from dist),
    r as (select cluster, node, sum(d) / nullif(count(*) - 1, 0) as r, count(*) + 1 as n from sy group by 1, 2)
    select cluster, dist.a, dist.b, round(d - ra.r - rb.r, 9) as q from dist join r ra using (cluster) join r rb using (cluster) where ra.node = dist.a and rb.node = dist.b and ra.n > 2""",
    "isolates",
)
def q_criterion(spark, sf):
    return tree.q_criterion(pairs.pair_distances(t.isolates(spark, sf))).filter("n > 2").select("cluster", "a", "b", "q")


@job("tree_first_merge", f"with {_DIST} select cluster, a, b, d / 2 as height from (select *, row_number() over (partition by cluster order by d, a, b) as r from dist) where r = 1", "isolates")
def tree_first_merge(spark, sf):
    return tree.nearest_pair(pairs.pair_distances(t.isolates(spark, sf))).select("cluster", "a", "b", (F.col("d") / 2).alias("height"))


@job("cluster_tree_upgma", f"with recursive {_DIST}, {_UPGMA.format(dist='dist')} select cluster, cast(leaves as bigint) as leaves, max_depth, newick from up_tree", "isolates")
def cluster_tree_upgma(spark, sf):
    return tree.cluster_tree(pairs.pair_distances(t.isolates(spark, sf)), method="upgma")[0]


# Leaves of average linkage all lie as deep as the root's height.
@job(
    "tree_depths",
    f"with recursive {_DIST}, {_UPGMA.format(dist='dist')} select cluster, leaf, max_depth as depth from (select cluster, a as leaf from dist union select cluster, b from dist) join up_tree using (cluster)",
    "isolates",
)
def tree_depths(spark, sf):
    return tree.cluster_tree(pairs.pair_distances(t.isolates(spark, sf)), method="upgma")[1]


@job("cluster_tree_neighbor_joining", f"with recursive {_DIST}, {_NJ.format()} select cluster, cast(leaves as bigint) as leaves, max_depth, newick from nj_tree", "isolates")
def cluster_tree_nj(spark, sf):
    return tree.cluster_tree(pairs.pair_distances(t.isolates(spark, sf)), method="neighbor-joining")[0]


@job("outbreak_pairs", f"with {_DIST}, {_RATES} select cluster, a, b, d, (1 - d) * 100 as identity, d / (2 * rate) as years, pathogen from dist join rates using (cluster)", "isolates")
def outbreak_pairs(spark, sf):
    return outbreaks.outbreak_pairs(_isolates(spark, sf))


_PROTEIN_DIST = """pc as materialized (select protein_id, species || '-' || cast(protein_id // 28 as varchar) as cluster, seq from proteins),
pl as materialized (select protein_id, b as c, string_split(substr(seq, cast(b * 512 + 1 as int), 512), '') as letters from (select protein_id, seq, unnest(range(0, (length(seq) + 511) // 512)) as b from pc)),
pm as (select l.cluster, l.protein_id as a, r.protein_id as b from pc l join pc r on l.cluster = r.cluster and l.protein_id < r.protein_id),
dist as materialized (select cluster, a, b, cast(sum(len(x)) as int) as valid, cast(sum(len(list_filter(x, lambda z: z[1] <> z[2]))) as int) as mismatches, round(sum(len(list_filter(x, lambda z: z[1] <> z[2]))) / sum(len(x)), 9) as d
  from (select cluster, a, b, list_filter(list_zip(list_slice(l.letters, 1, least(len(l.letters), len(r.letters))), list_slice(r.letters, 1, least(len(l.letters), len(r.letters)))), lambda z: z[1] not in ('X', '-') and z[2] not in ('X', '-')) as x
    from pm join pl l on l.protein_id = pm.a join pl r on r.protein_id = pm.b and r.c = l.c) group by 1, 2, 3)"""


def _protein_batches(spark, sf):
    """Proteins of a species in batches of 28 consecutive accessions."""
    batch = F.concat_ws("-", "species", F.expr("cast(protein_id div 28 as string)"))
    return t.proteins(spark, sf).withColumn("cluster", batch)


@job("protein_distances", f"with {_PROTEIN_DIST} select cluster, a, b, valid, cast(valid - mismatches as int) as matches, mismatches, d as p_distance, (1 - d) * 100 as identity from dist", "proteins")
def protein_distances(spark, sf):
    d = pairs.protein_distances(_protein_batches(spark, sf))
    return d.select("cluster", "a", "b", "valid", "matches", "mismatches", F.col("d").alias("p_distance"), ((1 - F.col("d")) * 100).alias("identity"))


@job("protein_tree_upgma", f"with recursive {_PROTEIN_DIST}, {_UPGMA.format(dist='dist')} select cluster, cast(leaves as bigint) as leaves, max_depth, newick from up_tree", "proteins")
def protein_tree_upgma(spark, sf):
    return tree.cluster_tree(pairs.protein_distances(_protein_batches(spark, sf)))[0]


@job("protein_tree_neighbor_joining", f"with recursive {_PROTEIN_DIST}, {_NJ.format()} select cluster, cast(leaves as bigint) as leaves, max_depth, newick from nj_tree", "proteins")
def protein_tree_neighbor_joining(spark, sf):
    return tree.cluster_tree(pairs.protein_distances(_protein_batches(spark, sf)), method="neighbor-joining")[0]


_BY_SOURCE = _DISTANCES.format(p="", long=" and length(a.seq) >= 10 and length(b.seq) >= 10").replace("isolates", "by_source")


@job(
    "source_distances",
    f"with by_source as (select isolate_id, source as cluster, seq from isolates), {_BY_SOURCE} select cluster, count(*) as pairs, min(d) as closest, max(d) as farthest, avg(d) as mean_d, cast(count_if(d = 0) as bigint) as equal from dist group by 1",
    "isolates",
)
def source_distances(spark, sf):
    """Distances inside a whole source, whose isolates grow with the table: many blocks a cluster, folded where pairs are made."""
    by_source = t.isolates(spark, sf).select("isolate_id", F.col("source").alias("cluster"), "seq")
    folded = pairs.pair_distances(by_source, in_cells=True, folded=True).groupBy("cluster")
    mean = F.sum("total") / F.sum("pairs")
    return folded.agg(F.sum("pairs").alias("pairs"), F.min("closest").alias("closest"), F.max("farthest").alias("farthest"), mean.alias("mean_d"), F.sum("equal").alias("equal"))
