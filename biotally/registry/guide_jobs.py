"""Registered jobs: guides and their off-target words."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotally.operators import guides, near_words
from biotally.reference_tables import GUIDE_PREFERRED, GUIDE_WEIGHTS
from biotally.registry.core import job
from biotally.registry.oracle_views import folding_sql, windows_sql
from biotally.sources import tables as t


def _seqs(spark, sf):
    return t.isolates(spark, sf).select("isolate_id", "seq")


_TEN = [round(w * 10) for w in GUIDE_WEIGHTS]
_SCORE = "500 - " + str(sum(2 * w for i, w in enumerate(_TEN, 1) if i not in GUIDE_PREFERRED)) + "".join(
    f" + case when substr(g, {i}, 1) in ({', '.join(repr(x) for x in good)}) then {5 * _TEN[i - 1]} else {-2 * _TEN[i - 1]} end" for i, good in GUIDE_PREFERRED.items()
) + " + case when gc between 40 and 60 then 100 when gc < 20 or gc > 80 then -150 else 0 end - case when contains(g, 'TTTT') then 200 else 0 end"


def _code(w: str, k: int) -> str:
    return " + ".join(f"(instr('ACGT', substr({w}, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k))


def _cand(view: str, key: str) -> str:
    return f"""st as (select {key}, '+' as strand, seq, length(seq) as n from {view} union all select {key}, '-', reverse(translate(seq, 'ACGT', 'TGCA')), length(seq) from {view}),
{windows_sql('w23', 'st', key, 23, extra='strand, n').replace('length(seq) as n, unnest', 'unnest').replace(', b, n, substr', ', b, substr').replace('strand, n, seq, unnest', 'strand, n, seq, unnest')},
gd as materialized (select *, length(regexp_replace(g, '[^GC]', '', 'g')) * 5.0::double as gc from (select {key}, strand, case when strand = '+' then i else cast(n as int) - i - 18 end as position, substr(w, 1, 20) as g, substr(w, 21, 3) as pam
  from w23 where substr(w, 22, 2) = 'GG')),
cand as materialized (select {key}, strand, position, g as guide, pam, gc, starts_with(g, 'G') as starts_with_g, cast(greatest(0, least(100, floor(({_SCORE} + 5) / 10.0::double))) as int) as on_target from gd),
sd as (select distinct {_code('substr(guide, 9, 12)', 12)} as seed, {_code("reverse(translate(substr(guide, 9, 12), 'ACGT', 'TGCA'))", 12)} as seed_rc from cand),
{windows_sql('g12', 'benchmark_dna', 'seq_id', 12)},
gw as materialized (select {_code('w', 12)} as target, count(*) as n from g12 group by 1)"""


_MM = "bit_count((xor(q, target) | (xor(q, target) >> 1)) & 5592405)"


@job("guide_candidates", f"with {_cand('isolates', 'isolate_id')} select isolate_id, strand, position, guide, pam, gc, starts_with_g, on_target from cand", "isolates benchmark_dna")
def guide_candidates(spark, sf):
    return guides.guide_candidates(_seqs(spark, sf), "isolate_id")


@job(
    "offtarget_hits",
    f"""with {_cand('benchmark_dna', 'seq_id')}, q as (select seed, '+' as turn, seed as q from sd union all select seed, '-', seed_rc from sd)
    select seed, turn, target, cast({_MM} as int) as mismatches, n from q join gw on {_MM} <= 3""",
    "benchmark_dna",
)
def offtarget_hits(spark, sf):
    b = t.benchmark_dna(spark, sf)
    return guides.offtarget_hits(guides.guide_candidates(b, "seq_id"), b)


_SPEC = f"""q as (select seed, unnest([seed, seed_rc]) as q from sd), dq as (select distinct q from q),
bl as materialized (select q, sum(case when {_MM} <= 2 then n else 0 end) as h2, sum(n) as h3 from dq join gw on {_MM} <= 3 group by 1),
hc as materialized (select seed, coalesce(sum(h2), 0) as hits2, coalesce(sum(h3), 0) as hits3 from q left join bl using (q) group by 1)"""


@job("offtarget_counts", f"with {_cand('isolates', 'isolate_id')}, {_SPEC} select seed, cast(hits2 as bigint) as hits2, cast(hits3 as bigint) as hits3 from hc", "isolates benchmark_dna")
def offtarget_counts(spark, sf):
    return guides.offtarget_counts(guides.guide_candidates(_seqs(spark, sf), "isolate_id"), t.benchmark_dna(spark, sf))


_BEST = f"""sp as (select cand.*, hits2, hits3, cast(greatest(0, 100 - 20 * hits2 - 2 * hits3) as int) as specificity from cand join hc on hc.seed = {_code('substr(guide, 9, 12)', 12)}),
best as (select * from (select *, row_number() over (partition by isolate_id order by 6 * on_target + 4 * specificity desc, position, strand) as rank from sp) where rank <= 20)"""


@job(
    "guide_specificity",
    f"with {_cand('isolates', 'isolate_id')}, {_SPEC}, {_BEST} select isolate_id, strand, position, guide, on_target, specificity, cast(rank as int) as rank, (6 * on_target + 4 * specificity) / 10.0::double as combined from best",
    "isolates benchmark_dna",
)
def guide_specificity(spark, sf):
    g = guides.find_guides(_seqs(spark, sf), t.benchmark_dna(spark, sf), "isolate_id")
    return g.select("isolate_id", "strand", "position", "guide", "on_target", "specificity", "rank", "combined")


@job(
    "find_guides",
    f"""with {_cand('isolates', 'isolate_id')}, {_SPEC}, {_BEST}, gs as (select distinct guide as w, 20 as n from best), {folding_sql('gs', 'fg')}
    select isolate_id, strand, position, guide, pam, gc, starts_with_g, on_target, cast(hits2 as bigint) as hits2, cast(hits3 as bigint) as hits3, specificity, cast(rank as int) as rank,
      (6 * on_target + 4 * specificity) / 10.0::double as combined, hairpin from best join fg_hp on fg_hp.w = guide""",
    "isolates benchmark_dna",
)
def find_guides(spark, sf):
    return guides.find_guides(_seqs(spark, sf), t.benchmark_dna(spark, sf), "isolate_id")


@job(
    "hamming",
    """with bl as (select isolate_id, b as c, substr(seq, cast(b * 12 + 1 as int), 12) as w from (select isolate_id, seq, unnest(range(0, length(seq) // 12)) as b from isolates)),
    p as (select isolate_id, w, lead(w) over (partition by isolate_id order by c) as nx from bl)
    select isolate_id, count(*) as blocks, cast(sum(hamming(w, nx)) as bigint) as distance, min(hamming(w, nx)) as closest from p where nx is not null group by 1""",
    "isolates",
)
def hamming(spark, sf):
    """Mismatches between consecutive 12-letter blocks of each sequence, by the letter-wise and the packed form."""
    from biotally.functions.sequence import hamming as letters
    from biotally.session import spread

    blocks = F.regexp_extract_all(F.col("seq"), F.lit("(.{12})"), F.lit(1))
    rows = spread(_seqs(spark, sf), "isolate_id").select("isolate_id", blocks.alias("b"))
    pairs = rows.select("isolate_id", F.explode(F.arrays_zip(F.expr("slice(b, 1, greatest(size(b) - 1, 0))").alias("x"), F.expr("slice(b, 2, greatest(size(b) - 1, 0))").alias("y"))).alias("p"))
    d = near_words.mismatches(near_words.word_code(F.col("p.x")), near_words.word_code(F.col("p.y")), 12)
    same = letters(F.col("p.x"), F.col("p.y"))
    return pairs.select("isolate_id", F.when(d == same, d).alias("d")).groupBy("isolate_id").agg(
        F.count("*").alias("blocks"), F.sum("d").alias("distance"), F.min("d").cast("bigint").alias("closest")
    )
