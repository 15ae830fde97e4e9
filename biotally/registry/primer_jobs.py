"""Registered jobs: primers over the benchmark templates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from biotally.operators import folding, primers
from biotally.reference_tables import (
    GAS_CONSTANT,
    INIT_AT_DH,
    INIT_AT_DS,
    INIT_GC_DH,
    INIT_GC_DS,
    SODIUM,
    STACK_DH,
    STACK_DS,
    STRAND_CONC,
    SYMMETRY_DS,
)
from biotally.registry.core import job
from biotally.registry.oracle_views import folding_sql, windows_sql
from biotally.sources import tables as t

_WORDS = windows_sql("w22", "benchmark_dna", "seq_id", 22, partial=True) + """,
pw as materialized (select seq_id, i as position, len, substr(w, 1, len) as primer from w22 cross join (values (18), (19), (20), (21), (22)) as l(len) where length(w) >= len)"""


def _stack(col: str, table: dict, n: int) -> str:
    m = "map {" + ", ".join(f"'{k}': {round(v * 10)}" for k, v in table.items()) + "}"
    return "(" + " + ".join(f"coalesce({m}[substr({col}, {j}, 2)], 0)" for j in range(1, n)) + ")"


def _end(c: str, gc: float, at: float) -> str:
    return f"(case when {c} in ('G', 'C') then {round(gc * 10)} else {round(at * 10)} end)"


def _tm(p: str) -> str:
    first, last = f"substr({p}, 1, 1)", f"right({p}, 1)"
    pal = f"{p} = reverse(translate({p}, 'ACGT', 'TGCA'))"
    dh = f"({_stack(p, STACK_DH, 22)} + {_end(first, INIT_GC_DH, INIT_AT_DH)} + {_end(last, INIT_GC_DH, INIT_AT_DH)}) / 10.0::double"
    ds = f"({_stack(p, STACK_DS, 22)} + {_end(first, INIT_GC_DS, INIT_AT_DS)} + {_end(last, INIT_GC_DS, INIT_AT_DS)} + case when {pal} then {round(SYMMETRY_DS * 10)} else 0 end) / 10.0::double"
    return f"round({dh} * 1000 / ({ds} + case when {pal} then {GAS_CONSTANT * math.log(STRAND_CONC)!r}::double else {GAS_CONSTANT * math.log(STRAND_CONC / 4)!r}::double end) - 273.15::double + {16.6 * math.log10(SODIUM)!r}::double, 1)"


_DG = f"round({_stack('right(primer, 5)', STACK_DH, 5)} / 10.0::double - 298.15::double * {_stack('right(primer, 5)', STACK_DS, 5)} / 10000.0::double, 1)"


def _templates(spark, sf):
    return t.benchmark_dna(spark, sf)


@job(
    "melting_temp",
    f"""with {_WORDS} select seq_id, position, len, {_tm('primer')} as tm, length(regexp_replace(primer, '[^GC]', '', 'g')) * 100.0::double / len as gc,
    {_DG} as three_prime, cast(length(regexp_replace(right(primer, 5), '[^GC]', '', 'g')) as int) as gc_clamp from pw""",
    "benchmark_dna",
)
def melting_temp(spark, sf):
    words = primers.primer_words(_templates(spark, sf), "seq_id").withColumn("primer", F.col("word"))
    return primers.primer_thermo(words).select("seq_id", (F.col("i") + 1).alias("position"), "len", "tm", "gc", "three_prime", "gc_clamp")


@job(
    "dinucleotide_stacks",
    f"""with {windows_sql('w2', 'benchmark_dna', 'seq_id', 2)}
    select seq_id, cast(sum({_stack('w', STACK_DH, 2)}) as int) as dh_tenths, cast(sum({_stack('w', STACK_DS, 2)}) as int) as ds_tenths from w2 group by 1""",
    "benchmark_dna",
)
def dinucleotide_stacks(spark, sf):
    s = F.col("seq")
    return _templates(spark, sf).select(
        "seq_id", primers.dinucleotide_stacks(s, STACK_DH).alias("dh_tenths"), primers.dinucleotide_stacks(s, STACK_DS).alias("ds_tenths")
    )


_W18 = windows_sql("w18", "benchmark_dna", "seq_id", 18) + ", d18 as materialized (select distinct w from w18)"


@job(
    "best_self_dimer",
    f"""with {_W18}, c as (select w, o, count_if(substr(w, i, 1) = translate(substr(w, 18 - (i - o) + 1, 1), 'ACGT', 'TGCA')) as pairs from
      (select w, o, unnest(range(greatest(1, 1 + o), least(18, 18 + o) + 1)) as i from (select w, unnest(range(-15, 15)) as o from d18)) group by 1, 2)
    select w as word, case when max(pairs) >= 4 then -max(pairs)::double else 0.0::double end as dimer from c group by 1""",
    "benchmark_dna",
)
def best_self_dimer(spark, sf):
    from biotally.functions.sequence import overlapping_words

    words = _templates(spark, sf).select(F.explode(overlapping_words(F.col("seq"), 18)).alias("word")).distinct()
    return words.select("word", folding.best_self_dimer("word").alias("dimer"))


@job(
    "best_hairpin",
    f"""with {_W18}, ij as (select w, i, j from (select w, i, unnest(range(i + 4, 19)) as j from (select w, unnest(range(1, 15)) as i from d18))),
    st as (select w, i, j, l, substr(w, i + l, 1) = translate(substr(w, j - l, 1), 'ACGT', 'TGCA') as ok from (select w, i, j, unnest(range(0, (j - i + 1) // 2)) as l from ij)),
    run as (select w, i, j, coalesce(min(case when not ok then l end), max(l) + 1) as n from st group by 1, 2, 3)
    select w as word, case when max(n) >= 3 then -1.5::double * max(n) else 0.0::double end as hairpin from run group by 1""",
    "benchmark_dna",
)
def best_hairpin(spark, sf):
    from biotally.functions.sequence import overlapping_words

    words = _templates(spark, sf).select(F.explode(overlapping_words(F.col("seq"), 18)).alias("word")).distinct()
    return words.select("word", folding.best_hairpin("word").alias("hairpin"))


_PSCORE = """cast(greatest(0, least(100, floor(round(100 - abs(tm - 58) * 2 - case when gc between 40 and 60 then 0 else 10 end - case when hairpin < -3 then 8 else 0 end - case when hairpin < -5 then 12 else 0 end
  - case when self_dimer < -3 then 6 else 0 end - case when self_dimer < -5 then 10 else 0 end - case when gc_clamp between 1 and 3 then 0 else 8 end - case when three_prime < -8 then 5 else 0 end, 6) + 0.5))) as int)"""
_CAND = f"""{_WORDS},
ori as (select seq_id, position, len, primer, 'forward' as orientation from pw union all select seq_id, position, len, reverse(translate(primer, 'ACGT', 'TGCA')), 'reverse' from pw),
th as materialized (select * from (select *, {_tm('primer')} as tm, length(regexp_replace(primer, '[^GC]', '', 'g')) * 100.0::double / len as gc, {_DG} as three_prime,
  cast(length(regexp_replace(right(primer, 5), '[^GC]', '', 'g')) as int) as gc_clamp from ori) where gc between 40 and 60 and abs(tm - 58) <= 10),
dw as materialized (select distinct primer as w, len as n from th),
{folding_sql('dw', 'fo')},
cand as materialized (select seq_id, position, len, primer, orientation, tm, gc, hairpin, self_dimer, three_prime, gc_clamp, {_PSCORE} as score from th join fo_hp on fo_hp.w = primer join fo_sd on fo_sd.w = primer
  where hairpin >= -6 and (orientation = 'reverse' or self_dimer >= -6))"""
_DESIGN = f"""{_CAND}, lt as (select seq_id from benchmark_dna where length(seq) >= 100),
f as (select * from (select *, row_number() over (partition by seq_id order by score desc, position, len) as r from cand where orientation = 'forward' and seq_id in (from lt)) where r <= 30),
pp as materialized (select seq_id, f.position as f_position, r.position as r_position, f.primer as f_primer, r.primer as r_primer, f.score as f_score, r.score as r_score, r.position + r.len - f.position as product,
  round(abs(f.tm - r.tm), 1) as tm_difference from f join cand r using (seq_id) where r.orientation = 'reverse' and r.position + r.len - f.position between 150 and 800 and round(abs(f.tm - r.tm), 1) <= 5),
pd as materialized (select distinct f_primer as a, r_primer as b, length(f_primer) as n, length(r_primer) as m from pp),
xd as materialized (select a, b, case when max(pairs) >= 4 then -max(pairs)::double else 0.0::double end as cross_dimer from (select a, b, o, count_if(substr(a, i, 1) = translate(substr(b, i - o, 1), 'ACGT', 'TGCA')) as pairs
  from (select a, b, o, unnest(range(greatest(1, 1 + o), least(n, m + o) + 1)) as i from (select a, b, n, m, unnest(range(3 - n, m - 3)) as o from pd)) group by 1, 2, 3) group by 1, 2),
sc as (select pp.*, cross_dimer, cast(greatest(0, least(100, floor(round(f_score * 0.35::double + r_score * 0.35::double + (100 - tm_difference * 10) * 0.15::double + case when cross_dimer > -3 then 100 when cross_dimer > -5 then 60 else 30 end * 0.15::double, 6) + 0.5))) as int) as score
  from pp join xd on a = f_primer and b = r_primer),
design as materialized (select * from (select *, cast(row_number() over (partition by seq_id order by score desc, f_position, r_position, f_primer, r_primer) as int) as rank from sc) where rank <= 15)"""
_MIS = f"""{_DESIGN}, up as (select distinct unnest([f_primer, r_primer]) as primer from design),
qu as materialized (select primer, turn, q, length(q) as n, right(q, 15) as seed from (select primer, '+' as turn, primer as q from up union all select primer, '-', reverse(translate(primer, 'ACGT', 'TGCA')) from up)),
{windows_sql('w15', 'benchmark_dna', 'seq_id', 15)},
dk as (select distinct w from w15), nr as materialized (select distinct seed, w, hamming(seed, w) as sm from (select distinct seed from qu) cross join dk where hamming(seed, w) <= 3),
mh as materialized (select primer, turn, seq_id, i as position, sm as seed_mismatches, n, q, seq, least(n - 15, i - 1) as ext from qu join nr using (seed) join w15 using (w) join benchmark_dna using (seq_id)),
mis as materialized (select primer, turn, seq_id, position, cast(seed_mismatches as int) as seed_mismatches, cast(seed_mismatches + wrong as int) as total_mismatches, cast(15 + ext as int) as match_length, (1 - (seed_mismatches + wrong) / (15 + ext)) * 100 as match_percent
  from (select *, case when ext > 0 then hamming(substr(q, cast(n - 15 - ext + 1 as int), cast(ext as int)), substr(seq, cast(position - ext as int), cast(ext as int))) else 0 end as wrong from mh))"""


@job("primer_candidates", f"with {_CAND} select * from cand", "benchmark_dna")
def primer_candidates(spark, sf):
    s = _templates(spark, sf)
    f = primers.candidates(s, "seq_id", "forward").withColumn("orientation", F.lit("forward"))
    return f.unionByName(primers.candidates(s, "seq_id", "reverse").withColumn("orientation", F.lit("reverse")))


@job("design_primers", f"with {_DESIGN} select * from design", "benchmark_dna")
def design_primers(spark, sf):
    return primers.design_primers(_templates(spark, sf), "seq_id")


def _pairs(spark, sf):
    return primers.design_primers(_templates(spark, sf), "seq_id").select("seq_id", "f_position", "r_position", "f_primer", "r_primer")


@job("mispriming_hits", f"with {_MIS} select * from mis", "benchmark_dna")
def mispriming_hits(spark, sf):
    p = _pairs(spark, sf).select(F.explode(F.array("f_primer", "r_primer")).alias("primer"))
    return primers.mispriming_hits(p, _templates(spark, sf))


@job(
    "top_mispriming_hits",
    f"with {_MIS} select * from (select *, cast(row_number() over (partition by primer order by total_mismatches, match_length desc, seq_id, position, turn) as int) as rank from mis) where rank <= 10",
    "benchmark_dna",
)
def top_mispriming_hits(spark, sf):
    p = _pairs(spark, sf).select(F.explode(F.array("f_primer", "r_primer")).alias("primer"))
    return primers.top_mispriming_hits(primers.mispriming_hits(p, _templates(spark, sf)))


@job(
    "pair_specificity",
    f"""with {_MIS}, pe as (select primer, count(*) as h, count_if(total_mismatches <= 1) as st, list(distinct seq_id) filter (where total_mismatches <= 1) as src from mis group by 1),
    ps as (select seq_id, f_position, r_position, f_primer, r_primer, coalesce(a.h, 0) + coalesce(b.h, 0) as hits, cast(coalesce(a.st, 0) + coalesce(b.st, 0) as bigint) as strong_hits,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(a.src, []), coalesce(b.src, [])))), ',') as strong_sources
      from design left join pe a on a.primer = f_primer left join pe b on b.primer = r_primer)
    select *, greatest(0, 100 - 5 * hits - 15 * strong_hits) as specificity, case when strong_hits > 0 then 'high' when hits > 5 then 'moderate' end as warning from ps""",
    "benchmark_dna",
)
def pair_specificity(spark, sf):
    pairs = _pairs(spark, sf)
    hits = primers.mispriming_hits(pairs.select(F.explode(F.array("f_primer", "r_primer")).alias("primer")), _templates(spark, sf))
    return primers.pair_specificity(pairs, hits)
