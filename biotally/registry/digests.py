"""Registered jobs: restriction digests, reading frames, plasmid annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotally.functions.sequence import iupac_regex, is_palindromic
from biotally.operators import orfs, restriction
from biotally.plans import plasmids
from biotally.reference_tables import CODON_RESIDUES, ENZYME_COLUMNS, ENZYMES, STARTS, STOPS, sql_values
from biotally.registry.core import job
from biotally.registry.oracle_views import windows_sql
from biotally.sources import tables as t

_KEY = "isolate_id"


def _seqs(spark, sf):
    return t.isolates(spark, sf).select(_KEY, "seq")


def _site_sql(enzymes=ENZYMES):
    parts = [
        f"select isolate_id, '{n}' as enzyme, i as position, i + {len(w) - 1} as \"end\", i - 1 + {top} as top_cut, i - 1 + {bot} as bottom_cut, "
        f"substr(w, 1, {len(w)}) as match_seq, '{kind}' as cut_type from win where regexp_matches(w, '^{iupac_regex(w)}')"
        for n, w, top, bot, kind, _ in enzymes
    ]
    return (
        windows_sql("win", "isolates", "isolate_id", 13, partial=True) + ",\nsites as (" + "\nunion all ".join(parts) + ")"
    )


_SITES = _site_sql()
_SIZES = """
cuts as (select isolate_id, enzyme, top_cut as cut, 0 as is_end from sites
  union all select isolate_id, enzyme, length(seq) as cut, 1 as is_end from (select distinct isolate_id, enzyme from sites) join isolates using (isolate_id)),
sizes as (select isolate_id, enzyme, cast(row_number() over w as int) as fragment_no, cast(cut - lag(cut, 1, 0) over w as int) as size from cuts
  window w as (partition by isolate_id, enzyme order by cut, is_end))"""


@job("find_cut_sites", f"with {_SITES} select * from sites", "isolates")
def find_cut_sites(spark, sf):
    return restriction.find_cut_sites(_seqs(spark, sf), _KEY)


@job("fragment_sizes", f"with {_SITES}, {_SIZES} select * from sizes", "isolates")
def fragment_sizes(spark, sf):
    s = _seqs(spark, sf)
    return restriction.fragment_sizes(restriction.find_cut_sites(s, _KEY), s.select(_KEY, F.length("seq").alias("length")), _KEY)


@job(
    "digest",
    f"""with {_SITES}, {_SIZES} select isolate_id, enzyme, count(*) - 1 as sites, count(*) as fragments, max(size) as largest,
    min(size) as smallest, list_sort(list(size), 'DESC') as sizes from sizes group by 1, 2""",
    "isolates",
)
def digest(spark, sf):
    return plasmids.digest(_seqs(spark, sf), _KEY)


@job(
    "top_cutting_enzymes",
    f"""with {_SITES}, c as (select isolate_id, enzyme, count(*) as sites from sites group by 1, 2)
    select isolate_id, enzyme, sites, rank from (select *, cast(row_number() over (partition by isolate_id order by sites desc, enzyme) as int) as rank from c) where rank <= 10""",
    "isolates",
)
def top_cutting_enzymes(spark, sf):
    return restriction.top_cutting_enzymes(restriction.find_cut_sites(_seqs(spark, sf), _KEY), _KEY)


@job(
    "count_distinct_enzymes",
    f"with {_SITES} select isolate_id, count(distinct enzyme) as enzymes_cutting, count(*) as cut_sites from sites group by 1",
    "isolates",
)
def count_distinct_enzymes(spark, sf):
    c = restriction.cutting_enzymes(restriction.find_cut_sites(_seqs(spark, sf), _KEY), _KEY)
    return c.groupBy(_KEY).agg(F.count("*").alias("enzymes_cutting"), F.sum("sites").alias("cut_sites"))


def _picked(rows):
    return {e[0] for e in rows}


@job(
    "select_enzymes",
    f"""with {_SITES}, e as (select * from {sql_values("v", ENZYME_COLUMNS, ENZYMES)})
    select enzyme, length(recognition) between 4 and 6 as default_choice, length(recognition) <= 5 as frequent, length(recognition) >= 6 as rare,
    enzyme in ('EcoRI', 'BamHI') as named, count(*) as sites from sites join e on e.name = sites.enzyme group by all""",
    "isolates",
)
def select_enzymes(spark, sf):
    """Enzyme choices (default, by name, frequent, rare) with the sites each enzyme has in the whole table."""
    e = restriction.enzyme_table(spark)
    flag = lambda df, name: df.select("name", F.lit(True).alias(name))
    e = (
        e.select("name")
        .join(flag(restriction.select_enzymes(e), "default_choice"), "name", "left")
        .join(flag(restriction.frequent_cutters(e), "frequent"), "name", "left")
        .join(flag(restriction.rare_cutters(e), "rare"), "name", "left")
        .join(flag(restriction.select_enzymes(e, ["EcoRI", "BamHI"]), "named"), "name", "left")
        .na.fill(False)
    )
    counts = restriction.find_cut_sites(_seqs(spark, sf), _KEY).groupBy("enzyme").agg(F.count("*").alias("sites"))
    return counts.join(F.broadcast(e), counts.enzyme == e.name).drop("name")


@job(
    "is_palindromic",
    f"""with {windows_sql('win', 'isolates', 'isolate_id', 6)}
    select w as word, w = reverse(translate(w, 'ACGT', 'TGCA')) as palindromic, count(*) as n from win group by 1""",
    "isolates",
)
def palindromic_words(spark, sf):
    from biotally.functions.sequence import overlapping_words

    words = _seqs(spark, sf).select(F.explode(overlapping_words(F.col("seq"), 6)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("palindromic", is_palindromic(F.col("word")))


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_ORFS = f"""st as (select isolate_id, '+' as strand, seq from isolates union all
  select isolate_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) from isolates),
{windows_sql('w3', 'st', 'isolate_id', 3, extra='strand')},
cod as (select isolate_id, strand, i - 1 as i, w as codon, (i - 1) % 3 as frame from w3 where w in {_in(STARTS + STOPS)}),
nx as (select *, min(case when codon in {_in(STOPS)} then i end) over (partition by isolate_id, strand, frame order by i desc
  rows between unbounded preceding and 1 preceding) as stop from cod),
sp as (select isolate_id, strand, i, stop, codon, stop + 3 - i as len, length(seq) as n, substr(seq, i + 1, stop + 3 - i) as orf
  from nx join st using (isolate_id, strand) where codon in {_in(STARTS)} and stop is not null and stop + 3 - i >= 30),
orfs as (select isolate_id, strand, case when strand = '+' then i + 1 else cast(n as int) - stop - 2 end as start,
  case when strand = '+' then stop + 3 else cast(n as int) - i end as "end", len as length, codon as start_codon,
  array_to_string(list_transform(range(0, len // 3), lambda k: substr('{CODON_RESIDUES}',
    cast((instr('TCAG', substr(orf, cast(3 * k + 1 as int), 1)) - 1) * 16 + (instr('TCAG', substr(orf, cast(3 * k + 2 as int), 1)) - 1) * 4 + instr('TCAG', substr(orf, cast(3 * k + 3 as int), 1)) as int), 1)), '') as protein,
  length(regexp_replace(orf, '[^GC]', '', 'g')) * 100.0::double / len as gc from sp)"""


_NEXT = _ORFS[: _ORFS.index("sp as (")].rstrip().rstrip(",")


@job(
    "next_stop",
    f"with {_NEXT} select isolate_id, strand, frame, count(*) as starts, max(stop - i) as longest, cast(sum(stop - i) as bigint) as total from nx where codon in {_in(STARTS)} and stop is not null group by 1, 2, 3",
    "isolates",
)
def next_stop(spark, sf):
    """Distance from each start codon to its first in-frame stop, per sequence and frame."""
    rows = orfs.next_stop(orfs.start_stop_codons(_seqs(spark, sf), _KEY), _KEY).withColumn("gap", F.col("stop") - F.col("i"))
    return rows.groupBy(_KEY, "strand", "frame").agg(F.count("*").alias("starts"), F.max("gap").alias("longest"), F.sum("gap").alias("total"))


@job("find_orfs", f"with {_ORFS} select * from orfs", "isolates")
def find_orfs(spark, sf):
    return orfs.find_orfs(_seqs(spark, sf), _KEY)


@job(
    "longest_orf",
    f"""with {_ORFS} select isolate_id, strand, start, "end", length, protein from
    (select *, row_number() over (partition by isolate_id order by length desc, strand, start) as r from orfs) where r = 1""",
    "isolates",
)
def longest_orf(spark, sf):
    """The first row of each sequence's frames sorted by length."""
    best = orfs.find_orfs(_seqs(spark, sf), _KEY).groupBy(_KEY).agg(
        F.min_by(
            F.struct("strand", "start", "end", "length", "protein"),
            F.struct(-F.col("length"), "strand", "start"),
        ).alias("o")
    )
    return best.select(_KEY, "o.*")


@job(
    "plasmid_annotation",
    f"""with {_site_sql([e for e in ENZYMES if 4 <= len(e[1]) <= 6])}, {_ORFS},
    o as (select isolate_id, count(*) as orfs, max(length) as longest_orf from orfs where length >= 60 group by 1),
    c as (select isolate_id, count(*) as cut_sites, count(distinct enzyme) as enzymes_cutting from sites group by 1)
    select isolate_id, cast(length(seq) as int) as length, length(regexp_replace(seq, '[^GC]', '', 'g')) * 100.0::double / length(seq) as gc,
    coalesce(orfs, 0) as orfs, coalesce(longest_orf, 0) as longest_orf, coalesce(cut_sites, 0) as cut_sites, coalesce(enzymes_cutting, 0) as enzymes_cutting
    from isolates left join o using (isolate_id) left join c using (isolate_id)""",
    "isolates",
)
def plasmid_annotation(spark, sf):
    return plasmids.plasmid_annotation(_seqs(spark, sf), _KEY)
