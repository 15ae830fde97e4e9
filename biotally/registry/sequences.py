"""Registered jobs: sequence scalars over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotally.functions import sequence as s
from biotally.operators import codons
from biotally.plans import constructs
from biotally.reference_tables import CODON_RESIDUES, REVERSE_CODONS
from biotally.registry.core import job
from biotally.registry.oracle_views import windows_sql
from biotally.sources import tables as t


@job(
    "sanitize",
    "select doc_id, " + ", ".join(f"md5(upper(regexp_replace(text, '[^{a}{a.lower()}]', '', 'g'))) as {n}" for n, a in s.ALPHABETS.items()) + " from documents",
)
def sanitize(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", *[F.md5(s.sanitize(F.col("text"), n)).alias(n) for n in s.ALPHABETS])


@job("gc_content", "select isolate_id, length(regexp_replace(seq, '[^GC]', '', 'g')) * 100.0::double / length(seq) as gc from isolates", "isolates")
def gc_content(spark, sf):
    return t.isolates(spark, sf).select("isolate_id", s.gc_content(F.col("seq")).alias("gc"))


@job("reverse_complement", "select isolate_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) as digest from isolates", "isolates")
def reverse_complement(spark, sf):
    return t.isolates(spark, sf).select("isolate_id", F.md5(s.reverse_complement(F.col("seq"))).alias("digest"))


@job("kmers", f"with {windows_sql('w5', 'proteins', 'protein_id', 5)} select w as word, count(*) as n from w5 group by 1", "proteins")
def kmers(spark, sf):
    return s.words_at(t.proteins(spark, sf), (), F.col("seq"), 5, word="word").groupBy("word").agg(F.count("*").alias("n"))


@job(
    "codon_join",
    f"""with {windows_sql('w3', 'isolates', 'isolate_id', 3)} select isolate_id, md5(string_agg(substr('{CODON_RESIDUES}', cast((instr('TCAG', substr(w, 1, 1)) - 1) * 16 + (instr('TCAG', substr(w, 2, 1)) - 1) * 4 + instr('TCAG', substr(w, 3, 1)) as int), 1), '' order by i)) as digest,
    count(*) as residues from w3 where (i - 1) % 3 = 0 group by 1""",
    "isolates",
)
def codon_join(spark, sf):
    p = s.translate_codons(F.col("seq"))
    return t.isolates(spark, sf).select("isolate_id", F.md5(p).alias("digest"), F.length(p).cast("bigint").alias("residues"))


@job("codons", f"with {windows_sql('w3', 'isolates', 'isolate_id', 3, extra='source')} select source, w as codon, count(*) as n from w3 where (i - 1) % 3 = 0 group by 1, 2", "isolates")
def codon_counts(spark, sf):
    return codons.codon_counts(t.isolates(spark, sf), "source").drop("aa")


@job(
    "iupac_regex",
    f"""with {windows_sql('w6', 'isolates', 'isolate_id', 6)} select count(*) as windows, cast(count_if(regexp_matches(w, '^GT[CT][AG]AC$')) as bigint) as gtyrac, cast(count_if(regexp_matches(w, '^GA[ACGT]TC')) as bigint) as gantc from w6""",
    "isolates",
)
def iupac_regex(spark, sf):
    w = s.words_at(t.isolates(spark, sf), (), F.col("seq"), 6).groupBy("w").agg(F.count("*").alias("n"))
    fixed = F.when(F.regexp_like("w", F.lit(f"^{s.iupac_regex('GTYRAC')}$")), F.col("n")).otherwise(0)
    column = F.when(F.regexp_like("w", F.concat(F.lit("^"), s.iupac_regex_column(F.lit("GANTC")))), F.col("n")).otherwise(0)
    return w.agg(F.sum("n").alias("windows"), F.sum(fixed).alias("gtyrac"), F.sum(column).alias("gantc"))


_REV = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in REVERSE_CODONS.items()) + "}"


@job("reverse_translate", f"select protein_id, md5(array_to_string(list_transform(string_split(seq, ''), lambda c: coalesce({_REV}[c], 'NNN')), '')) as digest, length(seq) * 110 / 1000.0::double as kda from proteins", "proteins")
def reverse_translate(spark, sf):
    q = F.col("seq")
    return t.proteins(spark, sf).select("protein_id", F.md5(constructs.reverse_translate(q)).alias("digest"), constructs.molecular_weight(q).alias("kda"))


@job(
    "clamp_and_round",
    "select o_orderkey, greatest(1000.0::double, least(200000.0::double, o_totalprice)) as clamped, cast(floor(o_totalprice / 7 + 0.5) as bigint) as whole, round(o_totalprice / 7, 2) as two_digits from orders",
)
def clamp_and_round(spark, sf):
    p = F.col("o_totalprice")
    return t.table(spark, sf, "orders").select("o_orderkey", s.clamp(p, 1000.0, 200000.0).alias("clamped"), s.round_half_up(p / 7).alias("whole"), F.round(p / 7, 2).alias("two_digits"))
