"""Registered jobs: parsers over texts derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotally.sources import records as r
from biotally.sources import tables as t
from biotally.registry.core import job


@job(
    "read_fasta",
    "select 'doc' || doc_id as seq_id, length(seq) as length, md5(seq) as digest from (select doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z\\s]', '', 'g')), '\\s', '', 'g') as seq from documents)",
)
def read_fasta(spark, sf):
    """FASTA records made of document texts: header words, wrapped lines, lower case."""
    rec = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(" lang="), "lang", F.lit("\n"), F.regexp_replace("text", "[^A-Za-z\\s]", ""))
    name, seq = r.parse_fasta(F.col("rec"))
    rows = t.table(spark, sf, "documents").select(rec.alias("rec")).select(name.alias("seq_id"), seq.alias("seq"))
    return rows.select("seq_id", F.length("seq").cast("bigint").alias("length"), F.md5("seq").alias("digest"))


@job(
    "read_named_sequences",
    "select conv_id || '/' || turn as name, cast(length(regexp_replace(text, '\\s', '', 'g')) as bigint) as letters, regexp_matches(text, '\\S') as accepted from (select conv_id, turn, regexp_replace(text, '[^A-Za-z ]', '', 'g') as text from conversations)",
)
def read_named_sequences(spark, sf):
    """Lines ``name<TAB>pieces`` made of conversation turns; a line without letters is malformed."""
    text = F.regexp_replace("text", "[^A-Za-z ]", "")
    label = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    lines = t.table(spark, sf, "conversations").select(label.alias("label"), F.concat(label, F.lit("\t"), text).alias("value"))
    name, seq = r.parse_named(F.col("value"))
    ok = F.regexp_like("value", F.lit(r._NAMED))
    return lines.select(F.when(ok, name).otherwise(F.col("label")).alias("name"), F.when(ok, F.length(seq)).otherwise(0).cast("bigint").alias("letters"), ok.alias("accepted"))


_QUALITY = "case when {0} >= 70 then 'high' when {0} >= 50 then 'medium' else 'low' end"
_BAND = "case when {0} >= 90 then 'very high' when {0} >= 70 then 'confident' when {0} >= 50 then 'low' else 'very low' end"


def _atoms(spark, sf):
    li = t.table(spark, sf, "lineitem")
    line = F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", F.col("l_linenumber"), (F.col("l_partkey") % 5 + 1).cast("int"), F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(1.0), F.round(F.col("l_quantity") * 2 - 0.5, 2))
    return li.select("l_orderkey", "l_linenumber", "l_quantity", line.alias("value"))


# Lines of one file are ordered by line number, then quantity in case of repeats.
_PDB = "fa as materialized (select l_orderkey as file, cast(l_partkey % 5 + 1 as int) as residue_no, arg_min(l_quantity * 2 - 0.5, l_linenumber * 1000 + l_quantity) as plddt from lineitem group by 1, 2)"


@job("read_pdb_confidence", f"with {_PDB} select file, residue_no, plddt::double as plddt, {_BAND.format('plddt')} as band from fa")
def read_pdb_confidence(spark, sf):
    """Fixed-width ATOM lines made of order lines: one file per order, first atom per residue."""
    lines = _atoms(spark, sf).select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("ord"), "value")
    rows = r.first_atoms(lines, "file", "ord")
    return rows.withColumn("band", r.bin_confidence(F.col("plddt"))[1])


@job(
    "confidence_summary",
    f"""with {_PDB}, m as (select o_orderkey as file, coalesce(avg(plddt), 50) as mean_plddt from orders left join fa on fa.file = o_orderkey group by 1)
    select file, mean_plddt::double as mean_plddt, {_QUALITY.format('mean_plddt')} as quality, case {_QUALITY.format('mean_plddt')} when 'high' then 'Высокая уверенность' when 'medium' then 'Средняя уверенность' else 'Низкая уверенность' end as label from m""",
)
def confidence_summary(spark, sf):
    lines = _atoms(spark, sf).select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("ord"), "value")
    means = r.first_atoms(lines, "file", "ord").groupBy("file").agg(F.avg("plddt").alias("m"))
    files = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"))
    out = files.join(means, "file", "left").select("file", F.coalesce("m", F.lit(50.0)).alias("mean_plddt"))
    q = r.bin_confidence(F.col("mean_plddt"))[0]
    return out.select("file", "mean_plddt", q.alias("quality"), r.quality_label(q).alias("label"))


@job(
    "read_hit_xml",
    """select 'AC' || p_partkey as accession, p_name || ' & co <x> [' || p_brand || ']' as title, p_brand as organism, round(cast(p_size + 10 as double) * 100 / (p_size + 60), 1) as identity,
    round(cast(p_size + 1 as double) * 100 / 200, 1) as coverage, p_partkey / 1000.0::double as evalue, p_retailprice as bit_score, p_size + 60 as align_length from part""",
)
def read_hit_xml(spark, sf):
    """Hit blocks written as XML from the part table; only the first HSP counts."""
    c = lambda n: F.col(n).cast("string")
    xml = F.concat(
        F.lit("<Hit><Hit_accession>AC"), c("p_partkey"), F.lit("</Hit_accession><Hit_def>"), "p_name", F.lit(" &amp; co &lt;x&gt; ["), "p_brand", F.lit("]</Hit_def><Hit_hsps><Hsp><Hsp_identity>"),
        (F.col("p_size") + 10).cast("string"), F.lit("</Hsp_identity><Hsp_align-len>"), (F.col("p_size") + 60).cast("string"), F.lit("</Hsp_align-len><Hsp_evalue>"), (F.col("p_partkey") / 1000).cast("string"),
        F.lit("</Hsp_evalue><Hsp_bit-score>"), c("p_retailprice"), F.lit("</Hsp_bit-score><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>"), (F.col("p_size") + 1).cast("string"),
        F.lit("</Hsp_query-to></Hsp><Hsp><Hsp_identity>1</Hsp_identity><Hsp_align-len>2</Hsp_align-len></Hsp></Hit_hsps></Hit>"),
    )
    hits = t.table(spark, sf, "part").select(F.from_xml(xml, r.HIT_SCHEMA, {"rowTag": "Hit"}).alias("hit"))
    return hits.select(*[x.alias(n) for n, x in r.hit_fields(F.col("hit"), F.lit(200)).items()])


def _catalogs(spark, sf):
    n = t.table(spark, sf, "part").select(F.to_json(F.struct(F.concat(F.lit("NP_"), F.col("p_partkey").cast("string")).alias("accessionversion"), F.col("p_name").alias("title"), F.col("p_type").alias("taxname"), F.col("p_size").cast("string").alias("slen"))).alias("j"))
    u = t.table(spark, sf, "supplier").select(
        F.concat(
            F.lit('{"primaryAccession":"P'), F.col("s_suppkey").cast("string"), F.lit('","proteinDescription":{'),
            F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('"recommendedName":{"fullName":{"value":"'), "s_name", F.lit('"}}'))).otherwise(F.concat(F.lit('"submissionNames":[{"fullName":{"value":"'), "s_name", F.lit('"}}]'))),
            F.lit('},"organism":{"scientificName":"nation '), F.col("s_nationkey").cast("string"), F.lit('"},"sequence":{"length":'), (F.col("s_suppkey") + 100).cast("string"), F.lit("}}"),
        ).alias("j")
    )
    p = t.table(spark, sf, "customer").select(F.to_json(F.struct(F.concat(F.lit("X"), F.col("c_custkey").cast("string")).alias("identifier"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("description"))).alias("j"))
    out = []
    for rows, source in ((n, "NCBI"), (u, "UniProt"), (p, "PDB")):
        parsed = rows.select(F.from_json("j", r.CATALOG_SCHEMAS[source]).alias("r"))
        out.append(parsed.select(*[x.alias(k) for k, x in r.record_fields(F.col("r"), source).items()]))
    return out


_CAT = """cat as (select 'NCBI' as source, 'NP_' || p_partkey as id, p_name as title, p_type as organism, cast(p_size as bigint) as length from part union all
  select 'UniProt', 'P' || s_suppkey, s_name, 'nation ' || s_nationkey, cast(s_suppkey + 100 as bigint) from supplier union all
  select 'PDB', 'X' || c_custkey, case when c_custkey % 3 = 0 then c_name else 'PDB X' || c_custkey end, '—', null from customer)"""


@job("read_records_json", f"with {_CAT} select * from cat")
def read_records_json(spark, sf):
    a, b, c = _catalogs(spark, sf)
    return a.unionByName(b).unionByName(c)


@job("search_catalogs", f"with {_CAT} select source, id, title, organism, length, cast(rank as int) as rank from (select *, row_number() over (partition by source order by id) as rank from cat where contains(lower(title), 'er') or contains(lower(organism), 'er')) where rank <= 5")
def search_catalogs(spark, sf):
    return r.search_catalogs(_catalogs(spark, sf), "er")


@job(
    "organism_from_title",
    "select p_brand as organism, count(*) as n from part where p_size % 2 = 0 group by 1 union all select 'Unknown', count(*) from part where p_size % 2 = 1",
)
def organism_from_title(spark, sf):
    title = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" ["), "p_brand", F.lit("]"))).otherwise(F.col("p_name"))
    return t.table(spark, sf, "part").groupBy(r.organism_from_title(title).alias("organism")).agg(F.count("*").alias("n"))


@job(
    "first_json_object",
    "select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_type as tag from events",
)
def first_json_object(spark, sf):
    """Answers with stray text, fences and nesting around the event properties."""
    nested = F.concat(F.lit('{"outer": '), "props", F.lit(', "tag": "'), "event_type", F.lit('"}'))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), nested, F.lit("\n```\nok {x}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("answer "), nested, F.lit(" and {more}"))).otherwise(nested)
    rows = t.table(spark, sf, "events").select("event_id", r.first_json_object(text).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.outer.k").cast("bigint").alias("k"), F.get_json_object("j", "$.tag").alias("tag"))


@job(
    "validate_diagnosis",
    """select event_id, case when event_type = 'view' then 'high' when event_type = 'click' then 'critical' else 'moderate' end as urgency, case when event_id % 2 = 0 then 'dx' else '?' end as name,
    case when event_id % 3 = 0 then 0.0::double else value end as probability, cast(1 as int) as tests from events where event_id % 5 <> 0""",
)
def validate_diagnosis(spark, sf):
    """Stored diagnosis answers: missing entries filled, unknown urgency corrected, answers without tests rejected."""
    e = F.col("event_id")
    entry = F.concat(F.lit("{"), F.when(e % 2 == 0, '"name":"dx",').otherwise(""), F.when(e % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('"probability":'), F.col("value").cast("string"), F.lit(","))), F.lit('"reasoning":"r"}'))
    urgency = F.when(F.col("event_type") == "view", "high").when(F.col("event_type") == "click", "critical").otherwise(F.col("event_type"))
    js = F.concat(F.lit('{"differentialDiagnoses":['), entry, F.lit("],"), F.when(e % 5 == 0, "").otherwise('"recommendedTests":["PCR",null],'), F.lit('"urgency":"'), urgency, F.lit('","recommendation":"x"}'))
    d = t.table(spark, sf, "events").select("event_id", r.validate_diagnosis(js).alias("d")).filter("d is not null")
    first = F.get(F.col("d.diagnoses"), F.lit(0))
    return d.select("event_id", "d.urgency", first["name"].alias("name"), first["probability"].alias("probability"), F.size("d.tests").alias("tests"))


@job(
    "validate_drug_analysis",
    "select event_id, case when event_id % 2 = 0 then event_type else 'unknown' end as potential, case when event_id % 3 = 0 then value else 0.0::double end as confidence, cast(case when event_id % 2 = 0 then 1 else 0 end as int) as risks from events where event_id % 2 = 0 or (event_id % 3 = 0 and value <> 0)",
)
def validate_drug_analysis(spark, sf):
    e = F.col("event_id")
    js = F.concat(
        F.lit("{"), F.when(e % 2 == 0, F.concat(F.lit('"repurposingPotential":"'), "event_type", F.lit('","keyRisks":["a",null],'))).otherwise(""),
        F.when(e % 3 == 0, F.concat(F.lit('"confidenceScore":'), F.col("value").cast("string"), F.lit(","))).otherwise(""), F.lit('"other":1}'),
    )
    a = t.table(spark, sf, "events").select("event_id", r.validate_drug_analysis(js).alias("a")).filter("a is not null")
    return a.select("event_id", "a.potential", "a.confidence", F.size("a.risks").alias("risks"))


@job(
    "admet_response_defaults",
    "select event_id, event_id % 2 = 0 as ames, case when event_id % 2 = 0 then value else 0.5::double end as confidence, 50.0::double as likeness, case when event_type = 'click' then 'high' else 'moderate' end as risk, '—' as rationale, cast(5 as int) as alerts from events",
)
def admet_response_defaults(spark, sf):
    e = F.col("event_id")
    js = F.concat(
        F.lit("{"), F.when(e % 2 == 0, F.concat(F.lit('"ames":{"positive":true,"confidence":'), F.col("value").cast("string"), F.lit("},"))).otherwise(""),
        F.lit('"overallRisk":"'), F.when(F.col("event_type") == "click", "high").otherwise("severe"), F.lit('","rationale":"","alerts":["a","b","c","d","e","f"]}'),
    )
    x = t.table(spark, sf, "events").select("event_id", r.admet_response_defaults(js).alias("x"))
    return x.select("event_id", F.col("x.ames.positive").alias("ames"), F.col("x.ames.confidence").alias("confidence"), "x.likeness", "x.risk", "x.rationale", F.size("x.alerts").alias("alerts"))


@job(
    "collection_date",
    "select o_orderkey, case o_orderkey % 3 when 0 then cast(o_orderdate as date) when 1 then cast(date_trunc('month', o_orderdate) as date) end as collected, case when o_orderkey % 3 = 2 then 'Unknown' else o_orderpriority end as location from orders",
)
def collection_date(spark, sf):
    """Partial and missing dates and places of order records."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise("spring 1996")
    place = F.when(k == 2, F.lit("")).otherwise(F.col("o_orderpriority"))
    return t.table(spark, sf, "orders").select("o_orderkey", r.collection_date(text).alias("collected"), r.default_unknown(place).alias("location"))
