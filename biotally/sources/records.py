"""Readers and parsers: FASTA, named sequences, structure files, hit XML, catalog JSON, stored model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biotally.functions.sequence import number

# ---------------------------------------------------------------- FASTA and named lines


def parse_fasta(record: Column) -> tuple[Column, Column]:
    """Id (first word of the header) and upper-cased sequence of one record without its leading ``>``."""
    header = F.regexp_extract(record, "^(\\S+)", 1)
    body = F.regexp_replace(F.regexp_replace(record, "^[^\\n]*(\\n|$)", ""), "\\s", "")
    return header, F.upper(body)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    name, seq = parse_fasta(F.col("value"))
    return spark.read.option("lineSep", ">").text(path).filter("trim(value) <> ''").select(name.alias("seq_id"), seq.alias("seq"))


_NAMED = "^\\s*(\\S+)\\s+(\\S.*)$"


def parse_named(line: Column) -> tuple[Column, Column]:
    return F.regexp_extract(line, _NAMED, 1), F.regexp_replace(F.regexp_extract(line, _NAMED, 2), "\\s", "")


def read_named_sequences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good lines as (name, seq) and malformed lines as (value)."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    ok = F.regexp_like("value", F.lit(_NAMED))
    name, seq = parse_named(F.col("value"))
    return lines.filter(ok).select(name.alias("name"), seq.alias("seq")), lines.filter(~ok)


# ---------------------------------------------------------------- per-residue confidence of structure files


def parse_atom_line(line: Column) -> tuple[Column, Column]:
    """Residue number (columns 23-26) and B-factor (columns 61-66) of a fixed-width ATOM line."""
    num = lambda a, n: number(F.trim(F.substring(line, a, n)))
    return num(23, 4).cast("int"), num(61, 6).cast("double")


def first_atoms(lines: DataFrame, file: str, order: str, value: str = "value") -> DataFrame:
    """The first atom of each residue of each file, in line order."""
    res, b = parse_atom_line(F.col(value))
    rows = lines.filter(F.startswith(F.col(value), F.lit("ATOM")) & (F.length(value) >= 66)).select(file, order, res.alias("residue_no"), b.alias("plddt")).filter("plddt is not null")
    return rows.groupBy(file, "residue_no").agg(F.min_by("plddt", order).alias("plddt"))


def read_pdb_confidence(spark: SparkSession, path: str) -> DataFrame:
    """Atoms are ordered by their serial number (columns 7-11), which follows the line order of a file."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    serial = F.try_to_number(F.trim(F.substring("value", 7, 5)), F.lit("99999")).cast("int")
    return first_atoms(lines.withColumn("serial", serial), "file", "serial")


def bin_confidence(plddt: Column) -> tuple[Column, Column]:
    quality = F.when(plddt >= 70, "high").when(plddt >= 50, "medium").otherwise("low")
    band = F.when(plddt >= 90, "very high").when(plddt >= 70, "confident").when(plddt >= 50, "low").otherwise("very low")
    return quality, band


def quality_label(quality: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in (("high", "Высокая уверенность"), ("medium", "Средняя уверенность"), ("low", "Низкая уверенность")) for x in kv])
    return F.try_element_at(labels, quality)


# ---------------------------------------------------------------- search hits

HIT_SCHEMA = (
    "Hit_accession string, Hit_def string, Hit_hsps struct<Hsp: array<struct<`Hsp_identity`: int, `Hsp_align-len`: int, `Hsp_evalue`: double, "
    "`Hsp_bit-score`: double, `Hsp_query-from`: int, `Hsp_query-to`: int>>>"
)


def organism_from_title(title: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(title, "\\[([^\\]]+)\\]", 1), F.lit("")), F.lit("Unknown"))


def hit_fields(hit: Column, query_length: Column) -> dict[str, Column]:
    """Identity and coverage percent (coverage over the query length), e-value, bit score and length of the first HSP."""
    hsp = F.get(hit["Hit_hsps"]["Hsp"], F.lit(0))
    length = F.coalesce(hsp["Hsp_align-len"], F.lit(0))
    span = F.when(hsp["Hsp_query-to"] > hsp["Hsp_query-from"], hsp["Hsp_query-to"] - hsp["Hsp_query-from"] + 1).otherwise(0)
    return {
        "accession": hit["Hit_accession"], "title": hit["Hit_def"], "organism": organism_from_title(hit["Hit_def"]),
        "identity": F.coalesce(F.round(hsp["Hsp_identity"] * 100.0 / F.nullif(length, F.lit(0)), 1), F.lit(0.0)),
        "coverage": F.coalesce(F.round(span * 100.0 / F.nullif(query_length, F.lit(0)), 1), F.lit(0.0)),
        "evalue": F.coalesce(hsp["Hsp_evalue"], F.lit(999.0)), "bit_score": F.coalesce(hsp["Hsp_bit-score"], F.lit(0.0)), "align_length": length,
    }


def read_hit_xml(spark: SparkSession, path: str, query_length: int) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "Hit").schema(HIT_SCHEMA).load(path)
    hit = F.struct("Hit_accession", "Hit_def", "Hit_hsps")
    return rows.select(*[c.alias(n) for n, c in hit_fields(hit, F.lit(query_length)).items()])


# ---------------------------------------------------------------- catalog records

CATALOG_SCHEMAS = {
    "NCBI": "accessionversion string, uid string, title string, organism string, taxname string, slen string",
    "UniProt": "primaryAccession string, proteinDescription struct<recommendedName: struct<fullName: struct<value: string>>, submissionNames: array<struct<fullName: struct<value: string>>>>, "
    "organism struct<scientificName: string>, sequence struct<length: bigint, value: string>",
    "PDB": "identifier string, description string",
}


def _filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def record_fields(r: Column, source: str) -> dict[str, Column]:
    """One record shape (source, id, title, organism, length) from the three catalog layouts."""
    if source == "NCBI":
        ident, title, org, length = _filled(r["accessionversion"], r["uid"]), r["title"], _filled(r["organism"], r["taxname"]), F.trim(r["slen"]).try_cast("bigint")
    elif source == "UniProt":
        d = r["proteinDescription"]
        title = _filled(d["recommendedName"]["fullName"]["value"], F.get(d["submissionNames"], F.lit(0))["fullName"]["value"])
        ident, org, length = r["primaryAccession"], r["organism"]["scientificName"], F.coalesce(r["sequence"]["length"], F.length(r["sequence"]["value"]))
    else:
        ident, org, length = r["identifier"], F.lit("—"), F.lit(None).cast("bigint")
        title = _filled(r["description"], F.concat(F.lit("PDB "), r["identifier"]))
    return {
        "source": F.lit(source), "id": F.coalesce(_filled(ident), F.lit("Unknown")), "title": F.coalesce(_filled(title), F.lit("Unknown")),
        "organism": F.coalesce(_filled(org), F.lit("Unknown")), "length": length,
    }


def read_records_json(spark: SparkSession, path: str, source: str) -> DataFrame:
    rows = spark.read.schema(CATALOG_SCHEMAS[source]).json(path)
    return rows.select(*[c.alias(n) for n, c in record_fields(F.struct("*"), source).items()])


def search_catalogs(catalogs: list[DataFrame], query: str, per_source: int = 5) -> DataFrame:
    """The first matches of each catalog by id, kept as one table."""
    rows = catalogs[0]
    for c in catalogs[1:]:
        rows = rows.unionByName(c)
    q = F.lit(query.lower())
    hits = rows.filter(F.contains(F.lower("title"), q) | F.contains(F.lower("organism"), q))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("id"))).filter(F.col("rank") <= per_source)


# ---------------------------------------------------------------- stored model answers

def _balanced_object(text: Column) -> Column:
    """The first object whose braces balance, at any depth; braces inside strings do not count. Null without one.

    The text is folded over its marks and the runs between them, so a state change costs one step and not one a letter.
    """
    pieces = F.regexp_extract_all(text, F.lit(r'(?s)([{}"\\]|[^{}"\\]+)'), F.lit(1))
    start = F.struct(*(F.lit(v).alias(n) for n, v in (("at", 1), ("depth", 0), ("quoted", False), ("escaped", False), ("first", 0), ("last", 0))))

    def step(s: Column, piece: Column) -> Column:
        quoted = F.when((piece == '"') & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"])
        opens, closes = (piece == "{") & ~s["quoted"] & (s["last"] == 0), (piece == "}") & ~s["quoted"] & (s["last"] == 0)
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(
            (s["at"] + F.length(piece)).alias("at"), depth.alias("depth"), quoted.alias("quoted"), ((piece == "\\") & ~s["escaped"]).alias("escaped"),
            F.when(opens & (s["depth"] == 0), s["at"]).otherwise(s["first"]).alias("first"),
            F.when(closes & (depth == 0) & (s["first"] > 0), s["at"]).otherwise(s["last"]).alias("last"),
        )

    found = F.aggregate(pieces, start, step)
    return F.when(F.contains(text, F.lit("{")) & (found["last"] > 0), F.substring(text, found["first"], found["last"] - found["first"] + 1))


def first_json_object(text: Column) -> Column:
    """The fenced block if it holds an object, else the first balanced object."""
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)\\s*```", 1)
    return F.coalesce(F.when(F.startswith(fenced, F.lit("{")), fenced), _balanced_object(text))


DIAGNOSIS_SCHEMA = "differentialDiagnoses array<struct<name: string, probability: double, reasoning: string>>, recommendedTests array<string>, urgency string, recommendation string"


def validate_diagnosis(json: Column) -> Column:
    """Typed diagnosis or null when a required field is missing; defaults inside entries, unknown urgency is moderate."""
    d = F.from_json(json, DIAGNOSIS_SCHEMA)
    ok = d["differentialDiagnoses"].isNotNull() & d["recommendedTests"].isNotNull() & d["urgency"].isNotNull() & d["recommendation"].isNotNull()
    entries = F.transform(
        d["differentialDiagnoses"],
        lambda e: F.struct(F.coalesce(e["name"], F.lit("?")).alias("name"), F.coalesce(e["probability"], F.lit(0.0)).alias("probability"), F.coalesce(e["reasoning"], F.lit("")).alias("reasoning")),
    )
    urgency = F.when(d["urgency"].isin("low", "moderate", "high", "critical"), d["urgency"]).otherwise("moderate")
    return F.when(ok, F.struct(entries.alias("diagnoses"), F.array_compact(d["recommendedTests"]).alias("tests"), urgency.alias("urgency"), d["recommendation"].alias("recommendation")))


ANALYSIS_SCHEMA = "repurposingPotential string, confidenceScore double, rationale string, keyRisks array<string>, nextSteps array<string>"


def validate_drug_analysis(json: Column) -> Column:
    a = F.from_json(json, ANALYSIS_SCHEMA)
    some = (F.coalesce(a["repurposingPotential"], F.lit("")) != "") | (F.coalesce(a["confidenceScore"], F.lit(0.0)) != 0) | (F.coalesce(a["rationale"], F.lit("")) != "")
    none = F.array().cast("array<string>")
    return F.when(
        some,
        F.struct(
            F.coalesce(a["repurposingPotential"], F.lit("unknown")).alias("potential"), F.coalesce(a["confidenceScore"], F.lit(0.0)).alias("confidence"),
            F.coalesce(a["rationale"], F.lit("")).alias("rationale"), F.coalesce(F.array_compact(a["keyRisks"]), none).alias("risks"), F.coalesce(F.array_compact(a["nextSteps"]), none).alias("steps"),
        ),
    )


RESPONSE_SCHEMA = (
    "ames struct<positive: boolean, confidence: double>, herg struct<blocker: boolean, confidence: double>, hepatotoxic struct<positive: boolean, confidence: double>, "
    "tpsa double, rotatableBonds double, drugLikenessScore double, overallRisk string, rationale string, alerts array<string>"
)


def admet_response_defaults(json: Column) -> Column:
    """Property answer with missing fields filled: false and 0.5 for tests, 50 for likeness, moderate risk, five alerts."""
    r = F.from_json(json, RESPONSE_SCHEMA)
    test = lambda s, f: F.struct(F.coalesce(s[f], F.lit(False)).alias("positive"), F.coalesce(s["confidence"], F.lit(0.5)).alias("confidence"))
    risk = F.when(r["overallRisk"].isin("low", "high"), r["overallRisk"]).otherwise("moderate")
    return F.struct(
        test(r["ames"], "positive").alias("ames"), test(r["herg"], "blocker").alias("herg"), test(r["hepatotoxic"], "positive").alias("hepatotoxic"),
        F.coalesce(r["tpsa"], F.lit(0.0)).alias("tpsa"), F.coalesce(r["rotatableBonds"], F.lit(0.0)).alias("rotatable_bonds"),
        F.coalesce(r["drugLikenessScore"], F.lit(50.0)).alias("likeness"), risk.alias("risk"), F.coalesce(F.nullif(r["rationale"], F.lit("")), F.lit("—")).alias("rationale"),
        F.coalesce(F.slice(r["alerts"], 1, 5), F.array().cast("array<string>")).alias("alerts"),
    )


def collection_date(text: Column) -> Column:
    """ISO date, or year and month as the first of the month; null otherwise."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyy-MM"))


def default_unknown(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("Unknown"))
