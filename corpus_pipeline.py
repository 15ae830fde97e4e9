"""Corpus pipeline: documents pass the stages in turn, each written as Parquet and read back as the next one's input.

A stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``; the last adds what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotally.llm.decontam import find_leaks
from biotally.llm.mixing import mix
from biotally.llm.pii import redacted
from biotally.llm.quality_rules import quality_rules
from biotally.llm.simhash import similar_components
from biotally.session import cut_lineage


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, ``_row``, written once: a document is never taken for another by its doc_id."""
    return cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))


def by_content(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows with a hash of what a verdict depends on as ``_row``: nothing is written, and equal rows have one verdict.

    The hash has 64 bits: that a document shares it with another one of a different verdict is out of reach for any corpus
    of practical size.
    """
    return docs.withColumn("_row", F.xxhash64(*columns, *(F.col(c).isNull() for c in columns)))


def by_row(rows: DataFrame) -> DataFrame:
    """``rows`` for an operator that tells documents apart by doc_id."""
    return rows.withColumn("doc_id", F.col("_row"))


def only(rows: DataFrame, listed: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose number is among the first column of ``listed``, or (left_anti) is not, without their number.

    The list grows with the documents, so both sides are always sorted and merged: a small corpus is treated as a large one.
    """
    listed = listed.select(F.col(listed.columns[0]).alias("_listed")).distinct()
    return rows.join(listed.hint("merge"), rows["_row"] == listed["_listed"], how).drop("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row by its own text, language and source."""
    rows = by_content(docs, "text", "lang", "source")
    return only(rows, quality_rules(by_row(rows)).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that SimHash links at a five-word similarity of 0.8: that with the smallest id.

    Rows of the group that share this id are told apart by a hash of the row; no id ranks last.
    """
    rows = keyed(docs)
    ranks = rows.select(F.col("_row").alias("k"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), "_row").alias("rank"))
    marked = similar_components(by_row(rows))
    first = marked.join(ranks, F.col("doc_id") == F.col("k")).groupBy("component_id").agg(F.min("rank").alias("first"))
    return only(rows, cut_lineage(first.select("first._row")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark and no paraphrase of one, each row by its own text."""
    rows = by_content(docs, "text")
    leaks = cut_lineage(find_leaks(by_row(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return only(rows, leaks, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with tags in place of the personal data in its text; n_chars follows the text."""
    clean = redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes at least once, with their copies and the words taken."""
    return mix(docs).where("copies > 0")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", personal_data),
    ("mixing", mixing),
]

#: Fingerprints, robust estimates and message passing are beyond SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
