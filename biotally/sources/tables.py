"""Typed views over the driver tables: the inputs of every registered job.

All sequences are whole texts: letters are kept in order, never cut to a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biotally.reference_tables import AMINO_ACIDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table for work on whole texts: where its files give fewer tasks than there are cores, dealt by key first.

    A file that cannot be split would otherwise be cleaned by one task. A table of many files is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def _letters(text: Column) -> Column:
    # Strip before upper-casing: some letters change length under upper().
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def _dna(text: Column) -> Column:
    return F.translate(_letters(text), "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_AS_DNA = dict(zip("BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC", strict=True)) | {x: x for x in "ACGT"}
_AS_PROTEIN = {x: x for x in _LETTERS if x not in "BJOUXZ"}


def _with_sequence(rows: DataFrame, letters: dict[str, str]) -> DataFrame:
    """Rows whose ``text`` holds one of ``letters`` in either case, with those letters in order, replaced, as ``seq`` instead.

    One pass over the bytes of a batch: patterns on columns would walk a text once for each filter and column that uses them.
    """
    becomes = np.zeros(256, np.uint8)
    for x, y in letters.items():
        becomes[[ord(x), ord(x.lower())]] = ord(y)
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").fill_null("").cast(pa.large_binary())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = becomes[np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
            kept = data != 0
            ends = np.concatenate(([0], np.cumsum(kept)))[ends - ends[0]].astype(np.int64)
            seq = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(ends), pa.py_buffer(data[kept])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), seq], names=[*others, "seq"]).filter(pa.array(np.diff(ends) > 0))

    return rows.select(*others, "text").mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others) + ", seq string")


def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One DNA sequence per document with a letter; ``cluster`` is a location's submission batch of 28 consecutive accessions."""
    rows = dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    return _with_sequence(rows, _AS_DNA).select(
        F.col("doc_id").alias("isolate_id"),
        F.col("lang").alias("location"),
        "source",
        F.concat_ws("-", "lang", F.expr("cast(doc_id div 28 as string)")).alias("cluster"),
        F.expr("doc_id div 28").alias("batch"),
        F.expr("date_add(date '2024-01-01', cast(doc_id % 365 as int))").alias("collected"),
        "seq",
    )


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    return _with_sequence(rows, _AS_PROTEIN).select(F.col("doc_id").alias("protein_id"), F.col("lang").alias("species"), "seq")


def benchmark_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNA templates and host-genome fragments from the benchmark table."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), _dna(F.col("text")).alias("seq"))


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("drug_id"),
        F.col("p_name").alias("name"),
        F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("inn"),
        F.col("p_type").alias("pharm_group"),
        F.expr(
            "case p_type when 'ECONOMY' then 'DNA gyrase inhibitor' when 'SMALL' then '30S subunit binder' "
            "when 'MEDIUM' then 'transpeptidase (PBP) inhibitor' when 'PROMO' then 'RdRp polymerase inhibitor' "
            "when 'STANDARD' then 'protease (3CL) inhibitor' end"
        ).alias("mechanism"),
        F.expr("case p_partkey % 3 when 0 then 'antibacterial' when 1 then 'antiviral' else 'unknown' end").alias("activity"),
        F.expr("cast(86 + (p_partkey * 37) % 1000 as double)").alias("mw"),
        F.expr("cast((p_partkey * 13) % 110 as double) / 10 - 3").alias("logp"),
        F.expr("cast(p_size % 8 as int)").alias("hbd"),
        F.expr("cast((p_partkey * 7) % 14 as int)").alias("hba"),
        F.expr("cast((p_partkey * 5) % 16 as int)").alias("rotatable_bonds"),
        F.expr("cast((p_partkey % 7) - 3 as int)").alias("charge"),
        F.expr("cast((p_partkey * 29) % 101 as double) / 100").alias("hydrophobicity"),
        F.expr("cast(2 as double) + cast((p_partkey * 11) % 140 as double) / 10").alias("radius"),
        F.expr("p_partkey % 2 = 0").alias("registered"),
    )


def od_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plate wells; a plate holds the readings of one instrument (user) on one day."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("user_id % 10").alias("plate"),
        F.expr("case event_type when 'view' then 'neg' when 'purchase' then 'pos' else 'sample' end").alias("control"),
        F.expr("case when event_type = 'purchase' then value / 100.0D + 0.3D else value / 100.0D end").alias("od"),
    )


def _hours(ts: str) -> Column:
    return F.expr(f"(unix_micros(cast({ts} as timestamp)) - unix_micros(timestamp '2024-01-01 00:00:00')) / 3600000000D")


def doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter("event_type = 'purchase'")
        .select("event_id", F.col("user_id").alias("subject"), _hours("ts").alias("t"), F.col("value").alias("dose"))
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter("event_type = 'click'")
        .select("event_id", F.col("user_id").alias("subject"), _hours("ts").alias("t"), F.col("value").alias("conc"))
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("patient_id"),
        F.expr("cast(o_custkey % 39 as int)").alias("rate_id"),
        F.expr("cast(5 + o_orderkey % 600 as double)").alias("weight"),
        F.expr("case o_orderstatus when 'P' then 'neonate' when 'O' then 'young' else 'adult' end").alias("age_group"),
        F.expr("case when o_orderkey % 5 = 0 then null else cast(10 * (1 + o_orderkey % 10) as double) end").alias("concentration"),
        F.expr("case when o_orderkey % 7 = 0 then null else cast(1 + o_orderkey % 9 as double) / 4 end").alias("price"),
    )


def tox_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two label scores per molecule and endpoint; every eleventh molecule lacks the last endpoint."""
    return (
        table(spark, sf_dir, "labels")
        .select(F.col("doc_id").alias("mol_id"), F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("endpoint"))
        .select("mol_id", "endpoint", F.explode(F.array(F.lit("toxic"), F.lit("safe"))).alias("label"))
        .filter("not (mol_id % 11 = 0 and endpoint = 5)")
        .withColumn(
            "score",
            F.expr(
                "case when label = 'toxic' then cast((mol_id * 7 + endpoint * 13) % 100 as double) / 100 "
                "else cast(100 - (mol_id * 7 + endpoint * 13) % 100 as double) / 100 end"
            ),
        )
    )


def residue_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of the first 20 embedding values: one vector is one position of a 25-residue protein."""
    v = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 25").alias("protein_id"),
        F.expr("cast(vec_id % 25 + 1 as int)").alias("pos"),
        F.expr("transform(slice(embedding, 1, 20), x -> exp(cast(x as double)))").alias("e"),
    )
    z = v.withColumn("z", F.expr("aggregate(e, 0D, (a, x) -> a + x)"))
    return z.select(
        "protein_id", "pos", F.posexplode("e").alias("i", "ex"), "z"
    ).select("protein_id", "pos", F.substring(F.lit(AMINO_ACIDS), F.col("i") + 1, F.lit(1)).alias("residue"), (F.col("ex") / F.col("z")).alias("prob"))


def wild_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 25").alias("protein_id"),
        F.expr("cast(vec_id % 25 + 1 as int)").alias("pos"),
        F.expr(f"substr('{AMINO_ACIDS}', cast((vec_id * 7) % 20 + 1 as int), 1)").alias("residue"),
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per set bit: indexes 1-64 with a positive embedding value."""
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("mol_id"), "label", F.posexplode("embedding").alias("i", "x"))
        .filter("x > 0")
        .select("mol_id", "label", (F.col("i") + 1).alias("bit"))
    )
