"""Session helpers: a local session for tests and bench, and lineage cutting that survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: str | None = None


def local_session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller passes in its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("biotally")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where none is set, a local master (tests, the bench) gets a scratch folder. A cluster without one is an error: what
    its executors write to their own disks would be read back in part only.
    """
    global _scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master!r})")
    if _scratch is None:
        _scratch = tempfile.mkdtemp(prefix="biotally-checkpoint-")
    return _scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and read them back.

    A written table survives lost executors, carries real sizes for the next plan, and, unlike a checkpointed plan,
    does not hand on the constraints of the plan that made it, which grow with every round of an iterative job.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows by key before they are exploded into positions.

    A sequence is one byte per letter here and tens of bytes per position afterwards, so this is the cheap side
    of the explode to move, and the windows, groups and joins by the same key that follow need no exchange.
    The explicit count keeps small inputs from being folded into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
