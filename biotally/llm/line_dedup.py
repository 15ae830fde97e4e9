"""Substring dedup by hashing lines, and the sentences inside them.

Units are normalised (lower case, one space for each run of separators, trimmed) and grouped by digest over the whole
corpus; the occurrence that ranks first by document and offset stays, every later one is removed. A passage that was
pasted into the middle of a line is caught by its sentences. Only digests, ids and offsets move: digests that occur
once leave after a grouping that is combined before the shuffle, and the others are joined back to their occurrences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotally.llm.words import WORD, id_column, text_column
from biotally.session import cut_lineage

MIN_WORDS = 5  # shorter lines and sentences repeat by chance and are no units

_WORD = re.compile(WORD)
_STOP = re.compile(r"[.!?] ")
_UNITS = "doc_id long, level int, start_char long, end_char long, line_start long, hi long, lo long"


def _digest(piece: str, min_words: int) -> tuple[int, int] | None:
    words = _WORD.findall(piece)
    if len(words) < min_words:
        return None
    d = xxhash.xxh3_128_digest(" ".join(words).lower())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def text_units(text: str, min_words: int = MIN_WORDS, separator: str = "\n") -> Iterator[tuple[int, int, int, int, int, int]]:
    """(level, start, end, start of the line, digest halves): level 0 lines, level 1 the sentences of lines with several."""
    at = 0
    for line in text.split(separator):
        found = _digest(line, min_words)
        if found:  # a line too short for a unit has no sentence that is one
            yield 0, at, at + len(line), at, *found
            cuts = [0, *(m.end() for m in _STOP.finditer(line)), len(line)]
            if len(cuts) > 2:
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b > a and (d := _digest(line[a:b], min_words)):
                        yield 1, at + a, at + b, at, *d
        at += len(line) + len(separator)


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, separator: str = "\n", key_col: str | None = None) -> DataFrame:
    keys = [id_column(docs, key_col).alias("row_key")] if key_col else []
    base = docs.select(*keys, id_column(docs, id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
    schema = "row_key long, " * len(keys) + _UNITS
    names = [c.split()[0] for c in schema.split(", ")]
    n_ids = len(keys) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for *ids, text in zip(*(b.column(c).to_pylist() for c in names[:n_ids]), b.column("text"), strict=True):
                rows.extend((*ids, *u) for u in text_units(text.as_py() or "", min_words, separator))
            if rows:
                kinds = [*[pa.int64()] * n_ids, pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return base.mapInArrow(cut, schema)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, separator: str = "\n", key_col: str | None = None) -> DataFrame:
    """doc_id, start_char, end_char (code points of the original text), level, first_doc_id, first_start of every removed unit.

    Sentences of a removed line are not listed again. A line and a sentence with equal words are the same unit. Ids
    rank in order, null last. Rows that repeat an id and offset with the same unit tie for its first place and all
    stay. Null, blank and unit-free texts lose nothing. Other columns are not read.

    With ``key_col``, a column that numbers the rows, rows that share an id are documents of their own: they rank by
    id and then by number, none tie, and each span carries the number of its row as ``row_key``.
    """
    seen = cut_lineage(units(docs, id_col, text_col, min_words, separator, key_col))
    own, first_own, keys = ("row_key", "first_key", ["row_key"]) if key_col else ("doc_id", "first_doc_id", [])
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys, "start_char")
    groups = seen.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where(F.col("first") != F.col("last"))
    groups = cut_lineage(groups.select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.start_char").alias("first_start"), *(F.col("first.row_key").alias("first_key") for _ in keys)))
    met = seen.join(groups, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")))
    later = met.where(~(F.col(own).eqNullSafe(F.col(first_own)) & (F.col("start_char") == F.col("first_start"))))
    later = cut_lineage(later.select(*keys, "doc_id", "level", "start_char", "end_char", "line_start", "first_doc_id", "first_start"))
    lines = later.where("level = 0").select(F.col(own).alias("d"), F.col("line_start").alias("s")).distinct()
    inside = later.where("level = 1").join(lines, F.col(own).eqNullSafe(F.col("d")) & (F.col("line_start") == F.col("s")), "left_anti")
    return later.where("level = 0").unionByName(inside).select(*keys, "doc_id", "start_char", "end_char", "level", "first_doc_id", "first_start")


def deduplicated(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """The columns of ``docs`` with the spans cut out of its text, and ``kept_spans``: the original offsets that remain.

    Spans are cut from every row of their id, or, with the ``key_col`` that they were found by, from their own row only.
    """
    per = spans.groupBy(F.col("row_key" if key_col else "doc_id").alias("_span_doc")).agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias("_spans"))
    joined = docs.join(per, F.col(key_col or id_col).cast("long").eqNullSafe(F.col("_span_doc")), "left").drop("_span_doc")
    closed = F.concat(F.coalesce("_spans", F.expr("cast(array() as array<struct<start_char:bigint,end_char:bigint>>)")), F.array(F.struct(F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("start_char"), F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("end_char"))))
    kept = F.filter(F.transform(closed, lambda x, i: F.struct(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at(closed, i)["end_char"]).alias("start"), x["start_char"].alias("stop"))), lambda x: x["stop"] > x["start"])
    with_kept = joined.withColumn("kept_spans", kept)
    text = F.array_join(F.transform("kept_spans", lambda x: F.substring(F.col(text_col), x["start"] + 1, x["stop"] - x["start"])), "")
    return with_kept.withColumn(text_col, F.when(F.col(text_col).isNull(), None).otherwise(text)).drop("_spans")
