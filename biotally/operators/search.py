"""Seeded search of query sequences against a table of sequences, and routing of the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotally.reference_tables import DEFAULT_ROUTE, NO_HIT_ROUTE, ROUTE_RULES
from biotally.session import cut_lineage, spread


MIX = 0x9E3779B97F4A7C15  # odd
TILE = 2048  # letters of a text that travel together when hits are compared
STRETCH = 1 << 20  # windows of a text hashed at once
HOT = 1000  # a word in more than one of so many rows is split; so there are no more than this many


def _minimizers(letters: np.ndarray, k: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, at, first, windows): runs of windows of k letters that have the same inner word as their smallest by hash (the first of equals)."""
    n = len(letters) - k + 1
    words = len(letters) - inner + 1
    h = np.zeros(words, np.uint64)
    for j in range(inner):
        h = h * np.uint64(MIX) + letters[j : j + words]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least, at = h[:n].copy(), np.arange(n)
    for j in range(1, k - inner + 1):
        less = h[j : j + n] < least
        least[less] = h[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return least[first].view(np.int64), at[first], first, np.diff(first, append=n)


def seeds(rows: DataFrame, key: str, k: int = 16) -> DataFrame:
    """(key, h, at, first, windows, piece): every window of k letters in one row with those next to it that share its minimizer.

    A minimizer is the inner word of about two thirds of k letters with the smallest hash; equal windows have equal ones,
    so texts that share a window meet at its minimizer, though only about a third of all positions are sent.
    """
    inner = max(1, k - max(1, k // 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("name"), batch.column("seq").to_pylist(), strict=True):
                if text is None or len(text) < k:
                    continue
                letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
                for start in range(0, len(text) - k + 1, STRETCH):
                    h, at, first, windows = _minimizers(letters[start : start + STRETCH + k - 1], k, inner)
                    a, b = (first + start).tolist(), (first + windows + start + k - 1).tolist()
                    pieces = [text[x:y] for x, y in zip(a, b, strict=True)]
                    columns = [pa.array(h), pa.array(at + start, pa.int32()), pa.array(first + start, pa.int32()), pa.array(windows, pa.int32()), pa.array(pieces, pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(h)), *columns], names=[key, "h", "at", "first", "windows", "piece"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("name"), "seq").mapInArrow(run, f"{key} {kind}, h long, at int, first int, windows int, piece string")


def _salted(q: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``: subject rows of a hot word are dealt over salts, query rows of it go to each of them.

    Hot is a word in more than one of ``HOT`` of the subject rows that share a word with a query, so there are at most
    ``HOT`` hot words, which are broadcast. Query rows and those subject rows are written first: the joins know their size.
    """
    q = cut_lineage(q)
    s = cut_lineage(s.join(q.select("h").distinct(), "h", "left_semi"))
    counts = s.groupBy("h").agg(F.count("*").alias("n"))
    total = counts.agg((F.sum("n") / HOT).alias("limit"))
    hot = F.broadcast(counts.crossJoin(F.broadcast(total)).filter(F.col("n") > F.greatest("limit", F.lit(float(HOT)))).select("h", F.ceil(F.col("n") / F.greatest("limit", F.lit(float(HOT)))).cast("int").alias("salts")))  # one row, then at most HOT
    one = F.coalesce("salts", F.lit(1))
    dealt = s.join(hot, "h", "left").withColumn("salt", F.pmod(F.xxhash64("subject_id", "at"), one).cast("int")).drop("salts")
    each = q.join(hot, "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
    return each, dealt


def seed_diagonals(queries: DataFrame, subjects: DataFrame, k: int = 16) -> DataFrame:
    """Best diagonal of each (query, subject) sharing a run of k letters: the one with most shared words.

    ``queries`` holds (query_id, seq), ``subjects`` (subject_id, seq). Rows meet at equal minimizers, and the windows that
    travel with them are compared there; the hits fold to (query, subject, diagonal) counts inside the join's tasks.
    """
    q = seeds(queries, "query_id", k).withColumnsRenamed({"at": "q_at", "first": "q_first", "windows": "q_windows", "piece": "q_piece"})
    q, s = _salted(q, seeds(spread(subjects.select("subject_id", "seq"), "subject_id"), "subject_id", k))
    met = q.join(s, ["h", "salt"])
    # Windows by their start, counted from the minimizer: those that both rows have.
    low = F.greatest(F.col("q_first") - F.col("q_at"), F.col("first") - F.col("at"))
    high = F.least(F.col("q_first") + F.col("q_windows") - F.col("q_at"), F.col("first") + F.col("windows") - F.col("at"))
    met = met.withColumn("low", low).withColumn("high", high).filter("low < high")
    shared = F.expr(f"size(filter(sequence(low, high - 1), p -> substr(q_piece, p + q_at - q_first + 1, {k}) = substr(piece, p + at - first + 1, {k})))")
    found = met.select("query_id", "subject_id", (F.col("at") - F.col("q_at")).alias("diagonal"), shared.cast("long").alias("shared")).filter("shared > 0")
    diag = found.groupBy("query_id", "subject_id", "diagonal").agg(F.sum("shared").alias("seeds"))
    best = diag.groupBy("query_id", "subject_id").agg(F.min(F.struct(-F.col("seeds"), "diagonal")).alias("m"))
    return best.select("query_id", "subject_id", F.col("m.diagonal").alias("diagonal"), (-F.col("m.col1")).alias("seeds"))


def _tiles(rows: DataFrame, key: str, name: str) -> DataFrame:
    pieces = F.regexp_extract_all("seq", F.lit(f"((?s).{{1,{TILE}}})"), F.lit(1))
    return spread(rows.select(key, "seq"), key).select(key, F.posexplode(pieces).alias(f"{name}_tile", f"{name}_text"))


def ungapped_identity(best: DataFrame, queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """Matching letters on the best diagonal over the whole overlap, identity and coverage of the query.

    Texts are cut into tiles; a hit asks for the tiles that its overlap runs through, on both sides, so that no row holds
    a whole text and a long overlap is many rows. Texts without a hit stay where they are.
    """
    best = cut_lineage(best)
    queries, subjects = (df.join(best.select(key).distinct(), key, "left_semi") for df, key in ((queries, "query_id"), (subjects, "subject_id")))
    q_len = queries.select("query_id", F.length("seq").alias("q_len"))
    s_len = subjects.select("subject_id", F.length("seq").alias("s_len"))
    start = F.greatest(F.lit(0), -F.col("diagonal"))
    j = best.join(q_len, "query_id").join(s_len, "subject_id").withColumn("start", start)
    j = j.withColumn("overlap", F.least(F.col("q_len") - F.col("start"), F.col("s_len") - F.col("start") - F.col("diagonal")))
    s_from = F.col("start") + F.col("diagonal")
    spans = j.withColumn("s_tile", F.explode(F.sequence((s_from / TILE).cast("int"), ((s_from + F.col("overlap") - 1) / TILE).cast("int"))))
    # The part of the overlap in a subject tile, in places of the query, and the query tiles it runs through.
    low = F.greatest(F.col("start"), F.col("s_tile") * TILE - F.col("diagonal"))
    high = F.least(F.col("start") + F.col("overlap"), (F.col("s_tile") + 1) * TILE - F.col("diagonal"))
    spans = spans.withColumn("low", low).withColumn("high", high).withColumn("q_tile", F.explode(F.sequence((F.col("low") / TILE).cast("int"), ((F.col("high") - 1) / TILE).cast("int"))))
    spans = spans.withColumn("low", F.greatest("low", F.col("q_tile") * TILE)).withColumn("high", F.least("high", (F.col("q_tile") + 1) * TILE))
    met = spans.join(_tiles(queries, "query_id", "q"), ["query_id", "q_tile"]).join(_tiles(subjects, "subject_id", "s"), ["subject_id", "s_tile"])
    a = F.split(F.expr(f"substr(q_text, low - q_tile * {TILE} + 1, high - low)"), "")
    b = F.split(F.expr(f"substr(s_text, low + diagonal - s_tile * {TILE} + 1, high - low)"), "")
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    total = met.withColumn("same", same).groupBy("query_id", "subject_id", "diagonal", "seeds", "overlap", "q_len").agg(F.sum("same").cast("int").alias("matches"))
    return total.select(
        "query_id", "subject_id", "diagonal", "seeds", "overlap", "matches", (F.col("matches") * 100.0 / F.col("overlap")).alias("identity"),
        (F.col("overlap") * 100.0 / F.col("q_len")).alias("coverage"),
    )


def hits_by_identity(hits: DataFrame, top: int = 10) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("identity"), F.desc("matches"), "subject_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def seed_search(queries: DataFrame, subjects: DataFrame, k: int = 16, top: int = 10) -> DataFrame:
    return hits_by_identity(ungapped_identity(seed_diagonals(queries, subjects, k), queries, subjects), top)


def route_hit(title: Column, organism: Column) -> Column:
    """First routing rule that matches the best hit; the alignment tool without a hit."""
    texts = {"title": F.lower(title), "organism": F.lower(organism)}
    tests = [F.when(F.regexp_like(texts[column], F.lit(pattern)), F.lit(route)) for _, column, pattern, route in ROUTE_RULES]
    return F.coalesce(*tests, F.when(title.isNotNull(), F.lit(DEFAULT_ROUTE)), F.lit(NO_HIT_ROUTE))


def identify_sequences(queries: DataFrame, subjects: DataFrame, titles: DataFrame, k: int = 16) -> DataFrame:
    """Each query with its best subject and the suggested next step, also for queries without a hit."""
    best = seed_search(queries, subjects, k).filter("rank = 1")
    named = best.join(titles, "subject_id", "left")
    out = queries.select("query_id").join(named, "query_id", "left")
    return out.select("query_id", "subject_id", "identity", "coverage", route_hit(F.col("title"), F.col("organism")).alias("route"))
