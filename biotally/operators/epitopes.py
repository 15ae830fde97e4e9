"""Epitope prediction over tables of proteins: residue scales, runs above a threshold, anchored 9-letter peptides."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotally.functions.letters import as_strings, letters, passes
from biotally.functions.letters import words as letters_at
from biotally.functions.sequence import TILE, clamp, letter_value, round_half_up, sequence_tiles, substitution_score, tile_words, words_at
from biotally.reference_tables import (
    AMINO_ACIDS,
    ANCHOR_P2,
    ANCHOR_P9,
    ANTIGENIC_RESIDUES,
    BLOSUM_ORDER,
    COMPOSITE_WEIGHTS,
    KNOWN_BINDERS,
    SCALES,
    UNKNOWN_PAIR_SCORE,
    blosum62,
)
from biotally.session import cut_lineage, spread

WINDOW = 7
# One bit field per scale; only the first scale has negative values, the shift makes them positive.
_SHIFT, _BITS = (4, 0, 0, 0), 16
_NOTHING = sum((shift * 1000) << (_BITS * i) for i, shift in enumerate(_SHIFT))


def _add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _window_means(words: DataFrame, *keep: str) -> DataFrame:
    """``keep`` with the means of the four residue scales over the first letters of the window ``w``."""
    letters = [F.substring("w", j, 1) for j in range(1, WINDOW + 1)]
    # The four scales travel as bit fields of one long (thousandths, shifted to be positive): one lookup per
    # letter instead of four, and an exact integer sum.
    packed = {c: sum(round((s[c] + _SHIFT[i]) * 1000) << (_BITS * i) for i, s in enumerate(SCALES.values())) for c in AMINO_ACIDS}
    table = F.array(*[F.lit(packed.get(chr(65 + i), _NOTHING)).cast("bigint") for i in range(26)])
    total = _add([F.coalesce(F.get(table, F.ascii(c) - 65), F.lit(_NOTHING).cast("bigint")) for c in letters])
    sums = words.select(*keep, total.alias("packed"))
    mask = (1 << _BITS) - 1
    means = [
        ((F.shiftright("packed", _BITS * i).bitwiseAND(F.lit(mask).cast("bigint")) - WINDOW * _SHIFT[i] * 1000) / F.lit(1000.0 * WINDOW)).alias(name)
        for i, name in enumerate(SCALES)
    ]
    return sums.select(*keep, *means)


def _padded(width: int) -> Column:
    return F.concat(F.col("seq"), F.lit("#" * (width - WINDOW)))


def sliding_scores(proteins: DataFrame, key: str = "protein_id", width: int = WINDOW) -> DataFrame:
    """Forward window means of the four residue scales, one row per window start. No shuffle."""
    rows = spread(proteins.filter(F.length("seq") >= WINDOW).select(key, "seq"), key)
    words = words_at(rows, (key,), _padded(width), width, "p")
    return _window_means(words.withColumn("pos", F.col("p") + 1), key, "pos", "w")


def _composite(scores: DataFrame, low: Callable[[str], Column], high: Callable[[str], Column]) -> DataFrame:
    out = scores
    for name in SCALES:
        out = out.withColumn(f"{name}_n", (F.col(name) - low(name)) / F.coalesce(F.nullif(high(name) - low(name), F.lit(0.0)), F.lit(1.0)))
    # Rounded so that a value on the threshold does not depend on the last bit.
    return out.withColumn("composite", F.round(_add([F.lit(wt) * F.col(f"{name}_n") for name, wt in COMPOSITE_WEIGHTS.items()]), 9))


def minmax_normalize(scores: DataFrame, key: str = "protein_id") -> DataFrame:
    """(value - min) / range per protein (range 0 counts as 1), then the weighted composite, for scores of any origin."""
    limits = scores.groupBy(key).agg(*[f(n).alias(f"{e}_{n}") for n in SCALES for e, f in (("low", F.min), ("high", F.max))])
    joined = scores.join(limits, key)
    return _composite(joined, lambda n: F.col(f"low_{n}"), lambda n: F.col(f"high_{n}")).drop(*limits.columns[1:])


def _scale_table() -> np.ndarray:
    """The residue scales in thousandths, by the code of a letter."""
    table = np.zeros((len(SCALES), 128), np.int64)
    for i, scale in enumerate(SCALES.values()):
        for c in AMINO_ACIDS:
            table[i, ord(c)] = round(scale[c] * 1000)
    return table


def _window_sums(text: str, table: np.ndarray) -> np.ndarray:
    """Sums of the scales over every window of a text, a row a scale."""
    letters = np.minimum(np.frombuffer(text.encode("ascii", "replace"), np.uint8), 127)
    run = np.cumsum(table[:, letters], axis=1)
    sums = run[:, WINDOW - 1 :].copy()
    sums[:, 1:] -= run[:, :-WINDOW]
    return sums


def _extremes(key: str, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Smallest and largest window sum of each scale in a tile, in thousandths."""
    table = _scale_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, least, most = [], [], []
            for at, text in enumerate(b.column("_text").to_pylist()):
                if len(text) < width:
                    continue
                sums = _window_sums(text[: len(text) - width + WINDOW], table)
                keys.append(at)
                least.append(sums.min(axis=1))
                most.append(sums.max(axis=1))
            columns = [pa.array([float(v[i]) / (1000.0 * WINDOW) for v in side], pa.float64()) for i in range(len(SCALES)) for side in (least, most)]
            kept = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(key).take(kept), b.column("_tile").take(kept), *columns], names=[key, "_tile", *_LIMITS])

    return run


_LIMITS = [f"{end}_{name}" for name in SCALES for end in ("low", "high")]


def scored_tiles(proteins: DataFrame, key: str = "protein_id", width: int = WINDOW, tile: int = TILE) -> DataFrame:
    """Tiles of the sequences, dealt over tasks, each with the extremes of its whole sequence in the residue scales.

    A first pass gives the extremes of every tile, which fold to one row a sequence; a tile then carries those of its
    sequence, so windows are never shuffled and a long sequence is as many tasks as it has tiles. ``_single`` is false where
    several sequences have one key.
    """
    tiles = sequence_tiles(proteins.filter(F.length("seq") >= WINDOW).select(key, "seq"), (key,), _padded(width), width, tile)
    kind = proteins.schema[key].dataType.simpleString()
    found = tiles.select(key, "_tile", "_text").mapInArrow(_extremes(key, width), f"{key} {kind}, _tile int, " + ", ".join(f"{c} double" for c in _LIMITS))
    single = F.count("*") == F.max("_tile") - F.min("_tile") + 1
    limits = cut_lineage(found.groupBy(key).agg(*[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in _LIMITS], single.alias("_single")))
    return spread(tiles.join(limits, key), key, "_tile").select(key, "_tile", "_text", *_LIMITS, "_single")


def _windows(tiles: DataFrame, key: str, width: int, tile: int) -> DataFrame:
    words = tile_words(tiles, (key, "_tile", *_LIMITS), width, "p", tile=tile)
    scores = _window_means(words.withColumn("pos", F.col("p") + 1), key, "_tile", "pos", "w", *_LIMITS)
    return _composite(scores, lambda n: F.col(f"low_{n}"), lambda n: F.col(f"high_{n}")).drop(*_LIMITS)


_SCORED = ("pos", "w", *SCALES, *[f"{n}_n" for n in SCALES], "composite")


def _tile_scores(key: str, width: int, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of each tile of `scored_tiles` with their means, normalized means and composite."""
    table = _scale_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in passes(batches, "_text", _WINDOWS):
            limits = {c: b.column(c).to_numpy() for c in _LIMITS}
            tiles = b.column("_tile").to_numpy().astype(np.int64)
            data, starts, ends = letters(b.column("_text"))
            counts = np.maximum(ends - starts - width + 1, 0)
            if not counts.sum():
                continue
            row = np.repeat(np.arange(len(counts)), counts)
            off = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = starts[row] + off
            upto = np.zeros((len(SCALES), len(data) + 1), np.int64)
            np.cumsum(table[:, data], axis=1, out=upto[:, 1:])
            means = (upto[:, at + WINDOW] - upto[:, at]) / (1000.0 * WINDOW)
            composite, normal = np.zeros(len(at)), {}
            for name, mean in zip(SCALES, means, strict=True):
                low, high = limits[f"low_{name}"], limits[f"high_{name}"]
                span = np.where(high == low, 1.0, high - low)
                normal[name] = (mean - low[row]) / span[row]
            for name, weight in COMPOSITE_WEIGHTS.items():
                composite += weight * normal[name]
            # Rounded so that a value on the threshold does not depend on the last bit.
            columns = [*means, *[normal[n] for n in SCALES], np.floor(composite * 1e9 + 0.5) / 1e9]
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(taken), pa.array(tiles[row], pa.int32()), pa.array(tiles[row] * tile + off + 1, pa.int32()), as_strings(letters_at(data, at, width)), *map(pa.array, columns)],
                names=[key, "_tile", *_SCORED],
            )

    return run


_WINDOWS = 1 << 17  # letters, and so about as many rows, of a pass


def composite_scores(proteins: DataFrame, key: str = "protein_id", width: int = WINDOW, tile: int = TILE) -> DataFrame:
    """`sliding_scores` with the composite, its sequences cut into tiles that are dealt over tasks (`scored_tiles`).

    The windows of a batch of tiles are made in one pass over its letters.
    """
    kind = proteins.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, _tile int, pos int, w string, " + ", ".join(f"{c} double" for c in _SCORED[2:])
    return scored_tiles(proteins, key, width, tile).mapInArrow(_tile_scores(key, width, tile), schema)


_SUMS = [f"sum_{c}" for c in ("composite", *SCALES)]


def _tile_runs(key: str, width: int, threshold: float, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The runs of windows at or above the threshold inside each tile of `scored_tiles`, with their sums."""
    table = _scale_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limits = {c: b.column(c).to_numpy() for c in _LIMITS}
            tiles = b.column("_tile").to_numpy()
            rows, starts, lasts, words, sums = [], [], [], [], []
            for at, text in enumerate(b.column("_text").to_pylist()):
                if len(text) < width:
                    continue
                means = _window_sums(text[: len(text) - width + WINDOW], table) / (1000.0 * WINDOW)
                composite = np.zeros(means.shape[1])
                for (name, weight), mean in zip(COMPOSITE_WEIGHTS.items(), means, strict=True):
                    low, high = limits[f"low_{name}"][at], limits[f"high_{name}"][at]
                    composite += weight * ((mean - low) / ((high - low) or 1.0))
                composite = np.floor(composite * 1e9 + 0.5) / 1e9
                edges = np.flatnonzero(np.diff((composite >= threshold).astype(np.int8), prepend=0, append=0))
                if not len(edges):
                    continue
                first, end = edges[::2], edges[1::2]
                rows.append(np.full(len(first), at))
                starts.append(tiles[at] * tile + first + 1)
                lasts.append(tiles[at] * tile + end)
                words += [text[k : k + width] for k in first.tolist()]
                # Sums of each run by itself, not as differences of running sums, which lose digits.
                sums.append(np.add.reduceat(np.vstack([composite, means])[:, : end[-1]], edges[:-1], axis=1)[:, ::2])
            if rows:
                kept, start, last = (np.concatenate(x) for x in (rows, starts, lasts))
                columns = [b.column(key).take(pa.array(kept)), pa.array(tiles[kept], pa.int32()), pa.array(start, pa.int32()), pa.array(last, pa.int32()), pa.array(words, pa.string()), pa.array(last - start + 1, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x) for x in np.hstack(sums)]], names=[key, "_tile", "start", "last", "w", "n", *_SUMS])

    return run


def _runs_of_tiles(tiles: DataFrame, key: str, width: int, threshold: float, tile: int) -> DataFrame:
    kind = tiles.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, _tile int, start int, last int, w string, n bigint, " + ", ".join(f"{c} double" for c in _SUMS)
    return tiles.mapInArrow(_tile_runs(key, width, threshold, tile), schema)


def _runs_of_windows(scored: DataFrame, key: str, threshold: float) -> DataFrame:
    # The count runs over all windows and not over those above: a filter on the composite would be pushed below its
    # projection and compute it twice.
    marked = scored.withColumn("above", (F.col("composite") >= threshold).cast("int"))
    island = F.col("pos") - F.sum("above").over(Window.partitionBy(key, "_tile").orderBy("pos"))
    return (
        marked.withColumn("island", island)
        .filter("above = 1")
        .groupBy(key, "_tile", "island")
        .agg(F.min("pos").alias("start"), F.max("pos").alias("last"), F.min_by("w", "pos").alias("w"), F.count("*").alias("n"), *[F.sum(c.removeprefix("sum_")).alias(c) for c in _SUMS])
    )


def runs_above(scored: DataFrame, threshold: float = 0.5, key: str = "protein_id", tile: int = TILE, width: int = WINDOW) -> DataFrame:
    """Maximal runs of windows at or above the threshold, of `scored_tiles` or of the windows of `composite_scores`.

    Tiles find their runs in one pass over their letters and give no row for a window; windows are sorted. Only the runs
    that touch a border of their tile can go on in the next one: they meet by sequence, all others stay with their tile.
    Several sequences of one key have their windows counted together, also those of tiles.
    """
    if "_text" in scored.columns:
        parts = _runs_of_tiles(scored.filter("_single"), key, width, threshold, tile)
        shared = _windows(scored.filter("not _single"), key, width, tile)
        parts = parts.unionByName(_runs_of_windows(shared, key, threshold).select(*parts.columns))
    else:
        parts = _runs_of_windows(scored, key, threshold)
    names = ["composite", *SCALES]
    border = ((F.col("_tile") > 0) & (F.col("start") == F.col("_tile") * tile + 1)) | (F.col("last") == (F.col("_tile") + 1) * tile)
    placed = parts.withColumn("place", F.when(border, -1).otherwise(F.col("_tile")))
    along = Window.partitionBy(key, "place").orderBy("start")
    fresh = placed.withColumn("fresh", (F.col("start") != F.coalesce(F.lag("last").over(along) + 1, F.lit(-1))).cast("int"))
    runs = fresh.withColumn("chain", F.sum("fresh").over(along)).groupBy(key, "place", "chain").agg(
        F.min("start").alias("start"), F.max("last").alias("last"), F.min_by("w", "start").alias("w"), F.sum("n").alias("n"), *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in names]
    )
    mean = lambda c: F.col(f"sum_{c}") / F.col("n")
    return runs.select(key, "start", (F.col("last") + WINDOW - 1).alias("end"), "w", mean("composite").alias("mean_composite"), *[mean(c).alias(c) for c in SCALES])


def predict_b_epitopes(proteins: DataFrame, key: str = "protein_id", min_len: int = 6, max_len: int = 20, top: int = 15, tile: int = TILE) -> DataFrame:
    width = max(max_len, WINDOW)
    runs = runs_above(scored_tiles(proteins, key, width, tile), key=key, tile=tile, width=width)
    length = F.col("end") - F.col("start") + 1
    score = clamp(round_half_up(F.col("mean_composite") * 100).cast("int"), 0, 100)
    w = Window.partitionBy(key).orderBy(F.desc("score"), "start")
    return (
        runs.filter(length.between(min_len, max_len))
        .select(
            key, "start", "end", F.expr("substr(w, 1, end - start + 1)").alias("sequence"), score.alias("score"),
            *[F.col(n) for n in SCALES],
        )
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top)
    )


def binding_total(pep: Column) -> Column:
    """Anchor residues 2 and 9 plus small terms for hydrophobic 1, 3, 6 and polar 4, 5, 7."""
    aux = [F.when(F.instr(F.lit("AILMVFYW"), F.substring(pep, j, 1)) > 0, 0.1).otherwise(0.0) for j in (1, 3, 6)]
    aux += [F.when(F.instr(F.lit("STNQDEKR"), F.substring(pep, j, 1)) > 0, 0.05).otherwise(0.0) for j in (4, 5, 7)]
    p2, p9 = letter_value(F.substring(pep, 2, 1), ANCHOR_P2), letter_value(F.substring(pep, 9, 1), ANCHOR_P9)
    return F.round(p2 * 0.4 + p9 * 0.4 + _add(aux), 9)


def _scored_peptides(words: DataFrame, key: str) -> DataFrame:
    pep = F.col("sequence")
    good = [(letter_value(F.substring(pep, 2, 1), ANCHOR_P2) > 0.5), (letter_value(F.substring(pep, 9, 1), ANCHOR_P9) > 0.5)]
    return (
        words.withColumn("total", binding_total(pep))
        .select(
            key,
            (F.col("p") + 1).alias("start"),
            (F.col("p") + 9).alias("end"),
            "sequence",
            clamp(round_half_up(F.col("total") * 100).cast("int"), 0, 100).alias("score"),
            F.greatest(F.lit(5), round_half_up((1 - F.col("total")) * 5000 + 50).cast("int")).alias("ic50"),
            _add([g.cast("int") for g in good]).alias("anchor_match"),
        )
    )


def binding_peptides(proteins: DataFrame, key: str = "protein_id") -> DataFrame:
    """Every 9-letter peptide with its score, affinity estimate and number of good anchors."""
    return _scored_peptides(words_at(spread(proteins.select(key, "seq"), key), (key,), F.col("seq"), 9, "p", "sequence"), key)


def _best_peptides(key: str, top: int, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``top`` peptides of each tile by affinity estimate and place; `binding_total` in thousandths, which hold it exactly."""
    table = np.zeros((4, 128), np.int64)
    for row, values in ((0, ANCHOR_P2), (1, ANCHOR_P9)):
        for c, v in values.items():
            table[row, ord(c)] = round(v * 400)
    for row, letters, points in ((2, "AILMVFYW", 100), (3, "STNQDEKR", 50)):
        for c in letters:
            table[row, ord(c)] = points

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tiles = b.column("_tile").to_pylist()
            rows, places, words = [], [], []
            for at, text in enumerate(b.column("_text").to_pylist()):
                n = len(text) - 8
                if n < 1:
                    continue
                by = table[:, np.minimum(np.frombuffer(text.encode("ascii", "replace"), np.uint8), 127)]
                total = by[0, 1 : n + 1] + by[1, 8 : n + 8]
                for j in (0, 2, 5):
                    total = total + by[2, j : n + j]
                for j in (3, 4, 6):
                    total = total + by[3, j : n + j]
                ic50 = np.maximum(5, (1000 - total) * 5 + 50)
                best = np.argsort(ic50, kind="stable")[:top].tolist()
                rows += [at] * len(best)
                places += [tiles[at] * tile + k for k in best]
                words += [text[k : k + 9] for k in best]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(words, pa.string())], names=[key, "p", "sequence"])

    return run


def predict_t_epitopes(proteins: DataFrame, key: str = "protein_id", top: int = 20, tile: int = TILE) -> DataFrame:
    """The ``top`` peptides of each sequence; a tile keeps as many of its own before any become rows to be sorted."""
    tiles = spread(sequence_tiles(proteins.select(key, "seq"), (key,), F.col("seq"), 9, tile), key, "_tile")
    kind = proteins.schema[key].dataType.simpleString()
    best = tiles.select(key, "_tile", "_text").mapInArrow(_best_peptides(key, top, tile), f"{key} {kind}, p int, sequence string")
    w = Window.partitionBy(key).orderBy("ic50", "start")
    return _scored_peptides(best, key).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def bin_ic50(ic50: Column) -> Column:
    return F.when(ic50 < 50, "High").when(ic50 < 500, "Moderate").when(ic50 < 1000, "Low").otherwise("Very Low")


def antigenicity(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, f"[^{ANTIGENIC_RESIDUES}]", "")) / F.length(seq)


def peptide_similarity(pep: Column, reference: Column, length: int = 9) -> Column:
    """Substitution score against a reference peptide over the peptide's self score; 0 for another length."""
    at = lambda x, i: F.substring(x, i, 1)
    pairs = _add([substitution_score(at(pep, i), at(reference, i)) for i in range(1, length + 1)])
    self_score = _add([letter_value(at(pep, i), {a: blosum62()[a, a] for a in BLOSUM_ORDER}, UNKNOWN_PAIR_SCORE) for i in range(1, length + 1)])
    return F.when((F.length(pep) == length) & (self_score > 0), pairs / self_score).otherwise(F.lit(0.0))


def max_reference_similarity(pep: Column, references=KNOWN_BINDERS) -> Column:
    """Highest similarity to a short fixed list of references, within the row."""
    listed = F.array(*[F.lit(r) for r in references])
    return clamp(F.array_max(F.transform(listed, lambda r: peptide_similarity(pep, r, len(references[0])))), 0.0, 1.0)


def combined_binding(anchor: Column, naturalness: Column, similarity: Column) -> dict[str, Column]:
    """Weighted binding score with its affinity, rank proxy and confidence."""
    combined = anchor * 0.4 + naturalness * 0.3 + similarity * 0.3
    return {
        "combined": combined,
        "ic50": F.greatest(F.lit(5), round_half_up((1 - combined) * 5000 + 50).cast("int")),
        "rank_proxy": F.exp((1 - combined) * 5) - 1,
        "confidence": anchor * 0.5 + F.least(F.lit(1.0), naturalness * 5) * 0.5,
    }
