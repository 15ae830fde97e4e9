"""Guide RNA search on both strands with on-target score and genome-wide specificity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotally.functions.letters import as_strings, inside, letters, passes, words
from biotally.functions.sequence import TILE, reverse_complement, sequence_tiles
from biotally.operators.folding import best_hairpin
from biotally.operators.near_words import HALF_WORDS, ball_counts, ball_values, near_pairs, word_code, word_counts
from biotally.reference_tables import COMPLEMENT_FROM, COMPLEMENT_TO, GUIDE_PREFERRED, GUIDE_WEIGHTS
from biotally.session import cut_lineage, spread

GUIDE, SEED = 20, 12


def _score_table() -> tuple[int, np.ndarray]:
    """The score of no preferred base, in tenths, and what each letter adds at each position of a guide."""
    tenths = [round(w * 10) for w in GUIDE_WEIGHTS]
    table = np.zeros((len(tenths), 256), np.int16)
    for i, good in GUIDE_PREFERRED.items():
        table[i - 1] = -2 * tenths[i - 1]
        table[i - 1, list(good.encode())] = 5 * tenths[i - 1]
    return 500 - sum(2 * w for i, w in enumerate(tenths, 1) if i not in GUIDE_PREFERRED), table


def on_target_scores(guides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and numbers of G and C of guides, a row of letters each.

    50, plus 5 w for a preferred base and minus 2 w otherwise, GC and poly-T terms; computed in exact tenths.
    """
    base, table = _score_table()
    score = np.full(len(guides), base, np.int32)
    for i in GUIDE_PREFERRED:
        score += table[i - 1][guides[:, i - 1]]
    gc = ((guides == ord("G")) | (guides == ord("C"))).sum(axis=1)
    score += np.where((gc * 5 >= 40) & (gc * 5 <= 60), 100, np.where((gc * 5 < 20) | (gc * 5 > 80), -150, 0))
    t = guides == ord("T")
    score -= 200 * (t[:, :-3] & t[:, 1:-2] & t[:, 2:-1] & t[:, 3:]).any(axis=1)
    return np.clip((score + 5) // 10, 0, 100).astype(np.int32), gc


def _tile_candidates(key: str, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The candidates of tiles: on the other strand a guide's window begins with the complement of its GG."""
    flipped = np.arange(256, dtype=np.uint8)
    flipped[list(COMPLEMENT_FROM.encode())] = list(COMPLEMENT_TO.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in passes(batches, "_text"):
            data, starts, ends = letters(b.column("_text"))
            tiles = b.column("_tile").to_numpy()
            last = len(data) - GUIDE - 2
            if last < 1:
                continue
            for strand, letter, first in (("+", "G", GUIDE + 1), ("-", "C", 0)):
                hit = data == ord(letter)
                at, row = inside(np.flatnonzero(hit[first : first + last] & hit[first + 1 : first + 1 + last]), GUIDE + 3, starts, ends)
                w = words(data, at, GUIDE + 3)
                if strand == "-":
                    w = flipped[w[:, ::-1]]
                score, gc = on_target_scores(w[:, :GUIDE])
                position = tiles[row].astype(np.int64) * tile + at - starts[row] + (1 if strand == "+" else 4)
                columns = [pa.array(position, pa.int32()), as_strings(w[:, :GUIDE]), as_strings(w[:, GUIDE:]), pa.array(gc * 100.0 / GUIDE), pa.array(w[:, 0] == ord("G")), pa.array(score)]
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row)), pa.array([strand] * len(at), pa.string()), *columns], names=[key, *_CANDIDATE])

    return run


_CANDIDATE = ("strand", "position", "guide", "pam", "gc", "starts_with_g", "on_target")


def guide_candidates(seqs: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """Every 20-letter guide followed by NGG, both strands, positions on the given strand.

    Tiles are dealt over tasks; one pass over the letters of a batch of tiles finds and scores the guides of both strands.
    """
    tiles = spread(sequence_tiles(seqs, (key,), F.col("seq"), GUIDE + 3, tile), key, "_tile")
    kind = seqs.schema[key].dataType.simpleString()
    return tiles.mapInArrow(_tile_candidates(key, tile), f"{key} {kind}, strand string, position int, guide string, pam string, gc double, starts_with_g boolean, on_target int")


def seed_codes(guide: Column) -> tuple[Column, Column]:
    """Codes of the PAM-side 12 letters and of their reverse complement."""
    seed = F.substring(guide, 20 - SEED + 1, SEED)
    return word_code(seed), word_code(reverse_complement(seed))


def offtarget_counts(candidates: DataFrame, genome: DataFrame) -> DataFrame:
    """Per distinct seed: genome windows within 0..3 mismatches of the seed or its reverse complement."""
    # Letters first: a code is made for each distinct seed and not for each guide.
    fwd, rev = seed_codes(F.col("guide"))
    seeds = candidates.select(F.concat(F.lit("#" * (GUIDE - SEED)), F.substring("guide", GUIDE - SEED + 1, SEED)).alias("guide")).distinct()
    seeds = seeds.select(fwd.alias("seed"), rev.alias("seed_rc")).distinct()
    both = seeds.select("seed", F.explode(F.array("seed", "seed_rc")).alias("code"))
    balls = ball_counts(both, word_counts(genome, SEED))
    total = lambda top: sum(F.col(f"mm{m}") for m in range(top + 1))
    return both.join(balls, "code").groupBy("seed").agg(F.sum(total(2)).alias("hits2"), F.sum(total(3)).alias("hits3"))


def guide_specificity(hits2: Column, hits3: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 20 * hits2 - 2 * hits3).cast("int")


def specificity_values(genome: DataFrame) -> DataFrame:
    """The specificity of every seed as `ball_values`: hits of a seed's reverse complement are those of the seed on the other strand."""
    turned = genome.select("seq").unionByName(genome.select(reverse_complement(F.col("seq")).alias("seq")))

    def value(hits: np.ndarray) -> np.ndarray:
        hits3 = hits.sum(axis=-1)
        return np.clip(100 - 20 * (hits3 - hits[..., 3]) - 2 * hits3, 0, 100)

    return ball_values(word_counts(turned, SEED), value)


def with_specificity(candidates: DataFrame, genome: DataFrame) -> DataFrame:
    counts = offtarget_counts(candidates, genome)
    keyed = candidates.withColumn("seed", seed_codes(F.col("guide"))[0])
    joined = keyed.join(counts, "seed", "left").na.fill(0, ["hits2", "hits3"])
    return joined.withColumn("specificity", guide_specificity(F.col("hits2"), F.col("hits3"))).drop("seed")


def offtarget_hits(candidates: DataFrame, genome: DataFrame) -> DataFrame:
    """Each distinct seed with every distinct genome word within 3 mismatches, and how often the word occurs."""
    fwd, rev = seed_codes(F.col("guide"))
    turns = F.array(F.struct(F.lit("+").alias("turn"), fwd.alias("query")), F.struct(F.lit("-").alias("turn"), rev.alias("query")))
    seeds = candidates.select(fwd.alias("seed"), F.inline(turns)).distinct()
    words = word_counts(genome, SEED)
    pairs = near_pairs(seeds.select(F.col("query").alias("code")), words, SEED, 3)
    return seeds.join(pairs, "query").join(words.select(F.col("code").alias("target"), "n"), "target").select("seed", "turn", "target", "mismatches", "n")


def find_guides(seqs: DataFrame, genome: DataFrame, key: str, top: int = 20) -> DataFrame:
    """Best guides of each sequence by 0.6 on-target + 0.4 specificity.

    All candidates are made once and ranked by the specificity of their seeds, looked up in a table of all 4**12 seeds;
    hits are counted for the best ones.
    """
    candidates = guide_candidates(seqs, key)
    seed = seed_codes(F.col("guide"))[0]
    # No hits on seeds that have no genome word in reach.
    known = F.get("values", F.expr(f"cast(seed div {HALF_WORDS} as int)"))
    placed = candidates.withColumn("seed", seed).withColumn("suffix", F.col("seed") % HALF_WORDS).join(F.broadcast(specificity_values(genome)), "suffix", "left")
    combined = 6 * F.col("on_target") + 4 * F.coalesce(known.cast("int"), F.lit(100))
    w = Window.partitionBy(key).orderBy(F.desc("tenths"), "position", "strand")
    first = placed.withColumn("tenths", combined).select(*candidates.columns, "tenths").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    best = with_specificity(cut_lineage(first), genome)
    best = best.select(*candidates.columns, "hits2", "hits3", "specificity", "tenths", "rank")
    return best.withColumn("combined", F.col("tenths") / 10).drop("tenths").withColumn("hairpin", best_hairpin("guide"))
