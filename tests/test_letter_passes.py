"""Passes over the letters of many tiles at once against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from biotally.operators import epitopes, guides, near_words, orfs, pairs, resistance, restriction
from biotally.reference_tables import CODON_BASES, CODON_RESIDUES, COMPLEMENT_FROM, COMPLEMENT_TO, ENZYMES, GUIDE_PREFERRED, GUIDE_WEIGHTS, IUPAC_CLASSES, STARTS, STOPS
from biotally.sources import tables


def flipped(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def dna(r, n):
    return "".join(r.choice("ACGTG") for _ in range(n))


def on_target(guide):
    tenths = [round(w * 10) for w in GUIDE_WEIGHTS]
    score = 500 + sum((5 * w if g in GUIDE_PREFERRED[i] else -2 * w) if i in GUIDE_PREFERRED else -2 * w for i, (g, w) in enumerate(zip(guide, tenths), 1))
    gc = 5 * sum(c in "GC" for c in guide)
    score += 100 if 40 <= gc <= 60 else -150 if gc < 20 or gc > 80 else 0
    return max(0, min(100, (score - (200 if "TTTT" in guide else 0) + 5) // 10))


@pytest.mark.parametrize("tile", [1 << 16, 30, 23])
def test_guides_of_both_strands_are_found_in_tiles_of_one_strand(spark, tile):
    r = random.Random(4)
    seqs = [(k, dna(r, n)) for k, n in enumerate([1, 22, 23, 24, 60, 400])] + [(4, dna(r, 70)), (None, dna(r, 90)), (9, "T" * 20 + "AGG" + "CCA" + "A" * 20), (10, "")]
    got = sorted(tuple(x) for x in guides.guide_candidates(spark.createDataFrame(seqs, "k long, seq string"), "k", tile).select(F.coalesce("k", F.lit(-1)), "strand", "position", "guide", "pam", "gc", "starts_with_g", "on_target").collect())
    want = []
    for k, seq in seqs:
        for strand, text in (("+", seq), ("-", flipped(seq))):
            for i in range(len(text) - 22):
                if text[i + 21 : i + 23] == "GG":
                    g = text[i : i + 20]
                    want.append((-1 if k is None else k, strand, i + 1 if strand == "+" else len(seq) - i - 19, g, text[i + 20 : i + 23], 5.0 * sum(c in "GC" for c in g), g[0] == "G", on_target(g)))
    assert got == sorted(want) and len(want) > 50


def test_values_of_all_words_are_those_of_the_balls(spark):
    r = random.Random(5)
    genome = spark.createDataFrame([(dna(r, 300),), (dna(r, 200),)], "seq string")
    words = near_words.word_counts(genome, 12)
    table = {x["suffix"]: x["values"] for x in near_words.ball_values(words, lambda hits: np.minimum(hits.sum(axis=-1), 120)).collect()}
    asked = [r.randrange(4**12) for _ in range(300)] + [x.code for x in words.limit(50).collect()]
    balls = {x.code: min(120, x.mm0 + x.mm1 + x.mm2 + x.mm3) for x in near_words.ball_counts(spark.createDataFrame([(c,) for c in asked], "code long"), words).collect()}
    assert {c: table[c % 4096][c // 4096] if c % 4096 in table else 0 for c in asked} == {c: balls.get(c, 0) for c in asked}
    assert sum(balls.values()) > 50


def test_best_guides_have_the_specificity_of_both_turns(spark):
    r = random.Random(6)
    genome = spark.createDataFrame([(1, dna(r, 3000))], "seq_id long, seq string")
    seqs = spark.createDataFrame([(k, dna(r, 200)) for k in range(4)], "k long, seq string")
    scored = guides.with_specificity(guides.guide_candidates(seqs, "k"), genome).collect()
    want = {}
    for x in sorted(scored, key=lambda x: (-6 * x.on_target - 4 * x.specificity, x.position, x.strand)):
        want.setdefault(x.k, []).append((x.strand, x.position, x.guide, x.hits2, x.hits3, x.specificity))
    got = {}
    for x in sorted(guides.find_guides(seqs, genome, "k", top=5).collect(), key=lambda x: x["rank"]):
        got.setdefault(x.k, []).append((x.strand, x.position, x.guide, x.hits2, x.hits3, x.specificity))
    assert got == {k: v[:5] for k, v in want.items()} and len(got) == 4


def plain_orfs(seq, min_len):
    out = []
    table = dict(zip(("".join((a, b, c)) for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES), CODON_RESIDUES, strict=True))
    for strand, text in (("+", seq), ("-", seq[::-1].translate(str.maketrans("ACGTN", "TGCAN")))):
        for i in range(len(text) - 2):
            if text[i : i + 3] in STARTS:
                stop = next((j for j in range(i, len(text) - 2, 3) if text[j : j + 3] in STOPS), None)
                if stop is not None and stop + 3 - i >= min_len:
                    orf, n = text[i : stop + 3], len(text)
                    at = (i + 1, stop + 3) if strand == "+" else (n - stop - 2, n - i)
                    out.append((strand, *at, len(orf), orf[:3], "".join(table.get(orf[k : k + 3], "X") for k in range(0, len(orf), 3)), sum(c in "GC" for c in orf) * 100.0 / len(orf)))
    return out


@pytest.mark.parametrize("tile", [orfs.ORF_TILE, 30, 3])
def test_frames_of_many_texts_in_one_pass(spark, tile):
    r = random.Random(8)
    seqs = [(k, "".join(r.choice("ACGTN" if k == 3 else "ACGT") for _ in range(n))) for k, n in enumerate([0, 1, 5, 300, 29, 30, 31, 400])]
    seqs += [(None, dna(r, 50) + "ATGAAATAA"), (20, "ATG" + "GCC" * 60), (21, "ATG" + "GCC" * 60 + "TAG")]
    rows = spark.createDataFrame(seqs, "k long, seq string").coalesce(1)
    got = sorted((-1 if x[0] is None else x[0], *x[1:]) for x in (tuple(x) for x in orfs.find_orfs(rows, "k", 9, tile).collect()))
    want = sorted((-1 if k is None else k, *x) for k, seq in seqs for x in plain_orfs(seq, 9))
    assert got == want and len(want) > 20


def test_frames_of_a_batch_share_their_tasks(spark):
    """Frames are made in passes over batches: no row for a codon and no expression over the codons of a segment."""
    plan = orfs.find_orfs(spark.createDataFrame([(1, "ATGAAATAA")], "seq_id long, seq string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3


@pytest.mark.parametrize("tile", [1 << 16, 40, 13])
def test_cut_sites_of_many_texts_in_one_pass(spark, tile):
    r = random.Random(10)
    seqs = [(k, "".join(r.choice("ACGTN" if k == 4 else "ACGT") for _ in range(n))) for k, n in enumerate([0, 3, 4, 2500, 300, 12])] + [(None, "GAATTC"), (3, "TTAGCTAA"), (8, "GAAT"), (9, "TC")]
    rows = spark.createDataFrame(seqs, "k long, seq string").coalesce(1)
    got = sorted((-1 if x[0] is None else x[0], *x[1:]) for x in (tuple(x) for x in restriction.find_cut_sites(rows, "k", tile=tile).collect()))
    want = []
    for k, seq in seqs:
        for name, word, top, bottom, kind, palindromic in ENZYMES:
            back = word.translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))[::-1]
            for i in range(len(seq) - len(word) + 1):
                w = seq[i : i + len(word)]
                fits = [all(c in IUPAC_CLASSES[x] for c, x in zip(w, turn)) for turn in (word, back)]
                cuts = (top, bottom) if fits[0] else (len(word) - bottom, len(word) - top)
                if fits[0] or (fits[1] and not palindromic):
                    want.append((-1 if k is None else k, name, i + 1, i + len(word), i + cuts[0], i + cuts[1], w, kind))
    assert got == sorted(want) and len(want) > 50
    assert sum(restriction.fragment_sizes(restriction.find_cut_sites(rows.where("k = 4"), "k", tile=tile), rows.select("k", F.length("seq").alias("length")), "k").where("enzyme = 'AluI'").toPandas()["size"]) in (0, 300)


def test_scores_of_windows_are_made_for_many_tiles_at_once(spark):
    """The windows of a batch of tiles are those of the expressions, without a row made and scored for each by the plan."""
    r = random.Random(14)
    seqs = [(k, "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))) for k, n in enumerate([0, 6, 7, 8, 120, 333])] + [(4, "KLMNPQRST" * 4), (None, "ACDEFGHIK"), (9, "A" * 60)]
    rows = spark.createDataFrame(seqs, "protein_id long, seq string")
    for tile, width in ((1 << 16, 7), (40, 20)):
        got = epitopes.composite_scores(rows, width=width, tile=tile)
        assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
        want = epitopes._windows(epitopes.scored_tiles(rows, "protein_id", width, tile), "protein_id", width, tile)
        assert got.dtypes == want.dtypes
        plain = lambda df: sorted([round(x, 8) if isinstance(x, float) else x for x in row] for row in df.collect())
        assert plain(got) == plain(want) and got.count() > 400


def test_frames_of_sequences_with_one_key_are_counted_together(spark):
    seq = "ATGAAATAAATGCCCTAG"
    rows = spark.createDataFrame([(1, seq), (1, seq), (2, seq)], "seq_id long, seq string")
    got = sorted((x.seq_id, x.start, x.end) for x in orfs.find_orfs(rows, min_len=9).where("strand = '+'").collect())
    assert got == [(1, 1, 9), (1, 10, 18), (1, 19, 27), (1, 28, 36), (2, 1, 9), (2, 10, 18)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mutations_in_context_are_found_without_a_row_for_each_window(spark):
    rules = [("x", "g1", 5, "S", "AC", "GG", "T", 90), ("y", "g2", 2, "T", "G", "G", "TGG", 70)]
    r = random.Random(6)
    seqs = [(k, dna(r, n)) for k, n in enumerate([0, 3, 4, 60, 500])] + [(4, "GGATGGCT"), (None, "GGGTGGATGGTGG"), (7, None), (8, "GGé" + "GGATGG"), (9, "GGA"), (10, "T")]
    out = resistance.context_mutation_hits(spark.createDataFrame(seqs, "k long, seq string"), "k", rules)
    want = []
    for k, seq in seqs:
        for cls, gene, pos, wild, mutants, before, after, conf in rules:
            for m in mutants:
                w = before + m + after
                want += [(k or -1, gene, cls, wild, m, pos, conf, i + len(before) + 1) for i in range(len(seq or "")) if seq.startswith(w, i)]
    assert sorted((x[0] or -1, *x[1:]) for x in out.collect()) == sorted(want) and len(want) > 5
    assert "Generate" not in plan(out)


def test_pairs_of_many_small_clusters_are_those_of_the_joined_planes(spark):
    r = random.Random(8)
    seqs = ["".join(r.choice("ACGTMKX-N") for _ in range(r.choice([0, 1, 60, 63, 64, 65, 300]))) for _ in range(400)]
    rows = [(None if k % 97 == 0 else f"c{k % 40}", None if k % 31 == 0 else k // 80, s) for k, s in enumerate(seqs)] + [("c1", 50 + k // 2, s) for k, s in enumerate(seqs[:300])] + [("c2", 2, None)]
    df = spark.createDataFrame(rows, "cluster string, k long, seq string").repartition(3)
    for encoded, counts, found in ((pairs.encode_planes, pairs.substitution_counts, pairs.pair_distances(df, key="k", min_length=0)), (pairs.encode_letters, pairs.residue_counts, pairs.protein_distances(df, key="k"))):
        joined = pairs.cluster_pairs(df.where("seq is not null and k is not null").select("cluster", "k", encoded(F.col("seq")).alias("planes")), "cluster", "k", ["planes"])
        n = counts(F.col("a_planes"), F.col("b_planes"))
        want = joined.select("cluster", "a", "b", *(c.alias(x) for x, c in n.items()))
        assert sorted(found.select(*want.columns).collect()) == sorted(want.collect()) and want.count() > 40000
        assert "regexp_extract_all" not in plan(found)


def test_sequences_are_the_letters_of_whole_texts(spark, tmp_path):
    texts = ["Ab cé\nZ-x", "", None, "123 é", "bjoux zz", "aaß İi" * 3000, "MKT"]
    df = spark.createDataFrame([(k if k % 4 else None, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    only = [re.sub("[^A-Za-z]", "", t or "").upper() for t in texts]
    dna_of = str.maketrans("BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")
    found = tables.isolates(spark, str(tmp_path))
    assert sorted(x.seq for x in found.collect()) == sorted(s.translate(dna_of) for s in only if s)
    assert sorted(x.seq for x in tables.proteins(spark, str(tmp_path)).collect()) == sorted(x for s in only if (x := re.sub("[BJOUXZ]", "", s)))
    assert "regexp_replace" not in plan(found)


def test_folded_pairs_are_those_of_the_rows(spark, monkeypatch):
    r = random.Random(9)
    text = lambda letters, n: "".join(r.choices(letters, k=n))
    near = dna(r, 700)
    rows = [("whole", k, dna(r, r.choice([9, 10, 63, 64, 65, 254, 255, 256, 510, 900]))) for k in range(150)]
    rows += [("whole", 200 + k, near[:k] + "A" + near[k + 1 :]) for k in range(20)] + [("whole", 300, near), ("whole", 301, near), ("whole", 301, near)]
    rows += [("odd", k // 2, text("ACGTNR-é", r.choice([10, 12, 64, 300]))) for k in range(80)] + [("odd", 90, "N" * 40), ("odd", None, near), ("odd", 91, None)]
    rows += [("long", k, dna(r, 33000 + k)) for k in range(3)] + [("lone", 1, near), ("twice", 1, near), ("twice", 1, near), (None, 1, near), (None, 2, near)]
    rows += [("edge", k, "ACGT" * n + "A" * n * 2) for k, n in enumerate(range(3, 40))] + [("edge", 50 + n, "G" * n + "ACTT" * n) for n in range(3, 40)]
    df = spark.createDataFrame(rows, "cluster string, isolate_id long, seq string").repartition(3)
    every = pairs.pair_distances(df).groupBy("cluster").agg(F.count("*").alias("pairs"), F.count_if(F.col("d") == 0).alias("equal"), F.min("d").alias("closest"), F.max("d").alias("farthest"), F.avg("d").alias("mean"))
    want = {x.cluster: x[1:] for x in every.collect()}
    assert set(want) == {"whole", "odd", "long", "edge"} and want["whole"][1] >= 5
    for letters, least, rows_of_block in ((1 << 27, 4, 2048), (4000, 40, 2048), (1 << 27, 15, 16)):
        monkeypatch.setattr(pairs, "_BLOCK_LETTERS", letters)
        monkeypatch.setattr(pairs, "_FOLDED_ROWS", rows_of_block)
        folded = pairs.pair_distances(df, in_cells=True, folded=True)
        found = folded.groupBy("cluster").agg(F.sum("pairs"), F.sum("equal"), F.min("closest"), F.max("farthest"), F.sum("total") / F.sum("pairs"), F.count("*").alias("n")).collect()
        assert {x.cluster: x[1:5] for x in found} == {c: x[:4] for c, x in want.items()}
        assert all(abs(x[5] - want[x.cluster][4]) < 1e-9 for x in found)
        # A row for each pair of blocks, none for a pair of sequences.
        assert least <= sum(x.n for x in found) < 1000


def test_distances_inside_a_source_make_no_row_for_a_pair(spark, tmp_path):
    from __spark_entry__ import queries

    r = random.Random(10)
    docs = [(k, dna(r, 30 + k % 50), "en", f"s{k % 2}") for k in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries()["source_distances"](spark, str(tmp_path))
    assert sorted((x.cluster, x.pairs) for x in out.collect()) == [("s0", 200 * 199 // 2), ("s1", 200 * 199 // 2)]
    grouped = [line for line in plan(out).splitlines() if "FlatMapGroupsInArrow" in line]
    assert len(grouped) == 1 and "total" in grouped[0]
