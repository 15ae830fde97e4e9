"""Scores and runs of sequences over several tiles against a plain version."""

import random

import pytest

from biotally.operators import epitopes
from biotally.reference_tables import COMPOSITE_WEIGHTS, SCALES


def plain(seq):
    """(composite of every window, runs at 0.5 or more)."""
    values = {n: [sum(round(s.get(c, 0) * 1000) for c in seq[p : p + 7]) / 7000.0 for p in range(len(seq) - 6)] for n, s in SCALES.items()}
    norm = {n: [(x - min(v)) / ((max(v) - min(v)) or 1.0) for x in v] for n, v in values.items()}
    composite = [round(sum(w * norm[n][p] for n, w in COMPOSITE_WEIGHTS.items()), 9) for p in range(len(seq) - 6)]
    runs, p = [], 0
    while p < len(composite):
        q = p
        while q < len(composite) and composite[q] >= 0.5:
            q += 1
        if q > p:
            runs.append((p + 1, q + 6, sum(composite[p:q]) / (q - p)))
        p = max(q, p + 1)
    return composite, runs


@pytest.mark.parametrize("tile", [1 << 16, 40, 7])
def test_runs_go_on_over_tile_borders(spark, tile):
    r = random.Random(9)
    seqs = {k: "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for k, n in enumerate([6, 7, 8, 46, 120, 333])}
    seqs[50] = "K" * 90 + "I" * 45 + "K" * 81  # runs over whole tiles
    seqs[51] = "A" * 60  # no range at all
    rows = spark.createDataFrame(list(seqs.items()), "protein_id long, seq string").repartition(3)
    scored = epitopes.composite_scores(rows, tile=tile)
    got = {}
    for x in scored.collect():
        got.setdefault(x.protein_id, {})[x.pos] = x.composite
    runs = {}
    for x in epitopes.runs_above(scored, tile=tile).collect():
        runs.setdefault(x.protein_id, []).append((x.start, x.end, x.mean_composite))
    for k, seq in seqs.items():
        composite, want = plain(seq)
        assert [got.get(k, {}).get(p + 1) for p in range(len(composite))] == pytest.approx(composite, abs=2e-9)
        mine = sorted(runs.get(k, []))
        assert [x[:2] for x in mine] == [x[:2] for x in want] and [x[2] for x in mine] == pytest.approx([x[2] for x in want], abs=1e-8)


def test_tiles_of_one_sequence_are_dealt(spark):
    seq = "".join(random.Random(1).choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(5000))
    scored = epitopes.composite_scores(spark.createDataFrame([(1, seq)], "protein_id long, seq string"), tile=100)
    sizes = scored.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 4994 and sum(x > 0 for x in sizes) > 2


@pytest.mark.parametrize("tile", [1 << 16, 40, 7])
def test_tiles_find_the_runs_of_the_windows_without_a_row_for_each(spark, tile):
    r = random.Random(19)
    seqs = [(k, "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))) for k, n in enumerate([6, 7, 46, 333, 900])] + [(50, "K" * 90 + "I" * 45 + "K" * 81), (51, "A" * 60)]
    seqs += [(60, seqs[3][1]), (60, seqs[3][1]), (61, seqs[3][1]), (61, seqs[4][1])]  # keys that come twice
    rows = spark.createDataFrame(seqs, "protein_id long, seq string")
    flat = lambda df: sorted((x.protein_id, x.start, x.end, x.w, *(round(v, 9) for v in x[4:])) for x in df.collect())
    out = epitopes.runs_above(epitopes.scored_tiles(rows, width=20, tile=tile), tile=tile, width=20)
    windows = epitopes.runs_above(epitopes.composite_scores(rows, width=20, tile=tile), tile=tile)
    assert out.schema.simpleString() == windows.schema.simpleString()
    for got, want in zip(flat(out), flat(windows), strict=True):
        assert got[:4] == want[:4] and got[4:] == pytest.approx(want[4:], abs=1e-8)


@pytest.mark.parametrize("tile", [1 << 16, 50])
def test_best_peptides_are_chosen_before_they_become_rows(spark, tile):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    r = random.Random(29)
    seqs = [(k, "".join(r.choice("ALVIMSKX" if k % 2 else "ACDEFGHIKLMNPQRSTVWY") for _ in range(n))) for k, n in enumerate([8, 9, 60, 333, 2000])] + [(9, "L" * 300)]
    rows = spark.createDataFrame(seqs, "protein_id long, seq string")
    out = epitopes.predict_t_epitopes(rows, top=7, tile=tile)
    rank = F.row_number().over(Window.partitionBy("protein_id").orderBy("ic50", "start"))
    want = epitopes.binding_peptides(rows).withColumn("rank", rank).filter("rank <= 7")
    assert out.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
