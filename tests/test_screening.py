"""Similarity search against all pairs; screening rules as bits; nothing runs while a query is built."""

import random

import pytest
from pyspark.sql import functions as F

from biotally.operators import screening
from biotally.reference_tables import MECHANISM_RULES


def molecules(r, n, most, start=0):
    return {start + k: set(r.sample(range(1, 65), r.randint(0, most))) for k in range(n)}


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.55, 0.8, 1.0])
def test_similar_references_equal_all_pairs(spark, threshold):
    r = random.Random(4)
    a, b = molecules(r, 60, 12), molecules(r, 40, 12, 1000)
    for k in range(12):  # near copies, and equal ones
        a[200 + k] = set(b[1000 + k]) | ({r.randint(1, 64)} if k % 2 else set())
    rows = lambda m: spark.createDataFrame([(k, x) for k, v in m.items() for x in v], "mol_id long, bit int")
    want = {(x, y): len(v & w) / len(v | w) for x, v in a.items() for y, w in b.items() if v | w and len(v & w) / len(v | w) >= threshold}
    got = [tuple(x) for x in screening.similar_references(rows(a), rows(b), threshold).collect()]
    assert len(got) == len(want) and {(x, y): s for x, y, s in got} == want
    best = {}
    for (x, y), s in want.items():
        best.setdefault(x, []).append((-s, y))
    top = {(x.mol_id, x.ref_id, x.rank) for x in screening.similar_references(rows(a), rows(b), threshold, 2).collect()}
    assert top == {(x, y, k + 1) for x, found in best.items() for k, (_, y) in enumerate(sorted(found)[:2])}


def test_blocks_of_references_give_every_pair(spark):
    packed = spark.createDataFrame([(k, k * 7919, 3) for k in range(50)], "mol_id long, fp long, n_bits int")
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    out = screening.tanimoto_to_references(packed, packed.select("mol_id", "fp"), block=7)
    assert len(jobs.getJobIdsForGroup(None)) == before
    got = [(x.mol_id, x.ref_id) for x in out.collect()]
    assert len(got) == 2500 and len(set(got)) == 2500
    assert screening.tanimoto_to_references(packed, packed.select("mol_id", "fp").limit(0)).collect() == []


def test_rules_as_bits_give_the_points_of_the_patterns(spark):
    words = ["DNA gyrase inhibitor", "30S рибосом", "PBP transpeptidase", "rdrp polymerase", "3CL protease", "нейраминидаз", "", None]
    targets = [("ecoli-gyra", "катализирует суперскручивание днк"), ("x-16s", "трансляция"), ("hpai-na", "сиаловую кислоту"), ("fmdv-3c", "расщепляет вирусный полипротеин"), ("q", "синтез клеточной стенки")]
    rows = spark.createDataFrame([(m, *t) for m in words for t in targets], "mechanism string, target_id string, function string")
    import re

    for x in rows.withColumn("points", screening.mechanism_boost(F.col("mechanism"), F.col("target_id"), F.col("function"))).collect():
        want = sum(p for m, t, f, p in MECHANISM_RULES if re.search(m, (x.mechanism or "").lower()) and (re.search(f, x.function.lower()) or (t and re.search(t, x.target_id))))
        assert x.points == want


def test_no_pattern_is_matched_per_pair(spark):
    from biotally.sources import tables

    plan = screening.virtual_screening(tables.compounds(spark, "/root/testdata/sf0.001"), screening.flatten_panel(screening.pathogen_table(spark)))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate inline")]
    assert "RLIKE" not in above and "contains" not in above.lower()


def test_ligand_alerts(spark):
    rows = spark.createDataFrame([(6.0, 3, 10, 11, 5), (1.0, 1, 1, 2, 1), (None, None, None, None, None)], "logp double, hbd int, hba int, rotatable_bonds int, aromatic_rings int")
    assert [len(x.a) for x in rows.select(screening.ligand_alerts().alias("a")).collect()] == [3, 0, 0]


def test_the_tanimoto_join_gives_every_pair(spark, tmp_path):
    from biotally.registry import load

    rows = [(k, k % 3, [1.0 if k >> i & 1 else -1.0 for i in range(6)]) for k in range(1, 40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(x.mol_id, x.ref_id): (x.n_bits, x.tanimoto) for x in load()[0]["tanimoto_join"](spark, str(tmp_path)).collect()}
    assert set(got) == {(m, r) for m in range(1, 40) for r in (1, 2, 3)}
    assert all(n == m.bit_count() and abs(t - (m & r).bit_count() / (m | r).bit_count()) < 1e-8 for (m, r), (n, t) in got.items())
