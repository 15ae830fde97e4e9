"""Hand-worked cases."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from biotally.functions import chem
from biotally.functions import sequence as s
from biotally.operators import clock, codons, exposure, pairs, plates, resistance, restriction, variants
from biotally.plans import plasmids
from biotally.sources import records


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_plate_report(spark):
    neg, pos = [0.10, 0.12, 0.11, 0.09, 0.13], [0.9, 0.95, 1.0]
    rows = [(1, "neg", v) for v in neg] + [(1, "pos", v) for v in pos]
    r = plates.plate_report(spark.createDataFrame(rows, "plate long, control string, od double")).first()
    assert r.mean_neg == pytest.approx(0.11) and r.sd_neg == pytest.approx(0.0158, abs=1e-4)
    assert r.cutoff_2sd == pytest.approx(0.1416, abs=1e-4) and r.cutoff_3sd == pytest.approx(0.1574, abs=1e-4)
    assert r.auc == pytest.approx(1.0) and r.sensitivity == 100 and r.specificity == 100


def test_roc_auc_equals_rank_statistic(spark):
    import random

    random.seed(3)
    rows = [(p, random.choice(["pos", "neg"]), random.randint(0, 30) / 10) for p in (1, 2) for _ in range(400)]
    got = {r.plate: r.auc for r in plates.roc_auc(plates.roc_points(spark.createDataFrame(rows, "plate long, control string, od double"))).collect()}
    for p in (1, 2):
        pos = [v for q, c, v in rows if q == p and c == "pos"]
        neg = [v for q, c, v in rows if q == p and c == "neg"]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        assert got[p] == pytest.approx(want)


def test_readings_keep_numbers(spark):
    assert one(spark, plates.read_readings(F.lit("0.4,0.5\n x 7 -1.5 1e")).alias("v")).v == [0.4, 0.5, 7.0, -1.5]


def test_kimura_distance(spark):
    df = spark.createDataFrame([("c", 1, "ACGTACGTAC"), ("c", 2, "ATGTACGTAC")], "cluster string, isolate_id long, seq string")
    r = pairs.pair_distances(df).first()
    assert (r.valid, r.transitions, r.transversions) == (10, 1, 0) and r.d == pytest.approx(-0.5 * math.log(0.8))


def test_long_pair_counts(spark):
    import random

    random.seed(5)
    a, b = ("".join(random.choice("ACGTN") for _ in range(n)) for n in (1000, 731))
    r = pairs.pair_distances(spark.createDataFrame([("c", 1, a), ("c", 2, b)], "cluster string, isolate_id long, seq string")).first()
    ok = [(x, y) for x, y in zip(a, b) if "N" not in (x, y)]
    ts = sum({x, y} in ({"A", "G"}, {"C", "T"}) for x, y in ok)
    assert (r.valid, r.transitions, r.transversions) == (len(ok), ts, sum(x != y for x, y in ok) - ts)


def test_hot_cluster_pairs_once(spark):
    rows = [("hot", i, i * 10) for i in range(50)] + [("small", 100, 1), ("small", 101, 2)]
    df = spark.createDataFrame(rows, "cluster string, id long, v long")
    got = [(r.cluster, r.a, r.b, r.a_v, r.b_v) for r in pairs.cluster_pairs(df, "cluster", "id", ["v"], block_rows=7).collect()]
    want = [("hot", i, j, i * 10, j * 10) for i in range(50) for j in range(i + 1, 50)] + [("small", 100, 101, 1, 2)]
    assert sorted(got) == sorted(want)


def test_divergence(spark):
    t = clock.divergence_time(F.lit(0.01), F.lit(1e-3), F.lit(0.0))
    r = one(spark, t["years"].alias("y"), clock.human_duration(F.lit(0.5)).alias("d"))
    assert r.y == pytest.approx(5.0) and r.d == "182.5 days"


def test_lipinski_and_scores(spark):
    df = spark.createDataFrame([(650.0, 1.0, 1, 1, 1)], "mw double, logp double, hbd int, hba int, rotatable_bonds int")
    assert df.select(chem.lipinski_violations().alias("v")).first().v == 1
    r = one(spark, *[chem.electrostatic_score(F.lit(q), F.lit(p)).alias(n) for n, q, p in (("a", 1, -1), ("b", 0, 1), ("c", 1, 1))])
    assert (r.a, r.b, r.c) == (100, 70, 40)


def test_steady_state_and_curve(spark):
    p = spark.createDataFrame([(1.0, 2.5, 1.5, 0.12, "oral", 0.5)], "bioavailability double, volume double, ka double, ke double, route string, mic double")
    c = exposure.steady_state(F.lit(5.0), F.lit(24.0))
    r = p.select(*[v.alias(k) for k, v in c.items()]).first()
    assert r.half_life == pytest.approx(5.776, abs=1e-3) and r.clearance == pytest.approx(0.3) and r.css_max > r.css_avg > r.css_min
    pts = exposure.emax_curve(p.select(F.lit(1).alias("id"), F.lit(2.0).alias("top"), "mic"), "id", "top").orderBy("point").collect()
    assert len(pts) == 51 and pts[0].effect == 0 and all(a.effect < b.effect for a, b in zip(pts, pts[1:]))


def test_dose_plan(spark):
    rows = [(1, "x", "y", 2.5, "IV", 24, 3, 100.0, a, None, None) for a in ("adult", "neonate")]
    df = spark.createDataFrame(rows, "patient_id long, drug string, species string, dose_mg_kg double, route string, interval_hours int, duration_days int, weight double, age_group string, concentration double, price double")
    adult, neonate = exposure.dose_plan(df).collect()
    assert (adult.dose_mg, adult.daily_mg, adult.administrations, adult.course_mg) == (250, 250, 3, 750) and neonate.dose_mg == pytest.approx(175)


def test_digest_single_site(spark):
    df = spark.createDataFrame([(1, "AAGAATTCAA")], "seq_id long, seq string")
    r = plasmids.digest(df, enzymes=[("EcoRI", "GAATTC", 1, 5, "5-overhang", True)]).first()
    site = restriction.find_cut_sites(df, enzymes=[("EcoRI", "GAATTC", 1, 5, "5-overhang", True)]).first()
    assert site.position == 3 and r.sizes == [7, 3] and r.sites == 1


def test_non_palindromic_both_orientations(spark):
    df = spark.createDataFrame([(1, "TTGGTCTCTT"), (2, "TTGAGACCTT")], "seq_id long, seq string")
    got = {r.seq_id: (r.position, r.top_cut) for r in restriction.find_cut_sites(df, enzymes=[("X", "GGTCTC", 1, 5, "5-overhang", False)]).collect()}
    assert got == {1: (3, 3), 2: (3, 3)}


def test_sequence_scalars(spark):
    r = one(spark, s.reverse_complement(F.lit("ACCGT")).alias("rc"), s.translate_codons(F.lit("ATGNNNTAA")).alias("p"), s.sanitize(F.lit("acgß tU"), "dna").alias("d"), s.hamming(F.lit("ACGT"), F.lit("AGGA")).alias("h"))
    assert (r.rc, r.p, r.d, r.h) == ("ACGGT", "MX*", "ACGT", 2)


def test_parse_variants(spark):
    v = one(spark, variants.parse_variants(F.lit("S83L,103 Y;5H>Y,bad")).alias("v")).v
    assert [(x.pos, x.mutant) for x in v] == [(83, "L"), (103, "Y"), (5, "Y")]


def test_context_mutations_overlap(spark):
    df = spark.createDataFrame([(1, "AAVMLDGVMLDGIYNAL")], "k long, seq string")
    got = sorted((r.gene, r.mutant, r.position) for r in resistance.context_mutation_hits(df, "k").collect())
    assert got == [("gyrA", "L", 5), ("gyrA", "L", 10), ("gyrA", "N", 15)]


def test_cai_of_preferred_codons_is_one(spark):
    df = spark.createDataFrame([(1, "s", "GCTGCTGCTGCC"), (2, "s", "GCTGCT")], "k long, species string, seq string")
    r = {x.k: x for x in codons.codon_adapt(df, "k").collect()}
    assert r[2].cai == pytest.approx(1.0) and r[1].cai == pytest.approx(math.exp(math.log(0.2) / 4))


def test_json_extraction(spark):
    texts = ['x {"a": {"b": 1}} {"c": 2}', 'pre ```json\n{"k": 1}\n``` post', "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(records.first_json_object(F.col("t")).alias("j"))
    assert [r.j for r in df.collect()] == ['{"a": {"b": 1}}', '{"k": 1}', None]


def test_superposition_over_many_spans(spark):
    import random

    random.seed(9)
    ds = [(1, random.uniform(0, 9000), random.uniform(1, 5)) for _ in range(300)]
    ss = [(1, random.uniform(0, 9000), i) for i in range(200)]
    out = exposure.decayed_sums(spark.createDataFrame(ds, "subject long, t double, dose double"), spark.createDataFrame(ss, "subject long, t double, sample_id long"), 0.4)
    got = {r.sample_id: r.amount for r in out.collect()}
    for _, t, i in ss:
        assert got[i] == pytest.approx(sum(d * math.exp(-0.4 * (t - u)) for _, u, d in ds if u <= t), rel=1e-9, abs=1e-12)


def test_cells_give_the_pairs_of_the_join(spark):
    import random

    r = random.Random(4)
    rows = [(c, k, "".join(r.choice("ACGTACGTN") for _ in range(r.choice((10, 59, 60, 61, 200, 1500))))) for c, n in (("large", 700), ("small", 3), ("lone", 1)) for k in range(n)]
    df = spark.createDataFrame([*rows, ("small", 2, "ACGTACGTACGT")], "cluster string, isolate_id long, seq string").withColumn("tag", F.upper("cluster"))
    got, want = ({tuple(x): n for x, n in Counter(pairs.pair_distances(df, carry=("tag",), each=("seq",), in_cells=cells).collect()).items()} for cells in (True, False))
    assert got == want and sum(n for x, n in got.items()) == 700 * 699 // 2 + 5


def test_rows_are_sent_a_bounded_number_of_times(spark):
    sent = lambda n: pairs._blocked(spark.range(n).selectExpr("0 as c", "id"), "c", "id", 4).agg(F.max("blocks")).first()[0]
    assert sent(400) == sent(4000) == 8  # a block for every four rows before
