"""Nothing is cut off: short and long texts, deep braces, small numbers, lone isolates, long primers, equal rates."""

import json
import math

import pytest
from pyspark.sql import functions as F

from biotally import session
from biotally.operators import exposure, plates, primers
from biotally.plans import outbreaks
from biotally.registry import core
from biotally.sources import records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numbers_of_any_length_and_exponent(spark):
    text = F.lit("12 1e-3 12345678901 0.12345678901 5. .5 -2E+4 x 1d NaN 1_0,7")
    assert one(spark, plates.read_readings(text)) == [12.0, 1e-3, 12345678901.0, 0.12345678901, 5.0, 0.5, -2e4, 7.0]


@pytest.mark.parametrize("text, want", [
    ("x " + '{"a":' * 8 + "1" + "}" * 8 + " y", '{"a":' * 8 + "1" + "}" * 8),
    ('say {"a": "}{\\"}"} and {"b": 1}', '{"a": "}{\\"}"}'),
    ("no object", None),
    ("open { only", None),
    ("", None),
    ('```json\n{"f": {"g": 1}}\n```', '{"f": {"g": 1}}'),
])
def test_first_json_object(spark, text, want):
    got = one(spark, records.first_json_object(F.lit(text)))
    assert got == want and (want is None or json.loads(got))


def test_doubles_keep_nine_digits_at_any_size(spark):
    values = [1e-7, 1e-8, 4.94e-30, 0.1 + 0.2, -123456.7891234, 1.5e15, 0.0, 2.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(core._significant("x").alias("x")).collect()
    assert [r["x"] for r in rows] == [pytest.approx(float(f"{v:.8e}"), rel=1e-14) for v in values]


def test_long_primers_match_on_all_their_letters(spark):
    primer = "ACGTTGCAACGGTCATTGCAGGCTA"
    genome = spark.createDataFrame([(1, "TTTTT" + primer + "CCCCC")], "seq_id long, seq string")
    asked = spark.createDataFrame([(primer,)], "primer string")
    best = primers.mispriming_hits(asked, genome, longest=25).orderBy(F.desc("match_length"), "total_mismatches").first()
    assert (best["match_length"], best["total_mismatches"]) == (25, 0)
    with pytest.raises(Exception, match="primer longer than 22"):
        primers.mispriming_hits(asked, genome).collect()


def test_lone_isolates_stay_in_the_report(spark):
    rows = [(1, "a", "H5N1 swab", "ACGT" * 40), (2, "b", "Brucella milk", "ACGT" * 40), (3, "b", "x", "ACGA" * 40), (4, "c", "x", "AC")]
    isolates = spark.createDataFrame(rows, "isolate_id long, cluster string, label string, seq string")
    report = {r["cluster"]: r for r in outbreaks.outbreak_report(isolates).collect()}
    assert set(report) == {"a", "b", "c"} and [report[c]["pairs"] for c in "abc"] == [0, 1, 0]
    assert report["a"]["closest_a"] is None and report["a"]["divergence"] is None and report["a"]["pathogen"]
    assert 0 < report["b"]["rate"] < 1e-6
    assert {r["cluster"] for r in outbreaks.report_lines(outbreaks.outbreak_report(isolates)).collect()} == {"a", "b", "c"}


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Cluster:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(Cluster())


def test_equal_absorption_and_elimination_rates(spark):
    doses = spark.createDataFrame([("s", 0.0, 100.0), ("s", 6.0, 50.0)], "subject string, t double, dose double")
    samples = spark.createDataFrame([("s", t, k) for k, t in enumerate((0.5, 3.0, 8.0))], "subject string, t double, sample_id long")
    profile = {"route": "oral", "ka": 0.3, "ke": 0.3, "bioavailability": 0.8, "volume": 10.0}
    got = {r["t"]: r["conc"] for r in exposure.dose_superposition(doses, samples, profile).collect()}
    for t, c in got.items():
        want = sum(0.8 * d / 10 * 0.3 * (t - at) * math.exp(-0.3 * (t - at)) for at, d in ((0.0, 100.0), (6.0, 50.0)) if at <= t)
        assert c == pytest.approx(want)
    row = spark.createDataFrame([("oral", 0.3, 0.3, 0.8, 10.0)], "route string, ka double, ke double, bioavailability double, volume double")
    steady = row.select(*[c.alias(n) for n, c in exposure.steady_state(F.lit(100.0), F.lit(12.0)).items()]).first()
    many = lambda t: sum(0.8 * 100 / 10 * 0.3 * (t + 12 * k) * math.exp(-0.3 * (t + 12 * k)) for k in range(200))
    assert steady["css_max"] == pytest.approx(many(1 / 0.3)) and steady["css_min"] == pytest.approx(many(12.0))


@pytest.mark.parametrize("tile", [4, 5, 7, 1 << 16])
def test_tiles_give_every_window_once(spark, tile):
    from biotally.functions.sequence import words_at

    texts = ["", "A", "ACG", "ACGT", "ACGTACGTTGCA" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    got = sorted(tuple(r) for r in words_at(df, ("id",), F.col("seq"), 4, tile=tile).collect())
    assert got == sorted((k, i, t[i : i + 4]) for k, t in enumerate(texts) for i in range(len(t) - 3))
