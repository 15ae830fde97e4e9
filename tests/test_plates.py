"""ROC curves over ranges of values, however the values lie."""

import random

import pytest

from biotally.operators import plates

SCHEMA = "plate long, control string, od double"


@pytest.mark.parametrize("kind", ["far", "close", "equal"])
def test_roc_over_ranges(spark, kind):
    r = random.Random(2)
    value = {"far": lambda: r.lognormvariate(0, 6), "close": lambda: 0.5 + r.randint(0, 400) * 1e-9, "equal": lambda: 1.5}[kind]
    rows = [(p, r.choice(["pos", "neg", "neg"]), value()) for p in (1, 2) for _ in range(600)] + [(1, "pos", 1e12), (3, "pos", 0.1)]
    points = plates.roc_points(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    got = {(x.plate, x.cutoff): (x.tpr, x.fpr) for x in points}
    for p in (1, 2, 3):
        mine = [(c, v) for q, c, v in rows if q == p]
        pos, neg = (sum(c == k for c, _ in mine) for k in ("pos", "neg"))
        for v in {v for _, v in mine}:
            above = [c for c, x in mine if x >= v]
            assert got[p, v] == (above.count("pos") / pos if pos else None, above.count("neg") / neg if neg else None)
    assert len(got) == len({(p, v) for p, _, v in rows})


def test_close_values_are_spread_over_ranges(spark):
    rows = [(1, "pos" if k % 3 else "neg", 0.5 + k * 1e-9) for k in range(20000)] + [(1, "pos", 1e9)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [x["count"] for x in plates.roc_points(df).groupBy("slice").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2.5 * sum(sizes) / len(sizes)
