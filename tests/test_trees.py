"""Trees and protein distances against plain versions; clusters beyond the matrix limit; the report's tree columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from biotally.operators import pairs, tree
from biotally.plans import outbreaks

SCHEMA = "cluster string, a long, b long, d double"


def plain_tree(d, n, method):
    """Newick text, one merge at a time; ``d`` maps (a, b), a < b."""
    d, open_, text, size, high = dict(d), list(range(n)), {k: str(k) for k in range(n)}, dict.fromkeys(range(n), 1), dict.fromkeys(range(n), 0.0)
    at = lambda a, b: d[min(a, b), max(a, b)]
    while len(open_) > 1:
        pairs_ = [(a, b) for i, a in enumerate(open_) for b in open_[i + 1 :]]
        if method == "upgma":
            a, b = min(pairs_, key=lambda p: (at(*p), p))
            h = at(a, b) / 2
            la, lb, high[a] = h - high[a], h - high[b], h
        else:
            m = len(open_)
            r = {k: sum(at(k, j) for j in open_ if j != k) / max(1, m - 2) for k in open_}
            a, b = min(pairs_, key=lambda p: (round(at(*p) - r[p[0]] - r[p[1]] + tree.TIE_SHIFT, 9), p))
            la = at(a, b) / 2 + ((r[a] - r[b]) / 2 if m > 2 else 0)
            lb = at(a, b) - la
        text[a] = f"({text[a]}:{max(0, la):.3f},{text[b]}:{max(0, lb):.3f})"
        open_.remove(b)
        for k in open_:
            if k != a:
                d[min(a, k), max(a, k)] = round((size[a] * at(a, k) + size[b] * at(b, k)) / (size[a] + size[b]), 12) if method == "upgma" else (at(a, k) + at(b, k) - at(a, b)) / 2
        size[a] += size[b]
    return text[0] + ":0.000;"


def points(seed, n):
    r = np.random.default_rng(seed)
    p = r.normal(size=(n, 4)).cumsum(axis=0)
    return {(i, j): round(float(np.linalg.norm(p[i] - p[j])), 9) for i in range(n) for j in range(i + 1, n)}


@pytest.mark.parametrize("method", ["upgma", "neighbor-joining"])
@pytest.mark.parametrize("whole", [1024, 9])
def test_trees_are_those_of_one_merge_at_a_time(spark, method, whole):
    clusters = {f"c{n}": points(n, n) for n in (2, 3, 4, 7, 14)}
    rows = [(c, a, b, v) for c, d in clusters.items() for (a, b), v in d.items()]
    trees, depths = tree.cluster_tree(spark.createDataFrame(rows, SCHEMA).repartition(3), method=method, whole=whole)
    got = {r.cluster: r for r in trees.collect()}
    for c, d in clusters.items():
        n = int(c[1:])
        assert got[c].newick == plain_tree(d, n, method) and got[c].leaves == n
    deep = {r.cluster: r.m for r in depths.groupBy("cluster").agg(F.max("depth").alias("m")).collect()}
    assert all(got[c].max_depth == deep[c] for c in clusters)


def test_equal_distances_and_copies(spark):
    flat = [("flat", a, b, 1.0) for a in range(6) for b in range(a + 1, 6)]
    zero = [("zero", a, b, 0.0) for a in range(5) for b in range(a + 1, 5)]
    for method in ("upgma", "neighbor-joining"):
        got = {r.cluster: r.newick for r in tree.cluster_tree(spark.createDataFrame(flat + zero, SCHEMA), method=method)[0].collect()}
        assert got["zero"] == plain_tree({(a, b): v for _, a, b, v in zero}, 5, method)
        assert got["flat"] == plain_tree({(a, b): v for _, a, b, v in flat}, 6, method)
    none = tree.cluster_tree(spark.createDataFrame([], SCHEMA))
    assert none[0].collect() == [] and none[1].collect() == []


def test_a_thousand_leaves_take_few_rounds(spark):
    p = np.random.default_rng(1).normal(size=(1000, 8))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    rows = spark.createDataFrame([("big", [float(v) for v in d[i, i + 1 :]], i) for i in range(999)], "cluster string, v array<double>, a long")
    long = rows.select("cluster", "a", F.posexplode("v").alias("k", "d")).select("cluster", "a", (F.col("a") + 1 + F.col("k")).alias("b"), "d")
    merges, rounds = tree.tree_merges(long, method="neighbor-joining")
    assert rounds < 30 and merges.count() == 999


def plain_protein(a, b):
    sites = [(x, y) for x, y in zip(a.upper(), b.upper(), strict=False) if x not in "-X" and y not in "-X"]
    off = sum(x != y for x, y in sites)
    return len(sites), off, round(off / len(sites), 9) if sites else 1.0


def test_protein_distances(spark):
    r = random.Random(2)
    letters = "ACDEFGHIKLMNPQRSTVWYBZUOJX-"
    seqs = ["".join(r.choice(letters) for _ in range(r.choice([1, 59, 60, 61, 150, 400]))) for _ in range(24)] + ["MKTAYIAK", "MKTAFIAK", "mktafiak", "X", "-", ""]
    rows = spark.createDataFrame([("c", k, s) for k, s in enumerate(seqs)], "cluster string, protein_id long, seq string")
    got = {(x.a, x.b): x for x in pairs.protein_distances(rows).collect()}
    assert len(got) == len(seqs) * (len(seqs) - 1) // 2
    for (a, b), x in got.items():
        assert (x.valid, x.mismatches, x.d) == plain_protein(seqs[a], seqs[b]) and x.matches == x.valid - x.mismatches


def test_report_draws_a_tree_of_all_isolates(spark):
    r = random.Random(3)
    base = "".join(r.choice("ACGT") for _ in range(300))
    near = [base[:k] + "A" + base[k + 1 :] for k in (10, 90, 200)]
    rows = [("c", k, s, "fmd swab") for k, s in enumerate([base, *near, "ACGTA"])] + [("lone", 9, base, "x"), ("short", 11, "ACGT", "x"), ("short", 12, "AGGT", "x")]
    report = {x.cluster: x for x in outbreaks.outbreak_report(spark.createDataFrame(rows, "cluster string, isolate_id long, seq string, label string")).collect()}
    assert report["c"].tree_leaves == 5 and report["c"].pairs == 6 and report["c"].newick.count(",") == 4
    assert (report["lone"].tree_leaves, report["lone"].tree_depth, report["lone"].newick, report["lone"].closest_d) == (1, 0.0, "9:0.000;", None)
    assert report["short"].tree_leaves == 2 and report["short"].pairs == 0 and report["short"].divergence is None
    lines = outbreaks.report_lines(outbreaks.outbreak_report(spark.createDataFrame(rows, "cluster string, isolate_id long, seq string, label string"))).collect()
    assert {x.line for x in lines if x.cluster == "c"} >= {"tree: 5 leaves"}
