"""Operators on embeddings against plain versions, and on odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from biotally.llm import centroids, vector_dedup, whitening
from biotally.llm.small_world import build

SCHEMA = "vec_id long, embedding array<double>, label int, key long, row int, x string, n long, cluster string"
EXTRA = (7, 8, "x", 9, "c")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, *EXTRA) for i, v, label in rows], SCHEMA).repartition(parts)


def families(seed=3, d=16):
    """Lone vectors, a large tight family, chains of neighbours near the threshold, and copies."""
    r = np.random.default_rng(seed)
    out = list(r.normal(size=(150, d)))
    heart = r.normal(size=d)
    out += [heart + 0.12 * r.normal(size=d) for _ in range(120)]
    for _ in range(6):
        v = r.normal(size=d)
        for _ in range(8):
            v = v / np.linalg.norm(v) + 0.085 * r.normal(size=d)
            out.append(v)
    out += [2.0 * out[3], out[5], out[5], out[160]]
    return [(int(k), v, int(k % 3 == 0)) for k, v in enumerate(out)]


def plain_links(rows, cosine):
    ids, n, least = [i for i, _, _ in rows], len(rows), {}
    ok = [v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() if good else None for (_, v, _), good in zip(rows, ok, strict=True)]
    near = [[b for b in range(n) if b != a and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine] for a in range(n)]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in near[a]:
                if root[b] < root[a]:
                    root[a], changed = root[b], True
    for a in range(n):
        if ids[a] is not None:
            least[root[a]] = min(ids[a], least.get(root[a], ids[a]))
    return sorted(((ids[a], len(near[a]), least.get(root[a]), ids[a] is not None and ids[a] == least.get(root[a])) for a in range(n)), key=str)


def linked(df, **given):
    return sorted((tuple(r) for r in vector_dedup.vector_components(df, **given).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("shard", [16384, 40])
def test_near_duplicate_vectors_equal_all_pairs(spark, shard):
    rows = families()
    assert linked(table(spark, rows), shard=shard) == plain_links(rows, 0.93)


def test_near_duplicate_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0], 1), (2, [1, 0], 1), (2, [1, 0], 1), (None, [1, 0.01], 1), (None, [0, 1], 1), (5, [1, 0], None), (6, None, 1), (7, [], 1), (8, [0, 0], 1), (9, [nan, 1], 1)]
    rows += [(10, [inf, 1], 1), (11, [None, 1], 1), (12, [1, 0, 0], 1), (13, [1e300, 1e290], 1), (14, [1e-300, 0], 1), (15, [1, -0.0], 1), (16, [-1, 0], 1), (17, [1, 0], 2), (18, [1, 0], None)]
    assert linked(table(spark, rows)) == plain_links(rows, 0.93)
    assert linked(table(spark, [])) == []


def test_graph_finds_what_all_comparisons_find():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, row_of, ball = build(x, r.random(3000), math.cos(math.acos(0.93) / 2))
    assert (np.einsum("ij,ij->i", x, x[row_of[ball]]) >= math.cos(math.acos(0.93) / 2)).all()
    leaders = x[row_of]
    best = np.argsort(-(leaders @ leaders.T), axis=1)[:, :10]
    found = graph.search(leaders.astype(np.float32), 64)[0]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best.tolist(), found.tolist(), strict=True)]) >= 0.9


def test_beams_widen_until_the_audit_passes():
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, row_of, _ = build(x, r.random(400), 1.1)
    least = np.full(len(row_of), 0.6)  # many in reach: a beam of 2 cannot hold them
    true = set(zip(*(v.tolist() for v in vector_dedup._all_within(x[row_of], x[row_of], least)), strict=True))
    q, n, used = vector_dedup.audited(graph, x[row_of], x[row_of], least, math.acos(0.6), 2, 64, 0.999)
    assert len(true & set(zip(q.tolist(), n.tolist(), strict=True))) >= 0.99 * len(true)
    graph.links = [np.full_like(k, -1) for k in graph.links]  # a graph without links fails its audit: all are compared
    q, n, used = vector_dedup.audited(graph, x[row_of], x[row_of], least, math.acos(0.6), 2, 64, 0.999)
    assert used == 0 and set(zip(q.tolist(), n.tolist(), strict=True)) == true


@pytest.mark.parametrize("scale", [1.0, 3e7, 2.0**54])
def test_whitening_equals_a_plain_version(spark, scale):
    r = np.random.default_rng(1)
    rows = [(k, r.normal(size=5) * scale / 8 * [1, 2, 3, 4, 0.5], 0) for k in range(150)]
    got = whitening.whiten(table(spark, rows), components=3).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    v = np.array([[(n * sum(e[i] * e[j] for e in x) - sums[i] * sums[j]) / (n * n) for j in range(5)] for i in range(5)])
    values, vectors = np.linalg.eigh(v)
    for k in range(3):
        mine = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        want = [sum((n * c - s) / n * u for c, s, u in zip(e, sums, vectors[:, 4 - k], strict=True)) / math.sqrt(values[4 - k]) for e in x]
        have = [mine[i]["whitened"] for i in range(n)]
        sign = 1 if np.dot(want, have) > 0 else -1
        assert np.allclose(want, np.array(have) * sign, atol=1e-9)
        assert all(abs(mine[i]["explained"] - values[4 - k] / np.trace(v)) < 1e-9 for i in range(n))
        exact = [sum((n * c - s) ** 2 for c, s in zip(e, sums, strict=True)) for e in x]
        assert [None if mine[i]["deviation"] is None else int(mine[i]["deviation"]) for i in range(n)] == [e if e < 10**38 else None for e in exact]
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-4


def test_plane_counts_are_cross_products():
    r = np.random.default_rng(2)
    y = r.integers(0, 1 << 11, size=(197, 4)).astype(np.uint64)
    found = {(i, j): s for i, j, s in whitening._folded(whitening.plane_counts(y, 11), 4, 11)}
    for i in range(4):
        assert found[i, -1] == int(y[:, i].sum())
        assert all(found[i, j] == int((y[:, i] * y[:, j]).sum()) for j in range(i, 4))


def test_whitening_of_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1, 2], 0), (1, [1, 2], 0), (None, [3, 1], 0), (4, None, 0), (5, [nan, 1], 0), (6, [None, 1], 0), (7, [], 0), (8, [1, 2, 3], None), (9, [1e300, 1], 0), (10, [0, 5], 0)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == sorted([(i, c, 4) for i in (1, 1, 0, 10) for c in (1, 2)] + [(8, c, 1) for c in (1, 2, 3)])
    assert all(r["whitened"] is None and r["explained"] is None for r in got if r["vec_id"] == 8)
    assert all(r["identity_error"] < 1e-9 for r in got)
    flat = whitening.whiten(table(spark, [(k, [k, 5], 0) for k in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    assert whitening.whiten(table(spark, [])).collect() == []


def plain_clusters(rows, clusters, rounds, length):
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v, _ in rows if v is not None and len(v) == length and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    c = [list(x) for _, x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(c))

    for _ in range(rounds):
        where = [nearest(x)[1] for _, x in kept]
        c = [[sum(v) // where.count(k) for v in zip(*(x for (_, x), w in zip(kept, where, strict=True) if w == k), strict=True)] if k in where else y for k, y in enumerate(c)]
    last = [(i, *nearest(x)) for i, x in kept]
    total = sum(f for _, f, _ in last)
    by = {k: sum(f for _, f, w in last if w == k) for k in range(len(c))}
    return sorted(((i, k, f, by[k], total, hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, f, k in last), key=str)


def clustered(df, **given):
    return sorted((tuple(r) for r in centroids.cluster(df, **given).collect()), key=str)


@pytest.mark.parametrize("scale", [0.3, 4.0, 2.0**19])
def test_clusters_equal_a_plain_version(spark, scale):
    r = np.random.default_rng(4)
    hearts = r.normal(size=(5, 6)) * 3
    rows = [(k, (hearts[k % 5] + r.normal(size=6)) * scale, 0) for k in range(300)]
    assert clustered(table(spark, rows), clusters=7, length=6) == plain_clusters(rows, 7, 3, 6)


def test_clusters_of_odd_rows(spark):
    nan = float("nan")
    rows = [(k, [k % 3, k % 2], 0) for k in range(30)] + [(3, [0, 1], 0), (None, [9, 9], 0), (40, None, 0), (41, [nan, 1], 0), (42, [1], 0), (43, [None, 1], 0), (44, [], 0)]
    assert clustered(table(spark, rows), length=2) == plain_clusters(rows, 16, 3, 2)
    assert clustered(table(spark, rows[:3]), length=2) == plain_clusters(rows[:3], 16, 3, 2)
    assert clustered(table(spark, [])) == []
    far = clustered(table(spark, [(1, [1e20, 1], 0), (2, [2.0**46, 0], 0), (3, [-(2.0**46), 0], 0)]), length=2, clusters=1, rounds=0)
    assert [r[0] for r in far] == [2, 3] and sorted(r[2] is None for r in far) == [False, True]


def test_orchard_measures_fewer_distances():
    r = np.random.default_rng(8)
    hearts = r.integers(-4000, 4000, size=(32, 3))
    x = hearts[r.integers(0, 32, 5000)] + r.integers(-60, 60, size=(5000, 3))
    own, far, measured = centroids.orchard(x, hearts)
    every = ((x[:, None] - hearts[None]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
    assert measured < 0.5 * every.size


def test_vector_queries_do_not_depend_on_the_layout(spark):
    rows = families(9)
    one, many = table(spark, rows, 1), table(spark, rows, 7).orderBy(F.rand(3))
    assert linked(one, shard=60) == linked(many, shard=60)
    assert clustered(one, length=16) == clustered(many, length=16)
