"""Operators against plain brute force on small random inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from biotally.operators import align, near_words, orfs, search, tree
from biotally.reference_tables import STARTS, STOPS, blosum62


def code(w):
    return sum("ACGT".index(c) * 4 ** (len(w) - 1 - i) for i, c in enumerate(w))


def words(n, k, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("ACGT") for _ in range(k)) for _ in range(n)]


def test_ball_counts(spark):
    targets, queries = words(400, 12, 1), words(60, 12, 2) + words(5, 12, 1)
    tdf = spark.createDataFrame([(code(w), 1 + i % 3) for i, w in enumerate(targets)], "code long, n long")
    got = {r.code: (r.mm0, r.mm1, r.mm2, r.mm3) for r in near_words.ball_counts(spark.createDataFrame([(code(q),) for q in queries], "code long"), tdf).collect()}
    for q in queries:
        mm = [(sum(a != b for a, b in zip(q, w)), 1 + i % 3) for i, w in enumerate(targets)]
        assert got[code(q)] == tuple(sum(n for d, n in mm if d == m) for m in range(4))


@pytest.mark.parametrize("k", [12, 15])
def test_near_pairs(spark, k):
    rnd = random.Random(k)
    base = words(80, k, 3)
    near = ["".join(rnd.choice("ACGT") if rnd.random() < 0.25 else c for c in w) for w in base]
    df = lambda ws: spark.createDataFrame([(code(w),) for w in ws], "code long")
    got = sorted((r["query"], r.target, r.mismatches) for r in near_words.near_pairs(df(base), df(near), k, 3).collect())
    want = {(code(a), code(b), d) for a in base for b in near if (d := sum(x != y for x, y in zip(a, b))) <= 3}
    assert got == sorted(want)


def leaf_paths(newick):
    """Leaf-to-leaf path lengths of a Newick text."""
    pos, leaves, serial = 0, {}, itertools.count()

    def node(depth_path):
        nonlocal pos
        if newick[pos] == "(":
            kids = []
            pos += 1
            while True:
                kids.append(node(depth_path))
                if newick[pos] == ",":
                    pos += 1
                    continue
                pos += 1
                break
            out = [leaf for k in kids for leaf in k]
        else:
            end = pos
            while newick[end] not in ":,)":
                end += 1
            out = [(newick[pos:end], [])]
            pos = end
        if pos < len(newick) and newick[pos] == ":":
            end = pos + 1
            while newick[end] not in ",);":
                end += 1
            edge = (float(newick[pos + 1 : end]), next(serial))
            for _, path in out:
                path.append(edge)
            pos = end
        return out

    for name, path in node(()):
        leaves[name] = path
    keep = {}
    for a, b in itertools.combinations(sorted(leaves), 2):
        common = {i for _, i in leaves[a]} & {i for _, i in leaves[b]}
        keep[a, b] = sum(x for x, i in leaves[a] if i not in common) + sum(x for x, i in leaves[b] if i not in common)
    return keep


def upgma(d, n):
    groups = {i: [i] for i in range(n)}
    out = {}
    while len(groups) > 1:
        def dist(x, y):
            return sum(d[min(i, j), max(i, j)] for i in groups[x] for j in groups[y]) / len(groups[x]) / len(groups[y])

        a, b = min(itertools.combinations(groups, 2), key=lambda p: dist(*p))
        h = dist(a, b)
        for i in groups[a]:
            for j in groups[b]:
                out[tuple(sorted((str(i), str(j))))] = h
        groups[a] = groups[a] + groups.pop(b)
    return out


def test_upgma_and_neighbour_joining(spark):
    rnd = random.Random(4)
    n = 7
    d = {p: rnd.uniform(0.1, 2.0) for p in itertools.combinations(range(n), 2)}
    # an additive tree: neighbour joining must give its path lengths back
    edges, parent = {}, {}
    for v in range(1, 2 * n - 1):
        parent[v] = (v - 1) // 2
        edges[v] = rnd.uniform(0.2, 1.0)
    leaves = [v for v in range(2 * n - 1) if 2 * v + 1 > 2 * n - 2]

    def up(v):
        out = []
        while v in parent:
            out.append(v)
            v = parent[v]
        return out

    add = {}
    for a, b in itertools.combinations(range(n), 2):
        x, y = set(up(leaves[a])), set(up(leaves[b]))
        add[a, b] = sum(edges[v] for v in x ^ y)
    rows = [("u", a, b, v) for (a, b), v in d.items()]
    t, depths = tree.cluster_tree(spark.createDataFrame(rows, "cluster string, a long, b long, d double"))
    r = t.first()
    got = leaf_paths(r.newick)
    for k, h in upgma(d, n).items():
        assert got[k] == pytest.approx(h, abs=0.01)
    assert r.leaves == n and max(x.depth for x in depths.collect()) == pytest.approx(r.max_depth)
    rows = [("j", a, b, v) for (a, b), v in add.items()]
    r = tree.cluster_tree(spark.createDataFrame(rows, "cluster string, a long, b long, d double"), method="neighbor-joining")[0].first()
    got = leaf_paths(r.newick)
    for (a, b), v in add.items():
        assert got[str(a), str(b)] == pytest.approx(v, abs=0.02)


def test_first_merge_example(spark):
    rows = [("c", "A", "B", 0.1), ("c", "A", "C", 0.3), ("c", "B", "C", 0.3), ("c", "A", "D", 0.5), ("c", "B", "D", 0.5), ("c", "C", "D", 0.4)]
    t = tree.cluster_tree(spark.createDataFrame(rows, "cluster string, a string, b string, d double"))[0].first()
    assert t.newick.count("A:0.050,B:0.050") == 1 and t.leaves == 4


def slow_align(a, b, local):
    s, gap = blosum62(), -8
    score = lambda x, y: s.get((x, y), -4)
    g = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0 or j == 0:
                g[i][j] = 0 if local else gap * (i + j)
                continue
            g[i][j] = max(g[i - 1][j - 1] + score(a[i - 1], b[j - 1]), g[i - 1][j] + gap, g[i][j - 1] + gap, *([0] if local else []))
    return max(max(r) for r in g) if local else g[-1][-1]


@pytest.mark.parametrize("mode", ["global", "local"])
def test_alignment_scores(spark, mode):
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice("ACDEFGHIK") for _ in range(rnd.randint(5, 30))), "".join(rnd.choice("ACDEFGHIK") for _ in range(rnd.randint(5, 30)))) for i in range(30)]
    out = {r.pair_id: r for r in align.align_pairs(spark.createDataFrame(rows, "pair_id long, a string, b string"), mode, "protein").collect()}
    s = blosum62()
    for i, a, b in rows:
        r = out[i]
        assert r.score == slow_align(a, b, mode == "local")
        assert len(r.aligned_a) == len(r.aligned_b)
        assert r.score == sum(-8 if "-" in p else s[p] for p in zip(r.aligned_a, r.aligned_b))
        if mode == "global":
            assert r.aligned_a.replace("-", "") == a and r.aligned_b.replace("-", "") == b


@pytest.mark.parametrize("tile", [orfs.ORF_TILE, 60, 9])
def test_orfs(spark, tile):
    rnd = random.Random(12)
    seq = "".join(rnd.choice("ACGT") for _ in range(900))
    rc = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = set()
    for strand, s in (("+", seq), ("-", rc)):
        for i in range(len(s) - 2):
            if s[i : i + 3] in STARTS:
                for j in range(i + 3, len(s) - 2, 3):
                    if s[j : j + 3] in STOPS:
                        if j + 3 - i >= 30:
                            want.add((strand, i + 1, j + 3) if strand == "+" else (strand, len(s) - j - 2, len(s) - i))
                        break
    got = {(r.strand, r.start, r.end) for r in orfs.find_orfs(spark.createDataFrame([(1, seq)], "seq_id long, seq string"), tile=tile).collect()}
    assert got == want


def test_seed_search_finds_copy(spark):
    rnd = random.Random(2)
    body = "".join(rnd.choice("ABCDEFGHIJ") for _ in range(300))
    q = spark.createDataFrame([(1, body[100:160])], "query_id long, seq string")
    s = spark.createDataFrame([(7, body), (8, body[:100]), (9, body[:130] + "Z" + body[131:])], "subject_id long, seq string")
    got = {r.subject_id: (r.rank, round(r.identity, 2), r.coverage) for r in search.seed_search(q, s).collect()}
    assert got[7] == (1, 100.0, 100.0) and got[9][0] == 2 and 8 not in got
    routes = search.identify_sequences(q, s, spark.createDataFrame([(7, "beta-lactamase", "x")], "subject_id long, title string, organism string"))
    assert routes.select(F.col("route")).first().route == "AMR Detector"
