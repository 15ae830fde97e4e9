"""Members of narrow values on their way to the roots of their nodes."""

import random

import numpy as np
import pytest

from biotally.llm import simhash
from tests.llm.test_operators import documents, prose


def test_a_node_joins_its_root_once_whatever_its_values(spark, monkeypatch):
    plans, kept = [], simhash.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df)

    monkeypatch.setattr(simhash, "cut_lineage", noted)
    meetings = spark.createDataFrame([(v, k + 1, k) for v in range(30) for k in range(6)], "value long, place int, node long")
    nodes = spark.createDataFrame([(k, k // 3, 7 << k // 2) for k in range(6)], "node long, near long, s0 long")
    links = {tuple(x) for x in simhash._all_meetings(meetings, nodes, ["s0"], 2).collect()}
    assert links == {(0, 1)}
    assert plans[0].index("inline") < plans[0].index("Join") < plans[0].index("collect_list")


def test_a_family_of_near_copies_is_compared_along_few_pairs(spark, monkeypatch):
    met, kept = [], simhash.cut_lineage

    def noted(df):
        if df.columns == ["node", "before"]:
            met.append(df.count())
        return kept(df)

    monkeypatch.setattr(simhash, "cut_lineage", noted)
    words = prose(random.Random(31), 400).split()
    texts = [" ".join([*words[: 2 * k], f"edit{k}", *words[2 * k + 1 :]]) for k in range(150)]
    found = simhash.similar_components(documents(spark, texts)).collect()
    assert {x["component_id"] for x in found} == {min(x["doc_id"] for x in found)}
    assert sum(met) <= 12 * len(texts)


def test_chance_meetings_of_strangers_make_no_rows(spark, monkeypatch):
    # Unrelated fingerprints, some within two bits of a narrow one of others: with 8,000 nodes about a thousand such pairs.
    r = np.random.default_rng(5)
    n, words = 8000, [f"s{k}" for k in range(simhash.PARTS)]
    prints = r.integers(0, 1 << 64, (n, simhash.PARTS), np.uint64)
    monkeypatch.setattr(simhash, "_fingerprints", lambda text, shingle, parts=1: prints[[int(t) for t in text.to_pylist()]][:, :parts])
    rows, kept = [], simhash.cut_lineage

    def noted(df):
        written = kept(df)
        if not set(words) & set(df.columns):
            rows.append((df.columns, written.count()))
        return written

    monkeypatch.setattr(simhash, "cut_lineage", noted)
    found = simhash.similar_components(documents(spark, [str(k) for k in range(n)])).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in found) == [(k, k) for k in range(n)]
    narrow = [prints[:, k] >> np.uint64(simhash.NARROW * half) & np.uint64((1 << simhash.NARROW) - 1) for k in range(simhash.PARTS) for half in (0, 1)]
    meetings = sum(int((np.bitwise_count(t[i + 1 :] ^ t[i]) <= simhash.RADIUS).sum()) for t in narrow for i in range(n))
    assert meetings > 300 and max(k for _, k in rows) < meetings / 10


@pytest.mark.parametrize("group", [5, simhash.GROUP])
def test_groups_link_all_that_are_close_in_narrow_and_whole_fingerprints(spark, monkeypatch, group):
    r = random.Random(41)
    start = [[r.getrandbits(64) for _ in range(simhash.PARTS)] for _ in range(12)]

    def near(prints, times):
        out = list(prints)
        for _ in range(times):
            k = r.randrange(len(out))
            out[k] ^= 1 << r.randrange(64)
        return out

    prints = [near(start[k % 12], r.randint(10, 70)) for k in range(240)]
    table = np.array(prints, np.uint64)
    monkeypatch.setattr(simhash, "_fingerprints", lambda text, shingle, parts=1: table[[int(t) for t in text.to_pylist()]][:, :parts])
    monkeypatch.setattr(simhash, "GROUP", group)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    mask, limit = (1 << simhash.NARROW) - 1, simhash.similarity_bits(0.8, 64 * simhash.PARTS)
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            apart = [x ^ y for x, y in zip(a, b, strict=True)]
            if sum(x.bit_count() for x in apart) <= limit and any((x >> simhash.NARROW * half & mask).bit_count() <= simhash.RADIUS for x in apart for half in (0, 1)):
                one, other = sorted((find(i), find(j)))
                parent[other] = one
    want = [find(k) for k in range(len(prints))]
    assert 12 < len(set(want)) < 200
    got = dict((x["doc_id"], x["component_id"]) for x in simhash.similar_components(documents(spark, [str(k) for k in range(len(prints))])).collect())
    assert [got[k] for k in range(len(prints))] == want


def test_masks_cover_any_two_bits_and_keep_groups_small():
    for count in (0, 1 << 24, 1 << 25, 1 << 40):
        masks = simhash.bits_left_out(count)
        assert all(any((1 << i | 1 << j) & ~m == 0 for m in masks) for i in range(simhash.NARROW) for j in range(i))
    assert [len(simhash.bits_left_out(n)) for n in (1 << 24, 1 << 25)] == [6, 10]


def test_merged_labels_are_those_of_components():
    r = np.random.default_rng(6)
    for n, m in ((1, 0), (50, 30), (300, 250), (300, 2000)):
        a, b = r.integers(0, n, (2, m))
        label = np.arange(n)
        simhash._merge(label, a, b)
        want = np.arange(n)
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                want[x] = want[y] = min(want[x], want[y])
            if (want[a] == want[b]).all():
                break
        assert (label == want).all()
