"""Alignment in bounded memory against the whole grid, and its memory on long texts."""

import random
import tracemalloc

import numpy as np
import pytest

from biotally.operators import align


def whole_grid(a, b, table, gap, local):
    """Score and texts from the whole grid, cell by cell."""
    m, n = len(a), len(b)
    g = [[0 if local else gap * (i + j) for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            g[i][j] = max(g[i - 1][j - 1] + int(table[a[i - 1], b[j - 1]]), g[i - 1][j] + gap, g[i][j - 1] + gap, *([0] if local else []))
    i, j = m, n
    if local:
        best = max(max(r) for r in g)
        i, j = next((i, j) for i, r in enumerate(g) for j, v in enumerate(r) if v == best)
    score, left, right = g[i][j], "", ""
    while (i > 0 and j > 0 and g[i][j] > 0) if local else (i > 0 or j > 0):
        if i > 0 and j > 0 and g[i][j] == g[i - 1][j - 1] + int(table[a[i - 1], b[j - 1]]):
            i, j, left, right = i - 1, j - 1, chr(a[i - 1]) + left, chr(b[j - 1]) + right
        elif i > 0 and g[i][j] == g[i - 1][j] + gap:
            i, left, right = i - 1, chr(a[i - 1]) + left, "-" + right
        else:
            j, left, right = j - 1, "-" + left, chr(b[j - 1]) + right
    return score, left, right


@pytest.mark.parametrize("local", [False, True])
@pytest.mark.parametrize(("alphabet", "letters"), [("dna", "ACGT"), ("protein", "ARNDCQEGHILKMFPSTWYVBZXJ")])
def test_equals_the_whole_grid(monkeypatch, local, alphabet, letters):
    r = random.Random(1)
    table = align._score_table(alphabet)
    for k in range(120):
        step = 1 + k % 7
        monkeypatch.setattr(align, "_stride", lambda rows, step=step: step)
        a, b = ("".join(r.choice(letters[: 2 + k % 3] if k % 2 else letters) for _ in range(r.randint(0, 40))) for _ in range(2))
        if k % 3 == 0 and a:
            b = a[: len(a) // 2] + b[:5] + a[len(a) // 2 + 3 :]
        x, y = (np.frombuffer(s.encode(), np.uint8) for s in (a, b))
        for gap in (-8, -1):
            assert align.align_texts(x, y, table, gap, local) == whole_grid(x, y, table, gap, local)


def test_long_texts_take_little_memory():
    r = np.random.default_rng(2)
    a = r.choice(np.frombuffer(b"ACGT", np.uint8), 12000)
    b = np.delete(a.copy(), r.integers(0, 12000, 300))
    tracemalloc.start()
    score, left, right = align.align_texts(a, b, align._score_table("dna"), -8, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # the whole grid would take 560 MB
    assert left.replace("-", "") == a.tobytes().decode() and right.replace("-", "") == b.tobytes().decode()
    assert score == sum(-8 if "-" in (x, y) else 2 if x == y else -1 for x, y in zip(left, right, strict=True))


def test_null_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, None, "ACG"), (2, "", ""), (3, "acg", "ACG")], "pair_id long, a string, b string")
    got = {r.pair_id: tuple(r)[1:] for r in align.align_pairs(rows).collect()}
    assert got == {1: (-24, "---", "ACG"), 2: (0, "", ""), 3: (6, "ACG", "ACG")}
    assert {r.pair_id: r.score for r in align.align_pairs(rows, "local").collect()} == {1: 0, 2: 0, 3: 6}
