"""Seeded search against a plain version: repeats, hot words, texts over several tiles and stretches."""

import random

import pytest

from biotally.operators import search


def plain_hits(queries, subjects, k=16):
    out = {}
    for q, a in queries:
        for s, b in subjects:
            at = {}
            for i in range(len(b or "") - k + 1):
                at.setdefault(b[i : i + k], []).append(i)
            diagonals = {}
            for i in range(len(a or "") - k + 1):
                for j in at.get(a[i : i + k], []):
                    diagonals[j - i] = diagonals.get(j - i, 0) + 1
            if diagonals:
                d, n = min(diagonals.items(), key=lambda x: (-x[1], x[0]))
                start = max(0, -d)
                size = min(len(a) - start, len(b) - start - d)
                same = sum(a[start + x] == b[start + d + x] for x in range(size))
                out[q, s] = (d, n, size, same)
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    word = lambda n, letters="ABCDEFGHIJ": "".join(r.choice(letters) for _ in range(n))
    body, common = word(5000), word(40)
    queries = [(1, body[100:400]), (2, body[2000:2100] + word(30) + body[2130:4500]), (3, common), (4, "AB" * 60), (5, "short"), (6, None), (7, word(10) + common + word(10)), (8, body)]
    subjects = [(10, body), (11, body[:2100] + word(5) + body[2100:]), (12, word(3000) + body[50:350]), (13, "AB" * 80), (14, None), (15, "")]
    subjects += [(20 + n, word(60) + common + word(60) if n % 3 == 0 else word(150)) for n in range(60)]
    return queries, subjects


@pytest.mark.parametrize("hot", [1000, 5])
@pytest.mark.parametrize("stretch", [1 << 20, 700])
def test_equals_the_plain_version(spark, monkeypatch, texts, hot, stretch):
    monkeypatch.setattr(search, "HOT", hot)
    monkeypatch.setattr(search, "STRETCH", stretch)
    queries, subjects = texts
    q, s = spark.createDataFrame(queries, "query_id long, seq string"), spark.createDataFrame(subjects, "subject_id long, seq string").repartition(3)
    best = search.seed_diagonals(q, s)
    got = {(x.query_id, x.subject_id): (x.diagonal, x.seeds, x.overlap, x.matches) for x in search.ungapped_identity(best, q, s).collect()}
    assert got == plain_hits(queries, subjects)


def test_a_hot_word_is_dealt_over_many_salts(spark, monkeypatch, texts):
    monkeypatch.setattr(search, "HOT", 20)
    common = texts[0][2][1]
    subjects = spark.createDataFrame([(n, common + str(n)) for n in range(900)], "subject_id long, seq string")
    q, s = search._salted(search.seeds(spark.createDataFrame([(1, common)], "query_id long, seq string"), "query_id"), search.seeds(subjects, "subject_id"))
    largest = s.groupBy("h", "salt").count().agg({"count": "max"}).first()[0]
    assert largest < 450 and q.count() > search.seeds(spark.createDataFrame([(1, common)], "query_id long, seq string"), "query_id").count()


def test_fewer_rows_than_places():
    import numpy as np

    letters = np.random.default_rng(1).integers(65, 91, 20000).astype(np.uint64)
    h, at, first, windows = search._minimizers(letters, 16, 11)
    assert windows.sum() == 20000 - 15 and len(h) < 0.4 * 20000
    assert ((at >= first + windows - 1) & (at <= first + 5)).all()  # the minimizer lies inside every window of its row
