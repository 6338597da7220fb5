import math

import numpy as np
import pytest

from tessera.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>, score string"


def vectors(n, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width)) * 3
    return (centres[rng.integers(0, 12, n)] + rng.standard_normal((n, width))).astype(np.float32)


def brute(rows, k, every):
    ids = np.array([i for i, *_ in rows])
    v = np.array([x for _, x, *_ in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("cell,part", [(10_000, 10_000), (100, 10_000), (400, 90)])
def test_recall_and_exact_scores(spark, monkeypatch, cell, part):
    monkeypatch.setattr(nn, "PART", part)
    monkeypatch.setattr(nn, "CELL", cell)
    monkeypatch.setattr(nn, "LEAF", 16)
    monkeypatch.setattr(nn, "BLOCK", 7)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors(1500))]
    got, true = found(nn.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), every=25)), brute(rows, 10, 25)
    assert got.keys() == true.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in true[q]}) for q in true)
    assert hits >= 0.95 * 10 * len(true)
    v = np.array([x for _, x, _ in rows], np.float64)
    for q, list_ in got.items():
        assert len(list_) == 10 and list_ == sorted(list_, key=lambda x: (x[1], x[0]))
        assert all(abs(s - math.sqrt(((v[q] - v[i]) ** 2).sum())) < 1e-12 for i, s in list_)


def test_hot_vector_ties_and_repeated_rows(spark):
    hot = [1.0, 2.0, 3.0]
    rows = [(i, hot, "x") for i in range(300)] + [(300 + i, [float(i), 1.0, 0.0], "x") for i in range(600)] + [(0, hot, "x"), (0, hot, "x")]
    got = found(nn.nearest(spark.createDataFrame(rows, SCHEMA), every=100))
    assert got[0] == [(i, 0.0) for i in range(1, 11)]
    assert got[100] == [(i, 0.0) for i in range(10)]
    assert got[200] == got[100]
    plain = list({r[0]: r for r in rows}.values())
    true = brute(plain, 10, 100)
    assert got[700] == true[700]


def test_rows_that_take_no_part_and_few_candidates(spark):
    rows = [(100, [1.0, 0.0], "a"), (1, [1.0, 1.0], "a"), (2, None, "a"), (200, [0.0, 0.0], "a"), (3, [float("nan"), 1.0], "a"), (4, [None, 1.0], "a"), (5, [float("inf"), 1.0], "a"), (6, [1.0, 2.0, 3.0], "a"), (None, [1.0, 0.5], "a"), (7, [], "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(nn.nearest(df)) == {100: [(1, 1.0)]}
    assert nn.nearest(df.limit(0)).count() == 0
    assert nn.nearest(df.filter("vec_id = 100")).count() == 0


def test_columns_named_as_the_result(spark):
    rows = [(i, [float(i), 1.0], 7, i, i) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, query_id long, cell long")
    assert found(nn.nearest(df, k=2))[100] == [(99, 1.0), (101, 1.0)]


def test_chi_square():
    assert abs(nn.chi_square_cdf(15.507, 8) - 0.95) < 1e-3
    assert abs(nn.chi_square_cdf(nn.chi_square_quantile(0.98, 8), 8) - 0.98) < 1e-9
