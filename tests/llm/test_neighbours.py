import numpy as np
from pyspark.sql import functions as F

from paragrove.llm import neighbours as nb


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_adaptive_scan_equals_brute_force():
    rng = np.random.default_rng(1)
    q, c = unit(rng.standard_normal((80, 64))).astype(np.float32), unit(rng.standard_normal((300, 64))).astype(np.float32)
    c[:40] = unit(q[:40] + 0.05 * rng.standard_normal((40, 64)))
    d2 = 2 - 2 * q @ c.T
    for bound in (0.2, 1.2, 4.1):
        i, j, got = nb.adaptive_scan(q, c, np.full(80, bound, np.float32))
        want = set(zip(*np.nonzero(d2 <= bound)))
        have = set(zip(i, j))
        assert have <= {(a, b) for a, b in zip(*np.nonzero(d2 <= bound + 1e-4))} and len(want - have) <= 0.01 * len(want)
        assert np.allclose(got, d2[i, j], atol=1e-4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, dense array<float>, upserted_at timestamp, home int, code string, tau2 double")


def test_pairs_and_edge_cases(spark):
    import datetime as dt

    rng = np.random.default_rng(2)
    x = unit(rng.standard_normal((400, 64)))
    x[200:260] = unit(x[:60] + 0.03 * rng.standard_normal((60, 64)))
    rows = [(i, [float(v) for v in x[i]], dt.datetime(2025, 1, 1), 0, "x", 0.0) for i in range(400)]
    rows += [(i, rows[i][1], dt.datetime(2025, 2, 1), 1, "y", 1.0) for i in range(5)]  # upserted again
    rows += [(1000 + i, rows[7][1], None, 0, "x", 0.0) for i in range(3)] + [(2000 + i, rows[9][1], None, 0, "x", 0.0) for i in range(70)]  # copies
    rows += [(3000, None, None, 0, "x", 0.0), (3001, [0.0] * 64, None, 0, "x", 0.0), (3002, [1.0] * 48, None, 0, "x", 0.0), (3003, [float("nan")] * 64, None, 0, "x", 0.0), (None, rows[1][1], None, 0, "x", 0.0), (3004, [None] * 64, None, 0, "x", 0.0)]
    df = frame(spark, rows)
    got = [tuple(r) for r in nb.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    have = set(got)
    s = x @ x.T
    want = {(i, j) for i, j in zip(*np.nonzero(s >= 0.9)) if i < j}
    assert len(want - have) <= 0.02 * len(want)
    assert {(7, 1000), (7, 1001), (7, 1002), (1000, 1001), (1000, 1002), (1001, 1002)} <= have  # a small class: all pairs
    assert {(9, 2000 + i) for i in range(70)} <= have and (2000, 2001) not in have  # a large one: links to the first
    assert {(7, 207), (207, 1000)} <= have
    assert not {a for p in have for a in p} & {3000, 3001, 3002, 3003, 3004}
    assert nb.similar_pairs(df.limit(0)).count() == 0


def test_nearest_recall(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((20, 64))
    x = unit(centre[rng.integers(0, 20, 2000)] + 0.8 * rng.standard_normal((2000, 64)))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], None) for i in range(2000)], "id long, dense array<float>, upserted_at timestamp")
    got = nb.nearest(df, F.col("id") % 20 == 0, 10).collect()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = {i: set(np.argpartition(-s[i], 10)[:10]) for i in range(0, 2000, 20)}
    hits = sum(r.id in top[r.id_q] for r in got)
    assert hits >= 0.9 * 1000 and len(got) == 1000 and all(r.id != r.id_q for r in got)
    assert nb.nearest(df.limit(0)).count() == 0
