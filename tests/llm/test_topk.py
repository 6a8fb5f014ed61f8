import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexward.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, k=topk.K):
    out = []
    for i, a in rows:
        scored = sorted(((-(round(float(np.dot(np.float64(a), np.float64(b))), topk.DIGITS) + 0.0), j) for j, b in rows if j != i))
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-7)


def run(spark, rows, k=topk.K):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "v", "q", "kind", "top", "norm", "label", "n")})
    return sorted(map(tuple, topk.top_k(df, k).collect()))


def vectors(n, dim, seed=0, skew=True):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * (0.7 ** np.arange(dim) if skew else 1)
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x * rng.gamma(2, 1, (n, 1)))]


@pytest.mark.parametrize(("n", "dim", "skew"), [(700, 12, True), (300, 5, False), (12, 3, True)])
def test_equals_brute_force(spark, n, dim, skew):
    rows = vectors(n, dim, n, skew)
    same(run(spark, rows), brute(rows))


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "RANGE", 2)
    monkeypatch.setattr(topk, "GROUP", 50)
    rows = vectors(900, 16, 5)
    same(run(spark, rows), brute(rows))


def test_ties_go_to_the_lesser_id(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(40)] + [(100, [0.0, 0.0])]
    same(run(spark, rows, 5), brute(rows, 5))


def test_messy(spark):
    good = [(1, [1.0, 2.0]), (2, [0.5, -1.0]), (3, [2.0, 0.0])]
    bad = [(None, [9.0, 9.0]), (4, None), (5, []), (6, [1.0, None]), (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (9, [1.0, 2.0, 3.0]), (3, [3.0, 0.0]), (1, [1.0, 2.0])]
    got = run(spark, good + bad)
    same(got, brute(good))


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(1, None)]])
def test_too_few(spark, rows):
    assert run(spark, rows) == []


def test_a_query_set(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "GROUP", 5)
    rows = vectors(600, 8, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, topk.top_k(df, 4, queries=F.col("id") % 7 == 0).collect()))
    same(got, [r for r in brute(rows, 4) if r[0] % 7 == 0])


def test_one_direction_is_split(spark, monkeypatch):
    """A third of all vectors point the same way: no group holds them all."""
    monkeypatch.setattr(topk, "GROUP", 40)
    rows = vectors(200, 6, 8, False) + [(1000 + i, [1.0 + i / 1000, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(100)]
    same(run(spark, rows), brute(rows))
    plain = spark.createDataFrame(rows, "id bigint, v array<double>")
    sizes = [r["count"] for r in topk._grouped(plain, np.eye(6), 6).groupBy("g").count().collect()]
    assert sum(sizes) == 300 and max(sizes) <= 60


def test_bounds_leave_pairs_out():
    """Of the pairs of queries and items most aren't even begun, and few of those begun are finished; the result stays."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 24)) * 0.6 ** np.arange(24) * rng.gamma(1, 1, (4000, 1))
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    _, _, basis = np.linalg.svd(x, full_matrices=False)
    asked = np.arange(0, 4000, 40)
    search, finished = topk.Search(asked, x[asked], basis.T, 3, 10), 0
    merge = search._merge
    search._merge = lambda r, ids, scores: (globals().update(finished=globals().get("finished", 0) + len(r)), merge(r, ids, scores))[1]
    globals()["finished"] = 0
    for at in range(0, 4000, 250):
        search.add(np.arange(at, at + 250), x[at : at + 250], float(np.linalg.norm(x[at])))
    assert search.met < 0.6 * 100 * 4000
    assert globals()["finished"] < 0.05 * 100 * 4000
    assert (search.reach() > np.linalg.norm(x[3999])).mean() > 0.5
    for n, q in enumerate(asked.tolist()):
        scores = np.round(x @ x[q], topk.DIGITS)
        scores[q] = -np.inf
        assert sorted(search.scores[n], reverse=True) == pytest.approx(sorted(scores, reverse=True)[:10])
