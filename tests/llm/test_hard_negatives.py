import math

import numpy as np
import pytest

from lonetext.llm import hard_negatives
from lonetext.llm.hard_negatives import LEVELS, Summary, mine, prepared, summaries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    """All answers by loops over whole rows; rows are (id, vector, label)."""
    kept = [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in rows
            if y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, va, ya in (r for r in kept if r[0] is not None and r[0] % every == 0):
        scored = [(sum(p * q for p, q in zip(va, v)), i, y) for i, v, y in kept if i != a and len(v) == len(va)]
        scored.sort(key=lambda r: (-r[0], last(r[1])))
        for ps, p, _ in [r for r in scored if r[2] == ya][:5]:
            inside = [r for r in scored if r[2] != ya and 80 * ps <= 100 * r[0] <= 100 * ps][:5]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(inside)]
    return sorted(out, key=str)


def random_rows(seed, n, dim, labels=3, centres=6):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, dim))
    v = c[r.integers(0, centres, n)] + 0.5 * r.standard_normal((n, dim))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    return [(i, v[i].tolist(), int(r.integers(0, labels))) for i in range(n)]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_bounds_hold_at_every_level_and_tighten():
    r = np.random.default_rng(0)
    for dim in (1, 5, 17, 64):
        x = np.floor(256 * r.standard_normal((60, dim)))
        s, exact = Summary(*summaries(x), dim), x @ x.T
        width = []
        for level in range(len(LEVELS)):
            low, high = (np.array([s.bounds(level, np.arange(60), s, i)[k] for i in range(60)]) for k in (0, 1))
            assert (low <= exact).all() and (exact <= high).all()
            width.append((high - low).mean())
        assert all(a >= b - 1e-6 for a, b in zip(width, width[1:]))


def test_coarse_summaries_are_those_of_the_whole_segment():
    x = np.floor(256 * np.random.default_rng(1).standard_normal((20, 37)))
    s = Summary(*summaries(x), 37)
    for level, segments in enumerate(LEVELS):
        mean, deviation = summaries(x, segments)
        root = np.sqrt(np.diff(hard_negatives.cuts(37, segments)))
        assert np.allclose(s.levels[level][0], mean * root) and np.allclose(s.levels[level][1], deviation * root)


@pytest.mark.parametrize("dim", [3, 64])
def test_against_brute_force(spark, dim):
    rows = random_rows(dim, 900, dim)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert want and found(mine(df)) == want
    assert found(mine(df, block=4)) == want  # several blocks of anchors


def test_ties_repeated_rows_and_odd_values(spark):
    v = [0.5, 0.25, -0.5, 0.1]
    rows = random_rows(9, 150, 4) + [(i, v, i % 2) for i in range(300, 330)] + [(300, v, 0), (200, v, 1), (200, v, 1)]
    rows += [(None, v, 0), (None, v, 1), (400, None, 1), (401, [], 1), (500, [1.0, None, 0.0, 0.0], 0),
             (600, [float("nan")] * 4, 0), (601, [float("inf"), 0.0, 0.0, 0.0], 1), (700, v, None),
             (800, [0.3, 0.4], 0), (801, [0.3, 0.4], 0), (802, [0.3, 0.39], 1), (0, [0.0] * 4, 2)]
    assert found(mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_large_components_stay_exact(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.integers(1, 4_000_000, 5)], i % 2) for i in range(0, 120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found(mine(df)) == brute(rows)
    assert prepared(spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")).isEmpty()


def test_fewer_partners_than_asked_and_negative_scores(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.88, 0.3], 1), (100, [-1.0, 0.0], 1), (3, [0.2, 0.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(mine(df)) == brute(rows)
    assert mine(df.filter("vec_id = 0")).isEmpty() and mine(df.filter("label = 9")).isEmpty()


def test_further_columns_are_not_looked_at(spark):
    from pyspark.sql import functions as F

    rows = random_rows(5, 200, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df.select("*", *[F.lit("x").alias(c) for c in ("row", "anchor", "rank", "score", "dim", "window", "v", "fit")])
    assert found(mine(odd)) == brute(rows)


def test_refinement_leaves_rows_out(spark):
    """Vectors that differ between segments more than within them: most rows are ruled out before exact scoring."""
    r = np.random.default_rng(11)
    v = np.repeat(r.standard_normal((2000, 16)), 4, axis=1) + 0.05 * r.standard_normal((2000, 64))
    table = prepared(spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], SCHEMA)).toArrow()
    block = next(hard_negatives.blocks(table))
    best = hard_negatives.Best(5)
    some = np.flatnonzero(block.label == block.label[0])
    made = hard_negatives.search(block, block, 0, some, [(-np.inf, np.inf, best)])
    assert 5 <= made < len(some) / 10
    assert best.score.tolist() == np.sort(block.double[some] @ block.double[0])[::-1][:5].astype(int).tolist()
