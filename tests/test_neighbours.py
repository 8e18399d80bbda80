"""How much travels and how much a task holds in the exact neighbour search."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lonetext.operators import neighbours
from lonetext.operators.neighbours import Cells


def vectors(spark, x):
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(x)), "embedding": x.tolist()}))


@pytest.mark.parametrize("answer", ["nearest", "log_kernel_sum"])
def test_a_query_travels_once_per_block_not_once_per_cell(spark, monkeypatch, answer):
    written = {}

    def keep(df, name, *args, **kwargs):
        written[name] = write_out(df, name, *args, **kwargs)
        return written[name]

    write_out = neighbours.write_out
    monkeypatch.setattr(neighbours, "write_out", keep)
    x = np.random.default_rng(1).normal(size=(2000, 16))  # no cell can be ruled out
    index = Cells(vectors(spark, x), cell_rows=8)
    queries = index.locations.select(F.col("loc").alias("qid"), "vec")
    found = index.nearest(queries, 5) if answer == "nearest" else index.log_kernel_sum(queries, 1.0)
    assert found.select("qid").distinct().count() == len(x)
    visits = written["visits"]
    sent = F.size("cells") if "cells" in visits.columns else F.col("n") * F.size("blocks")
    assert visits.agg(F.sum(sent)).first()[0] <= 8 * len(x)


def test_pivots_are_met_some_rows_at_a_time(spark):
    x = np.random.default_rng(2).normal(size=(4000, 4))
    nearest = Cells(vectors(spark, x), cell_rows=8)._nearest_pivot().func
    rows = pd.Series(list(x))
    tracemalloc.start()
    try:
        nearest(rows)
        assert tracemalloc.get_traced_memory()[1] < 8 << 20  # all at once: 16 MB a matrix of distances
    finally:
        tracemalloc.stop()


def test_blocks_of_equal_distances_and_missing_ids(spark):
    """Ties go to the smaller id, over several blocks, and crowded cells are cut."""
    x = np.repeat(np.eye(6), 1, axis=0)
    x = np.vstack([x * s for s in (1.0, 2.0, 3.0)])
    index = Cells(vectors(spark, x), cell_rows=3, piece_rows=2, batch_rows=2)
    queries = index.locations.select(F.col("loc").alias("qid"), "vec")
    got = {(r.qid, r.place): r.nbr for r in index.nearest(queries, 4).collect()}
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert got == {(q, p + 1): want[q, p] for q in range(len(x)) for p in range(4)}


def brute_log_sums(x, weights, queries, bandwidth):
    d2 = ((queries[:, None] - x[None]) ** 2).sum(2)
    return np.log((weights * np.exp(-d2 / (2 * bandwidth * bandwidth))).sum(1))


def test_locations_that_give_each_other_kernel_sums_meet_once(monkeypatch):
    rng = np.random.default_rng(3)
    sides = []
    for n in (700, 900):
        frame = pd.DataFrame({"id": np.arange(n), "none": False, "cell": np.sort(rng.integers(0, 9, n))})
        sides.append(neighbours.Packed(neighbours._pack(frame, rng.normal(size=(n, 5)), rng.integers(1, 4, n))))
    a, b = sides
    pairs, logs = [], neighbours.Kernel.logs

    def counted(self, x, among):
        for cols, found in logs(self, x, among):
            pairs.append(found.size)
            yield cols, found

    monkeypatch.setattr(neighbours.Kernel, "logs", counted)

    def needed(p, cells):
        return np.ones((len(neighbours._batches(len(p))), len(cells)), bool)

    to_a, to_b = neighbours._meet(a, b, needed, 2.0, 1e-12)
    assert sum(pairs) == len(a) * len(b)
    np.testing.assert_allclose(np.log(to_a), brute_log_sums(b.x, b.number, a.x, 1.0), rtol=1e-12)
    np.testing.assert_allclose(np.log(to_b), brute_log_sums(a.x, a.number, b.x, 1.0), rtol=1e-12)
    pairs.clear()
    own, none = neighbours._meet(b, None, needed, 2.0, 1e-12)
    assert none is None and sum(pairs) <= len(b) * (len(b) + neighbours.BLOCK_ROWS) / 2
    np.testing.assert_allclose(np.log(own), brute_log_sums(b.x, b.number, b.x, 1.0), rtol=1e-12)


@pytest.mark.parametrize("spread,bandwidth", [(1.0, 1.0), (30.0, 0.5)])
def test_own_kernel_sums_over_many_bands(spark, monkeypatch, spread, bandwidth):
    """Copies count; cells that cannot matter, as with a wide spread, are left out."""
    monkeypatch.setattr(neighbours, "ONE_BLOCK_ROWS", 10)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3)) + spread * rng.integers(0, 4, size=(600, 1))
    rows = np.vstack([x, x[:150]])
    index = Cells(vectors(spark, rows), cell_rows=20, piece_rows=16)
    got = {r["loc"]: r.log_sum for r in index.own_log_kernel_sums(bandwidth).collect()}
    weights = np.where(np.arange(600) < 150, 2, 1)
    want = brute_log_sums(x, weights, x, bandwidth)
    assert len(got) == 600
    np.testing.assert_allclose([got[i] for i in range(600)], want, rtol=0, atol=1e-11)
    queries = index.locations.select(F.col("loc").alias("qid"), "vec")
    other = {r.qid: r.log_sum for r in index.log_kernel_sum(queries, bandwidth).collect()}
    np.testing.assert_allclose([other[i] for i in range(600)], want, rtol=0, atol=1e-11)


def test_pieces_of_work_are_dealt_out_evenly(spark):
    costs = [1.0, 2.0, 3.0] * 20
    keys = neighbours._dealt(spark, costs)
    assert len(set(keys)) == len(costs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.createDataFrame(list(zip(keys, costs)), "key int, cost double")
    loads = df.groupBy(F.pmod(F.hash("key"), parts)).agg(F.sum("cost").alias("cost")).collect()
    assert len(loads) == parts and max(r.cost for r in loads) <= sum(costs) / parts + 3


@pytest.mark.parametrize("kind", ["cloud", "tight clusters", "ties", "beyond single precision"])
def test_the_best_are_found_by_bounds_and_few_exact_distances(monkeypatch, kind):
    rng = np.random.default_rng(5)
    y, k = rng.normal(size=(6000, 8)), 7
    if kind == "tight clusters":
        y = y * 1e-6 + (np.arange(6000) % 2)[:, None]
    elif kind == "ties":
        y = np.round(y[:, :3])
    elif kind == "beyond single precision":
        y = y * 1e20
    ids, looked = rng.permutation(len(y)), []
    exact = neighbours.Search._exact
    monkeypatch.setattr(neighbours.Search, "_exact", lambda self, x, r, c: looked.append(len(r)) or exact(self, x, r, c))
    x = y[:64]
    d = np.round(np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)), neighbours.TIE_DECIMALS)
    want = np.array([np.lexsort((ids, row))[:k] for row in d])
    for reach in (np.full(64, np.inf), np.sort(d[:, :500], axis=1)[:, k - 1] + 1e-3 * d.max()):
        looked.clear()
        r, c, got, place = neighbours.Search(y, ids, k).nearest(x, reach, np.arange(len(y)))
        assert np.array_equal(c.reshape(64, k), want) and np.array_equal(place.reshape(64, k)[0], np.arange(k))
        if kind == "cloud":
            assert sum(looked) < 2 * k * len(x)  # pairs within reach, or let in before that was known: many times that
