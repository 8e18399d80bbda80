import numpy as np
import pytest
from pyspark.sql import functions as F

from lonetext.operators import detectors as det
from lonetext.operators.candidates import HashTables, recall


def clustered(n=1500, dim=16, centres=30, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 4
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim))


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, embedding array<double>")


def as_queries(df):
    return df.select(F.col("row_id").alias("qid"), F.col("embedding").alias("vec"))


def nearest(x, i, m):
    d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
    return np.lexsort((np.arange(len(x)), d))[:m].tolist()


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r.place)):
        out.setdefault(r.qid, []).append(r.nbr)
    return out


@pytest.mark.parametrize("settings", [{"bits": 0, "tables": 1}, {"bits": 0, "tables": 2, "piece_rows": 100, "query_block": 60}])
def test_one_bucket_is_exact(spark, settings):
    x = clustered(300)
    got = found(HashTables(table(spark, x), **settings).nearest(as_queries(table(spark, x)), 7))
    assert got == {i: nearest(x, i, 7) for i in range(300)}


def test_recall_over_all_rows(spark):
    x = clustered()
    data = table(spark, x)
    index = HashTables(data, bucket_rows=64)
    assert index.bits == 5
    row = recall(index, as_queries(data.filter("row_id % 50 = 0")), 20).first()
    assert row.n_queries == 30 and row.n_true == 600 and row.n_found >= 540
    few = recall(HashTables(data, bucket_rows=64, tables=1, probes=0), as_queries(data.filter("row_id % 50 = 0")), 20).first()
    assert few.n_found < row.n_found


def test_queries_with_too_few_candidates_are_searched_exactly(spark):
    x = clustered(200)
    index = HashTables(table(spark, x), bits=12, tables=1, probes=0)
    got = found(index.nearest(as_queries(table(spark, x)), 9))
    assert index.short > 0 and all(len(v) == 9 for v in got.values()) and len(got) == 200


def test_stored_buckets_are_not_shuffled_again(spark):
    data = table(spark, clustered(400))
    index = HashTables(data, piece_rows=50)
    plan = index._search(as_queries(data), 5)._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("FlatMapCoGroupsInPandas"):]
    scan = stored[stored.index("bucket") - 3000 if "bucket" in stored else 0:]
    assert "SelectedBucketsCount" in scan or "Bucketed: true" in scan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_lof_over_candidates(spark):
    x = np.vstack([clustered(500), np.random.default_rng(3).normal(size=(10, 16)) * 12])
    data = table(spark, x)
    exact = {r.row_id: r.score for r in det.LOF(15).fit(data).score(data).collect()}
    near = {r.row_id: r.score for r in det.LOF(15, search="hash", bucket_rows=64).fit(data).score(data).collect()}
    assert near.keys() == exact.keys()
    a, b = np.array([exact[k] for k in exact]), np.array([near[k] for k in exact])
    assert np.corrcoef(a, b)[0, 1] > 0.95
    whole = {r.row_id: r.score for r in det.LOF(15, search="hash", bits=0).fit(data).score(data).collect()}
    assert np.allclose([whole[k] for k in exact], a)
    with pytest.raises(ValueError):
        det.LOF(search="other")


def test_copies_and_empty_tables(spark):
    x = np.repeat(clustered(40), 5, axis=0)
    got = det.LOF(5, search="hash", bucket_rows=8).fit(table(spark, x)).score(table(spark, x))
    assert got.count() == 200
    with pytest.raises(ValueError):
        HashTables(table(spark, x).limit(0))
