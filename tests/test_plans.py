import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lonetext.operators.detectors import HBOS, MLP, Detector, IsolationForest
from lonetext.operators.sampling import partial_labels_per_scenario
from lonetext.plans import benchmark, pairs, report
from lonetext.sources.results import RESULT_SCHEMA, as_csv_rows, read_log, read_results


class Broken(Detector):
    def fit(self, train):
        return self

    def score(self, rows):
        return rows.withColumn("score", F.raise_error(F.lit("no score")).cast("double"))


@pytest.fixture(scope="module")
def data(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "row_id")
    return benchmark.prepare(vectors, 0.5)


def test_unsupervised_run_survives_a_failing_model(spark, data):
    out = benchmark.run_unsupervised(data, {"HBOS": HBOS, "Broken": Broken, "IForest": IsolationForest}, "d")
    assert out.schema.names == RESULT_SCHEMA.names
    rows = {r.model: r for r in out.collect()}
    assert set(rows) == {"HBOS", "Broken", "IForest"} and len({r.run_id for r in rows.values()}) == 1
    good, bad = rows["HBOS"], rows["Broken"]
    assert good.contamination is None and good.round == 0 and good.n_known_outliers == 0
    assert good.train_auc_semi is None and good.train_ap_semi == 0.0 and 0 < good.test_auc < 1 and good.error is None
    assert good.train_size + good.test_size == data.count()
    assert "no score" in bad.error and bad.test_auc is None


def test_semisupervised_run(spark, data):
    rows, log = benchmark.run_semisupervised(data, {"MLP": lambda: MLP(max_iter=5), "HBOS": HBOS}, "d",
                                             levels=(0.05, 0.2), n_rounds=2)
    rows = rows.collect()
    assert len(rows) == 8 and len({r.run_id for r in rows}) == 4
    lists = {r.run_id: json.loads(r.indices) for r in as_csv_rows(log).collect()}
    train = data.filter("split = 'train'")
    outliers = {r.row_id for r in train.filter("y = 1").collect()}
    for r in rows:
        assert r.n_known_outliers == len(lists[r.run_id]) == int(r.contamination * r.train_size)
        assert set(lists[r.run_id]) <= outliers


def test_evaluate_model_returns_scores(spark, data):
    row, scores = benchmark.evaluate_model(IsolationForest(10), data.withColumn("y_semi", F.col("y")), uncertainty=True)
    assert scores.columns == ["row_id", "split", "y", "y_semi", "score", "uncertainty"]
    assert scores.count() == data.count() and row.first().train_auc == row.first().train_auc_semi


def test_parallel_fits_change_nothing(spark, data):
    models = {"HBOS": HBOS, "IForest": lambda: IsolationForest(10), "Broken": Broken}
    one = benchmark.run_unsupervised(data, models, "d", "r").drop("error").collect()
    three = benchmark.run_unsupervised(data, models, "d", "r", parallel=3).drop("error").collect()
    assert sorted(one, key=str) == sorted(three, key=str)


def test_high_rates_reveal_every_outlier(spark, data):
    rows, _ = benchmark.run_semisupervised(data, {"HBOS": HBOS}, "d", levels=(0.9,), n_rounds=1)
    row = rows.first()
    assert row.n_known_outliers == data.filter("split = 'train' and y = 1").count()
    assert row.train_auc == row.train_auc_semi


def test_grid_survives_a_failing_pair(spark, sf, tmp_path):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "row_id")
    pairs = {"good": lambda: vectors, "few": lambda: vectors.filter("label = 0")}
    root = str(tmp_path / "results")
    out, log = benchmark.run_grid(pairs, {"HBOS": HBOS}, {"MLP": lambda: MLP(epochs=3)}, share=0.5, root=root)
    rows = {(r.dataset, r.model): r for r in out.collect()}
    assert set(rows) == {("good", "HBOS"), ("good", "MLP"), ("few", None)}
    assert "not enough anomalies" in rows["few", None].error
    assert read_results(spark, root, dataset="good").count() == 2
    known = rows["good", "MLP"].n_known_outliers
    assert known > 0 and log.count() == known == read_log(spark, root).count()


def test_scratch_tables_go_with_their_pair(spark, sf, tmp_path, monkeypatch):
    written = []
    for module in (benchmark, pairs):
        monkeypatch.setattr(module, "write_out", lambda *a, f=module.write_out, **k: written.append((k.get("keep"), f(*a, **k))) or written[-1][1])
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "row_id")
    out, log = benchmark.run_grid({"p": lambda: vectors}, {"HBOS": HBOS}, {}, share=0.5)
    assert out.count() == 1 and log.count() > 0 and len(written) > 3
    for keep, df in written:
        folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").split("/pair=")[0].split("/split=")[0]
        assert os.path.exists(folder.replace("//", "")) is bool(keep)


def test_study_over_pairs_of_datasets_and_encoders(spark, sf, monkeypatch):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "row_id")
    pairs, seen = spark.createDataFrame([("a", "en", "x"), ("a", "en", "y")], "dataset string, lang string, encoder string"), []

    class Asked(HBOS):
        def score(self, rows, uncertainty=False):
            seen.append(uncertainty)
            return super().score(rows)

    out, _ = benchmark.run_study(lambda d, e: vectors, pairs, spark, unsupervised={"U": Asked, "P": Asked}, semisupervised={},
                                 share=0.5, uncertainty=["U"], normal_labels={"a/y": [0, 1, 2]})
    rows = {(r.dataset, r.model): r for r in out.collect()}
    assert set(rows) == {("a/x", "U"), ("a/x", "P"), ("a/y", "U"), ("a/y", "P")} and sorted(seen) == [False, False, True, True]
    assert rows["a/y", "P"].train_size > rows["a/x", "P"].train_size


def test_training_reads_stored_labels(spark, data):
    """No hash, join or sort stands between a training pass and the files."""
    plans = []

    class Looks(HBOS):
        def fit(self, train):
            plans.append(train._jdf.queryExecution().executedPlan().toString())
            return super().fit(train)

    benchmark.run_semisupervised(data, {"L": Looks}, "d", levels=(0.1,), n_rounds=1)
    assert plans and all(w not in plans[0] for w in ("md5", "Join", "Exchange")) and "PartitionFilters: [isnotnull(split" in plans[0]


def test_default_models_are_all_there():
    assert len(benchmark.UNSUPERVISED) == 8 and len(benchmark.SEMI_SUPERVISED) == 4


def test_histogram_densities_sum_to_one(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(i % 5 == 0), float(v)) for i, v in enumerate(rng.normal(size=500))],
                               "y int, score double")
    out = report.score_histogram(df)
    sums = out.groupBy("label").agg(F.sum(F.col("density") * (F.col("hi") - F.col("lo"))).alias("s")).collect()
    assert {r.label: round(r.s, 9) for r in sums} == {"Normal": 1.0, "Anomaly": 1.0}
    assert out.agg(F.max("bin")).first()[0] == 29
    same = report.score_histogram(df.withColumn("score", F.lit(2.0)))
    assert same.agg(F.sum("n")).first()[0] == 500


def test_density_curve(spark):
    rng = np.random.default_rng(0)
    s = rng.normal(size=400)
    df = spark.createDataFrame([(0, float(v)) for v in s], "y int, score double")
    got = report.score_density(df, 50).orderBy("point").toPandas()
    bw = s.std(ddof=1) * 400 ** -0.2
    x = np.linspace(s.min(), s.max(), 50)
    want = np.exp(-0.5 * ((x[:, None] - s) / bw) ** 2).mean(1) / (bw * np.sqrt(2 * np.pi))
    assert np.allclose(got["x"], x) and np.allclose(got["density"], want)


def test_curves(spark):
    data = [("a", "m", "d", 0, 5, 50, 0.6), ("b", "m", "d", 1, 5, 50, 0.8), ("c", "m", "d", 0, 10, 50, 0.9),
            ("d", "m", "d", 1, 10, 50, None)]
    df = spark.createDataFrame(data, "run_id string, model string, dataset string, round int, n_known_outliers int, "
                                     "train_size int, test_auc double")
    rows = report.curve_percent(df, sort=True, interval="normal").collect()
    assert [(r.labeled_percentage, r.n) for r in rows] == [(10.0, 2), (20.0, 1)]
    assert rows[0]["mean"] == pytest.approx(0.7) and rows[0].hi - rows[0].lo == pytest.approx(2 * 1.96 * 0.1)
    known = report.curve_known(df, sort=True).collect()
    assert [r.n_known_outliers for r in known] == [5, 10]
    assert (known[0].lo, known[0].hi) == pytest.approx((0.6, 0.8)) and (known[1].lo, known[1].hi) == (None, None)
    with pytest.raises(ValueError):
        report.curve_known(df, interval="other")


def test_bootstrap_interval_is_that_of_resampling(spark):
    values = np.random.default_rng(5).normal(0.7, 0.1, 200)
    df = spark.createDataFrame([(f"r{i}", "m", "d", 0, float(v)) for i, v in enumerate(values)],
                               "run_id string, model string, dataset string, round int, v double")
    got = report.bootstrap_interval(df, ["model"], "v", replicates=2000).first()
    draws = np.random.default_rng(6).choice(values, (4000, 200)).mean(1)
    assert np.allclose([got.lo, got.hi], np.percentile(draws, [2.5, 97.5]), atol=0.003)
    again = report.bootstrap_interval(df.repartition(5), ["model"], "v", replicates=2000).first()
    assert (again.lo, again.hi) == pytest.approx((got.lo, got.hi), abs=1e-12)


def test_poisson_weights_follow_the_law(spark):
    rows = spark.range(20_000).select(F.col("id").alias("replicate"), F.lit("x").alias("run_id"))
    found = dict(rows.select(report.poisson_weight("replicate", ["run_id"], 1).alias("w")).groupBy("w").count().collect())
    for k, p in ((0, 0.3679), (1, 0.3679), (2, 0.1839), (3, 0.0613)):
        assert abs(found[k] / 20_000 - p) < 0.015


def picks(df):
    return sorted((r.row_id, r.y, r.split) for r in df.select("row_id", "y", "split").collect())


def test_pairs_are_prepared_as_single_tables_are(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "row_id")
    tables = {"all": vectors, "text": vectors.withColumn("label", F.concat(F.lit("c"), (F.col("label") % 3).cast("string"))),
              "nulls": vectors.withColumn("label", F.when(F.col("label") > 1, F.col("label"))),
              "few": vectors.filter("label = 0"), "two": vectors.filter("label < 2"), "named": vectors}
    rows, bad = pairs.prepare_pairs(pairs.stack_pairs(tables), 0.3, normal={"named": [1, 2]})
    assert {r.pair: r.error.split(",")[0] for r in bad.collect()}.keys() == {"few"} and "not enough anomalies" in bad.first().error
    for name, df in tables.items():
        if name != "few":
            one = benchmark.prepare(df, 0.3, normal_label=[1, 2] if name == "named" else None)
            assert picks(rows.filter(F.col("pair") == name)) == picks(one), name
    marked, places = pairs.with_scenarios(rows, (0.01, 0.05), 2, 42)
    one = benchmark.prepare(vectors, 0.3)
    single, where = partial_labels_per_scenario(one.filter("split = 'train'"), (0.01, 0.05), 2, 42)
    assert places == where
    got = {r.row_id: r.semi for r in marked.filter("pair = 'all' AND split = 'train'").collect()}
    assert got == {r.row_id: r.semi for r in single.collect()} and sum(map(sum, got.values())) > 4
    assert marked.filter("split = 'test'").select(F.max(F.array_max("semi"))).first()[0] == 0


def test_jobs_of_the_preparation_do_not_grow_with_pairs(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "row_id")

    def jobs(n):
        group = f"pairs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        rows, bad = pairs.prepare_pairs(pairs.stack_pairs({f"p{i}": vectors for i in range(n)}), 0.3)
        pairs.with_scenarios(rows, (0.05,), 1)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(8) <= jobs(2) + 4  # small joins may be broadcast or not


def test_a_pair_whose_rows_fail_does_not_stop_the_grid(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "row_id")
    broken = vectors.withColumn("label", F.raise_error(F.lit("broken rows")).cast("int"))

    def missing():
        raise OSError("no such table")

    out, _ = benchmark.run_grid({"ok": lambda: vectors, "bad": lambda: broken, "gone": missing}, {"HBOS": HBOS}, {}, share=0.5)
    rows = {r.dataset: r for r in out.collect()}
    assert rows["ok"].error is None and "broken rows" in rows["bad"].error and "no such table" in rows["gone"].error
