import numpy as np
import pytest
from pyspark.sql import functions as F

from lonetext.common import join_lookup
from lonetext.operators import detectors as det
from lonetext.operators.detectors import deep, forest, gradient, oneclass
from lonetext.operators.metrics import ranking_metrics
from lonetext.operators.neighbours import Cells


def table(spark, x, y=None, first=0):
    y = [0] * len(x) if y is None else y
    data = [(first + i, [float(v) for v in row], int(t)) for i, (row, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "row_id long, embedding array<double>, y int")


def planted(seed=0, n=300, out=20, dim=8):
    """A tight cloud and far-off points in all directions."""
    rng = np.random.default_rng(seed)
    far = rng.normal(size=(out, dim))
    far *= 8 / np.linalg.norm(far, axis=1, keepdims=True)
    return np.vstack([rng.normal(size=(n, dim)), far]), np.repeat([0, 1], [n, out])


def scores(df):
    return np.array([r.score for r in df.orderBy("row_id").collect()])


def brute_lof(train, rows, k, self_included):
    """All distances; works on rows, not on distinct vectors."""
    k = max(1, min(k, len(train) - 1))
    dist = np.linalg.norm(train[:, None] - train[None], axis=2)
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(np.round(dist, 9), axis=1, kind="stable")[:, :k]
    d = np.take_along_axis(dist, near, 1)
    k_dist = d.max(1)
    lrd = 1 / (np.maximum(k_dist[near], d).mean(1) + 1e-10)
    dist = np.linalg.norm(rows[:, None] - train[None], axis=2)
    near = np.argsort(np.round(dist, 9), axis=1, kind="stable")[:, :k]
    d = np.take_along_axis(dist, near, 1)
    own = 1 / (np.maximum(k_dist[near], d).mean(1) + 1e-10)
    return lrd[near].mean(1) / own


SMALL = dict(cell_rows=40, piece_rows=16, batch_rows=32)


def clustered(seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 3)) * 15
    x = np.vstack([c + rng.normal(size=(20, 3)) for c in centres])
    if copies:
        x = np.vstack([x, np.repeat(x[:1], copies, axis=0)])
    return x


@pytest.mark.parametrize("cells", [{}, SMALL])
@pytest.mark.parametrize("copies", [0, 5, 150])
def test_lof_equals_brute_force(spark, cells, copies):
    x = clustered(1, copies)
    rows = np.vstack([x, clustered(2)[:50]])
    got = scores(det.LOF(10, **cells).fit(table(spark, x)).score(table(spark, rows)))
    want = brute_lof(x, rows, 10, True)
    assert np.allclose(got, want, rtol=1e-7)


def test_lof_with_fewer_rows_than_neighbours(spark):
    x = np.random.default_rng(0).normal(size=(6, 2))
    got = scores(det.LOF(20).fit(table(spark, x)).score(table(spark, x)))
    assert np.allclose(got, brute_lof(x, x, 20, True))


def test_lof_is_one_inside_a_grid(spark):
    x = np.array([(i, j) for i in range(20) for j in range(20)], dtype=float)
    got = scores(det.LOF(8).fit(table(spark, x)).score(table(spark, x))).reshape(20, 20)
    assert np.allclose(got[6:14, 6:14], 1.0, atol=0.05)


@pytest.mark.parametrize("cells", [{}, SMALL])
@pytest.mark.parametrize("bandwidth", [0.2, 1.0])
def test_kde_equals_brute_force(spark, cells, bandwidth):
    x = clustered(3, copies=100)
    rows = np.vstack([x, clustered(4)[:50]])
    got = scores(det.KDE(bandwidth, **cells).fit(table(spark, x)).score(table(spark, rows)))
    logs = -((rows[:, None] - x[None]) ** 2).sum(2) / (2 * bandwidth ** 2)
    top = logs.max(1)
    density = top + np.log(np.exp(logs - top[:, None]).sum(1)) - np.log(len(x)) - 3 * np.log(
        bandwidth * np.sqrt(2 * np.pi))
    assert np.allclose(got, -density, rtol=1e-9)


@pytest.mark.parametrize("cells", [{}, SMALL])
@pytest.mark.parametrize("offset, spread", [(1e4, 0.01), (1e6, 0.01), (1e6, 1.0)])
def test_neighbours_far_from_the_origin(spark, cells, offset, spread):
    x = offset + spread * np.random.default_rng(6).normal(size=(300, 8))
    got = scores(det.LOF(10, **cells).fit(table(spark, x)).score(table(spark, x)))
    assert np.allclose(got, brute_lof(x, x, 10, True), rtol=1e-5)
    bandwidth = 0.2 * spread
    got = scores(det.KDE(bandwidth, **cells).fit(table(spark, x)).score(table(spark, x)))
    logs = -((x[:, None] - x[None]) ** 2).sum(2) / (2 * bandwidth ** 2)
    top = logs.max(1)
    density = top + np.log(np.exp(logs - top[:, None]).sum(1)) - np.log(len(x)) - 8 * np.log(bandwidth * np.sqrt(2 * np.pi))
    assert np.allclose(got, -density, rtol=1e-9, atol=1e-9)


def test_kernel_sums_of_two_far_groups(spark):
    """Centring does not help here: squared distances are taken by differences."""
    r = np.random.default_rng(7)
    x = np.vstack([0.01 * r.normal(size=(60, 3)), 1e6 + 0.01 * r.normal(size=(60, 3))])
    got = scores(det.KDE(0.01).fit(table(spark, x)).score(table(spark, x)))
    logs = -((x[:, None] - x[None]) ** 2).sum(2) / 2e-4
    density = np.log(np.exp(logs).sum(1)) - np.log(len(x)) - 3 * np.log(0.01 * np.sqrt(2 * np.pi))
    assert np.allclose(got, -density, atol=1e-6)


def test_neighbour_search_skips_far_cells(spark):
    x = clustered(5)
    index = Cells(table(spark, x), **SMALL)
    queries = index.locations.select(F.col("loc").alias("qid"), "vec")
    visits = queries.withColumn("cells", index._cells_within()("vec", F.lit(1.0)))
    assert visits.agg(F.avg(F.size("cells"))).first()[0] < len(index.pieces) / 2


def test_hbos_formula(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    x[:, 3] = 2.0  # a constant dimension
    rows = np.vstack([x, [[9, 0, 0, 2], [x[:, 0].max() + 1e-9, 0, 0, 2.4], [0, 0, 0, 3.5]]])
    got = scores(det.HBOS().fit(table(spark, x)).score(table(spark, rows)))
    want = np.zeros(len(rows))
    for j in range(4):
        lo, hi = x[:, j].min(), x[:, j].max()
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / 10
        count = np.bincount(np.minimum(np.floor((x[:, j] - lo) / width), 9).astype(int), minlength=10)
        logs = np.log2(count / (200 * width) + 0.1)
        at = (rows[:, j] - lo) / width
        inside = np.clip(np.floor(at), 0, 9).astype(int)
        want -= np.where((at >= -0.5) & (at <= 10.5), logs[inside], logs.min())
    assert np.allclose(got, want, atol=1e-6)
    shuffled = scores(det.HBOS().fit(table(spark, x).orderBy(F.rand(1))).score(table(spark, rows)))
    assert np.allclose(got, shuffled)


def test_pca_is_the_mahalanobis_distance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 3
    got = scores(det.PCADetector().fit(table(spark, x)).score(table(spark, x)))
    z = (x - x.mean(0)) / x.std(0)
    want = np.einsum("ij,jk,ik->i", z, np.linalg.inv(np.cov(z.T)), z)
    # Spark's projection is not centred, but z is.
    assert np.allclose(got, want, rtol=1e-6)


def test_pca_with_a_constant_dimension(spark):
    x = np.random.default_rng(0).normal(size=(100, 3))
    with_constant = np.hstack([x, np.full((100, 1), 7.0)])
    a = scores(det.PCADetector().fit(table(spark, x)).score(table(spark, x)))
    b = scores(det.PCADetector().fit(table(spark, with_constant)).score(table(spark, with_constant)))
    assert np.allclose(a, b, rtol=1e-6)


def test_forest(spark):
    x, y = planted()
    data = table(spark, x, y)
    a = det.IsolationForest(max_samples=64).fit(data)
    roots = a.nodes[a.nodes["node"] == 0]
    assert len(roots) == 100 and (roots["size"] == 64).all()
    inner = a.nodes[a.nodes["feature"] >= 0]
    sizes = {(t, n): s for t, n, s in a.nodes[["tree", "node", "size"]].itertuples(index=False)}
    assert all(sizes[r.tree, r.low] + sizes[r.tree, r.high] == r.size for r in inner.itertuples())
    out = a.score(data, uncertainty=True).toPandas()
    assert out["score"].between(0, 1).all() and (out["uncertainty"] >= 0).all()
    b = det.IsolationForest(max_samples=64).fit(data.repartition(7))
    assert a.nodes.equals(b.nodes)
    # One row walked by hand.
    one = out[out["row_id"] == 5].iloc[0]
    paths = []
    for tree in range(100):
        nodes = a.nodes[a.nodes["tree"] == tree].set_index("node")
        at, depth = 0, 0
        while nodes.loc[at, "feature"] >= 0:
            below = x[5][nodes.loc[at, "feature"]] <= nodes.loc[at, "threshold"]
            at, depth = int(nodes.loc[at, "low" if below else "high"]), depth + 1
        paths.append(depth + forest.mean_path(nodes.loc[at, "size"]))
    assert one["score"] == pytest.approx(2 ** -(np.mean(paths) / forest.mean_path(64)))


def test_forest_keeps_trees_whole_when_the_first_draw_falls_short(spark, monkeypatch):
    data = table(spark, np.random.default_rng(0).normal(size=(400, 2)))
    plain = det.IsolationForest._nodes
    shares = []

    def meagre(self, train, share):
        shares.append(share)
        return plain(self, train, share / 8)

    monkeypatch.setattr(det.IsolationForest, "_nodes", meagre)
    fitted = det.IsolationForest(n_trees=5, max_samples=32).fit(data)
    assert len(shares) > 1 and (fitted.nodes[fitted.nodes["node"] == 0]["size"] == 32).all()


PLAIN = {"forest": det.IsolationForest, "lof": lambda: det.LOF(30), "hbos": det.HBOS, "kde": det.KDE,
         "pca": det.PCADetector, "ocsvm": lambda: det.OCSVM(epochs=40),
         "autoencoder": lambda: det.AutoEncoder(hidden=(6, 3), epochs=60),
         "vae": lambda: det.VariationalAutoEncoder(hidden=(6,), epochs=40),
         "svdd": lambda: det.DeepSVDD(epochs=20, rep_dim=16)}


@pytest.mark.parametrize("name", PLAIN)
def test_planted_outliers_are_found(spark, name):
    x, y = planted()
    data = table(spark, x, y)
    assert ranking_metrics(PLAIN[name]().fit(data).score(data)).first().auc > 0.9


SEMI = {"sad": lambda: det.DeepSAD(epochs=40, rep_dim=16), "devnet": lambda: det.DevNet(epochs=40),
        "mlp": lambda: det.MLP(epochs=40), "xgbod": lambda: det.XGBOD([det.IsolationForest(20)], max_iter=5)}


@pytest.mark.parametrize("name", SEMI)
def test_known_anomalies_lead_to_unseen_ones(spark, name):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(400, 6)), rng.normal(size=(40, 6)) + 2.5])
    y = np.repeat([0, 1], [400, 40])
    data = table(spark, x, y).withColumn("y_semi", F.col("y"))
    seen = F.col("row_id") % 4 != 0
    detector = SEMI[name]()
    assert detector.uses_labels
    scored = detector.fit(data.filter(seen)).score(data.filter(~seen))
    assert scored.columns == [*data.columns, "score"]
    assert ranking_metrics(scored).first().auc > 0.9


def numeric_gradient(loss, theta):
    out = np.zeros_like(theta)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        out[i] = (loss(theta + step) - loss(theta - step)) / 2e-6
    return out


def test_gradients():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, 4))
    for bias in (True, False):
        net = gradient.Net([4, 5, 3], bias)
        theta = net.initial(rng) + 0.01
        known = np.array([True, False] * 3 + [True])

        def loss(t):
            return deep.centre_loss(net.forward(t, x)[-1] - 0.3, known)[0]

        values = net.forward(theta, x)
        got = net.backward(theta, values, deep.centre_loss(values[-1] - 0.3, known)[1])[0]
        assert np.allclose(got, numeric_gradient(loss, theta), rtol=1e-3, atol=1e-4)

    encoder, decoder = gradient.Net([4, 5, 4]), gradient.Net([2, 5, 4])
    theta, noise = np.concatenate([encoder.initial(rng), decoder.initial(rng)]), rng.normal(size=(7, 2))
    got = deep.vae_loss(encoder, decoder, theta, x, noise)[1]
    assert np.allclose(got, numeric_gradient(lambda t: deep.vae_loss(encoder, decoder, t, x, noise)[0], theta),
                       rtol=1e-3, atol=1e-4)

    phi, theta = rng.normal(size=(20, 6)), rng.normal(size=7)
    got = oneclass.one_class_loss(theta, phi, 0.3)[1]
    assert np.allclose(got, numeric_gradient(lambda t: oneclass.one_class_loss(t, phi, 0.3)[0], theta), atol=1e-4)

    score = rng.normal(size=9) * 4
    known = np.arange(9) % 3 == 0
    got = deep.deviation_loss(score, known, 0.1, 0.9, 5.0, 2.0)[1]
    assert np.allclose(got, numeric_gradient(lambda s: deep.deviation_loss(s, known, 0.1, 0.9, 5.0, 2.0)[0], score),
                       atol=1e-4)


def test_fourier_features_approach_the_kernel():
    rng = np.random.default_rng(0)
    x, gamma = rng.normal(size=(30, 4)), 0.3
    phi = oneclass.fourier_features(x, rng.normal(0, np.sqrt(2 * gamma), (4, 20_000)), rng.uniform(0, 2 * np.pi, 20_000))
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(phi @ phi.T - kernel).max() < 0.05


def test_row_noise():
    a = deep.row_noise(np.arange(50_000), 3, 2, 42)
    assert abs(a.mean()) < 0.02 and abs(a.std() - 1) < 0.02 and abs(np.corrcoef(a.T)[0, 1]) < 0.02
    assert np.array_equal(a[10:20], deep.row_noise(np.arange(10, 20), 3, 2, 42))
    assert not np.array_equal(a, deep.row_noise(np.arange(50_000), 4, 2, 42))


def test_a_fit_takes_many_steps_in_few_jobs(spark, monkeypatch):
    x, y = planted()
    data = table(spark, x, y)
    one = det.AutoEncoder(hidden=(6, 3), epochs=30).fit(data)
    assert one.loop.jobs == 5 and len(one.loop.history) == 30 and one.loop.history[-1] < 0.9 * one.loop.history[0]
    assert det.AutoEncoder(hidden=(6, 3), epochs=3).fit(data).loop.jobs == 3
    again = det.AutoEncoder(hidden=(6, 3), epochs=30).fit(data.repartition(9))
    assert np.array_equal(one.theta, again.theta)  # however the rows are dealt out
    with pytest.raises(ValueError):
        det.AutoEncoder(hidden=(6, 3), epochs=1).fit(data.limit(0))


def test_shards_are_averaged(spark, monkeypatch):
    x, y = planted()
    data = table(spark, x, y)
    monkeypatch.setattr(gradient, "MAX_PARTIALS", 2)
    monkeypatch.setattr(gradient, "MAX_BUCKETS", 3)
    many = det.AutoEncoder(hidden=(6, 3), epochs=60, shard_rows=50).fit(data)
    assert many.loop.shards > 5 and many.loop.buckets == 3 and many.loop.jobs == 5
    assert many.loop.history[-1] < 0.9 * many.loop.history[0]
    assert np.allclose(many.theta, det.AutoEncoder(hidden=(6, 3), epochs=60, shard_rows=50).fit(data.repartition(7)).theta,
                       atol=1e-9)
    assert ranking_metrics(many.score(data)).first().auc > 0.9
    by_shard = plan_of(many.loop.table.groupBy("shard").applyInPandas(lambda f: f[["shard"]], "shard int"))
    assert "Exchange" not in by_shard  # rows were shuffled once, when they were stored


STORED = {**{k: PLAIN[k] for k in ("ocsvm", "autoencoder", "vae", "svdd")}, "inlier": lambda: det.OCSVM(epochs=3, orientation="inlier"),
          **{k: SEMI[k] for k in ("sad", "devnet", "mlp")}}


@pytest.mark.parametrize("name", STORED)
def test_scores_of_stored_weights_in_two_engines(spark, tmp_path, name):
    import duckdb

    x, y = planted()
    data = table(spark, x, y).withColumn("y_semi", F.col("y"))
    fitted = STORED[name]().fit(data)
    want = dict(fitted.score(data).select("row_id", "score").collect())
    if name == "mlp":
        want = {k: np.log(v / (1 - v)) for k, v in want.items()}
    model = fitted.stored()
    got = dict(model.score(data).collect())
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-6, atol=1e-6)
    model.table(spark).write.parquet(str(tmp_path / "weights"))
    data.select("row_id", F.posexplode("embedding").alias("i", "x")).write.parquet(str(tmp_path / "vectors"))
    con = duckdb.connect()
    for view in ("weights", "vectors"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{tmp_path / view}/*.parquet'")
    other = dict(con.execute(model.sql()).fetchall())
    assert np.allclose([other[k] for k in want], list(want.values()), rtol=1e-6, atol=1e-6)


def test_lookup_join_with_hot_keys(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 50).alias("k"))
    lookup = spark.range(60).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    plain = rows.join(lookup, "k")
    hot = join_lookup(rows, lookup, "k", hot_rows=100, hot_keys=1)
    assert sorted(hot.collect()) == sorted(plain.select(hot.columns).collect())
    assert sorted(join_lookup(rows, lookup, "k", n_rows=10).collect()) == sorted(plain.collect())
    counts = rows.groupBy("k").agg(F.count("*").alias("w"))
    known = join_lookup(rows, lookup, "k", counts=counts, hot_rows=40, hot_keys=5)
    assert sorted(known.collect()) == sorted(plain.select(known.columns).collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_wise_scoring_does_not_shuffle(spark):
    x, y = planted()
    data = table(spark, x, y)
    for detector in (det.HBOS(), det.IsolationForest(10), det.PCADetector(), det.OCSVM(epochs=1)):
        assert "Exchange" not in plan_of(detector.fit(data).score(data))


def test_neighbour_scores_need_no_cross_join(spark):
    x, y = planted()
    data = table(spark, x, y)
    for detector in (det.LOF(10, **SMALL), det.KDE(**SMALL)):
        plan = plan_of(detector.fit(data).score(data))
        assert not any(bad in plan for bad in ("Cartesian", "NestedLoop", "SinglePartition"))


def test_row_wise_scores_apply_to_a_stream(spark, tmp_path):
    x, y = planted()
    data = table(spark, x, y)
    data.write.parquet(str(tmp_path / "in"))
    fitted = det.IsolationForest(20).fit(data)
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    running = (fitted.score(stream).writeStream.format("parquet").trigger(availableNow=True)
               .option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out")))
    running.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert np.allclose(scores(got), scores(fitted.score(data)))


def test_kde_of_rows_that_were_trained_on_and_others(spark):
    """Training vectors give each other their sums; other rows, few rows and vectors that share a name are summed apart."""
    rng = np.random.default_rng(8)
    x, new = rng.normal(size=(90, 3)), rng.normal(size=(30, 3)) + 40
    fitted = det.KDE(0.7, **SMALL).fit(table(spark, x))
    rows = np.vstack([x, new])
    d2 = ((rows[:, None] - x[None]) ** 2).sum(2) / (2 * 0.7 ** 2)
    least = d2.min(1)
    want = (np.log(90) + 3 * np.log(0.7 * np.sqrt(2 * np.pi)) + least - np.log(np.exp(least[:, None] - d2).sum(1)))
    np.testing.assert_allclose(scores(fitted.score(table(spark, rows))), want, rtol=1e-9)
    assert fitted.own is not None
    few = det.KDE(0.7, **SMALL).fit(table(spark, x))
    np.testing.assert_allclose(scores(few.score(table(spark, x[:20]))), want[:20], rtol=1e-9)
    assert few.own is None
    named = table(spark, x).withColumn("row_id", F.floor(F.col("row_id") / 2))
    twice = det.KDE(0.7, **SMALL).fit(named)
    twice.score(table(spark, x)).count()
    assert twice.own is None
