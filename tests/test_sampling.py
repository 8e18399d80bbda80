import hashlib
from math import ceil

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lonetext.operators import labelling as lab
from lonetext.operators import sampling as smp


def rows(spark, labels, name="y"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(labels)], f"row_id long, {name} int")


def place(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def ids(df):
    return {r.row_id for r in df.collect()}


def test_pick_is_the_k_smallest_hashes_per_group(spark):
    data = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("g"))
    quotas = [(0, 1), (1, 250), (2, 1000)]
    got = ids(smp.flag_picked(data, ["g"], quotas, seed=7).filter("picked"))
    want = set()
    for g, k in quotas:
        want |= set(sorted(range(g, 3000, 3), key=lambda i: (place(7, i), i))[:k])
    assert got == want


def test_pick_with_a_null_group_and_no_quota(spark):
    data = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "row_id long, g string")
    got = smp.flag_picked(data, ["g"], [(None, 3)]).filter("picked").collect()
    assert len(got) == 3 and all(r.g is None for r in got)


def test_smaller_picks_are_part_of_larger_ones(spark):
    data = rows(spark, [1] * 200)
    previous = set()
    for k in (0, 1, 17, 199, 200):
        now = ids(smp.flag_picked(data, ["y"], [(1, k)]).filter("picked"))
        assert len(now) == k and previous <= now
        previous = now


def test_pick_does_not_depend_on_partitions(spark):
    data = rows(spark, [i % 2 for i in range(500)])
    a = ids(smp.flag_picked(data.repartition(13), ["y"], [(1, 40)]).filter("picked"))
    b = ids(smp.flag_picked(data.coalesce(1), ["y"], [(1, 40)]).filter("picked"))
    assert a == b


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=12), st.data())
def test_proportional_quotas(spark, sizes, data):
    total = data.draw(st.integers(0, sum(sizes)))
    table = spark.createDataFrame(list(enumerate(sizes)), "y long, n long")
    quotas = [r._k for r in smp.proportional_quotas(table, "y", total).orderBy("y").collect()]
    assert sum(quotas) == total
    for n, k in zip(sizes, quotas):
        assert abs(k - n * total / sum(sizes)) < 1 and 0 <= k <= n


def test_split_hand_case(spark):
    out = smp.stratified_split(rows(spark, [0] * 59 + [1] * 2))
    assert {(r.split, r.y): r["count"] for r in out.groupBy("split", "y").count().collect()} == {
        ("train", 0): 46, ("train", 1): 2, ("test", 0): 13}


def test_split_is_complete_and_of_exact_size(spark):
    out = smp.stratified_split(rows(spark, [int(i % 7 == 0) for i in range(333)]), test_size=0.3)
    assert out.count() == 333 and out.select("row_id").distinct().count() == 333
    assert out.filter("split = 'test'").count() == ceil(0.3 * 333)


def test_split_needs_two_rows_per_class(spark):
    with pytest.raises(ValueError):
        smp.stratified_split(rows(spark, [0, 0, 0, 1]))


def test_contamination(spark):
    out = smp.adjust_contamination(rows(spark, [0] * 100 + [1] * 20), 0.05)
    assert out.filter("y = 0").count() == 100 and out.filter("y = 1").count() == 5


def test_contamination_with_too_few_anomalies(spark):
    with pytest.raises(ValueError):
        smp.adjust_contamination(rows(spark, [0] * 100 + [1] * 2), 0.05)


@pytest.mark.parametrize("n_known, contamination, expected", [(2, 0.9, 2), (99, None, 4), (None, 0.05, 4),
                                                              (None, 0.02, 1), (0, None, 0)])
def test_known_labels(spark, n_known, contamination, expected):
    data = rows(spark, [0] * 80 + [1] * 4)
    out = smp.partial_labels(data, n_known=n_known, contamination=contamination)
    assert out.count() == 84
    assert out.filter("y_semi = 1").count() == expected
    assert out.filter("y_semi = 1 and y = 0").count() == 0


def test_known_labels_need_an_amount(spark):
    with pytest.raises(ValueError):
        smp.partial_labels(rows(spark, [0, 1]))


def test_grid_equals_single_scenarios(spark):
    data = rows(spark, [int(i % 4 == 0) for i in range(400)])
    grid = smp.partial_labels_grid(data, [0.02, 0.1], 2, seed=5)
    assert grid.count() == 400 * 4
    for level in (0.02, 0.1):
        for r in range(2):
            single = smp.partial_labels(data, contamination=level, seed=5 + r)
            here = grid.filter((F.col("contamination") == level) & (F.col("round") == r))
            assert ids(here.filter("y_semi = 1")) == ids(single.filter("y_semi = 1"))
    marked, places = smp.partial_labels_per_scenario(data, [0.02, 0.1], 2, seed=5)
    assert sorted(places) == [(0.02, 0), (0.02, 1), (0.1, 0), (0.1, 1)]
    for (level, r), at in places.items():
        single = smp.partial_labels(data, contamination=level, seed=5 + r)
        out = marked.withColumn("y_semi", F.col("semi")[at]).select(*single.columns)
        assert sorted(out.collect()) == sorted(single.collect())


def test_many_classes(spark):
    """Class counts stay a table, whatever their number."""
    data = spark.range(6000).select(F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 1500).alias("label"))
    out = smp.stratified_sample(data, 2000)
    sizes = [r["count"] for r in out.groupBy("label").count().collect()]
    assert sum(sizes) == 2000 and set(sizes) == {1, 2} and len(sizes) == 1500


def test_head_sample(spark):
    data = spark.range(0, 3000, 3).select(F.col("id").alias("row_id"), F.lit("t").alias("text")).repartition(7)
    for k in (0, 1, 17, 999, 1000, 5000):
        assert ids(smp.head_sample(data, k)) == set(range(0, 3 * min(k, 1000), 3))


def test_split_needs_a_row_of_every_class_on_both_sides(spark):
    with pytest.raises(ValueError):
        smp.stratified_split(rows(spark, [i // 2 for i in range(12)]), test_size=0.2)


def test_stratified_sample(spark):
    data = rows(spark, [0] * 700 + [1] * 200 + [2] * 100, "label")
    out = smp.stratified_sample(data, 50)
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0: 35, 1: 10, 2: 5}
    assert smp.stratified_sample(data, 1000).count() == 1000


def test_sampling_strategies(spark):
    data = rows(spark, range(30), "label")
    assert ids(smp.sample_rows(data, 4, "head")) == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        smp.sample_rows(data, 4, "other")


@pytest.mark.parametrize("k", [0, 1, 7, 1000, 19_999, 20_000, 30_000])
def test_head_sample(spark, k):
    data = spark.range(20_000).select((F.col("id") * F.col("id")).alias("row_id"))  # uneven ids
    out = smp.head_sample(data.repartition(5), k)
    assert sorted(ids(out)) == [i * i for i in range(min(k, 20_000))]
    assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()


def test_majority_tie_goes_to_the_smallest_label(spark):
    data = spark.createDataFrame([(i, v) for i, v in enumerate("bbaac")], "row_id long, label string")
    assert lab.majority_label(data).first().label == "a"
    out = {r.row_id: r.y for r in lab.label_binary(data).collect()}
    assert out == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1}
    assert {r.label for r in lab.label_binary(data, normal_label="c").filter("y = 0").collect()} == {"c"}


def test_missing_labels_are_anomalies(spark):
    data = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, None), (4, None)], "row_id long, label string")
    assert [r.y for r in lab.label_binary(data).orderBy("row_id").collect()] == [0, 0, 1, 1, 1]
    report = {r.label: (r.n, r.role) for r in lab.class_report(data).collect()}
    assert report == {"a": (2, "normal"), None: (3, "anomaly")}


def test_wide_rows_are_not_shuffled_by_a_pick(spark, sf):
    data = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "row_id")
    picked = smp.flag_picked(data, ["label"], [(1, 3)])
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan
