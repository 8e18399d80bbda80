import corpus_pipeline as cp
import pytest
from llm_rows import prose
from lonetext.llm import decontamination, jaccard_join
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, result = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        result.append((name, before, docs))
    return result


def test_order_and_columns(stages):
    assert [n for n, *_ in stages] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans",
                                       "mixing sources to target weights"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes and after.count() > 0


def test_quality_keeps_good_documents(spark, sf, stages):
    kept = {r.doc_id for r in stages[0][2].collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    assert sum(good) / len(good) > 0.97
    bad = [r.doc_id not in kept for r in labels if r.quality == 0]
    assert sum(bad) / len(bad) > 0.7


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    groups = jaccard_join.join_components(before, cp.SHINGLE_WORDS, cp.SHARE_PERCENT).groupBy("component_id").agg(F.min("doc_id").alias("keeper")).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.keeper for r in groups)


def test_no_benchmark_passage_is_left(spark, sf, stages):
    _, before, after = stages[2]
    items = [decontamination.folded(r.text.encode()).tobytes() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in before.collect() if any(i in decontamination.folded((r.text or "").encode()).tobytes() for i in items)}
    left = {r.doc_id for r in after.collect()}
    assert dirty and not dirty & left and left == {r.doc_id for r in before.collect()} - dirty


def test_secrets_are_hidden_and_other_texts_untouched(stages):
    _, before, after = stages[3]
    old, new = ({r.doc_id: r for r in x.collect()} for x in (before, after))
    assert old.keys() == new.keys()
    changed = [i for i in old if old[i].text != new[i].text]
    assert all("[SECRET]" in new[i].text and new[i].n_chars == len(new[i].text) for i in changed)
    assert not any("AKIA" in (r.text or "") or "password=" in (r.text or "") for r in new.values())


def test_hidden_secrets(spark, sf):
    docs = spark.createDataFrame([(1, "a token=abcdefgh b", "en", "x", 18), (2, "plain", "en", "x", 99)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r.text, r.n_chars) for r in cp.hide_secrets(spark, docs, sf).collect()] == [("a [SECRET] b", 12), ("plain", 99)]


def test_mix_keeps_every_document(stages):
    _, before, after = stages[4]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect())
    per = after.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal")).collect()
    assert all(abs(r.t - r.goal) <= 1 for r in per)


def test_odd_documents_go_through(spark, sf):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, prose(1, 80), "en", "a", 1), (2, prose(1, 80), "en", "a", 1),
            (3, prose(1, 80), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect() or [], stage(spark, docs, sf).schema)
    assert {r.doc_id for r in docs.collect()} <= {1, None, 2}


CLASHING = ("kept", "score", "text_score", "page_score", "row_key", "contamination", "secret_found", "secrets")


def test_columns_named_like_added_ones_keep_their_values(spark, sf):
    docs = spark.createDataFrame([(i, prose(i, 80) + (" token=abcdefgh" if i == 3 else ""), "en", "a", 400) for i in range(12)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        for r in after.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHING) and "abcdefgh" not in str(r[c] for c in CLASHING)


def test_an_empty_table_goes_through(spark, sf):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.collect() == []
