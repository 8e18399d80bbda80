import numpy as np
import pyarrow as pa
from llm_rows import docs_of, odd_rows, prose
from lonetext.llm import quality_classifier as qc


def labelled(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, 40 + i % 60)
        rows.append((i, text.replace(" ", "$$$ ") if bad else text, "en", "spam" if bad else f"s{i % 5}", len(text)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = labelled(spark)
    known = {r.doc_id for r in labels.collect()}
    scored = qc.classify(docs_of(spark, rows), labels).collect()
    right = [r.kept == (r.doc_id % 4 != 0) for r in scored if r.doc_id not in known]
    assert np.mean(right) > 0.98 and all(0 <= r.score <= 1 for r in scored)


def test_views_exchange_pseudo_labels():
    r = np.random.default_rng(0)
    y = (r.random(60) < 0.5).astype(float)
    pool = (r.random(500) < 0.5).astype(float)
    make = lambda t, k: t[:, None] * 3 + r.normal(size=(len(t), k))
    model = qc.co_train(make(y, 2), make(y, 3), y, make(pool, 2), make(pool, 3), per_round=50, sure=0.9)
    assert model.given[0][0] > 0 and model.given[0][1] > 0
    test = (r.random(500) < 0.5).astype(float)
    a, b, both = model.scores(make(test, 2), make(test, 3))
    error = lambda p: np.mean((p > 0.5) != test)
    assert error(both) <= min(error(a), error(b)) + 0.02


def test_newton_meets_the_gradient():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(80, 3)), (r.random(80) < 0.4).astype(float)
    w = qc.newton(x, y, 0.5)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + 0.5 * w[:-1]).max() < 1e-5


def test_nothing_to_learn(spark):
    rows, labels = labelled(spark, 40)
    none = labels.filter("false")
    assert all(r.score == 1 and r.kept for r in qc.classify(docs_of(spark, rows), none).collect())
    bad = labels.filter("quality = 0")
    assert not any(r.kept for r in qc.classify(docs_of(spark, rows), bad).collect())


def test_odd_rows(spark):
    rows, labels = labelled(spark, 200)
    docs = docs_of(spark, odd_rows(), clashing=True)
    scored = qc.score(docs, qc.fit(docs_of(spark, rows), labels)).collect()
    assert len(scored) == len(odd_rows()) and scored[0].level == "other" and all(0 <= r.score <= 1 for r in scored)
    assert qc.classify(docs_of(spark, []), labels).collect() == []
    odd_labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (4, 0, 0), (4, 1, 0)], labels.schema)
    assert len(qc.classify(docs, odd_labels).collect()) == len(odd_rows())


def test_text_features_of_empty_texts():
    assert np.isfinite(qc.text_features(pa.array(["", " ", "a"], pa.large_string()))).all()
