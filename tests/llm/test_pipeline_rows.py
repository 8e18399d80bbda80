import corpus_pipeline as cp
from llm_rows import SCHEMA, prose


def kept(spark, sf, rows):
    found = cp.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()
    return sorted((r.doc_id, r.text, r.lang) for r in found) if all(r.doc_id is not None for r in found) else sorted(
        ((r.doc_id, r.text, r.lang) for r in found), key=str)


def test_rows_without_an_id_go_one_by_one(spark, sf):
    rows = [(1, prose(1, 80), "en", "a", 1), (None, prose(1, 80), "en", "a", 1), (None, prose(2, 80), "en", "a", 1),
            (None, prose(3, 80), "en", "a", 1), (None, "", "en", "a", 0)]
    assert kept(spark, sf, rows) == sorted([(1, prose(1, 80), "en"), (None, prose(2, 80), "en"), (None, prose(3, 80), "en"),
                                            (None, "", "en")], key=str)


def test_an_id_with_two_texts_loses_only_the_copy(spark, sf):
    rows = [(1, prose(1, 80), "en", "a", 1), (2, prose(1, 80), "en", "a", 1), (2, prose(2, 80), "en", "a", 1)]
    assert kept(spark, sf, rows) == [(1, prose(1, 80), "en"), (2, prose(2, 80), "en")]


def test_of_repeated_rows_one_stays(spark, sf):
    rows = [(5, prose(5, 80), "pt", "b", 1), (5, prose(5, 80), "en", "a", 1), (6, prose(6, 80), "en", "a", 1)]
    assert kept(spark, sf, rows) == [(5, prose(5, 80), "en"), (6, prose(6, 80), "en")]
