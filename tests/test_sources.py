import bz2
import json

import pytest
from pyspark.sql import functions as F

from lonetext.common import collect_bounded, local_table, scratch_dir, write_out
from lonetext.operators.encode import encode_hashed
from lonetext.operators.labelling import majority_label
from lonetext.plans.preparation import prepare_dataset
from lonetext.sources import artifacts, corpora, results


def test_page_dump(spark, tmp_path):
    page = ("<page><title>T{0}</title><ns>{1}</ns><id>{0}</id><revision><id>99</id><contributor><id>7</id>"
            "</contributor><text bytes=\"3\" xml:space=\"preserve\">{2}</text></revision></page>")
    xml = ('<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">'
           + page.format(1, 0, "a &lt;b&gt;\n[[Categoria:Cultura]]") + page.format(2, 1, "x [[Categoria:Cultura]]")
           + page.format(3, 0, "") + page.format(4, 0, "#redirect [[a]] [[Categoria:Cultura]]") + "</mediawiki>")
    path = str(tmp_path / "dump.xml.bz2")
    with bz2.open(path, "wb") as f:
        f.write(xml.encode())
    rows = {r.row_id: r for r in corpora.read_pages(spark, path).collect()}
    assert sorted(rows) == [1, 2, 3, 4] and rows[1].ns == 0 and rows[2].ns == 1
    assert rows[1].text == "a <b>\n[[Categoria:Cultura]]"
    got = corpora.read_corpus(spark, "pages", path).collect()
    assert [tuple(r) for r in got] == [(1, "a", "Cultura")]


def test_delimited(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,tweet_text,sentiment\n1,"a, ""b""\nc",1\n2,"",0\n3,,0\n')
    schema = "id int, tweet_text string, sentiment int"
    rows = corpora.read_delimited(spark, str(path), schema, multiLine=True).collect()
    assert [tuple(r) for r in rows] == [('a, "b"\nc', 1), ("", 0), (None, 0)]


def test_splits(spark, tmp_path):
    paths = {}
    for i, name in enumerate(("train", "validation", "extra")):
        paths[name] = str(tmp_path / name)
        spark.createDataFrame([(i, "t")], "label int, tweet string").write.parquet(paths[name])
    df = corpora.read_splits(spark, paths, rename=corpora.TWEETS_RENAME)
    assert sorted((r.split, r.label) for r in df.collect()) == [("train", 0), ("validation", 1)]
    assert "text" in df.columns
    with pytest.raises(ValueError):
        corpora.read_splits(spark, {"extra": paths["extra"]})
    with pytest.raises(ValueError):
        corpora.read_corpus(spark, "ftp", "x")


def test_table_source(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "b", "m"), (2, None, "m")], "row_id long, body string, main_category string"
                          ).write.parquet(path)
    assert [tuple(r) for r in corpora.read_corpus(spark, "table", path).collect()] == [(1, "b", "m")]


def test_store(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path / "store"))
    calls = []

    def load():
        calls.append(1)
        return spark.range(60).select(F.col("id").alias("row_id"), F.concat(F.lit("t"), "id").alias("text"),
                                      (F.col("id") % 3).alias("label"))

    assert prepare_dataset(store, "d", "e1", load, encode_hashed, max_samples=30)
    before = sorted(store.combined(store.key("d", 30, "stratified", 42), "e1").collect())
    assert not prepare_dataset(store, "d", "e1", load, encode_hashed, max_samples=30)
    assert prepare_dataset(store, "d", "e2", load, encode_hashed, max_samples=30) and len(calls) == 1
    assert prepare_dataset(store, "d", "e1", load, encode_hashed, max_samples=20) and len(calls) == 2
    assert prepare_dataset(store, "d", "e1", load, encode_hashed, max_samples=10, strategy="head")
    after = sorted(store.combined(store.key("d", 30, "stratified", 42), "e1").collect())
    assert before == after and len(before) == 30
    head = store.corpus(store.key("d", 10, "head", 42))
    assert {r.row_id for r in head.collect()} == set(range(10))
    with pytest.raises(ValueError):
        prepare_dataset(store, "d", "e1", load, encode_hashed, strategy="other")


def test_store_reads_only_its_folders(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path / "store"))
    df = spark.range(3).select(F.col("id").alias("row_id"), F.array(F.lit(1.0)).alias("embedding"))
    for encoder in ("x", "org/enc y"):
        store.write_embeddings(df, "a", encoder)
        files = store.embeddings("a", encoder).inputFiles()
        assert files and len({f.rsplit("/", 1)[0] for f in files}) == 1


def test_names_that_need_escaping_are_cached(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path / "store"))

    def load():
        return spark.range(9).select(F.col("id").alias("row_id"), F.lit("t").alias("text"), F.lit(1).alias("label"))

    assert prepare_dataset(store, "SetFit/20_newsgroups", "org/enc", load, encode_hashed)
    assert not prepare_dataset(store, "SetFit/20_newsgroups", "org/enc", load, encode_hashed)
    with pytest.raises(ValueError):
        prepare_dataset(store, "d", "e", load, encode_hashed, max_samples=0)


def test_a_half_written_artefact_is_built_again(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path / "store"))
    df = spark.range(9).select(F.col("id").alias("row_id"), F.lit("t").alias("text"), F.lit(1).alias("label"))
    key = store.key("d", None, "stratified", 42)
    store.write_corpus(df.limit(3), key)
    assert prepare_dataset(store, "d", "e", lambda: df, encode_hashed) and store.corpus(key).count() == 9


def test_labels_keep_their_type(spark, tmp_path):
    """2 and 10 are tied; as text, 10 would be the smaller one."""
    store = artifacts.ArtifactStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(i, "t", 2 if i % 2 else 10) for i in range(10)], "row_id long, text string, label int")
    prepare_dataset(store, "d", "e", lambda: df, encode_hashed)
    corpus = store.corpus(store.key("d", None, "stratified", 42))
    assert dict(corpus.dtypes)["label"] == "int" and majority_label(corpus).first()[0] == 2


def test_texts_and_labels_without_ids(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("c", 1)], "text string, label int").repartition(3)
    assert prepare_dataset(store, "d", "e", lambda: df, encode_hashed)
    rows = store.corpus(store.key("d", None, "stratified", 42)).collect()
    assert sorted(r.row_id for r in rows) == [0, 1, 2, 3] and sorted(r.text for r in rows) == ["a", "a", "b", "c"]


def test_positions_as_ids(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("texts", "labels", "embeddings")]
    rows = spark.range(100)
    parts = (F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 7).alias("label"), F.col("id").cast("float").alias("0"))
    for path, n, column in zip(paths, (4, 1, 3), parts):
        rows.repartitionByRange(n, "id").sortWithinPartitions("id").select(column).write.parquet(path)
    corpus, vectors = artifacts.read_positional(spark, *paths)
    joined = artifacts.combine(corpus, vectors).collect()
    assert len(joined) == 100 and all((r.text, r.label, r.embedding) == (f"t{r.row_id}", r.row_id % 7, [float(r.row_id)])
                                      for r in joined)
    rows.limit(99).select(parts[1]).write.mode("overwrite").parquet(paths[1])
    with pytest.raises(ValueError):
        artifacts.read_positional(spark, *paths)


def test_malformed_pages_are_reported(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text("<m><page><title>a</title><ns>0</ns><id>1</id><revision><text>x</text></revision></page>"
                    "<page><title>b</title><ns>zero</ns><id>2</id></page>"
                    "<page><title>c</title><ns>0</ns><id>3</id><revision><text>cut off")
    assert [r.row_id for r in corpora.read_pages(spark, str(path)).collect()] == [1]
    found = [r.malformed for r in corpora.malformed_pages(spark, str(path)).collect()]
    assert len(found) == 2 and "zero" in found[0] and "cut off" in found[1]


def test_pages_do_not_depend_on_the_columns_asked_for(spark, tmp_path):
    path = tmp_path / "d.xml"
    page = "<page><title>{0}</title><ns>{1}</ns><id>{0}</id><revision><text>x {0}</text></revision></page>"
    path.write_text("<m>" + "".join(page.format(i, "zero" if i % 3 == 1 else 0) for i in range(9)) + "</m>")
    pages = corpora.read_pages(spark, str(path))
    assert pages.count() == 6 and corpora.malformed_pages(spark, str(path)).count() == 3
    for names in (["text"], ["title"], ["row_id"], ["ns"], ["text", "ns"]):
        assert len(pages.select(*names).collect()) == 6
    assert sorted(r.text for r in pages.select("text").collect()) == [f"x {i}" for i in (0, 2, 3, 5, 6, 8)]


@pytest.mark.parametrize("suffix", ["", ".bz2"])
def test_a_dump_is_read_in_splits(spark, tmp_path, suffix):
    import bz2
    import random

    r = random.Random(1)
    pages = [(i, " ".join(f"{r.getrandbits(40):x}" for _ in range(r.randrange(2000)))) for i in range(600)]
    text = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">\n' + "".join(
        f"  <page>\n<title>{i}</title><ns>0</ns><id>{i}</id><revision><text>{t}</text></revision>\n  </page>\n"
        for i, t in pages) + "</mediawiki>"
    path = tmp_path / f"dump.xml{suffix}"
    path.write_bytes(bz2.compress(text.encode()) if suffix else text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
    try:
        df = corpora.read_pages(spark, str(path))
        assert df.rdd.getNumPartitions() > 2
        assert sorted((r.row_id, r.text) for r in df.collect()) == pages
        assert df.count() == 600
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_delimited_files_without_line_breaks_are_split(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("tweet_text,sentiment\n" + "some words,1\n" * 50_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = corpora.read_delimited(spark, str(path), "tweet_text string, sentiment int")
        assert df.rdd.getNumPartitions() > 4 and df.count() == 50_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parity(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "row_id long")
    b = spark.createDataFrame([(2,), (3,), (4,), (5,)], "row_id long")
    assert tuple(artifacts.parity(a, b).first()) == (1, 2)


def test_wide_matrix(spark):
    wide = spark.createDataFrame([(7, 0.5, 1.5)], ["row_id", "0", "1"])
    assert tuple(artifacts.fold_wide(wide).first()) == (7, [0.5, 1.5])


def test_index_log(spark, tmp_path):
    known = spark.range(0, 95, 3).select(F.lit("r").alias("run_id"), F.lit(0.1).alias("contamination"),
                                         F.lit(0).alias("round"), F.col("id").alias("row_id"))
    whole = results.as_csv_rows(results.labelled_index_log(known)).collect()
    assert len(whole) == 1 and json.loads(whole[0].indices) == list(range(0, 95, 3))
    root = str(tmp_path / "log")
    results.append_log(known, root)
    results.append_log(known.withColumn("run_id", F.lit("s")), root)
    results.append_log(known, root)
    log = results.read_log(spark, root)
    assert log.schema == results.LOG_SCHEMA and log.count() == 64
    assert sorted(r.row_id for r in log.filter("run_id = 's'").collect()) == list(range(0, 95, 3))


def test_csv_export(spark, tmp_path):
    known = spark.range(3).select(F.lit("r").alias("run_id"), F.lit(0.1).alias("contamination"),
                                  F.lit(0).alias("round"), F.col("id").alias("row_id"))
    path = str(tmp_path / "log")
    for _ in range(2):
        results.export_csv(results.as_csv_rows(results.labelled_index_log(known)), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path).collect()
    assert len(rows) == 2 and json.loads(rows[0].indices) == [0, 1, 2]


def test_results_are_appended_and_pruned(spark, tmp_path):
    root = str(tmp_path / "out")
    row = ("id", "m1", "d", None, 0, 1, 10, 5, None, 0.5, 0.6, 0.0, 0.7, 0.8, None)
    df = local_table(spark, [row], results.RESULT_SCHEMA)
    results.append_results(df, root)
    results.append_results(df.withColumn("model", F.lit("m2")), root)
    results.append_results(df, root)  # the same run again takes its own place
    results.append_results(df.withColumn("run_id", F.lit("other")), root)
    assert results.read_results(spark, root).count() == 3
    one = results.read_results(spark, root, ["m2"], "d")
    filters = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert one.count() == 1 and "(dataset" in filters and "(model" in filters
    assert one.schema == results.RESULT_SCHEMA


def test_scratch_folder_is_the_configured_one(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    plan = write_out(spark.range(3).toDF("x"), "t")
    assert scratch_dir(spark) in plan.inputFiles()[0]


def test_bounded_collect(spark):
    assert len(collect_bounded(spark.range(5), 5, "x")) == 5
    with pytest.raises(ValueError):
        collect_bounded(spark.range(6), 5, "x")
