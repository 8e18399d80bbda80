"""One DataFrame query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import as_doubles, local_table
from ..functions import text as tx
from ..operators import encode as enc
from ..operators import labelling as lab
from ..operators import metrics as met
from ..operators import sampling as smp
from ..operators.candidates import HashTables, recall
from ..operators.detectors import (HBOS, KDE, LOF, MLP, OCSVM, XGBOD, AutoEncoder, DeepSAD, DeepSVDD, Detector,
                                   DevNet, IsolationForest, PCADetector, VariationalAutoEncoder)
from ..plans import benchmark, report
from ..plans.preparation import prepare_dataset
from ..sources import artifacts, corpora, results
from . import inputs as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EPOCHS = 100  # as the configured runs


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and sinks


def _split_files(spark: SparkSession, sf: str, text: str) -> dict[str, str]:
    root = src.fresh_folder(spark, "splits")
    rows = src.labelled_documents(spark, sf).select("row_id", F.col("text").alias(text), F.col("toxic").alias("label"))
    paths = {}
    for i, name in enumerate(corpora.SPLITS):
        paths[name] = f"{root}/{name}"
        rows.filter(F.col("row_id") % 3 == i).write.parquet(paths[name])
    return paths


@query
def read_splits(spark, sf):
    return corpora.read_splits(spark, _split_files(spark, sf, "text"))


@query
def split_rename(spark, sf):
    paths = _split_files(spark, sf, "tweet")
    return corpora.read_splits(spark, paths, splits=["train"], rename=corpora.TWEETS_RENAME)


@query
def csv_corpus(spark, sf):
    path = src.fresh_folder(spark, "csv")
    (src.labelled_documents(spark, sf)
     .select("row_id", F.col("text").alias("tweet_text"), F.col("toxic").alias("sentiment"))
     .write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False,
                    ignoreTrailingWhiteSpace=False).csv(path))
    return corpora.read_delimited(spark, path, "row_id long, tweet_text string, sentiment int", keep=["row_id"],
                                  multiLine=True)


@query
def keyless_corpus(spark, sf):
    """Texts and labels without ids, stored in the order of their ids: the position is the id."""
    path = src.fresh_folder(spark, "keyless")
    docs = src.table(spark, sf, "documents").orderBy("doc_id").select("text", F.col("lang").alias("label"))
    docs.write.parquet(path)
    return tx.as_corpus(corpora.read_keyed(spark, path), "row_id")


@query
def positional_artifacts(spark, sf):
    """Three files aligned by position, cut into different numbers of parts."""
    root = src.fresh_folder(spark, "positional")
    rows = src.table(spark, sf, "embeddings")
    wide = [F.col("embedding")[i].alias(str(i)) for i in range(64)]
    for name, parts, columns in (("texts", 3, [F.concat(F.lit("text "), "vec_id").alias("text")]),
                                 ("labels", 1, ["label"]), ("embeddings", 5, wide)):
        rows.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").select(*columns).write.parquet(
            f"{root}/{name}")
    corpus, vectors = artifacts.read_positional(spark, *[f"{root}/{n}" for n in ("texts", "labels", "embeddings")])
    combined = artifacts.combine(corpus, vectors)
    return src.long_vectors(combined).join(combined.select("row_id", "text", "label"), "row_id")


@query
def xml_pages(spark, sf):
    path = src.fresh_folder(spark, "xml")
    pages = src.wiki_pages(spark, sf).select("title", "ns", F.col("row_id").alias("id"),
                                             F.struct("text").alias("revision"))
    (pages.write.format("xml").option("rowTag", "page").option("compression", "bzip2")
     .option("rootTag", 'mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/"').save(path))
    return corpora.read_pages(spark, path)


def _hashed(df: DataFrame) -> DataFrame:
    return enc.encode_hashed(df)


def _store(spark: SparkSession, sf: str) -> tuple[artifacts.ArtifactStore, str, list[bool]]:
    store = artifacts.ArtifactStore(spark, src.fresh_folder(spark, "store"))

    def load() -> DataFrame:
        return src.labelled_documents(spark, sf).select("row_id", "text", F.col("toxic").alias("label"))

    built = [prepare_dataset(store, "documents", "hashed", load, _hashed, max_samples=None) for _ in range(2)]
    return store, store.key("documents", None, "stratified", 42), built


@query
def artifact_store(spark, sf):
    store, key, _ = _store(spark, sf)
    combined = store.combined(key, "hashed")
    return src.long_vectors(combined).join(combined.select("row_id", "label"), "row_id")


@query
def cached_preparation(spark, sf):
    store, key, built = _store(spark, sf)
    return store.corpus(key).agg(F.lit(built[0]).alias("first_built"), F.lit(built[1]).alias("second_built"),
                                 F.count("*").alias("n_rows"))


@query
def combine(spark, sf):
    emb = src.vectors(spark, sf)
    wide = emb.select("row_id", *[F.col("embedding")[i].alias(str(i)) for i in range(64)])
    both = artifacts.combine(emb.select("row_id", "label"), artifacts.fold_wide(wide))
    return src.long_vectors(both).join(both.select("row_id", "label"), "row_id")


def _appended(spark: SparkSession, sf: str) -> str:
    root = src.fresh_folder(spark, "results")
    rows = src.result_rows(spark, sf)
    results.append_results(rows, root)
    results.append_results(rows, root)
    return root


@query
def result_append(spark, sf):
    rows = results.read_results(spark, _appended(spark, sf))
    return rows.select("run_id", "model", "dataset", "contamination", "round", "n_known_outliers", "train_size",
                       "test_size", F.round("test_auc", 6).alias("test_auc"), F.round("test_ap", 6).alias("test_ap"))


@query
def result_readback(spark, sf):
    rows = results.read_results(spark, _appended(spark, sf), models=["m0", "m2"], dataset="en")
    return rows.groupBy("model", "dataset").agg(F.count("*").alias("n"),
                                                F.round(F.avg("test_auc"), 6).alias("mean_auc"))


@query
def labelled_index_log(spark, sf):
    grid = smp.partial_labels_grid(src.train(spark, sf), benchmark.LEVELS, benchmark.ROUNDS)
    known = grid.filter(F.col("y_semi") == 1).withColumn("run_id", F.concat(
        F.lit("run-"), F.col("contamination").cast("string"), F.lit("-"), F.col("round").cast("string")))
    return results.as_csv_rows(results.labelled_index_log(known))


# --- text preparation


@query
def namespace_filter(spark, sf):
    return src.wiki_pages(spark, sf).filter(F.col("ns") == 0).select("row_id", "title")


@query
def redirect_filter(spark, sf):
    return src.wiki_pages(spark, sf).filter(~tx.is_redirect("text")).select("row_id", "title")


@query
def extract_categories(spark, sf):
    return src.wiki_pages(spark, sf).select("row_id", F.array_join(tx.categories("text"), "|").alias("categories"),
                                            tx.without("text", tx.CATEGORY).alias("text"))


@query
def pick_category(spark, sf):
    pages = src.wiki_pages(spark, sf).withColumn("label", tx.main_category(tx.categories("text")))
    return pages.filter(F.col("label").isNotNull()).select("row_id", "label")


@query
def strip_templates(spark, sf):
    return src.wiki_pages(spark, sf).select("row_id", tx.without("text", tx.SOURCE).alias("text"))


@query
def extract_dates(spark, sf):
    return src.wiki_pages(spark, sf).select("row_id", F.array_join(tx.dates("text"), "|").alias("dates"),
                                            tx.without("text", tx.DATE).alias("text"))


@query
def strip_markup(spark, sf):
    return src.wiki_pages(spark, sf).select("row_id", tx.strip_markup(F.col("text")).alias("text"))


@query
def drop_empty(spark, sf):
    rows = src.raw_documents(spark, sf).select(F.col("doc_id").alias("row_id"), F.expr(src.MAYBE_EMPTY).alias("text"))
    return rows.filter(tx.not_empty("text"))


@query
def wiki_articles(spark, sf):
    return tx.wiki_articles(src.wiki_pages(spark, sf), "row_id")


@query
def detect_columns(spark, sf):
    raw = src.documents(spark, sf).select("row_id", F.col("text").alias("body"), "n_chars", "source",
                                          F.col("lang").alias("category"))
    return tx.as_corpus(raw, "row_id")


@query
def join_list_text(spark, sf):
    raw = src.documents(spark, sf).select("row_id", F.split("text", " ").alias("text"), F.col("lang").alias("label"))
    return tx.as_corpus(raw, "row_id")


@query
def cast_text(spark, sf):
    number = F.when(F.col("row_id") % 9 != 0, F.col("n_chars"))
    raw = src.documents(spark, sf).select("row_id", number.alias("text"), F.col("lang").alias("label"))
    return tx.as_corpus(raw, "row_id")


@query
def head_sample(spark, sf):
    return smp.head_sample(src.documents(spark, sf).select("row_id", "text", "lang"), 500)


@query
def stratified_sample(spark, sf):
    rows = src.documents(spark, sf).select("row_id", "text", F.col("source").alias("label"))
    return smp.stratified_sample(rows, 500)


@query
def parity_check(spark, sf):
    labels = src.table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id")
    return artifacts.parity(src.documents(spark, sf), labels)


# --- encoding


class VowelCounts(enc.BatchEncoder):
    """Length and counts of five letters; stands in for a model that needs weights."""

    def encode_texts(self, texts, batch_size=128):
        return np.array([[len(t), *[t.count(v) for v in "aeiou"]] for t in texts], dtype=np.float32)


@query
def encode_batches(spark, sf):
    return src.long_vectors(enc.encode(src.documents(spark, sf).select("row_id", "text"), VowelCounts()))


@query
def encode_hashed(spark, sf):
    return src.long_vectors(enc.encode_hashed(src.labelled_documents(spark, sf)).select("row_id", "embedding"))


@query
def pool_cls(spark, sf):
    return src.long_vectors(enc.pool_first(src.token_vectors(spark, sf)))


@query
def pool_mean(spark, sf):
    return src.long_vectors(enc.pool_mean(src.token_vectors(spark, sf)), digits=9)


@query
def truncate_tokens(spark, sf):
    cut = enc.truncate_tokens(enc.tokens("text"))
    return src.documents(spark, sf).select("row_id", F.size(cut).cast("long").alias("n_tokens"),
                                           F.array_join(cut, " ").alias("text"))


@query
def encoder_pairs(spark, sf):
    datasets = src.table(spark, sf, "documents").select(F.col("source").alias("name"), "lang").distinct()
    encoders = local_table(spark, [("m1", "multi"), ("m2", "multi"), ("m3", "multi"), ("e1", "en"), ("d1", "de")],
                           "name string, lang string")
    return enc.encoder_pairs(datasets, encoders)


# --- labelling, sampling, splitting


@query
def label_binary(spark, sf):
    return src.binary(spark, sf).select("row_id", "label", "y")


@query
def label_binary_named(spark, sf):
    return lab.label_binary(src.vectors(spark, sf), normal_label=0).select("row_id", "label", "y")


@query
def class_report(spark, sf):
    return lab.class_report(src.vectors(spark, sf))


@query
def adjust_contamination(spark, sf):
    return src.thinned(spark, sf).select("row_id", "label", "y")


@query
def data_summary(spark, sf):
    return lab.data_summary(src.thinned(spark, sf)).withColumn("share_anomalies", F.round("share_anomalies", 6))


@query
def stratified_split(spark, sf):
    return src.split(spark, sf).select("row_id", "y", "split")


@query
def split_summary(spark, sf):
    return lab.split_summary(src.split(spark, sf))


@query
def partial_labels_n(spark, sf):
    return smp.partial_labels(src.train(spark, sf), n_known=5).select("row_id", "y", "y_semi")


@query
def partial_labels_c(spark, sf):
    return smp.partial_labels(src.train(spark, sf), contamination=src.LEVEL).select("row_id", "y", "y_semi")


@query
def partial_labels_grid(spark, sf):
    return smp.partial_labels_grid(src.train(spark, sf), benchmark.LEVELS, benchmark.ROUNDS)


# --- detectors


def _detect(detector: Detector, spark: SparkSession, sf: str, digits: int = 6, **score) -> DataFrame:
    """Fit on the train rows, score all rows."""
    data = src.semi(spark, sf)
    columns = ["row_id", "embedding"] + (["y_semi"] if detector.uses_labels else [])
    fitted = detector.fit(data.filter(F.col("split") == "train").select(*columns))
    out = fitted.score(data, **score)
    extra = [F.round("uncertainty", digits).alias("uncertainty")] if score else []
    return out.select("row_id", "split", "y", F.round("score", digits).alias("score"), *extra)


def _detect_documents(detector: Detector, spark: SparkSession, sf: str) -> DataFrame:
    """Fit on and score the hashed vectors of all labelled documents."""
    data = src.document_vectors(spark, sf)
    return detector.fit(data).score(data).select("row_id", "y", F.round("score", 6).alias("score"))


DETECTORS: dict[str, Callable[[], Detector]] = {
    "iforest": IsolationForest,
    "lof": LOF,
    "hbos": HBOS,
    "ocsvm": lambda: OCSVM(epochs=EPOCHS),
    "oneclass_svm": lambda: OCSVM(epochs=EPOCHS, orientation="inlier"),
    "kde": KDE,
    "pca_score": PCADetector,
    "autoencoder": lambda: AutoEncoder(epochs=EPOCHS),
    "vae": lambda: VariationalAutoEncoder(epochs=EPOCHS),
    "deep_svdd": lambda: DeepSVDD(epochs=EPOCHS),
    "deep_sad": lambda: DeepSAD(epochs=EPOCHS),
    "devnet": lambda: DevNet(epochs=EPOCHS),
    "xgbod": XGBOD,
    "mlp": lambda: MLP(epochs=EPOCHS),
}
for _name, _make in DETECTORS.items():
    QUERIES[_name] = lambda spark, sf, make=_make: _detect(make(), spark, sf)


@query
def iforest_uncertainty(spark, sf):
    return _detect(IsolationForest(), spark, sf, uncertainty=True)


@query
def hbos_documents(spark, sf):
    return _detect_documents(HBOS(), spark, sf)


@query
def lof_documents(spark, sf):
    return _detect_documents(LOF(), spark, sf)


@query
def kde_documents(spark, sf):
    return _detect_documents(KDE(), spark, sf)


@query
def lof_hashed(spark, sf):
    """LOF over the candidates of hash tables."""
    return _detect(LOF(search="hash"), spark, sf)


@query
def candidate_recall(spark, sf):
    """Whether hash tables find nine in ten of the 20 nearest vectors, among all rows, of every row whose id 50 divides."""
    rows = src.vectors(spark, sf)
    queries = rows.filter(F.col("row_id") % 50 == 0).select(F.col("row_id").alias("qid"), as_doubles("embedding").alias("vec"))
    found = recall(HashTables(rows), queries, 20)
    return found.select("n_queries", "n_true", (F.col("n_found") >= 0.9 * F.col("n_true")).alias("nine_in_ten"))


@query
def lof_cells(spark, sf):
    """Document vectors in small cells, so that bounds decide which cells are searched."""
    return _detect_documents(LOF(cell_rows=32), spark, sf)


@query
def kde_cells(spark, sf):
    return _detect_documents(KDE(bandwidth=0.2, cell_rows=32), spark, sf)


# --- metrics


@query
def roc_auc(spark, sf):
    return met.roc_auc(src.scored(spark, sf), ["split"]).withColumn("auc", F.round("auc", 6))


@query
def average_precision(spark, sf):
    return met.average_precision(src.scored(spark, sf), ["split"]).withColumn("ap", F.round("ap", 6))


@query
def split_sizes(spark, sf):
    return met.split_sizes(src.split(spark, sf))


@query
def evaluate(spark, sf):
    row = met.evaluate(src.scored(spark, sf))
    return row.select("n_known_outliers", "train_size", "test_size",
                      *[F.round(c, 6).alias(c) for c in row.columns if "_auc" in c or "_ap" in c])


@query
def document_length_auc(spark, sf):
    """How well text length alone ranks toxic documents, per language."""
    rows = src.labelled_documents(spark, sf).select("lang", F.col("toxic").alias("y"),
                                                    F.floor(F.col("n_chars") / 100).alias("score"))
    out = met.ranking_metrics(rows, ["lang"])
    return out.withColumns({c: F.round(c, 6) for c in ("auc", "ap")})


@query
def flagship(spark, sf):
    """Majority labelling, contamination, HBOS and both metrics, end to end."""
    data = src.thinned(spark, sf)
    out = met.ranking_metrics(HBOS().fit(data).score(data))
    return out.withColumns({c: F.round(c, 6) for c in ("auc", "ap")})


# --- benchmark jobs


def _run_id(*parts) -> str:
    return "run-" + "-".join(str(p) for p in parts)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if "_auc" in c or "_ap" in c})


def _configured_models() -> tuple[dict, dict]:
    """The configured models."""
    make = DETECTORS
    plain = {"IForest": make["iforest"], "LOF": make["lof"], "DeepSVDD": make["deep_svdd"], "OCSVM": make["ocsvm"],
             "OneClassSVM": make["oneclass_svm"], "AutoEncoder": make["autoencoder"], "VAE": make["vae"],
             "HBOS": make["hbos"]}
    semi = {"DevNet": make["devnet"], "DeepSAD": make["deep_sad"], "XGBOD": make["xgbod"], "MLP": make["mlp"]}
    return plain, semi


@query
def bench_unsup(spark, sf):
    data = benchmark.prepare(src.vectors(spark, sf), src.SHARE)
    rows = benchmark.run_unsupervised(data, _configured_models()[0], "embeddings", _run_id("unsup"), parallel=4)
    return _rounded(rows)


@query
def bench_exact(spark, sf):
    """The unsupervised run with the detectors whose scores SQL can compute."""
    data = benchmark.prepare(src.vectors(spark, sf), src.SHARE)
    models = {"HBOS": HBOS, "LOF": LOF, "KDE": KDE}
    return _rounded(benchmark.run_unsupervised(data, models, "embeddings", _run_id("exact"), parallel=3)).drop("error")


@query
def bench_semi(spark, sf):
    data = benchmark.prepare(src.vectors(spark, sf), src.SHARE)
    rows, _ = benchmark.run_semisupervised(data, _configured_models()[1], "embeddings", levels=(0.05, 0.1), n_rounds=1,
                                           run_id=_run_id, parallel=4)
    return _rounded(rows)


@query
def bench_grid(spark, sf):
    def hashed(label: str, dim: int) -> Callable[[], DataFrame]:
        return lambda: (enc.encode_hashed(src.labelled_documents(spark, sf), dim)
                        .select("row_id", "embedding", F.col(label).alias("label")))

    pairs = {"embeddings_given": lambda: src.vectors(spark, sf), "toxic_hashed64": hashed("toxic", 64),
             "quality_hashed32": hashed("quality", 32)}
    plain, semi = _configured_models()
    rows, _ = benchmark.run_grid(pairs, plain, semi, run_id=_run_id, spark=spark, parallel=4, uncertainty=["IForest"])
    return _rounded(rows)


@query
def grid_tables(spark, sf):
    """Both tables that a grid over pairs of datasets and encoders leaves behind: metric rows and revealed labels."""
    root = src.fresh_folder(spark, "grid")
    pairs = enc.encoder_pairs(local_table(spark, [("toxic", "en"), ("quality", "de")], "name string, lang string"),
                              local_table(spark, [("64", "multi"), ("32", "en")], "name string, lang string"))

    def load(dataset: str, encoder: str) -> DataFrame:
        vectors = enc.encode_hashed(src.labelled_documents(spark, sf), int(encoder))
        return vectors.select("row_id", "embedding", F.col(dataset).alias("label"))

    benchmark.run_study(load, pairs, spark, unsupervised={"HBOS": HBOS}, semisupervised={}, levels=(0.02, 0.04),
                        n_rounds=2, root=root, run_id=_run_id, normal_labels={"quality/64": [1, 2]})
    revealed = results.read_log(spark, root).groupBy("run_id").agg(F.count("*").alias("n"), F.min("row_id").alias("low"))
    done = results.read_results(spark, root).select("run_id", F.col("train_size").alias("n"), F.lit(-1).cast("long").alias("low"))
    return revealed.unionByName(done)


# --- reporting tables


def _first_value(spark: SparkSession, sf: str) -> DataFrame:
    return src.binary(spark, sf).select("y", F.col("embedding")[0].cast("double").alias("score"))


@query
def score_histogram(spark, sf):
    out = report.score_histogram(_first_value(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("lo", "hi", "density")})


@query
def score_density(spark, sf):
    out = report.score_density(_first_value(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("x", "density")})


def _rounded_curve(df: DataFrame) -> DataFrame:
    extra = ["labeled_percentage"] if "labeled_percentage" in df.columns else []
    return df.withColumns({**{c: F.round(c, 6) for c in ("mean", "sd", *extra)}, **{c: F.round(c, 8) for c in ("lo", "hi")}})


@query
def curve_known(spark, sf):
    return _rounded_curve(report.curve_known(src.result_rows(spark, sf)))


@query
def curve_percent(spark, sf):
    return _rounded_curve(report.curve_percent(src.result_rows(spark, sf)))
