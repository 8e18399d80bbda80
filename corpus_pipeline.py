"""A corpus pipeline of five stages; each takes the documents the one before it kept, written as Parquet and read again.

All stages but the last return the columns of documents. The near-duplicate stage tells rows apart by a 64-bit hash of id
and text, so rows without an id, or with an id that others carry too, are judged one by one. Columns of documents that are
named like a column a stage adds keep their own values. Empty tables go through all stages.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession, functions as F

from lonetext.common import scratch_path, ship_package, write_out
from lonetext.llm import decontamination, jaccard_join, mixing, quality_classifier, secrets


SHINGLE_WORDS = 5
SHARE_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _beside(docs: DataFrame, added: Collection[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`stage` on documents whose columns named like an `added` one have another name meanwhile."""
    hidden = {c: f"documents_{i}_{c}" for i, c in enumerate(docs.columns) if c in added}
    done = stage(docs.withColumnsRenamed(hidden))
    return done.drop(*added).withColumnsRenamed({h: c for c, h in hidden.items()}).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    ship_package(spark)
    labels = _table(spark, sf_dir, "labels")
    return _beside(docs, (*quality_classifier.SCORES, "kept"),
                   lambda d: quality_classifier.classify(d, labels).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of rows that five-word shingles link: the one with the smallest id, no id last.

    Of rows with equal id and text one stays, the one that is smallest in all columns.
    """
    ship_package(spark)
    return _beside(docs, ["row_key"], lambda d: _one_of_each(d))


def _one_of_each(docs: DataFrame) -> DataFrame:
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    found = jaccard_join.join_components(docs.select(key.alias("doc_id"), "text"), SHINGLE_WORDS, SHARE_PERCENT)
    groups = found.select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("group")).distinct()
    ids = docs.select(key.alias("row_key"), "doc_id").groupBy("row_key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("times"))
    rows = write_out(ids.join(groups, "row_key"), "pipeline-rows")
    kept = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "times")).alias("best"))
    kept = write_out(kept.select("best.row_key", "best.times"), "pipeline-kept")
    losers = write_out(rows.join(kept, "row_key", "left_anti").select("row_key"), "pipeline-losers")
    repeated = write_out(kept.filter("times > 1").select("row_key"), "pipeline-repeated")
    keyed = docs.withColumn("row_key", key)
    once = keyed.join(losers.unionByName(repeated), "row_key", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return once
    first = keyed.join(repeated, "row_key", "left_semi").groupBy("row_key").agg(
        F.min(F.struct(*docs.columns)).alias("first"))
    return once.unionByName(first.select("first.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship_package(spark)
    benchmark = _table(spark, sf_dir, "benchmark")
    return _beside(docs, ["contamination"], lambda d: decontamination.contaminations(d, benchmark).filter(
        F.size("contamination") == 0))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; n_chars follows the text where it changed."""
    def hide(d: DataFrame) -> DataFrame:
        scanned = secrets.scan(d)
        text = secrets.redact(F.col("text"), F.col("secrets"))
        changed = scanned.withColumns({"secret_found": F.size("secrets") > 0, "text": text})
        return changed.withColumn("n_chars", F.when(F.col("secret_found"), F.length("text").cast("long"))
                                  .otherwise(F.col("n_chars")))

    return _beside(docs, ("secrets", "secret_found"), hide)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words the mix takes from them, in the order of their first training position."""
    ship_package(spark)
    narrow = write_out(mixing.with_size(docs.select("doc_id", "source", "text")), "pipeline-sizes")
    mixed = mixing.mix(mixing.with_size(docs, keep_text=True), narrow=narrow)
    return mixing.sort_by_position(mixed)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontaminate), ("secret scans", hide_secrets),
          ("mixing sources to target weights", mix)]

ORACLE_SQL = None  # the classifier, the joins' components and the alignment are beyond SQL; tested by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
