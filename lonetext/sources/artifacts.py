"""Keyed tables of texts, labels and embeddings, written once per dataset (and encoder)."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from .corpora import read_keyed


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there; a metadata call, no job."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def combine(corpus: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Text, label and vector by `row_id`."""
    return corpus.join(embeddings, "row_id")


def fold_wide(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """A matrix with one column per dimension as (row_id, embedding)."""
    values = [F.col(f"`{c}`").cast("float") for c in df.columns if c != row_id]
    return df.select(row_id, F.array(*values).alias("embedding"))


def parity(corpus: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: ids without a vector and vectors without an id. Both are 0 in a whole store."""
    both = corpus.select("row_id", F.lit(1).alias("c")).join(
        embeddings.select("row_id", F.lit(1).alias("e")), "row_id", "full")
    return both.agg(F.count_if(F.col("e").isNull()).alias("missing_embeddings"),
                    F.count_if(F.col("c").isNull()).alias("missing_texts"))


def read_positional(spark: SparkSession, texts: str, labels: str, embeddings: str) -> tuple[DataFrame, DataFrame]:
    """(row_id, text, label) and (row_id, embedding) of three keyless files that are aligned by position."""
    parts = [read_keyed(spark, p) for p in (texts, labels, embeddings)]
    text, label, wide = parts
    names = [next(c for c in p.columns if c != "row_id") for p in (text, label)]
    corpus = text.select("row_id", F.col(names[0]).alias("text")).join(
        label.select("row_id", F.col(names[1]).alias("label")), "row_id", "full")
    sizes = [p.agg(F.count("*")).first()[0] for p in parts]
    if len(set(sizes)) > 1:
        raise ValueError(f"texts, labels and embeddings have {sizes} rows")
    return corpus, fold_wide(wide)


class ArtifactStore:
    """Two tables per dataset under one root: its corpus, and its embeddings by encoder.

    The sampling settings are part of the dataset key, so a cached sample is never taken for another one. Each has a
    folder of its own, so labels keep their type; a marker is written when a part is whole.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def key(dataset: str, max_samples: int | None, strategy: str, seed: int) -> str:
        return f"{dataset}-{'all' if max_samples is None else max_samples}-{strategy}-{seed}"

    def _folder(self, key: str, encoder: str | None = None) -> str:
        name = quote(key, safe="")
        return f"{self.root}/corpus/{name}" if encoder is None else f"{self.root}/embeddings/{name}/{quote(encoder, safe='')}"

    def complete(self, key: str, encoder: str | None = None) -> None:
        """Mark a dataset's corpus, or its embeddings, as whole."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(key, encoder) + "/_COMPLETE")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(target, True).close()

    def has_corpus(self, key: str) -> bool:
        return exists(self.spark, self._folder(key) + "/_COMPLETE")

    def has_embeddings(self, key: str, encoder: str) -> bool:
        return exists(self.spark, self._folder(key, encoder) + "/_COMPLETE")

    def write_corpus(self, df: DataFrame, key: str) -> None:
        df.select("row_id", "text", "label").write.mode("overwrite").parquet(self._folder(key))

    def write_embeddings(self, df: DataFrame, key: str, encoder: str) -> None:
        vectors = df.select("row_id", F.col("embedding").cast("array<float>").alias("embedding"))
        vectors.write.mode("overwrite").parquet(self._folder(key, encoder))

    def corpus(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(key))

    def embeddings(self, key: str, encoder: str) -> DataFrame:
        return self.spark.read.schema("row_id long, embedding array<float>").parquet(self._folder(key, encoder))

    def combined(self, key: str, encoder: str) -> DataFrame:
        return combine(self.corpus(key), self.embeddings(key, encoder))
