"""Readers for labelled text corpora: split files, delimited files, wiki page dumps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..common import scratch_path
from ..functions.text import as_corpus, computed_once, wiki_articles

# Split names, and column names of the two corpora that need renaming.
SPLITS = ("train", "test", "validation")
TWEETS_RENAME = {"tweet": "text"}
SENTIMENT_RENAME = {"tweet_text": "text", "sentiment": "label"}

PAGE_SCHEMA = "title string, ns int, id long, revision struct<text: string>, malformed string"
PAGE_START, PAGE_END = r"(?s)<page[\s>].*", "</page>"


def read_table(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """A parquet corpus; `parts` deals a small file out to that many tasks ahead of costly work on each row."""
    df = spark.read.parquet(path)
    return df.repartition(parts) if parts else df


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table with `row_id`, the position of a row: files in the order of their names, rows as stored.

    The files' row counts come from a scan without columns; their running sum is one narrow row per file.
    """
    rows = spark.read.parquet(path)
    names = rows.columns
    placed = rows.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = placed.groupBy("_file").agg((F.max("_row") + 1).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_file").select((F.col("_start") + F.col("_row")).alias("row_id"), *names)


def keyed(df: DataFrame) -> DataFrame:
    """Any table with a `row_id`: it is written once, and a row's place in the written files is its id."""
    path = scratch_path(df.sparkSession, "keyed")
    df.write.parquet(path)
    return read_keyed(df.sparkSession, path)


def read_splits(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet",
                splits: Sequence[str] = SPLITS, rename: Mapping[str, str] | None = None,
                schema: T.StructType | str | None = None, **options) -> DataFrame:
    """The wanted splits of a corpus in one table with a `split` column; absent splits are skipped."""
    present = [s for s in splits if s in paths]
    if not present:
        raise ValueError(f"none of the splits {list(splits)} present")
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    parts = [reader.load(paths[s]).withColumn("split", F.lit(s)) for s in present]
    return reduce(DataFrame.unionByName, parts).withColumnsRenamed(dict(rename or {}))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str,
                   rename: Mapping[str, str] = SENTIMENT_RENAME, keep: Sequence[str] = (), **options) -> DataFrame:
    """A delimited file with a header and quoted fields; keeps text and label.

    Line breaks inside quotes need `multiLine=True`, which makes each file one task.
    """
    settings = {"header": True, "quote": '"', "escape": '"', **options}
    # A text may be empty, which is not the same as missing.
    df = spark.read.options(**{"emptyValue": "", "nullValue": "\u0000", **settings}).schema(schema).csv(path)
    return df.withColumnsRenamed(dict(rename)).select(*keep, "text", "label")


def _pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, parsed): a dump cut at the ends of its pages, each page parsed as one string.

    The page's own text is what is parsed, with all its fields, so what counts as malformed does not depend on the
    columns that a query asks for. Plain and bz2 files are read in splits.
    """
    cut = spark.read.text(path, lineSep=PAGE_END).select(F.regexp_extract("value", PAGE_START, 0).alias("body"))
    pages = cut.filter(F.col("body") != "").select(F.concat("body", F.lit(PAGE_END)).alias("page"))
    options = {"columnNameOfCorruptRecord": "malformed", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false",
               "mode": "PERMISSIVE"}
    return pages.select("page", computed_once(F.from_xml("page", PAGE_SCHEMA, options)).alias("parsed"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, title, ns, text) of a wiki page dump, plain or bz2; namespaces of the tags are ignored.

    Pages that cannot be parsed are left out here and reported by `malformed_pages`.
    """
    return _pages(spark, path).filter(F.col("parsed.malformed").isNull()).select(
        F.col("parsed.id").alias("row_id"), "parsed.title", "parsed.ns", F.col("parsed.revision.text").alias("text"))


def malformed_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a dump that cannot be parsed, as they stand in the file."""
    return _pages(spark, path).filter(F.col("parsed.malformed").isNotNull()).select(F.col("page").alias("malformed"))


def read_corpus(spark: SparkSession, source: str, location, **kwargs) -> DataFrame:
    """Dispatch by kind of source: 'splits', 'delimited', 'pages' (as articles) or 'table'."""
    if source == "splits":
        return read_splits(spark, location, **kwargs)
    if source == "delimited":
        return read_delimited(spark, location, **kwargs)
    if source == "pages":
        return wiki_articles(read_pages(spark, location), "row_id")
    if source == "table":
        df = read_table(spark, location).withColumnsRenamed({"body": "text", "main_category": "label"})
        return as_corpus(df if "row_id" in df.columns else read_keyed(spark, location).withColumnsRenamed(
            {"body": "text", "main_category": "label"}), "row_id")
    raise ValueError(f"unknown source: {source}")
