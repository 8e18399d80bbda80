"""Views of the given tables that the registered queries start from, and expressions shared with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import scratch_path, write_out
from ..operators.encode import encode_hashed, tokens
from ..operators.labelling import label_binary
from ..operators.sampling import adjust_contamination, partial_labels, stratified_split
from ..sources.corpora import read_table
from ..sources.results import RESULT_SCHEMA

SHARE = 0.5  # ten even classes: a smaller share would leave almost no anomalies
LEVEL = 0.1

# SQL text valid in both engines.
WIKI_TEXT = """concat(
  CASE WHEN doc_id % 11 = 0 THEN concat('#Redirect [[', source, ']]', chr(10)) ELSE '' END,
  '{{data|', lang, '-', cast(doc_id % 28 + 1 AS string), '}}', chr(10),
  '{{Infobox|{{small|', lang, '}}|x}}', repeat(chr(39), 3), source, repeat(chr(39), 3),
  ' [[', lang, '|', source, ']] [[Lisboa]] [https://example.com/', source, ' site] <!-- nota -->',
  ' 3 < 5 and 7 > 2 &amp; more&nbsp;x {{a{{b{{c{{d}}}}}}}} {{x|{y}|z}} {| class=t | a || b |}',
  '<ref name="a">r', chr(10), 's</ref>', chr(10), '== ', lang, ' ==', chr(10),
  text, chr(10), '{{Fonte|', source, '}}', chr(10),
  '[[Categoria:', CASE doc_id % 7 WHEN 0 THEN 'Cultura' WHEN 1 THEN 'economia do Brasil'
    WHEN 2 THEN 'Política' WHEN 3 THEN 'Esporte' WHEN 4 THEN 'Saúde'
    WHEN 5 THEN 'Ciência e Tecnologia' ELSE 'Mundo' END, ']]',
  CASE WHEN doc_id % 3 = 0 THEN '[[categoria:Economia]]' ELSE '' END)"""
WIKI_NS = "CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END"
MAYBE_EMPTY = "CASE WHEN doc_id % 7 = 0 THEN concat(chr(32), chr(9), chr(10), chr(160)) ELSE text END"
RESULT_ROWS = """
  SELECT concat('run-', cast(doc_id % 20 AS string)) AS run_id, concat('m', cast(doc_id % 3 AS string)) AS model,
         lang AS dataset, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 4) / cast(100 AS double) END AS contamination,
         cast(doc_id % 5 AS int) AS round, cast(sum(toxic) AS int) AS n_known_outliers, count(*) AS train_size,
         cast(sum(quality) AS bigint) AS test_size,
         CASE WHEN count(*) > 1 THEN avg(n_chars % 1000) / cast(1000 AS double) END AS test_auc,
         avg(n_chars % 97) / cast(97 AS double) AS test_ap
  FROM doc GROUP BY doc_id % 20, doc_id % 3, lang, doc_id % 4, doc_id % 5"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, dealt out to the session's shuffle partitions: the given tables are small single files."""
    return read_table(spark, f"{sf}/documents.parquet", int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return raw_documents(spark, sf).withColumnRenamed("doc_id", "row_id")


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    return (raw_documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
            .withColumnRenamed("doc_id", "row_id"))


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, embedding, y) of the labelled documents, y = toxic; encoded once, then read."""
    encoded = encode_hashed(labelled_documents(spark, sf))
    return write_out(encoded.select("row_id", "embedding", F.col("toxic").alias("y")), "vectors")


def wiki_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dressed as wiki pages: row_id, title, ns, text."""
    return raw_documents(spark, sf).select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("title"), F.expr(WIKI_NS).alias("ns"),
        F.expr(WIKI_TEXT).alias("text"))


def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, pos, vec, mask): every token as the first 8 hex digits of its md5, every fifth one masked."""
    words = labelled_documents(spark, sf).select("row_id", F.posexplode(tokens("text")).alias("pos", "token"))
    digits = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: (
        F.conv(F.substring(F.md5("token"), j, F.lit(1)), 16, 10).cast("double") / 15))
    mask = F.when(F.col("pos") % 5 == 4, 0).otherwise(1)
    return words.select("row_id", "pos", digits.alias("vec"), mask.alias("mask"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")


def binary(spark: SparkSession, sf: str) -> DataFrame:
    return label_binary(vectors(spark, sf))


def thinned(spark: SparkSession, sf: str) -> DataFrame:
    return adjust_contamination(binary(spark, sf), SHARE)


def split(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors, split."""
    return stratified_split(binary(spark, sf))


def train(spark: SparkSession, sf: str) -> DataFrame:
    return split(spark, sf).filter(F.col("split") == "train")


def revealed(spark: SparkSession, sf: str) -> DataFrame:
    """Train and test rows with y and y_semi (LEVEL of the train rows revealed)."""
    data = split(spark, sf)
    known = partial_labels(data.filter(F.col("split") == "train"), contamination=LEVEL)
    return known.unionByName(data.filter(F.col("split") == "test").withColumn("y_semi", F.lit(0)))


def semi(spark: SparkSession, sf: str) -> DataFrame:
    return write_out(revealed(spark, sf), "semi")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """A closed-form score with many ties over the split vectors."""
    first = F.col("embedding")[0].cast("double")
    return (revealed(spark, sf).withColumn("score", F.floor(first * 10) / F.lit(10.0))
            .select("row_id", "split", "y", "y_semi", "score"))


def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the result schema, one per run, model, dataset, level and round, aggregated from the documents."""
    doc = labelled_documents(spark, sf).withColumnRenamed("row_id", "doc_id")
    rows = spark.sql(f"WITH doc AS (SELECT * FROM {{doc}}) {RESULT_ROWS}", doc=doc)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in RESULT_SCHEMA if f.name not in rows.columns}
    return rows.withColumns(missing).select(*RESULT_SCHEMA.names)


def long_vectors(df: DataFrame, column: str = "embedding", digits: int = 6) -> DataFrame:
    """(row_id, dim, value): vectors as rows, for comparison."""
    return (df.select("row_id", F.posexplode_outer(column).alias("dim", "value"))
            .withColumn("value", F.round(F.col("value").cast("double"), digits)))


def fresh_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
