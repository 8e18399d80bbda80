"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from lonetext.llm import (decontamination, hard_negatives, html_text, jaccard_join, lm_scoring, mixing,
                          quality_classifier, quality_rules, secrets, sharding, token_alignment, token_counts, warc)

TOKENIZERS = "/opt/tokenizers"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_LEVEL = f"{TOKENIZERS}/byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = mixing.write_out(mixing.with_size(docs), "sizes")
    return mixing.sort_by_position(mixing.mix(sized)).select(
        "doc_id", "size", "source_size", "target", "taken", "position")


def jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminations(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("contamination.item_id")))
    return found.select("doc_id", F.size("contamination").cast("long").alias("n_regions"), items.alias("item_ids"),
                        (F.size("contamination") > 0).alias("contaminated"))


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.classify(docs, labels).select("doc_id", *quality_classifier.SCORES, "kept")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["rank"] < 3)

    def count(rank: int) -> Column:  # a second parameter of the lambda would be the place in the list
        return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS[:3])]
    return scanned.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"),
                          secrets.listed(spans).alias("spans"))


def hard_negative_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(rows)


def jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "text"))


def token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align_documents(docs, BYTE_LEVEL, PIECES)


LLM_QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_quality_outliers": quality_outliers,
    "op2_mix_sources": mix_sources,
    "op3_jaccard_join": jaccard_groups,
    "op4_benchmark_passages": benchmark_passages,
    "op5_lm_scores": lm_scores,
    "op6_warc_round_trip": warc_round_trip,
    "op7_cotrained_quality": cotrained_quality,
    "op8_page_text": page_texts,
    "op9_token_counts": unigram_counts,
    "op10_secret_scan": secret_scan,
    "op11_hard_negatives": hard_negative_answers,
    "op12_jump_shards": jump_shards,
    "op13_token_alignment": token_groups,
}


def _time_sql(share: str) -> str:
    """SQL of the time at which the schedule of rank k reaches a share of its whole."""
    number = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    cases = []
    for k, knots in enumerate(mixing.SCHEDULES):
        pieces, whole = mixing.integral(knots)
        whens = []
        for t0, t1, w0, slope, area in reversed(pieces):
            left = f"({share} * {number(whole)} - {number(area)})"
            root = f"sqrt(greatest({number(w0 * w0)} + {number(2 * slope)} * {left}, 0))"
            step = f"CASE WHEN {left} <= 0 THEN 0 ELSE 2 * {left} / ({number(w0)} + {root}) END"
            test = f"{number(area)} <= {share} * {number(whole)}" if t0 else "TRUE"
            whens.append(f"WHEN {test} THEN least({number(t0)} + {step}, {number(t1)})")
        cases.append(f"WHEN {k} THEN CASE {' '.join(whens)} END")
    return f"CASE rank % {len(mixing.SCHEDULES)} {' '.join(cases)} END"


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  md5(concat_ws(':', '0', doc_id::VARCHAR)) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], (rank % 3 + 1)::INT) AS weight FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE
        - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, rank
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER (ORDER BY source_size * 3 / weight, rank
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, rank, least(source_size::DOUBLE * 3,
        (SELECT max(level) FROM l WHERE source_size * 3 >= level * weight) * weight) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, [greatest(0, least(size, floor(target) - i * source_size - start))::BIGINT
                 FOR i IN [0, 1, 2]] AS parts FROM p),
f AS (SELECT *, list_sum(parts)::BIGINT AS taken, parts[1] AS first,
             (start + parts[1] / 2) / target AS share FROM o)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN first > 0 THEN {_time_sql("share")} END AS position FROM f
"""

NEGATIVES_SQL = """
WITH l AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v,
                  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings),
r AS (SELECT rid, vec_id, label, [floor(256 * x)::BIGINT FOR x IN v] AS x FROM l
      WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS aid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same,
             list_inner_product(a.x, b.x)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND len(a.x) = len(b.x) AND b.vec_id IS DISTINCT FROM a.vec_id),
p AS (SELECT aid, anchor_id, rid AS pid, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id, rid) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY aid, pid ORDER BY s.score DESC, s.vec_id, s.rid) AS rank
      FROM p JOIN s USING (aid) WHERE NOT s.same
      AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

# The checksum and the jumps run byte by byte and jump by jump; a hash's high half as a number keeps 31 bits.
SHARDS_SQL = f"""
WITH RECURSIVE poly AS (
    SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS steps FROM poly WHERE k = 8),
k AS (SELECT DISTINCT doc_id, ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 16))::UBIGINT::HUGEINT AS h FROM documents),
j AS (SELECT doc_id, n, h, -1::BIGINT AS place, 0::BIGINT AS after FROM k, (VALUES (8), (9)) v(n)
    UNION ALL SELECT doc_id, n, g, after, floor((after + 1) * (2147483648::DOUBLE / ((g // 8589934592) + 1)::DOUBLE))::BIGINT
    FROM (SELECT *, (h * {sharding.FACTOR} + 1) % 18446744073709551616 AS g FROM j WHERE after < n)),
s AS (SELECT doc_id, (max(place) FILTER (n = 8))::INT AS shard, (max(place) FILTER (n = 9))::INT AS grown_shard FROM j GROUP BY doc_id),
b AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
c AS (SELECT doc_id, octet_length(bytes) + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT,
             [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(bytes), '..')]),
             lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, crc)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY
           md5(concat_ws(':', coalesce(c.doc_id::VARCHAR, '-'), size, text_crc32, grown_shard)), c.doc_id) - 1 AS slot,
       grown_shard
FROM c JOIN s ON c.doc_id IS NOT DISTINCT FROM s.doc_id
"""

LLM_ORACLE = {"op11_hard_negatives": NEGATIVES_SQL, "op12_jump_shards": SHARDS_SQL, "op2_mix_sources": MIX_SQL}
if corpus_pipeline.ORACLE_SQL:
    LLM_ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
