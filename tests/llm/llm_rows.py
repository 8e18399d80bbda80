"""Rows that every operator must stand: NULLs, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("kept", "score", "size", "position", "contamination", "secrets", "n", "node", "rank", "row", "key", "c",
            "bin", "stratum", "distance", "label", "level", "weight", "n_tokens", "component", "gram")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + r.choice(("", "s", "x", "ing", "ed")) for _ in range(n)]
    return " ".join(w.capitalize() if i % 9 == 0 else w for i, w in enumerate(words)) + "."


def odd_rows() -> list[tuple]:
    long = prose(7, 30_000)
    rows = [(1, prose(1, 60), "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0),
            (None, prose(2, 40), "en", None, 3), (4, long, "de", "b", len(long)), (5, " \t\n\v\f\r ", "en", "b", 7),
            (6, prose(1, 60), "en", "b", 1), (6, prose(1, 60), "en", "b", 1), (7, "one", None, "a", 3),
            (8, "x" * 5000, "en", "a", 5000), (9, "Ünïcödé ß 日本語 \U0001f600 text", "de", "a", 20), (0, "\n\n", "", "", 2)]
    return rows


def docs_of(spark, rows: list[tuple], clashing: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        df = df.select("*", *[F.lit("other").alias(c) for c in CLASHING])
    return df


def many(n: int = 300) -> list[tuple]:
    return [(i, prose(i, 30 + i % 40), ("en", "de")[i % 2], f"s{i % 3}", 10) for i in range(n)]
