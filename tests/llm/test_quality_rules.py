import random
import re

import numpy as np
import pyarrow as pa
from llm_rows import docs_of, odd_rows, prose
from lonetext.llm import quality_rules as qr


def brute_counts(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_counts_match_brute_force(spark):
    r = random.Random(1)
    rows = list(odd_rows())
    for i in range(200):
        words = [r.choice("ab") if i % 3 else r.choice("abcdefghij") for _ in range(r.randrange(40))]
        rows.append((100 + i, r.choice(("", " ", "\n")).join("") + "".join(w + r.choice((" ", "\n", "  ", " # ", "\x0b"))
                     for w in words) * r.randrange(1, 3), "en", "a", 1))
    by_id = {}
    for row in qr.with_counts(docs_of(spark, rows)).collect():
        by_id.setdefault(row.doc_id, []).append(tuple(row[c] for c in qr.COUNTS))
    for doc_id, text, *_ in rows:
        assert brute_counts(text) in by_id[doc_id], text[:80] if text else text


def test_repeats_never_cross_texts():
    ids = np.array([1, 2, 3, 4, 5, 6, 7, 8] * 2)
    assert qr.repeated_words(ids, np.array([0, 8, 16])).tolist() == [0, 0]
    assert qr.repeated_words(ids, np.array([0, 16])).tolist() == [16]
    assert qr.repeated_words(np.zeros(9, np.int64), np.array([0, 9])).tolist() == [9]
    assert qr.duplicate_lines(pa.array(["a\n \na\n\nb\na", ""], pa.large_string())).tolist() == [2, 0]


def brute_mcd(x: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Concentration steps on sorted distances, without bins."""
    quart = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    spread = np.maximum((quart[2] - quart[0]) / 1.349, qr.FLOOR)
    mean, precision = quart[1], np.diag(1 / spread ** 2)
    for _ in range(qr.STEPS):
        d = np.einsum("ij,jk,ik->i", x - mean, precision, x - mean)
        some = x[d <= np.sort(d)[int(np.ceil(len(x) * share)) - 1]]
        mean, precision = some.mean(axis=0), _inverse(some, qr.CONSISTENCY)
    d = np.einsum("ij,jk,ik->i", x - mean, precision, x - mean)
    some = x[d <= qr.REWEIGHT]
    return some.mean(axis=0), _inverse(some, 1.0)


def _inverse(x: np.ndarray, factor: float) -> np.ndarray:
    s = np.cov(x.T, bias=True) * factor
    s[np.diag_indices(len(s))] += np.maximum(np.square(qr.FLOOR) - np.diag(s), 0) + 1e-9
    return np.linalg.inv(s)


def test_estimate_matches_brute_force(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, qr.DIM)) @ np.diag([0.3, 0.2, 0.3, 0.25, 0.2])
    x[:300] += 5
    x = np.round(x * qr.UNIT)
    df = spark.createDataFrame([("g", *map(float, row)) for row in x], "stratum string, " + ", ".join(f"x{i} double" for i in range(qr.DIM)))
    row = qr.fit(df).first()
    mean, precision = brute_mcd(x / qr.UNIT, qr.SHARE)
    assert np.allclose([row[f"m{i}"] / qr.UNIT for i in range(qr.DIM)], mean, atol=0.02)
    found = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(qr.DIM)] for i in range(qr.DIM)])
    assert np.allclose(found, precision, rtol=0.1, atol=0.5)


def test_outliers_go_and_clean_texts_stay(spark):
    rows = [(i, prose(i, 60 + i % 50), "en" if i % 2 else "de", f"s{i % 2}", 1) for i in range(600)]
    junk = [(1000 + i, prose(i, 60).replace(" ", "### "), "en", "s1", 1) for i in range(20)]
    few = [(2000 + i, prose(i, 50), "fr", f"t{i}", 1) for i in range(5)]
    kept = {r.doc_id: r.kept for r in qr.judge(docs_of(spark, rows + junk + few)).collect()}
    assert all(kept[i] for i, *_ in rows + few) and not any(kept[i] for i, *_ in junk)


def test_strata_are_pooled(spark):
    rows = ([(i, prose(i, 30), "en", "big", 1) for i in range(100)] + [(200 + i, prose(i, 30), "en", f"s{i}", 1) for i in range(100)]
            + [(400 + i, prose(i, 30), None, None, 1) for i in range(9)])
    found = {(r.lang, r.source): r.stratum for r in qr.judge(docs_of(spark, rows)).collect()}
    assert found[("en", "big")] == "s/=en/=big" and found[("en", "s3")] == "l/=en" and found[(None, None)] is None


def test_odd_rows(spark):
    rows = qr.judge(docs_of(spark, odd_rows(), clashing=True)).collect()
    assert len(rows) == len(odd_rows())
    assert {r.doc_id for r in rows if r.base_failed} >= {2, 3, 5, 7, 8, 9, 0}
    assert qr.judge(docs_of(spark, [])).collect() == []


def test_reruns_agree(spark):
    rows = [(i, prose(i % 170, 20 + i % 90), "en", "a", 1) for i in range(400)]
    a, b = (sorted((r.doc_id, r.distance) for r in qr.judge(docs_of(spark, rows).repartition(k)).collect()) for k in (3, 7))
    assert a == b
