import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import docs_of, odd_rows, prose
from lonetext.llm import lm_scoring as lm


def tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def brute(rows):
    counts = Counter(t for i, text, *_ in rows if not is_held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return counts, [(i, is_held(i), len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), n,
                     sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(text))) for i, text, *_ in rows]


def rows_of(n=300):
    return [(i, prose(i, 20 + i % 30), "en", "a", 1) for i in range(n)]


@pytest.mark.parametrize("frequent", [1 << 18, 20, 1])
def test_base_matches_brute_force(spark, frequent):
    rows = rows_of() + odd_rows()
    found = lm.score_documents(docs_of(spark, rows, clashing=True), n_classes=16, frequent=frequent, steps=1).collect()
    key = lambda r: (str(r[0]), r[2])
    expected = sorted(brute(rows)[1], key=key)
    got = sorted((tuple(r)[:6] for r in found), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in expected])
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_class_probabilities_add_up():
    model = lm.LogBilinear.fresh(np.array([5, 3, 0, 9]))
    base = 5
    for before, last in ((4, 4), (0, 3), (2, 1)):
        p = np.exp(model.log_probability((before * base + last) * base + np.arange(4)))
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_word_probabilities_add_up(spark):
    docs = docs_of(spark, rows_of())
    counts = lm.token_counts(docs.filter(~lm.held_out(docs.doc_id)))
    known = lm.vocabulary(counts, 16)
    every = counts.collect()
    own = {int(k) for k, c in zip(known.keys, known.classes) if c}
    rest = sum(r.c + 0.5 for r in every if np.int64(r.key).view(np.uint64) not in own) + 0.5
    assert rest == pytest.approx(known.rest_total) and len(own) == 15
    assert known.class_counts.sum() == known.train_tokens == sum(r.c for r in every)


def test_training_learns_context():
    """Classes that follow each other in turn: the model must beat the unigram far."""
    n = 7
    counts = np.full(n, 100)
    triples = np.array([((i % n) * (n + 1) + (i + 1) % n) * (n + 1) + (i + 2) % n for i in range(n)])
    noise = counts / counts.sum()
    fresh = lm.LogBilinear.fresh(counts)
    model = lm.nce_pass(fresh, np.tile(triples, 14_629), noise, 1, batch=256, n_noise=16)
    assert model.log_probability(triples).mean() > fresh.log_probability(triples).mean() + 1


def test_held_out_beats_the_base(spark):
    """Texts in which two words always come in turn."""
    rows = [(i, " ".join(("ping" if k % 2 else "pong") for k in range(40)) + " " + prose(i, 5), "en", "a", 1) for i in range(200)]
    found = [r for r in lm.score_documents(docs_of(spark, rows), n_classes=16, steps=200).collect() if r.held_out]
    assert found and np.mean([r.score - r.base_score for r in found]) > 1


def test_class_triples_by_hand():
    texts = pa.array(["a b a", "", "b"], pa.large_string())
    tokens_, bounds = lm.token_hashes(texts)
    keys = np.unique(tokens_)
    known = lm.Vocabulary(keys, np.ones(len(keys), int), np.arange(1, len(keys) + 1), len(keys) + 1, 9, 3,
                          np.ones(len(keys) + 1, int))
    base = known.n_classes + 1
    name = {int(k): i + 1 for i, k in enumerate(keys)}
    own = [name[int(t)] for t in tokens_]
    s = known.n_classes
    expected = [(s, s, own[0]), (s, own[0], own[1]), (own[0], own[1], own[2]), (own[1], own[2], own[3]), (s, s, own[4]),
                (s, s, own[5]), (s, own[5], own[6])]
    got = lm.class_triples(tokens_, bounds, known)
    assert [(int(g // base // base), int(g // base % base), int(g % base)) for g in got] == expected


def test_empty_tables(spark):
    assert lm.score_documents(docs_of(spark, [])).collect() == []
    only = [(i, "some words", "", "", 1) for i in range(40) if is_held(i)]
    for r in lm.score_documents(docs_of(spark, only), steps=1).collect():
        assert r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(r.base_score, abs=1e-6)
