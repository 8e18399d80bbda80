"""The language model's vocabulary beyond its classes, and passes over the whole corpus."""
import random

import numpy as np
from llm_rows import docs_of
from lonetext.llm import lm_scoring as lm


def test_words_beyond_the_classes_know_their_context(spark):
    """Sixty words, each always followed by its own partner: with four classes all of them share one."""
    draw = random.Random(1)
    rows = [(i, " ".join(f"k{j} v{j}" for j in draw.choices(range(60), k=30)), "en", "a", 1) for i in range(300)]
    found = lm.score_documents(docs_of(spark, rows), n_classes=4, steps=900).collect()
    gain = [(r.score - r.base_score) / r.n_tokens for r in found if r.held_out]
    assert gain and np.mean(gain) > 0.3


def test_probabilities_of_heads_and_members_add_up():
    members = np.arange(2 * lm.GROUP + 5, 0, -1)
    heads = np.concatenate([[3, 9, 4], np.add.reduceat(members, np.arange(0, len(members), lm.GROUP))])
    model = lm.LogBilinear.fresh(heads, member_counts=members)
    n = 3 + len(members)
    for before, last in ((n, n), (0, 3), (2, n - 1)):
        p = np.exp(model.log_probability((before * (n + 1) + last) * (n + 1) + np.arange(n)))
        assert abs(p.sum() - 1) < 1e-4


def test_a_pass_meets_every_row():
    n = 5000
    counts = np.ones(n)
    own = np.arange(n)
    triples = (own * (n + 1) + own) * (n + 1) + own
    fresh = lm.LogBilinear.fresh(counts)
    model = lm.nce_pass(fresh, triples, counts / n, 0, batch=512, n_noise=16)
    assert (model.context[:n] != fresh.context[:n].astype(np.float32)).any(axis=1).all()


def test_shards_hold_every_document_and_grow_with_the_corpus(spark):
    rows = [(i, f"a{i} b c", "en", "a", 1) for i in range(400)]
    docs = docs_of(spark, rows)
    known = lm.vocabulary(lm.token_counts(docs))
    stored = lm.coded_texts(docs, known, 7).collect()
    assert len(stored) == 400 and {r.shard for r in stored} == set(range(7))
    codes = np.concatenate([np.frombuffer(r.codes, np.int32) for r in stored])
    assert len(codes) == known.train_tokens == 1600 and (codes > 0).all() and len(np.unique(codes)) == 403
    model = lm.train(docs, known, steps=1, shard_tokens=300)
    fresh = lm.LogBilinear.fresh(known.head_counts, member_counts=known.member_counts)
    moved = (model.context != fresh.context.astype(np.float32)).any(axis=1)
    assert moved[known.codes[known.keys != lm.END]].all()


def test_a_fit_does_not_depend_on_how_files_are_dealt(spark):
    draw = random.Random(2)
    docs = docs_of(spark, [(i, " ".join(draw.choices("abcdefghij", k=30)), "en", "a", 1) for i in range(200)])
    known = lm.vocabulary(lm.token_counts(docs))
    one = lm.train(docs.repartition(7), known, steps=4, batch=512, shard_tokens=1500)
    other = lm.train(docs.coalesce(1), known, steps=4, batch=512, shard_tokens=1500)
    assert np.allclose(one.table(), other.table(), atol=1e-3)


def test_sums_without_a_shift_are_the_same():
    logits = np.random.default_rng(0).normal(size=(40, 300)).astype(np.float32) * 5
    assert np.allclose(lm._log_sums(logits.copy(), True), lm._log_sums(logits.copy()), atol=1e-4)
