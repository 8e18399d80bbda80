"""What the language model asks of a word or a pair of words is asked once, and quicker steps give the same numbers."""
import numpy as np
import pyarrow as pa
import pytest
from llm_rows import docs_of
from lonetext.llm import lm_scoring as lm
from lonetext.llm.words import hashed


def model_of(n_heads: int, n_members: int, factor: float = 1.0) -> lm.LogBilinear:
    draw = np.random.default_rng(3)
    members = draw.integers(1, 50, n_members)
    groups = np.add.reduceat(members, np.arange(0, n_members, lm.GROUP))
    model = lm.LogBilinear.fresh(np.concatenate([draw.integers(1, 99, n_heads), groups]), member_counts=members)
    model.context *= factor
    return model.of_table(model.table())


def by_hand(model: lm.LogBilinear, before: int, last: int, word: int) -> float:
    def log_share(logits: np.ndarray, at: int) -> float:
        return logits[at] - logits.max() - np.log(np.exp(logits - logits.max()).sum())

    x = [a.astype(np.float64) for a in model.arrays()]
    hidden = x[0][before] * x[2][0] + x[0][last] * x[2][1]
    head = int(model.heads(np.array([word]))[0])
    result = log_share(x[1] @ hidden + x[3], head)
    if word >= model.n_classes:
        first = (word - model.n_classes) // lm.GROUP * lm.GROUP
        some = slice(first, first + lm.GROUP)
        result += log_share(x[4][some] @ hidden + x[5][some], word - model.n_classes - first)
    return result


@pytest.mark.parametrize("factor", [1.0, 30.0, 3000.0])
def test_probabilities_by_hand(factor, monkeypatch):
    """At the largest factor exponentials need the shift by their largest logit."""
    monkeypatch.setattr(lm, "SUMMED", 7)
    model = model_of(40, 2 * lm.GROUP + 9, factor)
    n = len(model.context) - 1
    draw = np.random.default_rng(4)
    before, last, word = draw.integers(0, n + 1, 60), draw.integers(0, n + 1, 60), draw.integers(0, n, 60)
    got = model.log_probability((before * (n + 1) + last) * (n + 1) + word)
    expected = [by_hand(model, *t) for t in zip(before, last, word)]
    assert np.allclose(got, expected, rtol=1e-4, atol=1e-4)


def test_exponentials_are_taken_once_a_word(monkeypatch):
    """Thirty words make 900 pairs; every head has an exponential for 60 words, not for 900 pairs."""
    model, taken, exp = model_of(64, lm.GROUP), [0], np.exp
    n = len(model.context) - 1
    pair = np.arange(30)[:, None] * (n + 1) + np.arange(30)

    def counted(x, *args, **named):
        taken[0] += np.size(x)
        return exp(x, *args, **named)

    monkeypatch.setattr(lm.np, "exp", counted)
    model.log_probability(pair.ravel() * (n + 1) + 5)
    assert taken[0] <= 61 * len(model.target)


def test_words_are_looked_up_once_a_slice(spark, monkeypatch):
    docs = docs_of(spark, [(i, "a b c a b c", "en", "a", 1) for i in range(50)])
    known = lm.vocabulary(lm.token_counts(docs))
    ids, hashes, bounds = lm.token_words(pa.array(["A b a", "", "c c b"], pa.large_string()))
    tokens, same = lm.token_hashes(pa.array(["A b a", "", "c c b"], pa.large_string()))
    assert len(hashes) == 4 and np.array_equal(hashes[ids], tokens) and np.array_equal(bounds, same)
    assert np.array_equal(lm.word_codes(hashes, known)[ids], lm.word_codes(tokens, known))


def test_hashes_of_words():
    words = ["", "a", "é中", "x" * 300, "a\x00b"]
    import xxhash
    for seed in (0, 7):
        assert hashed(pa.array(words), seed).tolist() == [xxhash.xxh3_64_intdigest(w, seed) for w in words]
        assert hashed(pa.array(words, pa.large_string()), seed).tolist() == [xxhash.xxh3_64_intdigest(w, seed) for w in words]
    assert len(hashed(pa.array([], pa.large_string()))) == 0


def plain_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As sums were made before: one call for each row when some row has many values."""
    order = np.argsort(rows.astype(np.int32))
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


def test_sums_of_rows_are_the_same_bits():
    draw = np.random.default_rng(5)
    for n in (50, 400, 5000):
        rows = np.concatenate([draw.zipf(1.3, n) % 700, np.full(40, 3)])
        values = draw.normal(size=(len(rows), 5)).astype(np.float32)
        for got, expected in zip(lm._summed(rows, values), plain_sums(rows, values)):
            assert np.array_equal(got, expected)
    for times in range(1, 33):  # no row has many
        rows = np.repeat([4, 9], times)
        values = draw.integers(-9, 9, (len(rows), 2)).astype(np.float32)
        at, sums = lm._summed(rows, values)
        assert at.tolist() == [4, 9] and np.array_equal(sums, values.reshape(2, times, 2).sum(axis=1))
