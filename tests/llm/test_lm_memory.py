"""What a task of the language model's passes holds beside the model."""
import tracemalloc

import numpy as np
import pyarrow as pa
from lonetext.llm import lm_scoring as lm


class Held:
    def __init__(self, value):
        self.value = value


def test_a_task_holds_its_word_numbers_and_an_order_of_them():
    n, length = 1 << 19, 256
    counts = np.full(50, n // 50)
    model = lm.LogBilinear.fresh(counts)
    codes = np.random.default_rng(0).integers(0, 50, n).astype(np.int32).reshape(-1, length)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(codes), np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())],
                                       ["shard", "codes"])
    fit = lm._trainer(Held(model), counts / counts.sum(), 0, lm.RATE, 8192, 1 << 30)
    tracemalloc.start()
    blocks = list(fit([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(blocks) == 1
    assert peak < 30 * n  # 4 bytes a number, the order and what is behind a word, and what a step needs


def test_triples_made_when_asked_for_are_those_of_the_whole():
    texts = [[5, 1, 2, 3], [4], [], [2, 2], [1]]
    own = np.array(sum(texts, []), np.int32)
    bounds = np.cumsum([0, *map(len, texts)])
    bounds = np.delete(bounds, 3)  # every text has its end token, so none is empty
    base, got = 7, lm.Triples(own, bounds, 6)
    expected = [(6, 6, 5), (6, 5, 1), (5, 1, 2), (1, 2, 3), (6, 6, 4), (6, 6, 2), (6, 2, 2), (6, 6, 1)]
    at = np.array([7, 0, 3, 2, 1, 6, 5, 4])
    assert len(got) == 8
    assert [(int(g // base // base), int(g // base % base), int(g % base)) for g in got[at]] == [expected[i] for i in at]


def large_model():
    counts, members = np.full(200 + 256, 1000), np.full(1 << 16, 100)
    model = lm.LogBilinear.fresh(counts, member_counts=members)
    return model.of_table(model.table()), counts / counts.sum()


def peak_of(work):
    tracemalloc.start()
    try:
        result = work()
        return tracemalloc.get_traced_memory()[1], result
    finally:
        tracemalloc.stop()


def test_a_task_holds_no_further_tables_of_the_model():
    """Beside the model a pass holds its vectors, their sums of squares and, from the second shard on, what moved so far."""
    model, noise = large_model()
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.arange(256, dtype=np.int32).tobytes()], pa.binary())],
                                       ["shard", "codes"])
    peak, blocks = peak_of(lambda: list(lm._trainer(Held(model), noise, 0, lm.RATE, 256, 1 << 30)([batch])))
    assert blocks
    assert peak < 4.5 * model.table().nbytes


def test_moved_is_the_difference_of_the_tables():
    model, _ = large_model()
    other = model.of_table(model.table() + np.float32(0.25))
    assert np.array_equal(other.moved_from(model), other.table() - model.table())


def test_scoring_holds_predicted_vectors_once():
    model, _ = large_model()
    n = 1 << 17
    triples = lm.code_triples(np.random.default_rng(0).integers(0, len(model.context) - 1, n).astype(np.int32),
                              np.arange(0, n + 1, 256), len(model.context) - 1)
    before, last = np.arange(1, n) % 5000, np.arange(1, n) % 7001
    peak, vectors = peak_of(lambda: model.predicted(before, last))
    assert peak < 1.5 * vectors.nbytes
    assert np.array_equal(vectors, model.context[before] * model.scale[0] + model.context[last] * model.scale[1])
    peak, scores = peak_of(lambda: model.log_probability(triples))
    assert peak < 2.4 * vectors.nbytes and len(scores) == n
