import math
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import docs_of, odd_rows, prose
from lonetext.llm import token_counts as tc
from lonetext.llm.catalog import PIECES


@pytest.fixture(scope="module")
def pieces():
    return tc.load_pieces(PIECES)


def brute(word, scores, unknown, longest):
    marked = tc.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(marked) + 1):
        options = []
        for size in range(1, min(end, longest) + 1):
            piece = marked[end - size:end]
            if piece in scores:
                options.append((best[end - size][0] + scores[piece], best[end - size][1] + 1))
            elif size == 1:
                options.append((best[end - size][0] + unknown, best[end - size][1] + len(piece.encode())))
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    return best[-1][1]


def words():
    r = random.Random(8)
    some = {w for i in range(30) for w in prose(i, 60).split()} | {"日本語", "\U0001f600", "naïve", "a", "x" * 47, "x" * 48, "ab" * 40,
                                                                  "ab" * 40 + "c", "\x00", "ﬀ", "́"}
    some |= {"".join(r.choice("abcdeé日") for _ in range(r.randrange(1, 60))) for _ in range(200)}
    return sorted(some)


def test_matches_brute_force(pieces, monkeypatch):
    vocabulary = tc.Vocabulary.of(pieces)
    expected = [brute(w, vocabulary.scores, vocabulary.unknown, vocabulary.longest) for w in words()]
    assert tc.count_words(pa.array(words(), pa.large_string()), vocabulary).tolist() == expected
    monkeypatch.setattr(tc, "CHUNK", 7)
    monkeypatch.setattr(tc, "LONG", 5)
    assert tc.count_words(pa.array(words(), pa.large_string()), vocabulary).tolist() == expected


def test_matches_a_public_unigram_model(pieces):
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0), *pieces]
    model = Tokenizer(models.Unigram(vocab, unk_id=0))
    vocabulary = tc.Vocabulary.of(pieces)
    plain = [w for w in words() if all(c in vocabulary.scores for c in w)]
    found = tc.count_words(pa.array(plain, pa.large_string()), vocabulary).tolist()
    assert len(plain) > 300 and found == [len(model.encode(tc.MARK + w).ids) for w in plain]


def test_documents(spark, pieces):
    vocabulary = tc.Vocabulary.of(pieces)
    rows = odd_rows()
    found = tc.with_token_counts(docs_of(spark, rows, clashing=True), PIECES).collect()
    assert len(found) == len(rows) and found[0].c == "other"
    for row, got in zip(rows, found):
        expected = sum(brute(w, vocabulary.scores, vocabulary.unknown, vocabulary.longest)
                       for w in (row[1] or "").replace("\x0b", " ").split(" ") if w.strip()) if len(row[1] or "") < 4000 else None
        if expected is not None and "\n" not in (row[1] or ""):
            assert got.n_tokens == expected
    assert tc.with_token_counts(docs_of(spark, []), PIECES).collect() == []


def test_scores_of_ranks(pieces):
    scores = dict(pieces)
    assert scores["▁t"] == pytest.approx(-math.log(4.7)) and scores["▁t"] > scores["▁the"] > scores["梦"]
    assert np.isfinite([s for _, s in pieces]).all()
    with pytest.raises(ValueError):
        tc.Vocabulary.of([])
