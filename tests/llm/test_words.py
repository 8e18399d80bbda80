import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from llm_rows import odd_rows, prose
from lonetext.llm import words as w

TEXTS = [t for _, t, *_ in odd_rows()] + [f"É{prose(i, 30)}ñ {i}Ö\n" for i in range(40)] + ["\x1c\x85 a b\x0bc"]


def expected(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_of_every_slice():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS, pa.string())], ["text"])
    for size in (1, 50, 200, 1 << 22):
        found, lower = [], []
        for part in w.slices(batch, slice_bytes=size):
            for texts, out in ((w.texts_of(part), found), (pc.ascii_lower(w.texts_of(part)), lower)):
                flat, bounds = w.split(texts)
                every = flat.to_pylist()
                out += [every[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        assert found == [expected(t) for t in TEXTS]
        assert lower == [["".join(c.lower() if c.isascii() else c for c in x) for x in expected(t)] for t in TEXTS]


def test_shingles_tell_texts_apart():
    def sets(*texts):
        grams, bounds = w.shingles(pa.array(texts, pa.large_string()), 4)
        return [frozenset(grams[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]

    a, b, c, d, e, f, g = sets("a b c d e", "A b  C d\te", "b c d e", "a b c", "a b c d", "", "x a b c d")
    assert a == b and len(a) == 2 and c < a and d not in (c, e) and len(d) == 1 and f == frozenset() and e < a and e < g
    one = sets(*[t or "" for t in TEXTS])
    assert one == [sets(t or "")[0] for t in TEXTS]
    assert [len(x) for x in one] == [len({tuple("".join(c.lower() if c.isascii() else c for c in v) for v in x[i:i + 4])
                                          for i in range(max(1, len(x) - 3))}) if (x := expected(t)) else 0 for t in TEXTS]


def test_totals():
    assert w.totals(np.array([1, 2, 3]), np.array([0, 0, 2, 3])).tolist() == [0, 3, 3]
