import random

import numpy as np
import pytest
from llm_rows import docs_of, odd_rows, prose
from lonetext.llm import decontamination as dc


def distance(item: bytes, text: bytes) -> int:
    """Least edit distance of `item` to any stretch of `text`."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(text: str, k: int, seed: int) -> str:
    r, out = random.Random(seed), list(text)
    for _ in range(k):
        at = r.randrange(len(out))
        out[at] = r.choice(("", "q", out[at] + "z"))
    return "".join(out)


def benchmark_of(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_matches_brute_force(spark):
    items = [prose(900 + i, 9 + 3 * i) for i in range(6)]
    rows = []
    for i in range(60):
        item = items[i % 6]
        hidden = edited(item, int(len(item) * 0.02 * (i // 6)), i).upper() if i % 5 else ""
        rows.append((i, prose(i, 15) + " " + hidden + "\n" + prose(i + 70, 10), "en", "a", 1))
    found = {r.doc_id: {c.item_id: c.distance for c in r.contamination}
             for r in dc.contaminations(docs_of(spark, rows), benchmark_of(spark, items)).collect()}
    hits = 0
    for i, text, *_ in rows:
        data = dc.folded(text.encode()).tobytes()
        for j, item in enumerate(items):
            d = distance(dc.folded(item.encode()).tobytes(), data)
            k = int(len(item.encode()) * dc.EDIT_SHARE)
            assert (j in found[i]) == (d <= k), (i, j, d, k)
            if d <= k:
                hits += 1
                assert found[i][j] == d
    assert 10 < hits < 60


def test_places_are_code_points(spark):
    item = prose(5, 12)
    text = "日本é " * 3 + item + " ß"
    c = dc.contaminations(docs_of(spark, [(1, text, "", "", 1)]), benchmark_of(spark, [item])).first().contamination[0]
    assert text[c.start:c.end] == item and c.distance == 0


def test_repeated_passages_and_equal_items(spark):
    item = prose(6, 14)
    row = dc.contaminations(docs_of(spark, [(1, f"{item} and then {item}", "", "", 1)]),
                            benchmark_of(spark, [item, item, "short", None])).first()
    assert [(c.item_id, c.distance) for c in row.contamination] == [(0, 0), (1, 0), (0, 0), (1, 0)]


def test_blocks_of_items_agree(spark):
    items = [prose(50 + i, 12) for i in range(20)]
    docs = docs_of(spark, [(i, prose(i, 20) + items[i % 20], "", "", 1) for i in range(40)])
    one = sorted(map(str, dc.contaminations(docs, benchmark_of(spark, items)).collect()))
    assert sorted(map(str, dc.contaminations(docs, benchmark_of(spark, items), block_bytes=300).collect())) == one


def test_no_finding_crosses_texts(spark):
    item = prose(8, 20)
    rows = [(i, half, "", "", 1) for i, half in enumerate((item[:60], item[60:]) * 3)]
    found = dc.contaminations(docs_of(spark, rows).coalesce(1), benchmark_of(spark, [item])).collect()
    assert all(r.contamination == [] for r in found)


def test_banded_alignment_is_exact():
    r = random.Random(4)
    for _ in range(100):
        item = bytes(r.choice(b"abc") for _ in range(r.randrange(8, 30)))
        text = bytes(r.choice(b"abc") for _ in range(5)) + edited(item.decode(), r.randrange(4), 1).encode() + b"cab"
        found = dc.align(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8), 0, 10, 6)
        d = distance(item, text)
        assert (found is None and d > 6) or (found and found[0] == d)
        if found:
            assert distance(item, text[found[1]:found[2]]) == d


def test_odd_rows(spark):
    docs = docs_of(spark, odd_rows(), clashing=True)
    assert all(r.contamination == [] for r in dc.contaminations(docs, benchmark_of(spark, [prose(777, 20)])).collect())
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminations(docs, empty).count() == len(odd_rows())
    assert dc.contaminations(docs_of(spark, []), benchmark_of(spark, [prose(1, 20)])).collect() == []
    long = next(r for r in dc.contaminations(docs, benchmark_of(spark, [prose(7, 40)[:-1]])).collect() if r.doc_id == 4)
    assert [(c.start, c.distance) for c in long.contamination] == [(0, 0)]


@pytest.mark.parametrize("size", [40, 95, 394])
def test_lemma_asks_for_something(size):
    index = dc.Index.build([(1, "".join(random.Random(1).choice("abcdefgh") for _ in range(size)))])
    assert index.needed[0] > 0 and index.dense > 0


def test_short_items_and_items_without_an_id(spark):
    items = [(1, "forty\ttwo!?"), (None, prose(31, 14)), (None, "Nul"), (2, "x=7"), (3, "ß"), (4, "  "), (5, None), (6, "#"),
             (7, "a b c d"), (8, "a b c de"), (9, "exactly twenty bytes")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(0, "say Forty two!? twice", "", "", 1), (1, "forty twoo!?", "", "", 1), (2, prose(31, 14) + " end", "", "", 1),
            (3, "null and nul, NUL", "", "", 1), (4, "x=7 but x=77 or xx=7", "", "", 1), (5, "ß", "", "", 1), (6, "aß", "", "", 1),
            (7, "why#no##", "", "", 1), (8, "a b c d", "", "", 1), (9, "aa b c d", "", "", 1), (10, "a b c de", "", "", 1),
            (11, "exactly twenty byte", "", "", 1), (12, "Exactly Twenty bytes", "", "", 1), (13, None, "", "", 1), (14, "nu", "", "", 1)]
    found = {r.doc_id: [(c.item_id, c.start, c.end, c.distance) for c in r.contamination]
             for r in dc.contaminations(docs_of(spark, rows).coalesce(1), benchmark).collect()}
    assert found[0] == [(1, 4, 15, 0)] and found[1] == [] and [f[0] for f in found[2]] == [None]
    assert found[3] == [(None, 9, 12, 0), (None, 14, 17, 0)] and found[4] == [(2, 0, 3, 0)]
    assert found[5] == [(3, 0, 1, 0)] and found[6] == [] and found[7] == [(6, 3, 4, 0), (6, 6, 7, 0), (6, 7, 8, 0)]
    assert found[8] == [(7, 0, 7, 0)] and found[9] == [] and found[10] == [(8, 0, 8, 0)]
    assert found[11] == [] and found[12] == [(9, 0, 20, 0)] and found[13] == [] and found[14] == []
    only = dc.contaminations(docs_of(spark, rows), spark.createDataFrame([(2, "x=7")], "item_id long, text string"))
    assert {r.doc_id for r in only.collect() if r.contamination} == {4}
