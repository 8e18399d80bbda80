import random
import re

import numpy as np
import pandas as pd
import pytest
from llm_rows import docs_of, odd_rows, prose
from lonetext.llm import jaccard_join as jj
from lonetext.llm.components import components


def shingle_set(text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3)))


def brute(rows):
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            k = root(i)
            least[k] = min(least.get(k, r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows)), key=str)


def variants(base: str, n: int, edits: int, seed: int) -> list[str]:
    r, result = random.Random(seed), []
    for _ in range(n):
        words = base.split()
        for _ in range(r.randrange(edits + 1)):
            words[r.randrange(len(words))] = "edit" + str(r.randrange(40))
        result.append(" ".join(words))
    return result


def corpus():
    texts = [prose(i, 20 + i % 90) for i in range(60)]
    texts += variants(prose(300, 90), 70, 4, 1) + variants(prose(301, 200), 40, 9, 2) + [prose(302, 50)] * 20
    texts += [prose(303, 60) + " " + prose(400 + i, 40) for i in range(40)]  # a passage that many share
    texts += [t.upper() for t in texts[:5]] + [t + " tail" for t in texts[5:15]]
    texts += ["one two", "one two", "ONE two three", "a b c d", "a b c d", "a b c d e"]
    random.Random(9).shuffle(texts)
    return [(i, t, "en", "a", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block,stripe,rows,sketch", [(2048, 32, 1 << 14, 512), (8, 3, 20, 8), (16, 16, 1, 64)])
def test_matches_brute_force(spark, monkeypatch, block, stripe, rows, sketch):
    for name, value in (("BLOCK", block), ("STRIPE", stripe), ("WALK_ROWS", rows), ("SKETCH_BYTES", sketch), ("CHUNK", 50)):
        monkeypatch.setattr(jj, name, value)
    rows = corpus()
    found = sorted(map(tuple, jj.join_components(docs_of(spark, rows)).collect()), key=str)
    assert found == brute(rows)


def test_odd_rows(spark):
    rows = odd_rows() + [(None, prose(2, 40), "x", "y", 1), (None, "lonely words here now", "x", "y", 1)]
    found = sorted(map(tuple, jj.join_components(docs_of(spark, rows, clashing=True)).collect()), key=str)
    assert found == brute(rows)
    assert jj.join_components(docs_of(spark, [])).collect() == []
    assert {tuple(r) for r in jj.join_components(docs_of(spark, [(1, None, "", "", 1), (2, None, "", "", 1)])).collect()} == {
        (1, 0, 1), (2, 0, 2)}


def test_prefix_and_bitmap_bounds_are_safe():
    r = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64))
        b = np.unique(np.concatenate([r.choice(a, max(1, len(a) * 9 // 10)), r.integers(0, 400, 5).astype(np.uint64)]))
        overlap, least = len(np.intersect1d(a, b)), jj.needed(len(a), len(b))
        assert (100 * overlap >= 85 * (len(a) + len(b) - overlap)) == (overlap >= least)
        differ = jj.Bitmaps([jj.bitmap(a), jj.bitmap(b)]).differ(np.array([0]), np.array([1]))[0]
        assert (len(a) + len(b) - differ) // 2 >= overlap
        if overlap >= least:
            assert set(a[:jj.prefix_size(len(a))].tolist()) & set(b[:jj.prefix_size(len(b))].tolist())


def test_bitmaps_of_different_sizes():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 60, n).astype(np.uint64)) for n in (3, 500, 600, 1100, 5000)]
    sets += [np.concatenate([s, s[:2] ^ np.uint64(7)]) for s in sets]
    maps = jj.Bitmaps([jj.bitmap(s) for s in sets])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    for i, j, d in zip(a, b, maps.differ(a, b)):
        assert d <= len(np.setxor1d(sets[i], sets[j])) and (d == 0) == (i == j)
    near = maps.differ(np.array([3]), np.array([8]))[0]
    assert near <= 2 and maps.differ(np.array([1]), np.array([2]))[0] > 400


def rows_of(sets, shared_at, component, most, least, side=None, group=None):
    n = len(sets)
    return pd.DataFrame({"gram": group or [1] * n, "first": [0] * n, "second": [0] * n, "side": side or [2] * n,
                         "node": range(1, n + 1), "n": [len(s) for s in sets], "pos": shared_at, "most": most, "least": least,
                         "component": component, "sketch": [jj.bitmap(s) for s in sets]})


def test_derived_answers_bar_pairs():
    """A set that shares little with the representative cannot link with one that has little beside it."""
    same = np.arange(100, dtype=np.uint64) << np.uint64(20)  # bitmaps that rule nothing out
    frame = rows_of([same, same], [0, 0], [1, 2], [90, 30], [90, 30])
    assert jj.forests(frame, set()) == []
    assert jj.forests(frame.assign(most=[90, 89], least=[90, 89]), set()) == [(1, 1, 2)]
    assert jj.forests(frame.assign(most=[90, 89], least=[90, 89]), {(1, 1, 2)}) == []
    assert jj.forests(frame.assign(most=100, least=0), set()) == [(1, 1, 2)]
    assert jj.forests(frame.assign(most=100, least=0, component=5), set()) == []
    assert jj.forests(frame.assign(most=100, least=0, side=[0, 0]), set()) == []
    assert jj.forests(frame.assign(most=100, least=0, side=[0, 1]), set()) == [(1, 1, 2)]
    assert jj.forests(frame.assign(most=100, least=0, pos=[0, 40]), set()) == []
    assert jj.forests(frame.assign(most=100, least=0, gram=[1, 2]), set()) == []


def test_blocks_skip_what_pairs_rule_out():
    """Row pairs left by skipping blocks are exactly those that the tests leave pair by pair."""
    r = np.random.default_rng(7)
    for _ in range(20):
        k = 300
        group, comp = np.sort(r.integers(0, 3, k)), r.choice([1, 1, 1, 2, 3, *range(10, 40)], k)
        n = r.integers(20, 60, k)
        pos = (n * r.random(k) * 0.3).astype(np.int64)
        least = (n * r.random(k)).astype(np.int64)
        most = np.minimum(n, least + r.integers(0, 20, k))
        side = np.full(k, 2)
        lists = jj.Lists(group, side, comp, n, pos, most, least)
        found = {tuple(sorted(map(int, p))) for a, b in lists.pairs(85) for p in zip(lists.order[a], lists.order[b])}
        want = set()
        for i in range(k):
            for j in range(i):
                need = jj.needed(int(n[i]), int(n[j]))
                if (group[i] == group[j] and comp[i] != comp[j] and min(n[i], n[j]) >= need
                        and min(pos[i], pos[j]) + min(n[i] - pos[i], n[j] - pos[j]) >= need
                        and min(most[i] + n[j] - least[j], most[j] + n[i] - least[i]) >= need):
                    want.add((j, i))
        assert found == want


@pytest.mark.parametrize("k", [500, 2000])
def test_a_contracted_group_costs_a_constant_per_set(k):
    """A near-copy group of one component, and a few sets outside it: pairs tested per set do not grow with the group."""
    r = np.random.default_rng(8)
    comp, n = np.concatenate([np.ones(k, np.int64), np.arange(2, 12)]), r.integers(90, 110, k + 10)
    lists = jj.Lists(np.zeros(k + 10, np.int64), np.full(k + 10, 2), comp, n, np.zeros(k + 10, np.int64), n, n * 0)
    list(lists.pairs(85))
    assert lists.tested <= 32 * (k + 64)


def test_long_copies_carry_small_sketches():
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 60, 40_000).astype(np.uint64)) for i in range(2)]
    maps = [jj.bitmap(s) for s in sets]
    assert len(maps[0]) > 8_000 and len(jj.folded(maps[0], jj.SKETCH_BYTES)) == jj.SKETCH_BYTES
    near = jj.Bitmaps([jj.folded(maps[0], 512), jj.folded(jj.bitmap(sets[0][5:]), 512)])
    assert near.differ(np.array([0]), np.array([1]))[0] <= 5


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    label = {v: v for link in links for v in link}
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = set(label) - {v for a, b in links if a != b for v in (a, b)}
    assert found == {k: v for k, v in label.items() if k not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
