import hashlib
import math

import pytest
from llm_rows import docs_of, many, odd_rows
from lonetext.llm import mixing


def sized(spark, rows, **more):
    return mixing.with_size(docs_of(spark, rows, **more))


def brute_targets(sizes: dict) -> dict:
    ordered = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(ordered)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in ordered if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in ordered}
        capped |= above


def test_targets_match_iteration(spark):
    rows = [(i, "w " * (1 + i * i % 50), "en", s, 1) for i in range(120)
            for s in [("a", "b", "c", "d", None)[i % 5 if i > 20 else 0]]]
    rows += [(500, "w", "en", "tiny", 1), (501, "", "en", "void", 1)]
    df = sized(spark, rows)
    found = {r.source: r for r in mixing.targets(df).collect()}
    expected = brute_targets({s: r.source_size for s, r in found.items()})
    for s, r in found.items():
        assert r.target == pytest.approx(expected[s])
    assert sum(r.target for r in found.values()) == pytest.approx(sum(r.source_size for r in found.values()))


def test_taken_meets_targets_and_positions_follow_demand(spark):
    rows = mixing.mix(sized(spark, many())).collect()
    per = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == sum(o.taken for o in r.occurrences)
        per.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(t - goal) <= 1 for t, goal in per.values())
    for k, s in enumerate(sorted(per)):  # an occurrence's time is where demand reaches the middle of its stretch
        pieces, whole = mixing.integral(mixing.SCHEDULES[k % 3])
        at = 0
        for o in sorted((o for r in rows if r.source == s for o in r.occurrences), key=lambda o: o.position):
            t0, _, w0, slope, area = [p for p in pieces if p[0] <= o.position][-1]
            x = o.position - t0
            assert (area + w0 * x + slope * x * x / 2) / whole * per[s][1] == pytest.approx(at + o.taken / 2, rel=1e-6)
            at += o.taken


def test_many_buckets_give_the_same_order(spark, monkeypatch):
    df = sized(spark, many())
    one = sorted((r.doc_id, r.taken, r.position) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert sorted((r.doc_id, r.taken, r.position) for r in mixing.mix(df).collect()) == one
    keys = sorted(hashlib.md5(f"0:{i}".encode()).hexdigest() for i in range(300) if i % 3 == 0)
    first = min((r for r in mixing.mix(df).collect() if r.source == "s0"), key=lambda r: r.position or 2)
    assert hashlib.md5(f"0:{first.doc_id}".encode()).hexdigest() == keys[0]


def test_sorted_by_position(spark):
    found = [r.position for r in mixing.sort_by_position(mixing.mix(sized(spark, many()))).collect()]
    known = [p for p in found if p is not None]
    assert known == sorted(known) and found[:len(known)] == known


def test_odd_rows(spark):
    df = mixing.mix(sized(spark, odd_rows(), clashing=True))
    rows = df.collect()
    assert len(rows) == len(odd_rows()) and "kept" in df.columns
    assert all((r.position is None) == (r.taken == 0) for r in rows)
    assert [r.size for r in rows if r.doc_id in (2, 3, 5, 0)] == [0] * 4
    assert mixing.mix(sized(spark, [])).collect() == []
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mix(sized(spark, [(1, None, "en", "a", 0)])).collect())


def test_flat_schedules_and_bad_ones(spark):
    rows = mixing.mix(sized(spark, many(30)), schedules=[((0.0, 1.0), (1.0, 1.0))]).collect()
    assert all(0 <= r.position <= 1 for r in rows if r.position is not None)
    for bad in (((0.1, 1.0), (1.0, 1.0)), ((0.0, -1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 0.0))):
        with pytest.raises(ValueError):
            mixing.integral(bad)
    assert not math.isnan(mixing.integral(mixing.SCHEDULES[0])[1])
