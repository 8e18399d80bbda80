"""What a list carries to the next round, and what its making shuffles."""
import numpy as np
import pandas as pd
from lonetext.llm import jaccard_join as jj


def frame_of(sets, gram=1):
    maps = [jj.bitmap(np.array(sorted(s), np.uint64)) for s in sets]
    return pd.DataFrame({"gram": gram, "first": 0, "second": 0, "side": 2, "node": range(len(sets)), "n": [len(s) for s in sets],
                         "pos": 0, "most": 100, "least": 0, "component": range(len(sets)), "sketch": maps})


def test_sets_are_left_only_by_pairs_that_were_not_given():
    near = [set(range(100)) - {i} for i in range(5)]  # all ten pairs may link
    far = [set(range(1000 + 200 * i, 1100 + 200 * i)) for i in range(4)]  # none of these with any
    left: set = set()
    pairs = jj.forests(frame_of(near + far), set(), extra=0, left=left)
    assert len(pairs) == 4 and left == {(1, i) for i in range(1, 5)}  # set 0 gave all its pairs
    left = set()
    assert len(jj.forests(frame_of(near + far), set(), extra=5, left=left)) == 10 and left == set()
    left = set()
    assert jj.forests(frame_of(near + far), {(1, a, b) for a in range(5) for b in range(a + 1, 5)}, left=left) == []
    assert left == set()


def test_entries_are_shuffled_once(spark, capsys, monkeypatch):
    sets = spark.createDataFrame([(1, 3, [10, 11]), (2, 3, [10, 12]), (2, 3, [10, 12]), (3, 3, [13]), (4, 2, [12, 10])],
                                 "node long, n long, prefix array<long>")
    plans = []

    def keep(df, name, *args, **kwargs):
        df.explain()
        plans.append(capsys.readouterr().out)
        return df

    monkeypatch.setattr(jj, "write_out", keep)
    rows = jj.index_lists(sets).collect()
    assert len(plans) == 1 and plans[0].count("Exchange ") == 1
    got = {(r.gram, r.node): (r.n, r.pos, r.k) for r in rows}
    assert got == {(10, 1): (3, 0, 3), (10, 2): (3, 0, 3), (10, 4): (2, 1, 3), (12, 2): (3, 1, 2), (12, 4): (2, 0, 2)}
    assert len(rows) == 5 and all(len({(r.rep, r.rep_n, r.rep_pos) for r in rows if r.gram == g}) == 1 for g in (10, 12))
    assert all((r.rep_n, r.rep_pos) == got[r.gram, r.rep][:2] for r in rows)
