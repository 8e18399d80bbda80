import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import docs_of, many, odd_rows
from lonetext.llm import sharding


def jump_one(key: int, shards: int) -> int:
    """The published loop, one key at a time."""
    at, after = -1, 0
    while after < shards:
        at = after
        key = (key * sharding.FACTOR + 1) % (1 << 64)
        after = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


def test_jumps_follow_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 3000, dtype=np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [jump_one(int(k), n) for k in keys]


def test_appending_moves_only_into_new_shards():
    keys = np.random.default_rng(2).integers(0, 1 << 64, 40_000, dtype=np.uint64)
    for n in range(1, 12):
        old, new = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert set(new[old != new].tolist()) <= {n}
        assert abs((old != new).mean() - 1 / (n + 1)) < 0.01


def check(rows, found):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows),
        key=lambda x: x) if all(r[0] is not None for r in rows) else True
    by_shard = {}
    for r in found:
        assert r.law == "key" and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    for i in {r.doc_id for r in found}:
        assert len({r.shard for r in found if r.doc_id == i}) == 1


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, clashing):
    rows = odd_rows() + [(None, None, None, None, None)] * 3
    found = sharding.place(docs_of(spark, rows, clashing)).collect()
    assert len(found) == len(rows)
    check(rows, found)
    size = {(r.doc_id, r.size, r.text_crc32) for r in found}
    assert (2, 1, 0) in size and (3, 1, 0) in size and (None, 1, 0) in size


def test_slots_are_the_same_again_whatever_the_partitions(spark):
    docs = docs_of(spark, many(400))
    first = sorted(map(tuple, sharding.place(docs.repartition(7)).collect()))
    assert first == sorted(map(tuple, sharding.place(docs.repartition(3, "source")).collect()))
    check(many(400), sharding.place(docs).collect())


def test_equal_rows_beyond_a_run_keep_their_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 16)
    rows = [(5, "the same", "en", "a", 1)] * 1000 + many(50)
    found = sharding.place(docs_of(spark, rows)).collect()
    assert len(found) == 1050
    check(rows, found)
    same = sorted(r.slot for r in found if r.doc_id == 5 and r.size == 9)
    assert same == list(range(same[0], same[0] + 1000))


def test_empty_table(spark):
    assert sharding.place(docs_of(spark, [])).collect() == []
    assert sharding.with_shard(docs_of(spark, [])).collect() == []


def test_moved_rows_and_written_shards(spark, tmp_path):
    docs = docs_of(spark, many(300)).withColumn("shard", F.lit("other"))
    moved = sharding.moved(docs, 8, 10).collect()
    assert 0 < len(moved) < 120 and all(r.grown_shard in (8, 9) for r in moved)
    assert sharding.moved(docs, 8, 8).isEmpty()
    with pytest.raises(ValueError):
        sharding.moved(docs, 8, 7)
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, 4, file_rows=20)
    back = spark.read.parquet(path)
    assert sorted(back.columns) == sorted(docs.columns) and back.count() == 300
    expected = {r.doc_id: r.shard for r in sharding.with_shard(docs, 4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == expected
    files = back.groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in files) <= 20


def test_shards_without_a_shuffle(spark):
    plan = sharding.with_shard(docs_of(spark, many(20)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_query_against_a_plain_version(spark, sf):
    import hashlib

    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in entry.queries()["op12_jump_shards"](spark, sf).collect()}
    assert len(found) == len(docs)
    for d in docs:
        key = int(hashlib.md5(str(d.doc_id).encode()).hexdigest()[:16], 16)
        r = found[d.doc_id]
        assert (r.shard, r.grown_shard) == (jump_one(key, 8), jump_one(key, 9))
        assert (r.size, r.text_crc32) == (len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode()))
