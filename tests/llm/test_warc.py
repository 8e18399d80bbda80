import base64
import hashlib
import random

import pytest
from llm_rows import prose
from lonetext.llm import warc

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    result = set()
    for i, _, html in rows:
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        size = len((html or "").encode())
        again = size >= least and same and i != max(same)
        result.add((i, size, digest(html), "revisit" if again else "response", max(same) if again else None))
    return result


def pages():
    r = random.Random(3)
    rows = [(i, f"http://x/{i} é\n", prose(i % 23, r.choice((5, 60, 6000))) if i % 9 else "same") for i in range(60)]
    return rows + [(70, None, None), (71, "", ""), (72, "u", "日本\r\n\r\nWARC/1.1\r\n\r\n" * 3000), (73, "u", "\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, tmp_path, least):
    rows = pages()
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "w"), least).collect()
    assert len(found) == len(rows) and {tuple(r) for r in found} == brute(rows, least)


def test_payloads_come_back(spark, tmp_path):
    rows, path = pages(), str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path, segment_bytes=1000)
    found = {r.record_id.split(":")[2]: r for r in warc.read_archives(spark, path).collect()}
    for i, _, html in rows:
        r = found[str(i)]
        assert r.problem is None and (r.record_type == "revisit" or bytes(r.payload) == (html or "").encode())
    assert sum(r.record_type == "revisit" for r in found.values()) > 5


def test_repeated_rows_null_ids_and_empty_tables(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "u", "alone"), (2, "u", "y" * 40_000)] * 2
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a")).collect()
    assert len(found) == 10 and {tuple(r) for r in found} == brute(rows)
    assert sorted(tuple(r)[:2] for r in found if r.page_id in (1, 2)) == [(1, 1)] * 4 + [(2, 40_000)] * 2
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), str(tmp_path / "b")).collect() == []


def test_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x", "d", "k")], SCHEMA + ", digest string, keeper string")
    assert [r.page_id for r in warc.round_trip(df, str(tmp_path / "w")).collect()] == [1]


def test_chunked_framing():
    for payload in (b"", b"a", b"\r\n" * 50, bytes(range(256)) * 40):
        for size in (1, 7, 4096):
            assert warc.unchunked(warc.chunked(payload, size)) == payload
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nab", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"-1\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_segments_are_checked():
    assert warc.joined_segments([(1, None, b"a"), (2, 2, b"b")]) == b"ab"
    for bad in ([(2, 1, b"a")], [(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, None, b"b")], [(1, None, b"a"), (2, 9, b"b")]):
        with pytest.raises(ValueError):
            warc.joined_segments(bad)


def test_broken_archives_are_reported(spark, tmp_path):
    path = tmp_path / "w"
    path.mkdir()
    records = warc.page_records(5, "u", b"x" * 5000, warc.digest_of(b"x" * 5000), None, 1000)
    whole = warc.page_records(6, "u", b"y", warc.digest_of(b"z"), None)
    r = random.Random(1)
    for k, drop in enumerate((0, 2, len(records) - 1)):
        some = [x for n, x in enumerate(records) if n != drop]
        r.shuffle(some)
        some = [x.replace(b"page:5:", b"page:%d:" % (50 + k)) for x in some]
        (path / f"{k}.warc").write_bytes(b"".join(x + b"\r\n\r\n" for x in some))
    (path / "9.warc").write_bytes(b"".join(x + b"\r\n\r\n" for x in whole))
    shuffled = list(records)
    r.shuffle(shuffled)
    (path / "a.warc").write_bytes(b"".join(x + b"\r\n\r\n" for x in shuffled))
    found = {x.record_id.split(":")[2]: (x.problem, x.payload_bytes) for x in warc.read_archives(spark, str(path)).collect()}
    assert found == {"50": ("first segment missing", None), "51": ("segments missing", None),
                     "52": ("last segment missing", None), "6": ("payload digest", None), "5": (None, 5000)}
