import hashlib
import itertools
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm_rows import docs_of, many, odd_rows
from lonetext.llm import token_alignment
from lonetext.llm.catalog import BYTE_LEVEL, PIECES
from lonetext.llm.token_alignment import ByteLevel, Pieces, Side, Tokens, align, align_documents, overlaps

ODD = ["", " ", "  a  b ", "a\n  b\t c ", "x" * 3000, "don't <|endoftext|> </s> <0x41> a", "▁ a", "日本語 テキスト \U0001f600",
       "a b", "é b  ", "\0 a\x01", "　 x  y", "tab\t \n end\n", "a.b c's  'll", " " * 50 + "z", "Straße naïve"]


@pytest.fixture(scope="module")
def tools():
    whole = Tokenizer.from_file(BYTE_LEVEL)
    whole.encode_special_tokens = True
    with open(BYTE_LEVEL, "rb") as f, open(PIECES, "rb") as g:
        a, b = Side(ByteLevel(BYTE_LEVEL, f.read()), "|"), Side(Pieces(PIECES, g.read()), ";")
    return whole, sentencepiece.SentencePieceProcessor(model_file=PIECES), a, b


def plain(text, tools):
    """(ids a, ids b, groups, links) of a text by loops over its whole tokens."""
    whole, pieces, side_a, side_b = tools
    ids_a = whole.encode(" " + (text or ""), add_special_tokens=False).ids
    ids_b = pieces.encode(text or "")
    bytes_a, bytes_b = ([s.tokenizer.bytes[i] for i in ids] for s, ids in ((side_a, ids_a), (side_b, ids_b)))
    if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], Counter()
    ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
    spans_a, spans_b = list(zip([0, *ends_a], ends_a)), list(zip([0, *ends_b], ends_b))
    covering = {p: j for j, (s, e) in enumerate(spans_b) for p in range(s, e)}
    links = Counter((ids_a[i], ids_b[j]) for i, (s, e) in enumerate(spans_a) for j in {covering[p] for p in range(s, e)})
    groups, x, y = [], 0, 0
    upto_a, upto_b = ({e: k for k, e in enumerate(ends, 1)} for ends in (ends_a, ends_b))
    for end in sorted(set(ends_a) & set(ends_b)):
        to_a, to_b = upto_a[end], upto_b[end]
        groups.append(",".join(map(str, ids_a[x:to_a])) + "|" + ",".join(map(str, ids_b[y:to_b])))
        x, y = to_a, to_b
    return ids_a, ids_b, groups, links


def expected(rows, tools):
    parts = [(i, *plain(t, tools)) for i, t in rows]
    docs = Counter(p for *_, links in parts for p in links)
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    return sorted(((i, len(a), len(b), len(g), sum(links.values()),
                    sum(n for p, n in links.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in links.items()),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, links in parts), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_batch_against_loops(tools):
    texts = ODD + [t for _, t, *_ in many(40)]
    got = align(pa.array(texts, pa.large_string()), *tools[2:])
    for i, t in enumerate(texts):
        a, b, g, links = plain(t, tools)
        assert [got[c][i].as_py() for c in ("n_a", "n_b", "n_groups", "n_links")] == [len(a), len(b), len(g), sum(links.values())], t
        pairs = dict(zip(got["pairs"][i].as_py(), got["times"][i].as_py()))
        assert pairs == {(x << token_alignment.SIDE_BITS) + y: n for (x, y), n in links.items()}


def test_overlaps_are_all_pairs_that_share_a_byte(tools):
    import numpy as np

    r = np.random.default_rng(3)
    length = np.arange(1, 6)
    sizes = [r.integers(1, 60) for _ in range(30)] + [0]
    def side():
        ids, n = [], []
        for size in sizes:
            left, k = size, 0
            while left:
                step = int(min(left, r.integers(1, 6)))
                ids.append(step - 1)
                left, k = left - step, k + 1
            n.append(k)
        return Tokens(np.array(ids), np.array(n), length)
    a, b = side(), side()
    brute = {(i, j) for i in range(len(a.ids)) for j in range(len(b.ids))
             if a.doc[i] == b.doc[j] and a.start[i] < b.end[j] and b.start[j] < a.end[i]}
    x, y = overlaps(a, b)
    assert len(x) == len(brute) and set(zip(x.tolist(), y.tolist())) == brute


@pytest.mark.parametrize("known", [0, 40, 1 << 20])
def test_documents_against_brute_force(spark, tools, known):
    rows = odd_rows() + [(100 + i, t, "en", "a", 0) for i, t in enumerate(ODD)] + many(60)
    rows += [(500, many(1)[0][1], "en", "a", 0)] * 5  # one hot text
    got = found(align_documents(docs_of(spark, rows, clashing=known == 40), BYTE_LEVEL, PIECES, known))
    assert got == expected([(r[0], r[1]) for r in rows], tools)


def test_empty_table(spark):
    assert align_documents(docs_of(spark, []), BYTE_LEVEL, PIECES).collect() == []
    assert found(align_documents(docs_of(spark, [(1, None, None, None, None)]), BYTE_LEVEL, PIECES)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query_against_brute_force(spark, sf, tools):
    import __spark_entry__ as entry

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(entry.queries()["op13_token_alignment"](spark, sf)) == expected(rows, tools)
