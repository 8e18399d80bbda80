"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers cut the same bytes; a stretch of text that occurs often is encoded once a slice. Per batch and keyed by document, a pandas `merge_asof` gives each token start of one
side the token of the other side that covers it; the union of both directions are all overlapping pairs of tokens. Bytes
where tokens of both sides end cut a document into groups.

A document's overlaps are kept as counted id pairs. In how many documents a pair occurs is counted over the whole
corpus: tasks add up what they hold, Spark adds up the tasks. The pairs of most documents (a table of fixed size) are
looked up where documents are read, all other pairs are joined.

Defined results: a text that is NULL, empty, or whose tokens' bytes do not join to a space and the text on either side
has no tokens. Strings of special tokens inside a text are plain text. Rows repeated with one id are documents of their
own, each counted. An empty table gives an empty table. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lonetext.common import write_out
from lonetext.llm.words import column, slices, texts_of

SIDE_BITS = 24  # an id pair is one number: A's id times 2^24 plus B's
KNOWN = 1 << 20  # pairs in the table that every task holds, those of most documents
PART_BYTES = 1 << 20  # of texts that are aligned at a time: their tokens take some hundred times as much memory
FLUSH = 1 << 21  # pairs a task adds up before it sends them on
# Fixed value: the pattern that byte-level tokenizers split a text with before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# --- tokenizers ------------------------------------------------------------------------------------------------------

def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones for themselves, others shifted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if chr(b) not in symbols)
    return symbols | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level merge vocabulary from its JSON file; encodes a space and the text."""

    def __init__(self, path: str, content: bytes):
        import tiktoken

        model = json.loads(content)
        symbols = byte_symbols()
        special = {t["content"] for t in model["added_tokens"] if t["special"]}
        vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        order = [vocab["".join(m)] for m in merges]
        if order != sorted(order) or len(set(order)) != len(order):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t
        self.encoding = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, stretches: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(s) for s in stretches]


class Pieces:
    """A piece model; it adds the leading space itself."""

    def __init__(self, path: str, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.bytes = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece) if self.model.is_byte(i) else None
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        if any(b" " in b.lstrip(b" ") for b in self.bytes):
            raise ValueError(f"{path}: a piece goes on after a word's end")
        self.blank = [self.model.piece_to_id("▁")]

    def encode(self, stretches: list[str]) -> list[list[int]]:
        found = self.model.encode([s[1:] for s in stretches], num_threads=1)  # the model adds the space again
        return [ids if len(s) > 1 else self.blank for s, ids in zip(stretches, found)]


class Stretches:
    """A space and each text, cut before every space that follows a visible ASCII character.

    Neither tokenizer has a token across such a place: the byte-level pattern takes a space with what follows it, and no
    piece goes on after a word's end. So the tokens of the stretches are those of the text.
    """

    def __init__(self, texts: pa.LargeStringArray):
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        data, begin = buffer_of(spaced)
        raw = np.frombuffer(data, np.uint8)[:begin[-1]]
        cut = np.flatnonzero((raw[1:] == 32) & (raw[:-1] > 32) & (raw[:-1] < 127)) + 1
        cut = np.sort(np.concatenate([cut, begin]))  # every text begins with its space, which follows another text
        cut = cut[np.append(True, np.diff(cut) > 0)]
        flat = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype(np.int64)), spaced.buffers()[2])
        coded = flat.dictionary_encode()
        self.distinct, self.index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.bounds = np.searchsorted(cut, begin)


class Side:
    """One tokenizer's ids, their bytes and decimal names as Arrow arrays."""

    def __init__(self, tokenizer: ByteLevel | Pieces, last: str):
        self.tokenizer = tokenizer
        self.bytes = pa.array(tokenizer.bytes, pa.large_binary())
        self.length = np.array([len(b) for b in tokenizer.bytes], np.int64)
        n = len(self.length)
        # an id with each of the signs that can follow it: a comma inside a group, `last` at its end, none at the very end
        self.names = pa.array([f"{i}{sign}" for sign in (",", last, "") for i in range(n)], pa.large_string())

    def named(self, ids: np.ndarray, sign: np.ndarray) -> np.ndarray:
        return ids + sign * len(self.length)

    def encode(self, words: Stretches) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has. A stretch is encoded once, however often it occurs."""
        lists = self.tokenizer.encode(words.distinct)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
        each = pa.LargeListArray.from_arrays(pa.array(starts_of(n)), pa.array(flat))
        return each.take(pa.array(words.index)).flatten().to_numpy(), np.diff(starts_of(n[words.index])[words.bounds])


def starts_of(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


def buffer_of(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The joined bytes of an Arrow array of strings, and where each begins."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    return memoryview(data if data is not None else b""), offsets


# --- one batch -------------------------------------------------------------------------------------------------------

class Tokens:
    """The tokens of one side of a batch: id, document, first byte and the byte after the last, within the document."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, length: np.ndarray):
        self.ids, self.n = ids, n
        self.doc = np.repeat(np.arange(len(n)), n)
        size = length[ids]
        whole = starts_of(size)
        self.first = starts_of(n)
        self.base = whole[self.first]
        self.start = whole[:-1] - np.repeat(self.base[:-1], n)
        self.end = self.start + size

    def frame(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"start": self.start, "doc": self.doc, name: np.arange(len(self.ids))})


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (token of a, token of b) that share a byte, by one `merge_asof` in each direction.

    Both sides cover the same bytes, so the last token that starts at or before a position covers it. Pairs of tokens
    with one start are found both ways and kept once.
    """
    left, right = a.frame("a"), b.frame("b")
    # merge_asof wants its `on` column sorted over all documents
    left["at"], right["at"] = left["start"] + a.base[left["doc"]], right["start"] + b.base[right["doc"]]
    forth = pd.merge_asof(left[["at", "doc", "a"]], right[["at", "doc", "b", "start"]], on="at", by="doc")
    back = pd.merge_asof(right[["at", "doc", "b", "start"]], left[["at", "doc", "a"]].assign(met=left["at"]), on="at", by="doc")
    back = back[back["met"] < back["at"]]
    return (np.concatenate([forth["a"].to_numpy(np.int64), back["a"].to_numpy(np.int64)]),
            np.concatenate([forth["b"].to_numpy(np.int64), back["b"].to_numpy(np.int64)]))


def group_numbers(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of every token of both sides, numbered over the batch, and how many groups each document has."""
    # ends as places in the batch's bytes: documents follow each other, and both sides have the same bytes
    end_a, end_b = a.end + np.repeat(a.base[:-1], a.n), b.end + np.repeat(b.base[:-1], b.n)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    groups = np.searchsorted(cuts, a.base[1:], side="right") - np.searchsorted(cuts, a.base[:-1], side="right")
    return np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), groups


def group_texts(a: Tokens, b: Tokens, side_a: Side, side_b: Side, group_a: np.ndarray, group_b: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of every document."""
    n_groups = int(group_a.max()) + 1 if len(group_a) else 0
    per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    before_b, upto_a = starts_of(per_b)[:-1], starts_of(per_a)[1:]
    place_a, place_b = np.arange(len(group_a)) + before_b[group_a], np.arange(len(group_b)) + upto_a[group_b]
    last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    final = np.zeros(len(group_b), bool)
    final[b.first[1:][b.n > 0] - 1] = True
    code = np.empty(len(group_a) + len(group_b), np.int64)
    code[place_a] = side_a.named(a.ids, last_a.astype(np.int64))
    code[place_b] = side_b.named(b.ids, last_b.astype(np.int64) + final) + len(side_a.names)
    names = pa.concat_arrays([side_a.names, side_b.names])
    data, offsets = buffer_of(names.take(pa.array(code)))
    cut = offsets[a.first + b.first]
    return [bytes(data[s:e]) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]


def same_bytes(ids: np.ndarray, n: np.ndarray, side: Side, texts: pa.Array) -> np.ndarray:
    """Whether the tokens of each text join to a space and the text."""
    joined, at = buffer_of(side.bytes.take(pa.array(ids)))
    at = at[starts_of(n)]
    raw, begin = buffer_of(texts)
    good = np.diff(at) == np.diff(begin) + 1
    for i in np.flatnonzero(good).tolist():
        good[i] = (joined[at[i]:at[i] + 1] == b" "
                   and joined[at[i] + 1:at[i + 1]] == raw[begin[i]:begin[i + 1]])
    return good


def align(texts: pa.Array, side_a: Side, side_b: Side) -> dict[str, pa.Array]:
    """Per text: n_a, n_b, n_groups, n_links, groups_sha256, and its id pairs with the links of each."""
    texts = texts.cast(pa.large_string())
    words = Stretches(texts)
    (ids_a, n_a), (ids_b, n_b) = side_a.encode(words), side_b.encode(words)
    good = same_bytes(ids_a, n_a, side_a, texts) & same_bytes(ids_b, n_b, side_b, texts)
    good &= pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
    a = Tokens(ids_a, np.where(good, n_a, 0), side_a.length)
    b = Tokens(ids_b, np.where(good, n_b, 0), side_b.length)
    at_a, at_b = overlaps(a, b)
    group_a, group_b, groups = group_numbers(a, b)
    shown = group_texts(a, b, side_a, side_b, group_a, group_b)
    digests = [hashlib.sha256(s).hexdigest() if ok else "" for s, ok in zip(shown, good.tolist())]
    doc, code = a.doc[at_a], (a.ids[at_a] << SIDE_BITS) | b.ids[at_b]
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(code)))
    bounds = pa.array(starts_of(np.bincount(doc[heads], minlength=len(texts))), pa.int32())
    return {"n_a": pa.array(a.n), "n_b": pa.array(b.n), "n_groups": pa.array(groups, pa.int64()),
            "n_links": pa.array(np.bincount(doc, minlength=len(texts)), pa.int64()),
            "groups_sha256": pa.array(digests, pa.string()),
            "pairs": pa.ListArray.from_arrays(bounds, pa.array(code[heads], pa.int64())),
            "times": pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32()))}


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, times array<int>")


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """A tokenizer's file, read once by the driver: a vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Every document's alignment; `row` tells rows apart once the table is written."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((byte_level, file_bytes(spark, byte_level), pieces, file_bytes(spark, pieces)))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path_a, file_a, path_b, file_b = held.value
        side_a, side_b = Side(ByteLevel(path_a, file_a), "|"), Side(Pieces(path_b, file_b), ";")
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, slice_bytes=PART_BYTES):
                # copies of a text that lie together are aligned once
                coded = texts_of(part).dictionary_encode()
                found = align(coded.dictionary, side_a, side_b)
                rows = pa.array(np.arange(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows, column(part, "doc_id"), *[found[c].take(coded.indices) for c in COLUMNS]],
                    ["row", "doc_id", *COLUMNS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, ALIGNED)


# --- counts over the corpus ------------------------------------------------------------------------------------------

def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents a pair occurs, and whether that is the most for its A id."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            own, times = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            pairs, inverse = np.unique(np.concatenate([pairs, own]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, times]), len(pairs)).astype(np.int64)
            if len(pairs) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                pairs, counts = pairs[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    parts = table.select("pairs").mapInArrow(count, "pair long, n long")
    counted = write_out(parts.groupBy("pair").agg(F.sum("n").alias("count")), "align-counts")
    token = F.shiftright("pair", SIDE_BITS)
    most = counted.groupBy(token.alias("token")).agg(F.max("count").alias("most"))  # one row per id of the vocabulary
    return counted.join(most, token == F.col("token")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def known_pairs(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `size` pairs of most documents, in order of the pair."""
    top = counts.orderBy(F.desc("count"), "pair").limit(size).toPandas().sort_values("pair")
    return top["pair"].to_numpy(np.int64), top["count"].to_numpy(np.int64), top["best"].to_numpy(bool)


def with_pair_counts(table: DataFrame, counts: DataFrame, known: int = KNOWN) -> DataFrame:
    """Add `n_best` and `count_sum` to aligned documents."""
    spark = table.sparkSession
    held = spark.sparkContext.broadcast(known_pairs(counts, known))
    fields = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "sure_best long, sure_sum long, rare array<struct<pair: long, times: int>>")

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, count, best = held.value
        for batch in batches:
            lists = column(batch, "pairs")
            own, times = lists.flatten().to_numpy(), column(batch, "times").flatten().to_numpy().astype(np.int64)
            size = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), size)
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            met = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            at, some = at[met], times[met]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], doc[met], some * best[at])
            np.add.at(sums[1], doc[met], some * count[at])
            rest = ~met
            bounds = starts_of(np.bincount(doc[rest], minlength=batch.num_rows))
            rare = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(own[rest]), pa.array(times[rest], pa.int32())], ["pair", "times"]))
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in fields], pa.array(sums[0]), pa.array(sums[1]), rare],
                                             [*fields, "sure_best", "sure_sum", "rare"])

    first = write_out(table.select(*fields, "pairs", "times").mapInArrow(look_up, schema), "align-known")
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.times").join(counts, "pair")
    late = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("late_best"),
                                   F.sum(F.col("times") * F.col("count")).alias("late_sum"))
    zero = F.lit(0).cast("long")
    return first.join(late, "row", "left").select(
        *fields[1:-1], (F.col("sure_best") + F.coalesce("late_best", zero)).alias("n_best"),
        (F.col("sure_sum") + F.coalesce("late_sum", zero)).alias("count_sum"), "groups_sha256")


def align_documents(docs: DataFrame, byte_level: str, pieces: str, known: int = KNOWN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    table = write_out(aligned(docs, byte_level, pieces), "align-documents")
    counts = write_out(pair_counts(table), "align-pairs")
    return with_pair_counts(table, counts, known)
