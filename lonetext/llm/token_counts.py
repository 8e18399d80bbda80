"""Token counts of a unigram tokenizer by dynamic programming over a trie of the distinct pre-tokens.

A text's pre-tokens are its words, each behind a word mark. The best segmentation of a pre-token maximises the sum of
its pieces' scores; the forward score of a prefix is the best sum up to it. Distinct pre-tokens are sorted, so that
equal prefixes stand together: each prefix, a node of the trie, is computed once, one depth at a time for all nodes of
that depth, and the piece count at a pre-token's last node is its count. Texts add up the counts of their words.

Pieces come from a vocabulary file. Where it has ranks instead of log probabilities, a piece of rank r scores
-log(r + 2.7), Zipf's law. A character outside the vocabulary costs `UNKNOWN` below the lowest score and counts as its
UTF-8 bytes. Equal scores take the segmentation with the shorter last piece.

Defined results: NULL and empty texts have 0 tokens. Rows are treated one by one; a column named like the output is
replaced, all others are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from lonetext.llm.words import coded, mixed, slices, split, texts_of, totals

MARK = "▁"
UNKNOWN = 10.0
SLICE_BYTES = 12 << 20
CHUNK = 32_768  # pre-tokens per table of the dynamic programme
LONG = 48  # code points; longer pre-tokens are handled one at a time
BASE = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    if all(s == round(s) for _, s in pieces):  # ranks of merges
        return [(p, -math.log(-s + 2.7)) for p, s in pieces]
    return pieces


@dataclass
class Vocabulary:
    scores: dict[str, float]
    unknown: float
    longest: int
    hashes: np.ndarray  # sorted
    values: np.ndarray

    @staticmethod
    def of(pieces: Iterable[tuple[str, float]]) -> "Vocabulary":
        scores = dict(pieces)
        if not scores:
            raise ValueError("no pieces")
        names = list(scores)
        keys = np.array([_hash_of(p) for p in names], np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces with one hash")
        return Vocabulary(scores, min(scores.values()) - UNKNOWN, max(map(len, names)), keys,
                          np.array([scores[p] for p in names])[order])

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Scores by hash, minus infinity for strings that are no piece."""
        at = np.searchsorted(self.hashes, keys)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == keys, self.values[at], -np.inf)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hash_of(piece: str) -> np.uint64:
    key = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in mixed(_points(piece).astype(np.uint64) + np.uint64(1)):
            key = key * BASE + c
    return key


def byte_length(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def count_sorted(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Piece counts of sorted distinct pre-tokens of at most LONG code points (without the mark)."""
    marked = [MARK + w for w in words]
    length = np.array([len(w) for w in marked])
    deep = int(length.max())
    points = np.zeros((len(words), deep), np.uint32)
    points[np.arange(deep)[None, :] < length[:, None]] = _points("".join(marked))
    codes = mixed(points.astype(np.uint64).ravel() + np.uint64(1)).reshape(points.shape)
    same = np.cumprod(points[1:] == points[:-1], axis=1).sum(axis=1)
    shared = np.concatenate([[0], np.minimum(same, np.minimum(length[1:], length[:-1]))])
    score = np.full((len(words), deep + 1), -np.inf)
    count = np.zeros((len(words), deep + 1), np.int32)
    prefix = np.zeros((len(words), deep + 1), np.uint64)
    score[:, 0] = 0.0
    power = np.ones(vocabulary.longest + 1, np.uint64)
    result = np.zeros(len(words), np.int64)
    with np.errstate(over="ignore"):
        for k in range(1, len(power)):
            power[k] = power[k - 1] * BASE
        for depth in range(1, deep + 1):
            live = np.flatnonzero(length >= depth)
            new = shared[live] < depth  # the first word of a node; the others share its prefix
            if len(live):
                new[0] = True
                # a word cut out between two live ones ends above this depth, so it shares less than this depth
                gap = np.concatenate([[False], np.diff(live) > 1])
                new |= gap
            node = live[new]
            key = prefix[node, depth - 1] * BASE + codes[node, depth - 1]
            best = np.full(len(node), -np.inf)
            pieces = np.zeros(len(node), np.int32)
            for size in range(1, min(depth, vocabulary.longest) + 1):
                value = vocabulary.look_up(key - prefix[node, depth - size] * power[size])
                added = 1
                if size == 1:
                    lost = np.isinf(value)
                    value = np.where(lost, vocabulary.unknown, value)
                    added = np.where(lost, byte_length(points[node, depth - 1]), 1)
                value = value + score[node, depth - size]
                better = value > best
                best = np.where(better, value, best)
                pieces = np.where(better, count[node, depth - size] + added, pieces)
            run = np.cumsum(new) - 1
            score[live, depth], count[live, depth], prefix[live, depth] = best[run], pieces[run], key[run]
            ended = live[length[live] == depth]
            result[ended] = count[ended, depth]
    return result


def count_long(words: list[str], vocabulary: Vocabulary) -> list[int]:
    """The same for sorted pre-tokens of any length; a word goes on from the prefix it shares with the one before."""
    result, last = [], ""
    score, count = [0.0], [0]
    for word in (MARK + w for w in words):
        keep = 0
        for a, b in zip(last, word):
            if a != b:
                break
            keep += 1
        del score[keep + 1:], count[keep + 1:]
        for end in range(keep + 1, len(word) + 1):
            best, pieces = -math.inf, 0
            for size in range(1, min(end, vocabulary.longest) + 1):
                value = vocabulary.scores.get(word[end - size:end])
                added = 1
                if value is None:
                    if size > 1:
                        continue
                    value, added = vocabulary.unknown, len(word[end - 1].encode("utf-8", "surrogatepass"))
                value += score[end - size]
                if value > best:
                    best, pieces = value, count[end - size] + added
            score.append(best)
            count.append(pieces)
        result.append(count[-1])
        last = word
    return result


def count_words(words: pa.Array, vocabulary: Vocabulary) -> np.ndarray:
    """Piece counts of distinct words."""
    result = np.zeros(len(words), np.int64)
    if not len(words):
        return result
    long = pc.greater(pc.utf8_length(words), LONG).to_numpy(zero_copy_only=False)
    order = pc.sort_indices(words).to_numpy()
    short = order[~long[order]]
    for at in range(0, len(short), CHUNK):
        some = short[at:at + CHUNK]
        result[some] = count_sorted(words.take(pa.array(some)).to_pylist(), vocabulary)
    some = order[long[order]]
    if len(some):
        result[some] = count_long(words.take(pa.array(some)).to_pylist(), vocabulary)
    return result


def with_token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` without the text, with n_tokens. `path` is a vocabulary file, sent to the tasks as a bounded table."""
    pieces = load_pieces(path)
    held = docs.sparkSession.sparkContext.broadcast(pieces)
    names = [c for c in docs.columns if c not in (text, "n_tokens")]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(held.value)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                words, bounds = split(texts_of(part, text))
                ids, distinct = coded(words)
                counts = count_words(distinct, vocabulary)
                sums = totals(counts[ids] if len(ids) else np.empty(0, np.int64), bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in names] + [pa.array(sums, pa.int64())],
                    [*names, "n_tokens"])

    return docs.select(*names, text).mapInArrow(run, schema)
