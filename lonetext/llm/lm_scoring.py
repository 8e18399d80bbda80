"""LM scoring: a log-bilinear model trained by noise-contrastive estimation, over all documents.

Tokens are the words of a text with A-Z in lower case, then one end token. Token counts come from all training
documents. The `WORDS` most frequent words and the end token have a vector as context and one as target. The model
predicts a token from the two before it in two levels: their vectors, each scaled per dimension, add up to the predicted
vector, whose products with the heads' vectors plus offsets score the heads. The most frequent words and the end token
are heads of their own (the classes), the other words are members of heads of `GROUP` words of like frequency, scored
within their head in the same way, and one head (`REST`) stands for all words beyond the vocabulary. Scoring normalises
both levels by matrix products. A word beyond the vocabulary has its head's probability times its smoothed share of the
head, so the probabilities of all words and the unknown word add up to one.

A pass goes over every token of the training documents: texts are kept as word numbers, dealt by their hash to shards of
about `SHARD_TOKENS` tokens, and every shard runs steps of noise-contrastive estimation over its rows. A pass is cut into
rounds, one more whenever the shards double; a round takes its part of the shards, and a vector of the next round is the
mean over them, weighted by how often each met it. A corpus too small for `STEPS` steps is passed over until it has had
them, in whole passes. Shards, orders and noise follow from the texts and the seed, not from how files are dealt to tasks.

Bounds: the vocabulary (`WORDS`), the classes (`CLASSES`), the table of frequent counts sent to every task (`FREQUENT`;
all other words are joined by hash). Counts and passes cover every training document. Words are told apart by 64-bit
hashes.

Defined results: a NULL or empty text is the end token alone; a NULL id belongs to the training documents. Repeated rows
count and score one by one. Without training documents every word is unknown, and the model equals the base.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from lonetext.common import write_out
from lonetext.llm.words import coded, column, hashed, slices, split, texts_of, totals

CLASSES = 256
FREQUENT = 1 << 18
WORDS = 1 << 17
GROUP = 256
DIM = 24
SHARD_TOKENS = 4 << 20
STEPS = 1800  # at least: a small corpus is passed over several times
BATCH = 2048
NOISE = 32
MANY = 8  # values of a row, above which they are summed by a call of their own
MEMBER_NOISE = 2  # of a row, from its own head
MOST_FILES = 4096  # of the stored word numbers; a file may hold several shards
MODEL_BLOCK = 1024  # rows of the model's table in a row of the shuffle
RATE = 0.1
FLUSH = 1 << 20
PREDICTED = 1 << 14  # predicted vectors that are handled at a time
HEADS = 32  # heads whose exponentials are held for all words of a slice
SUMMED = 1 << 12  # pairs whose products are summed at a time
END = np.uint64(1)  # the hash of the end token; no word hash is below 16
REST = 0  # the class of words without one; as a head, of words beyond the vocabulary

HELD_OUT_REMAINDER = 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == HELD_OUT_REMAINDER, F.lit(False))


def token_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each token among the hashes that follow, ends included, these hashes once a word, and the bounds of
    each text's tokens. What is asked of a word is asked once for all its tokens."""
    words, bounds = split(pc.ascii_lower(texts))
    ids, distinct = coded(words)
    hashes = np.append(np.maximum(hashed(distinct), np.uint64(16)), END)
    n = len(bounds) - 1
    out = bounds + np.arange(n + 1)
    result = np.full(out[-1], len(hashes) - 1)
    if len(ids):
        result[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return result, hashes, out


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, ends included, and the bounds of each text's tokens."""
    ids, hashes, bounds = token_words(texts)
    return hashes[ids], bounds


class Tally:
    """Counts of 64-bit keys, handed out whenever enough have come together."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """`counts` are those of the keys, 1 each if not given."""
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > FLUSH:
            self._merge()

    def _merge(self) -> None:
        distinct, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.size = [distinct], [counts], len(distinct)

    def taken(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.size > least:
            self._merge()
        if self.size > least:
            keys, counts = self.keys[0].astype(np.uint64).view(np.int64), self.counts[0]
            self.__init__()
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + 100_000]), pa.array(counts[at:at + 100_000])],
                                                 ["key", "c"])


def token_counts(training: DataFrame) -> DataFrame:
    """(key, c): how often each token occurs in the training documents."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in slices(batch):
                ids, hashes, _ = token_words(texts_of(part))
                tally.add(hashes, np.bincount(ids, minlength=len(hashes)))
                yield from tally.taken(FLUSH)
        yield from tally.taken()

    return training.select("text").mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What every task knows: the frequent tokens with counts, their classes, and the sums over all tokens."""
    keys: np.ndarray  # sorted
    counts: np.ndarray
    classes: np.ndarray  # of the frequent tokens; REST for those without a class of their own
    n_classes: int
    train_tokens: int
    distinct: int
    class_counts: np.ndarray
    n_members: int = 0  # vocabulary words without a class of their own, numbered after the classes
    codes: np.ndarray = field(default=None)  # number of each frequent token; REST beyond the vocabulary

    def __post_init__(self) -> None:
        if self.codes is None:
            self.codes = self.classes
        own = self.codes >= self.n_classes
        self.member_counts = np.zeros(self.n_members, np.int64)
        self.member_counts[self.codes[own] - self.n_classes] = self.counts[own]

    @property
    def n_words(self) -> int:
        return self.n_classes + self.n_members

    @property
    def head_counts(self) -> np.ndarray:
        """Counts of the classes, REST without the members, and of the heads of members."""
        own = self.class_counts.copy()
        own[REST] -= self.member_counts.sum()
        return np.concatenate([own, np.add.reduceat(self.member_counts, np.arange(0, self.n_members, GROUP))
                               if self.n_members else self.member_counts])

    @property
    def base_total(self) -> float:
        return self.train_tokens + 0.5 * (self.distinct + 1)

    @property
    def rest_total(self) -> float:
        """The smoothed counts of all tokens of the class REST, the unknown one included."""
        own = self.n_classes - 1
        return self.train_tokens - self.class_counts[1:].sum() + 0.5 * (self.distinct - own + 1)

    @property
    def beyond_total(self) -> float:
        """The same of the tokens beyond the vocabulary."""
        return self.rest_total - self.member_counts.sum() - 0.5 * self.n_members

    def places(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each token among the frequent ones, and whether it is one."""
        at = np.searchsorted(self.keys, tokens)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == tokens if len(self.keys) else np.zeros(len(tokens), bool))


def vocabulary(counts: DataFrame, n_classes: int = CLASSES, frequent: int = FREQUENT, words: int = WORDS) -> Vocabulary:
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "key").limit(frequent).toArrow()  # at most `frequent` pairs of numbers
    keys, number = top["key"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.lexsort((keys, -number, keys != END))  # the end token always has a class
    classes = np.zeros(len(keys), np.int64)
    own = order[:n_classes - 1]
    if len(own) and keys[order[0]] != END:  # not among the frequent ones
        own = order[:0]
    classes[own] = np.arange(1, len(own) + 1)
    size = len(own) + 1
    class_counts = np.zeros(size, np.int64)
    class_counts[classes[own]] = number[own]
    class_counts[REST] = int(sums[0]) - class_counts[1:].sum()
    codes, members = classes.copy(), order[len(own):words]
    codes[members] = np.arange(size, size + len(members))
    at = np.argsort(keys)
    return Vocabulary(keys[at], number[at], classes[at], size, int(sums[0]), int(sums[1]), class_counts, len(members),
                      codes[at])


def word_codes(tokens: np.ndarray, known: Vocabulary) -> np.ndarray:
    at, found = known.places(tokens)
    return np.where(found, known.codes[at] if len(known.keys) else 0, REST)


def code_triples(own: np.ndarray, bounds: np.ndarray, n_words: int) -> np.ndarray:
    """(before last, last, own) of every word number as one number each; the start of a text is `n_words`."""
    return Triples(own, bounds, n_words)[np.arange(len(own))]


class Triples:
    """The triples of `code_triples`, made when they are asked for: what is held are the word numbers themselves."""

    def __init__(self, own: np.ndarray, bounds: np.ndarray, n_words: int):
        self.own, self.n_words = own, n_words
        self.behind = np.full(len(own), 2, np.int8)  # words of the text before this one, two at most
        first = bounds[:-1]
        self.behind[first[np.diff(bounds) > 1] + 1] = 1
        self.behind[first] = 0

    def __len__(self) -> int:
        return len(self.own)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        behind, base = self.behind[at], self.n_words + 1
        last = np.where(behind > 0, self.own[at - 1], self.n_words).astype(np.int64)
        before = np.where(behind > 1, self.own[at - 2], self.n_words).astype(np.int64)
        return (before * base + last) * base + self.own[at]


def class_triples(tokens: np.ndarray, bounds: np.ndarray, known: Vocabulary) -> np.ndarray:
    return code_triples(word_codes(tokens, known), bounds, known.n_words)


def coded_texts(training: DataFrame, known: Vocabulary, shards: int) -> DataFrame:
    """(shard, codes) of every training document: its word numbers; the shard is a hash of them."""
    held = training.sparkSession.sparkContext.broadcast(known)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, hashes, bounds = token_words(texts_of(part))
                codes = word_codes(hashes, held.value).astype(np.int32)[ids]
                yield pa.RecordBatch.from_arrays([pa.array(
                    [codes[start:end].tobytes() for start, end in zip(bounds[:-1], bounds[1:])], pa.binary())], ["codes"])

    rows = training.select("text").mapInArrow(code, "codes binary")
    return rows.select(F.pmod(F.xxhash64("codes"), F.lit(shards)).cast("int").alias("shard"), "codes")


@dataclass
class LogBilinear:
    """Word vectors as context (start included), heads' vectors as target, scales of the two places, offsets of the
    heads, and vectors and offsets of the members within their heads."""
    context: np.ndarray
    target: np.ndarray
    scale: np.ndarray
    offset: np.ndarray
    member: np.ndarray
    member_offset: np.ndarray

    @staticmethod
    def fresh(class_counts: np.ndarray, dim: int = DIM, seed: int = 0,
              member_counts: np.ndarray = np.empty(0, np.int64)) -> "LogBilinear":
        """`class_counts` are the heads' counts, those of the members' heads last."""
        draw = np.random.default_rng(seed)
        n, m = len(class_counts), len(member_counts)
        share = (class_counts + 0.5) / (class_counts.sum() + 0.5 * n)
        head = np.arange(m) // GROUP
        inside = np.bincount(head, member_counts + 0.5)[head] if m else np.empty(0)
        return LogBilinear(draw.normal(0, 0.1, (n - -(-m // GROUP) + m + 1, dim)), draw.normal(0, 0.1, (n, dim)),
                           np.ones((2, dim)), np.log(share), draw.normal(0, 0.1, (m, dim)),
                           np.log((member_counts + 0.5) / inside))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.target, self.scale, self.offset, self.member, self.member_offset]

    @property
    def n_classes(self) -> int:
        return len(self.context) - 1 - len(self.member)

    def heads(self, words: np.ndarray) -> np.ndarray:
        return np.where(words < self.n_classes, words, self.n_classes + (words - self.n_classes) // GROUP)

    def predicted(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        result = self.context[before]
        result *= self.scale[0]
        for at in range(0, len(result), PREDICTED):
            other = self.context[last[at:at + PREDICTED]]
            other *= self.scale[1]
            result[at:at + PREDICTED] += other
        return result

    def log_probability(self, triples: np.ndarray) -> np.ndarray:
        """Natural logarithms of the words' probabilities, once per distinct triple, heads once per distinct context."""
        every, of = np.unique(triples, return_inverse=True)
        return self._distinct(every)[of]

    def _distinct(self, triples: np.ndarray) -> np.ndarray:
        base = len(self.context)
        pairs, inverse = np.unique(triples // base, return_inverse=True)
        words = triples % base
        before, before_at = np.unique(pairs // base, return_inverse=True)
        last, last_at = np.unique(pairs % base, return_inverse=True)
        before, last = ((self.context[x] * scale).astype(np.float32, copy=False)
                        for x, scale in zip((before, last), self.scale))
        target, offset, member, member_offset = (x.astype(np.float32, copy=False) for x in (
            self.target, self.offset, self.member, self.member_offset))
        # where no product can leave the range of exponentials, sums need no shift
        longest = _longest(before) + _longest(last)
        plain = [longest * _longest(x) + np.abs(y).max(initial=0) < 60 for x, y in ((target, offset), (member, member_offset))]

        def hidden(at: np.ndarray | slice) -> np.ndarray:
            result = before.take(before_at[at], axis=0)
            result += last.take(last_at[at], axis=0)
            return result

        if plain[0]:
            norm = _shared_sums(before, last, before_at, last_at, target, offset)
        else:
            norm = np.empty(len(pairs))
            for at in range(0, len(pairs), 1024):
                norm[at:at + 1024] = _log_sums(hidden(slice(at, at + 1024)) @ target.T + offset)
        own = self.heads(words)
        result = np.empty(len(triples))
        for at in range(0, len(triples), PREDICTED):
            rows = slice(at, at + PREDICTED)
            result[rows] = (np.einsum("ij,ij->i", hidden(inverse[rows]), target.take(own[rows], axis=0)) + offset[own[rows]]
                            - norm[inverse[rows]])
        inner = np.flatnonzero(words >= self.n_classes)
        inner = inner[np.argsort(own[inner], kind="stable")]
        cuts = np.flatnonzero(np.diff(own[inner])) + 1
        for some in np.split(inner, cuts) if len(inner) else ():
            first = (own[some[0]] - self.n_classes) * GROUP
            for at in range(0, len(some), 4096):
                rows = some[at:at + 4096]
                logits = hidden(inverse[rows]) @ member[first:first + GROUP].T
                logits += member_offset[first:first + GROUP]
                place = words[rows] - self.n_classes - first
                result[rows] += logits[np.arange(len(rows)), place]
                result[rows] -= _log_sums(logits, plain[1])
        return result

    def parts(self) -> list[tuple[np.ndarray, np.ndarray | int]]:
        return [(self.context, 0), (self.member, self.member_offset), (self.target, self.offset), (self.scale, 0)]

    def rows(self) -> int:
        return sum(len(x) for x, _ in self.parts())

    def table(self) -> np.ndarray:
        """All numbers as rows of vector and offset: contexts, members, heads, scales."""
        result, at = np.empty((self.rows(), self.context.shape[1] + 1), np.float32), 0
        for vectors, offsets in self.parts():
            result[at:at + len(vectors), :-1] = vectors
            result[at:at + len(vectors), -1] = offsets
            at += len(vectors)
        return result

    def moved_from(self, old: "LogBilinear") -> np.ndarray:
        """The table of this model less that of another one."""
        result, at = self.table(), 0
        for vectors, offsets in old.parts():
            result[at:at + len(vectors), :-1] -= vectors
            result[at:at + len(vectors), -1] -= offsets
            at += len(vectors)
        return result

    def of_table(self, table: np.ndarray) -> "LogBilinear":
        context, member, target, scale = np.split(table, np.cumsum([len(self.context), len(self.member),
                                                                    len(self.target)]))
        return LogBilinear(context[:, :-1], target[:, :-1], scale[:, :-1], target[:, -1], member[:, :-1], member[:, -1])


def _longest(vectors: np.ndarray) -> float:
    """The greatest length of a row."""
    return math.sqrt(max((float(np.einsum("ij,ij->i", x, x).max(initial=0)) for x in np.split(
        vectors, range(PREDICTED, len(vectors), PREDICTED))), default=0))


def _shared_sums(before: np.ndarray, last: np.ndarray, before_at: np.ndarray, last_at: np.ndarray, target: np.ndarray,
                 offset: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all heads of exponentials, for the pairs of `before[before_at]` and `last[last_at]`.

    The exponential of a sum is the product of exponentials, so these are taken once a word and not once a pair. Pairs
    come by their first word: of that one only a run is held at a time, of the other all words, for some heads at a time.
    """
    sums = np.zeros(len(before_at))
    for at in range(0, len(target), HEADS):
        some = slice(at, at + HEADS)
        other = last @ target[some].T
        other += offset[some]
        np.exp(other, out=other)
        for k in range(0, len(sums), SUMMED):
            rows = slice(k, k + SUMMED)
            first, end = before_at[k], before_at[rows][-1] + 1
            one = before[first:end] @ target[some].T
            np.exp(one, out=one)
            sums[rows] += np.einsum("ij,ij->i", one.take(before_at[rows] - first, axis=0), other.take(last_at[rows], axis=0))
        del other
    return np.log(sums)


def _log_sums(logits: np.ndarray, plain: bool = False) -> np.ndarray:
    """Logarithms of the rows' sums of exponentials; `logits` is overwritten. `plain` ones are small enough as they are."""
    top: np.ndarray | float = 0.0
    if not plain:
        top = logits.max(axis=1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return top + np.log((logits @ np.ones(logits.shape[1], logits.dtype)).astype(np.float64))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(z, -30, 30, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _scattered(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of values added up by row number."""
    result = np.zeros((size, values.shape[1]), np.float32)
    distinct, sums = _summed(rows, values)
    result[distinct] = sums
    return result


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct row numbers and the sums of their values."""
    order = np.argsort(rows.astype(np.int32))
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    times = np.diff(np.append(first, len(rows)))
    sums, live = values.take(order[first], axis=0), np.flatnonzero(times > 1)
    if times.max() <= 32:
        for k in range(1, times.max()):
            sums[live] += values.take(order[first[live] + k], axis=0)
            live = live[times[live] > k + 1]
        return rows[first], sums
    # only the sums of many values are worth a call each
    many = times > MANY
    some = np.repeat(many, times)
    starts = np.cumsum(times[many]) - times[many]
    sums[many] = np.add.reduceat(values.take(order[some], axis=0), starts, axis=0)
    live = live[~many[live]]
    rest, at = values.take(order[first[live] + 1], axis=0), np.arange(len(live))
    for k in range(2, MANY):
        at = at[times[live[at]] > k]
        rest[at] += values.take(order[first[live[at]] + k], axis=0)
    sums[live] += rest
    return rows[first], sums


def _step(table: np.ndarray, rows: np.ndarray, d: np.ndarray, rate: float) -> None:
    """An AdaGrad step of some rows of a table that holds values and, behind them, sums of squares."""
    some = table.take(rows, axis=0)
    values, squares = np.split(some, 2, axis=1)
    squares += d * d
    values -= rate * d / np.sqrt(squares)
    table[rows] = some


def nce_pass(model: LogBilinear, triples: np.ndarray | Triples, noise: np.ndarray, seed: int | list[int], batch: int = BATCH,
             n_noise: int = NOISE, rate: float = RATE, met: np.ndarray | None = None) -> LogBilinear:
    """AdaGrad steps of noise-contrastive estimation, one pass over all triples in an order drawn anew.

    All rows of a step share their noise heads, so that noise is two matrix products; a member's noise is drawn from
    its own head evenly, since members of a head are about equally frequent. `met` takes how often each row of the
    model's table had a gradient.
    """
    draw = np.random.default_rng(seed)
    base, first = len(model.context), model.n_classes
    target, scale, offset = (x.astype(np.float32) for x in (model.target, model.scale, model.offset))
    dim, sums = target.shape[1], [np.full_like(x, 1e-2) for x in (target, scale, offset)]
    # a row lies beside its sums of squares, so that a step fetches and stores both at once
    context, inner = np.ones((base, 2 * dim), np.float32), np.ones((len(model.member), 2 * dim + 2), np.float32)
    context[:, :dim], inner[:, :dim], inner[:, dim] = model.context, model.member, model.member_offset
    met = np.zeros(model.rows()) if met is None else met
    met_context, met_inner, met_all = np.split(met, [base, base + len(inner)])
    below = np.cumsum(noise)
    below /= below[-1]
    log_kq = np.log(n_noise * noise).astype(np.float32)
    log_kg = np.log(MEMBER_NOISE / np.arange(1, GROUP + 1)).astype(np.float32)
    done, order = 0, draw.permutation(np.arange(len(triples), dtype=np.int32 if len(triples) < 1 << 31 else np.int64))
    for at in range(0, len(order), batch):
        chosen = order[at:at + batch]
        rows = triples[chosen]
        word, last, before = rows % base, rows // base % base, rows // base // base
        own = model.heads(word)
        false = below.searchsorted(draw.random(n_noise), side="right")
        one, other = context.take(before, axis=0)[:, :dim], context.take(last, axis=0)[:, :dim]
        total, meant = len(chosen), target.take(own, axis=0)
        hidden = one * scale[0] + other * scale[1]
        true_error = _sigmoid((hidden * meant).sum(axis=1) + offset[own] - log_kq[own]) - 1
        false_error = hidden @ target[false].T
        false_error += offset[false] - log_kq[false]
        _sigmoid(false_error)
        back = true_error[:, None] * meant + false_error @ target[false]
        d_target = (_scattered(own, true_error[:, None] * hidden, len(target))
                    + _scattered(false, false_error.T @ hidden, len(target))) / total
        d_offset = (np.bincount(own, true_error, len(target))
                    + np.bincount(false, false_error.sum(axis=0), len(target))) / total
        at_inner = np.flatnonzero(word >= first)
        if len(at_inner):
            place = word[at_inner] - first
            start = place // GROUP * GROUP
            size = np.minimum(GROUP, len(inner) - start)
            drawn = start[:, None] + (draw.random((len(place), MEMBER_NOISE)) * size[:, None]).astype(np.int64)
            tried = np.column_stack([place, drawn])
            vectors, near = inner.take(tried, axis=0), hidden[at_inner]
            error = _sigmoid(np.einsum("ijk,ik->ij", vectors[..., :dim], near) + vectors[..., dim]
                             - log_kg[size - 1, None])
            error[:, 0] -= 1
            back[at_inner] += np.einsum("ij,ijk->ik", error, vectors[..., :dim])
            with_one = np.column_stack([near, np.ones(len(near), np.float32)])
            touched, d = _summed(tried.ravel(), (error[..., None] * with_one[:, None, :]).reshape(-1, dim + 1))
            _step(inner, touched, d, rate)
            met_inner[touched] += 1
        d_scale = np.stack([(back * one).sum(axis=0), (back * other).sum(axis=0)]) / total
        touched, d = _summed(np.concatenate([before, last]), np.concatenate([back * scale[0], back * scale[1]]))
        _step(context, touched, d, rate)
        met_context[touched] += 1
        for x, squares, d in zip((target, scale, offset), sums, (d_target, d_scale, d_offset)):
            squares += d * d
            x -= (rate * d / np.sqrt(squares)).astype(np.float32)
        done += 1
    met_all += done
    context = context[:, :dim].copy()
    inner = inner[:, :dim + 1].copy()
    return LogBilinear(context, target, scale, offset, inner[:, :dim], inner[:, dim])


BLOCKS = "block int, moved binary, met binary"


def _trainer(held: Broadcast, noise: np.ndarray, turn: int, rate: float, batch: int,
             shard_tokens: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over the rows of a task, shard by shard; blocks of how far each row of the model's table moved, in the
    mean over the shards, and how often it was met. A shard that holds very many copies of a text is several parts."""
    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, texts, size, place = held.value, [], 0, (-1, 0)
        total, times = None, np.zeros(model.rows(), np.float32)

        def pass_over() -> None:
            nonlocal total
            bounds = np.cumsum([0, *(len(t) // 4 for t in texts)])
            codes = np.frombuffer(b"".join(texts), np.int32)
            texts.clear()
            triples, met = Triples(codes, bounds, len(model.context) - 1), np.zeros(len(times), np.float32)
            new = nce_pass(model, triples, noise, [turn, *place], batch, rate=rate, met=met).moved_from(model)
            new *= met[:, None]
            if total is None:
                total = new
            else:
                total += new
            times[:] += met

        for some in batches:
            for shard, text in zip(some.column(0).to_pylist(), some.column(1)):
                text = text.as_py()
                if texts and (shard != place[0] or size >= 2 * shard_tokens):
                    pass_over()
                    texts, size, place = [], 0, (shard, place[1] + 1 if shard == place[0] else 0)
                elif shard != place[0]:
                    place = (shard, 0)
                texts.append(text)
                size += len(text) // 4
        if texts:
            pass_over()
        if total is not None:
            yield from _blocks(total, times)

    return fit


def _blocks(total: np.ndarray, times: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(times), MODEL_BLOCK):
        rows = slice(at, at + MODEL_BLOCK)
        if times[rows].any():
            mean = (total[rows] / np.maximum(times[rows], 1)[:, None]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([
                pa.array([first + at // MODEL_BLOCK], pa.int32()), pa.array([mean.tobytes()], pa.binary()),
                pa.array([times[rows].astype(np.float32).tobytes()], pa.binary())], ["block", "moved", "met"])


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    """The mean of several tasks' blocks, weighted by how often each row was met."""
    total, times = 0.0, 0.0
    for moved, met in sorted(zip(frame["moved"], frame["met"])):
        met = np.frombuffer(met, np.float32).astype(np.float64)
        total = total + np.frombuffer(moved, np.float16).reshape(len(met), -1) * met[:, None]
        times = times + met
    return next(_blocks(total, times, int(frame["block"].iloc[0]))).to_pandas()


def train(training: DataFrame, known: Vocabulary, steps: int = STEPS, batch: int = BATCH,
          shard_tokens: int = SHARD_TOKENS) -> LogBilinear:
    """Passes over all training documents. A task holds one shard's word numbers and the model; what tasks send back is
    added up on executors, and the driver receives one model a round."""
    spark = training.sparkSession
    counts = known.head_counts
    noise = (counts + 0.5) / (counts + 0.5).sum()
    model = LogBilinear.fresh(counts, member_counts=known.member_counts)
    model = model.of_table(model.table())
    if not known.train_tokens:
        return model
    shards = -(-known.train_tokens // shard_tokens)
    rounds = 1 + math.ceil(math.log2(shards))
    stored = write_out(coded_texts(training, known, shards).repartition(min(shards, MOST_FILES), "shard")
                       .sortWithinPartitions("shard", "codes"), "lm-codes")
    for turn in range(-(-steps * batch // known.train_tokens)):
        for part in range(rounds):
            held = spark.sparkContext.broadcast(model)
            rows = stored.filter((F.col("shard") + turn) % rounds == part)
            fit = _trainer(held, noise, turn, RATE / (1 + turn / 2), batch, shard_tokens)
            blocks = rows.mapInArrow(fit, BLOCKS).groupBy("block").applyInPandas(_added, BLOCKS).collect()  # one model
            held.destroy()
            table = model.table()
            for r in blocks:
                moved = np.frombuffer(r.moved, np.float16).reshape(-1, table.shape[1])
                table[r.block * MODEL_BLOCK:(r.block + 1) * MODEL_BLOCK] += moved
            model = model.of_table(table)
    return model


PARTS = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, "
         "rare array<long>, times array<int>")


def score(docs: DataFrame, counts: DataFrame, known: Vocabulary, model: LogBilinear) -> DataFrame:
    """Scores of all documents. Tokens beyond the frequent ones are joined with their counts by hash."""
    held = docs.sparkSession.sparkContext.broadcast((known, model))

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, model = held.value
        row = TaskContext.get().partitionId() << 40
        total, rest = math.log10(known.base_total), math.log10(known.beyond_total)
        for batch in batches:
            for part in slices(batch):
                ids, hashes, bounds = token_words(texts_of(part))
                at, found = known.places(hashes)
                count = np.where(found, known.counts[at] if len(known.keys) else 0, 0)
                own = word_codes(hashes, known)[ids]
                smooth = np.where(found, np.log10(count + 0.5), 0.0)[ids]  # of rare words it is added after the join
                found = found[ids]
                by_model = model.log_probability(code_triples(own, bounds, known.n_words)) / math.log(10)
                by_model += np.where(own == REST, smooth - rest, 0.0)
                n = len(bounds) - 1
                text = np.repeat(np.arange(n), np.diff(bounds))[~found]
                rare = hashes[ids[~found]].view(np.int64)
                order = np.lexsort((rare, text))
                rare, text = rare[order], text[order]
                new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (text[1:] != text[:-1])])
                                     ) if len(rare) else np.empty(0, np.int64)
                times = np.diff(np.append(new, len(rare))).astype(np.int32)
                offsets = pa.array(np.searchsorted(text[new], np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(n), pa.int64()), column(part, "doc_id"), column(part, "held_out"),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(totals(found.astype(np.int64), bounds), pa.int64()),
                    pa.array(totals(smooth - total, bounds)), pa.array(totals(by_model, bounds)),
                    pa.ListArray.from_arrays(offsets, pa.array(rare[new], pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                    [p.split()[0] for p in PARTS.split(", ")])
                row += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       "text")
    found = write_out(rows.mapInArrow(parts, PARTS), "lm-parts")
    rare = found.select("row", F.explode(F.arrays_zip(F.col("rare").alias("key"), F.col("times").alias("t"))).alias("x"))
    rare = rare.select("row", "x.key", "x.t").join(counts, "key", "left")
    added = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("t")).otherwise(0)).alias("more"),
        F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("smooth"))
    smooth = F.coalesce("smooth", F.lit(0.0))
    return found.join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(known.train_tokens).cast("long").alias("train_tokens"), (F.col("base") + smooth).alias("base_score"),
        (F.col("model") + smooth).alias("score"))


def score_documents(docs: DataFrame, n_classes: int = CLASSES, frequent: int = FREQUENT, words: int = WORDS,
                    **training: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    text = docs.filter(~held_out(F.col("doc_id"))).select("text")
    counts = write_out(token_counts(text), "lm-counts")
    known = vocabulary(counts, n_classes, frequent, words)
    model = train(text, known, **training)
    return score(docs, counts, known, model)
