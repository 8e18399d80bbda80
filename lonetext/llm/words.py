"""Words of whole texts inside Arrow batches: splitting, ids, hashes, shingles, all without a Python loop per word.

A word is a run of characters other than the space and the six ASCII controls 9 to 13. Texts are handled in slices of a
few megabytes, so a task's memory does not depend on its batch; a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
SIZE_SQL = r"size(regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+', 0))"


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column as large strings, NULL as the empty text.

    The rows are copied: pyarrow's ASCII kernels misread a slice whose offsets do not start at zero.
    """
    texts = pc.fill_null(column(batch, name).cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts))))


def slices(batch: pa.RecordBatch, text: str = "text", slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `slice_bytes` bytes, at least one row each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // slice_bytes
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(start), int(end - start))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the bounds of each text's words (one more than there are texts)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # a blank at either end of a text gives an empty piece
        flat = flat.filter(pa.array(full))
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
    return flat, bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    """The number of the text each word belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` within `bounds`."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[bounds[1:]] - running[bounds[:-1]]


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as small numbers, and the word of each number."""
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def hashed(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of distinct words."""
    words = dictionary.to_numpy(zero_copy_only=False)  # several times as fast as a list of the words
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's word n-grams in order, A-Z lower-cased, and the bounds of each text's n-grams.

    A text with fewer than `width` words is one n-gram (its length is part of the hash), one without words has none.
    """
    words, bounds = split(pc.ascii_lower(texts))
    ids, dictionary = coded(words)
    codes = hashed(dictionary)[ids] if len(ids) else np.empty(0, np.uint64)
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    result = np.empty(out[-1], np.uint64)
    long = n >= width
    if long.any():
        grams = np.zeros(len(codes) - width + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                grams = mixed((grams + codes[k:len(codes) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15))
        size = count[long]
        start = np.repeat(bounds[:-1][long] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        target = np.repeat(out[:-1][long] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        step = np.arange(size.sum())
        result[target + step] = grams[start + step]
    for t in np.flatnonzero((n > 0) & ~long):
        result[out[t]] = xxhash.xxh3_64_intdigest(codes[bounds[t]:bounds[t + 1]].tobytes(), int(n[t]))
    return result, out
