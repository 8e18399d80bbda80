"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage within `k` edits of a benchmark item of `m` bytes shares at least m - q + 1 - k * q q-grams with it, and their
diagonals (place in the text minus place in the item) differ by at most k. Every q-gram of a text is looked up in a
table of the items' q-grams; hits are counted per item in bands of diagonals that overlap by half; regions with enough
hits are aligned with the item in a band of k diagonals on either side, and stay when the edit distance is at most k.

Texts are compared as UTF-8 bytes with A-Z in lower case and white space as spaces, whole and in slices that end between
texts. Items are sent to the tasks in blocks of at most `BLOCK_BYTES`, one pass over the documents each.

Items under `MIN_BYTES` bytes are searched without edits, and items under `Q` bytes, which have no q-gram, as whole words:
a number or letter at either end of the item has none beside it in the text.

Defined results: NULL and empty texts have no findings; NULL items and items of white space alone are not searched. Items
with a NULL id are searched and reported with a NULL item_id. Items with equal texts are all reported. Findings of one item whose places overlap
count once, with the least distance, then the first place. Repeated documents are treated one by one. An empty
benchmark finds nothing. A column named like the output is replaced, all others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from lonetext.common import write_out
from lonetext.llm.words import slices, texts_of

Q = 8
EDIT_SHARE = 0.08  # edits allowed per byte of an item
MIN_BYTES = 40  # shorter items are searched without edits
BLOCK_BYTES = 8 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[9, 10, 11, 12, 13]] = 32

WORD = np.zeros(256, bool)  # bytes that belong to words
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

FINDINGS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("distance", T.IntegerType())]))


def folded(raw: bytes | pa.Buffer) -> np.ndarray:
    return FOLD[np.frombuffer(raw, np.uint8)]


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as one number each; the view is unaligned and copies nothing."""
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, 0, (1,))


@dataclass
class Index:
    """Items with their q-grams: sorted distinct grams, where each occurs, and a bit table ahead of the search."""
    ids: list[int | None]
    items: list[np.ndarray]
    edits: np.ndarray  # k of each item
    needed: np.ndarray  # hits of each item that the lemma asks for
    grams: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    shift: np.uint64
    bits: np.ndarray
    dense: int  # hits in some window of WINDOW places that every passage has
    tiny: dict[int, dict[int, list[int | None]]]  # ids of items under Q bytes by length and bytes as a number

    WINDOW = 64

    @staticmethod
    def build(rows: Iterable[tuple[int | None, str | None]]) -> "Index | None":
        found = [(i, folded(" ".join(t.split(" ")).strip().encode())) for i, t in rows if t]
        tiny: dict[int, dict[int, list[int | None]]] = {}
        for i, x in found:
            if 0 < len(x) < Q:
                tiny.setdefault(len(x), {}).setdefault(int.from_bytes(x.tobytes(), "little"), []).append(i)
        found = [(i, x) for i, x in found if len(x) >= Q]
        if not found and not tiny:
            return None
        items = [x for _, x in found]
        size = np.array([len(x) for x in items], np.int64)
        edits = np.where(size < MIN_BYTES, 0, size * EDIT_SHARE).astype(np.int64)
        needed = size - Q + 1 - edits * Q
        every = np.concatenate([grams(x) for x in items] or [np.empty(0, "<u8")])
        owner = np.repeat(np.arange(len(items)), size - Q + 1)
        place = np.concatenate([np.arange(n - Q + 1) for n in size] or [np.empty(0, np.int64)])
        order = np.argsort(every, kind="stable")
        distinct, starts = np.unique(every[order], return_index=True)
        width = int(max(16, np.ceil(np.log2(max(1, len(distinct)) * 16))))
        shift = np.uint64(64 - width)
        bits = np.zeros(1 << width, bool)
        with np.errstate(over="ignore"):
            bits[(distinct * FACTOR) >> shift] = True
        # a passage spans at most m + k places; of the aligned windows it touches, one holds the mean at least
        windows = (size + edits + Index.WINDOW - 2) // Index.WINDOW + 1
        return Index([i for i, _ in found], items, edits, needed, distinct,
                     np.append(starts, len(every)), owner[order], place[order], shift, bits,
                     int(np.ceil(needed / windows).min(initial=Index.WINDOW)), tiny)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of shared q-grams, where the text has enough of them at all."""
        g = grams(data)
        if not len(g) or not self.items:
            return (np.empty(0, np.int64),) * 3
        with np.errstate(over="ignore"):
            maybe = self.bits[(g * FACTOR) >> self.shift]
        count = np.add.reduceat(maybe, np.arange(0, len(maybe), self.WINDOW), dtype=np.int64)
        rich = np.flatnonzero(count >= self.dense)
        if not len(rich):
            return (np.empty(0, np.int64),) * 3
        # around every rich window, the span of the longest item either way
        reach = (int(max(len(x) for x in self.items) + self.edits.max()) // self.WINDOW + 1) if len(rich) else 0
        edge = np.zeros(len(count) + 1, np.int64)
        np.add.at(edge, np.maximum(rich - reach, 0), 1)
        np.add.at(edge, np.minimum(rich + reach + 1, len(count)), -1)
        near = np.repeat(np.cumsum(edge)[:-1] > 0, self.WINDOW)[:len(maybe)]
        at = np.flatnonzero(maybe & near)
        found = np.searchsorted(self.grams, g[at])
        found[found == len(self.grams)] = 0
        same = self.grams[found] == g[at]
        at, found = at[same], found[same]
        n = self.starts[found + 1] - self.starts[found]
        where = np.repeat(self.starts[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(at, n), self.owner[where], self.place[where]

    def regions(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, least and greatest diagonal) of bands that hold the hits the lemma asks for."""
        at, item, place = self.hits(data)
        if not len(at):
            return
        text = np.searchsorted(bounds, at, side="right") - 1
        inside = at + Q <= bounds[text + 1]
        at, item, place, text = at[inside], item[inside], place[inside], text[inside]
        diagonal = at - place + len(data)  # never negative: places are below the item's size
        half = self.edits + 1
        band = diagonal // half[item]
        n_bands = int(2 * len(data) + 2)
        base = (text * len(self.items) + item) * n_bands + band
        # a band is a stretch of `half` diagonals and the next one, so every hit counts for two bands
        distinct, total = np.unique(np.concatenate([base, base + 1]), return_counts=True)
        owner = distinct // n_bands
        enough = total >= self.needed[owner % len(self.items)]
        for key in distinct[enough]:
            pair, b = divmod(int(key), n_bands)
            t, i = divmod(pair, len(self.items))
            low = (b - 1) * int(half[i]) - len(data)
            yield t, i, low, low + 2 * int(half[i]) - 1

    def words(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int | None, int, int]]:
        """(text, item id, start, end) of whole words, or runs of them, that are an item under Q bytes."""
        if not self.tiny or not len(data):
            return
        padded = np.concatenate([np.zeros(1, np.uint8), data, np.zeros(Q, np.uint8)])
        word = WORD[padded]
        begins = np.flatnonzero(~word[:-1] | ~word[1:])  # places in `data` where a word may begin
        begins = np.union1d(begins[begins < len(data)], bounds[:-1][bounds[:-1] < len(data)])
        g = grams(padded[1:])[begins]
        text = np.searchsorted(bounds, begins, side="right") - 1
        for length, items in self.tiny.items():
            code = g & np.uint64((1 << 8 * length) - 1)
            ends = begins + length
            fits = np.isin(code, np.array(list(items), np.uint64)) & (ends <= bounds[text + 1])
            fits &= (ends == bounds[text + 1]) | ~word[ends] | ~word[ends + 1]
            last: dict[tuple[int, int], int] = {}
            for at in np.flatnonzero(fits).tolist():
                t, c, start = int(text[at]), int(code[at]), int(begins[at] - bounds[text[at]])
                if start >= last.get((t, c), 0):
                    last[t, c] = start + length
                    yield from ((t, i, start, start + length) for i in items[c])

    def findings(self, data: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int | None, int, int, int]]]:
        """Per text (item id, start, end, distance), byte places in the text."""
        best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for t, i, low, high in self.regions(data, bounds):
            start, end = int(bounds[t]), int(bounds[t + 1])
            k, m = int(self.edits[i]), len(self.items[i])
            a, b = max(start, low - k), min(end, high + m + k + 1)
            found = align(self.items[i], data[a:b], low - a, high - a, k) if a < b else None
            if found:
                best.setdefault((t, i), []).append((found[0], found[1] + a - start, found[2] + a - start))
        result: dict[int, list[tuple[int | None, int, int, int]]] = {}
        for t, item, s, e in self.words(data, bounds):
            result.setdefault(t, []).append((item, s, e, 0))
        for (t, i), some in best.items():
            taken: list[tuple[int, int, int]] = []
            for d, s, e in sorted(some):
                if all(e <= a or s >= b for _, a, b in taken):
                    taken.append((d, s, e))
            result.setdefault(t, []).extend((self.ids[i], s, e, d) for d, s, e in taken)
        return result


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """Least edit distance of the item to a stretch of the text, with diagonals from low - k to high + k.

    The stretch may start and end anywhere in the band. Returns (distance, start, end) or None above k edits.
    """
    m = len(item)
    for d in range(max(low, 0), min(high, len(text) - m) + 1):  # the common case, an exact copy
        if text[d] == item[0] and np.array_equal(text[d:d + m], item):
            return 0, d, d + m
    first, width = low - k, high - low + 2 * k + 1
    lane = np.arange(width)
    padded = np.full(max(0, -first) + max(len(text), first + m + width) + 1, 256, np.int16)  # 256 matches nothing
    offset = max(0, -first)
    padded[offset:offset + len(text)] = text
    far = m + 1
    place = first + lane
    cost = np.where((place >= 0) & (place <= len(text)), 0, far)
    start = place.copy()
    for row in range(m):
        at = first + row + lane  # text place that cell (row + 1, lane) consumes on its diagonal
        ok = (at >= 0) & (at < len(text))
        swap = np.where(ok, cost + (padded[offset + first + row:offset + first + row + width] != item[row]), far)
        drop = np.append(cost[1:], far) + 1  # the item's byte has no counterpart
        new = np.minimum(swap, drop)
        begin = np.where(swap <= drop, start, np.append(start[1:], 0))
        # extra bytes of the text: cheapest cell to the left plus the distance
        slope = new - lane
        best = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == best, lane, 0))
        cost = np.where((at + 1 >= 0) & (at + 1 <= len(text)), np.minimum(best + lane, far), far)
        start = begin[source]
        if cost.min() > k:
            return None
    j = int(np.argmin(cost))
    return (int(cost[j]), int(start[j]), int(first + m + j)) if cost[j] <= k else None


def contaminations(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with `contamination`: an array of (item_id, start, end, distance), in code points, by place then item."""
    names = [c for c in docs.columns if c != "contamination"]
    result = docs.select(*names).withColumn("contamination", F.array().cast(FINDINGS))
    size = benchmark.agg(F.sum(F.length(F.encode("text", "UTF-8")))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        rows = [(r.item_id, r.text) for r in benchmark.filter(block == b).select("item_id", "text").collect()]
        index = Index.build(sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if index is not None:
            result = _search(result, names, index)
    return result


def _search(docs: DataFrame, names: list[str], index: Index) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("contamination", FINDINGS)])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()),
                               ("distance", pa.int32())]))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            for part in slices(batch):
                texts = pa.concat_arrays([texts_of(part)])
                bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
                raw = texts.buffers()[2]
                data = folded(raw)[bounds[0]:bounds[-1]] if raw is not None and len(raw) else np.empty(0, np.uint8)
                found = index.findings(data, bounds - bounds[0])
                old = part.column(part.schema.get_field_index("contamination"))
                if found:
                    lists = old.to_pylist()
                    for t, some in found.items():
                        text = texts[t].as_py().encode()
                        chars = lambda p: len(text[:p].decode(errors="ignore"))  # noqa: E731, B023
                        new = [dict(item_id=i, start=chars(s), end=chars(e), distance=d) for i, s, e, d in some]
                        lists[t] = sorted(lists[t] + new, key=lambda x: (
                            x["start"], x["item_id"] is None, x["item_id"] or 0, x["end"]))
                    old = pa.array(lists, kind)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in names] + [old.cast(kind)],
                    [*names, "contamination"])

    return docs.mapInArrow(search, schema)
