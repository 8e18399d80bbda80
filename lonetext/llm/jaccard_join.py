"""N-gram Jaccard join with set-relation skipping, down to the connected components of its links.

A text's set are its distinct word n-grams. Two texts link when their sets' Jaccard similarity reaches the threshold.

1. Equal sets are one node. A sketch of all n-grams' frequencies (a table of fixed size) orders n-grams from rare to
   frequent; two sets that link share an n-gram among the first few of each, their prefixes. An index list holds the
   sets with one n-gram in their prefix, with size and position.
2. Every list has a representative. Its answers are computed first: all sets of the list that size, position and bitmaps
   allow are compared with it, k comparisons for k sets. What links is contracted before any list is walked.
3. Lists with sets of several components are walked. The answers of a set are derived from the representative's: two sets
   share at most what one shares with the representative and what the other has beside it. Members of the
   representative's own component that can reach no set outside it that way leave the list. The others lie in blocks of
   one component, by size and position; whole blocks are skipped by component, by size range, by positions and by the
   derived bound, then pairs by the same tests and by small bitmaps. A list gives a forest of pairs that could join
   different components, and a few more a set.
4. Pairs are tested by whole bitmaps, fetched for them alone, then verified on whole sets; what links is contracted.
   Of a list only the sets are carried on that could still join another component by a pair it has not given yet, and
   they are walked again until none is left. Lists above `BLOCK` sets are split into pairs of blocks.

Every step is exact but for 59-bit hashes of n-grams and 64-bit hashes of sets. Only connections matter for components,
so a pair inside one component needs no look; no link between different texts is lost.

Defined results: NULL and empty texts have an empty set and link with nothing. A text with fewer words than an n-gram is
one n-gram. Rows repeated with one id are one document with several texts, all in one component if they link. A NULL id
takes part but is never the component's id, unless no row of it has one. An empty table gives an empty table. Further
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from lonetext.common import write_out
from lonetext.llm.components import components
from lonetext.llm.words import column, mixed, shingles, slices, texts_of

WIDTH = 4
SHARE = 85  # per cent of the union
CELLS = 1 << 20  # of the frequency sketch
CELL_BLOCK = 4096
CLASS_BITS = 5  # frequency classes ahead of the hash in an n-gram's code
BITMAP_BYTES = 128  # at least; a bitmap has two bits and more per member
SKETCH_BYTES = 512  # at most, of the folded bitmap that a list's sets carry
BLOCK = 2048  # sets of a list in one task
STRIPE = 32  # sets of a list that are skipped together
CHUNK = 1 << 18  # pairs of a task that are tested at a time
WALK_ROWS = 1 << 13  # rows of a task that are walked at a time, and the rest of the last list
FILTER_BITS = (1 << 20, 1 << 30)  # least and most bits of the filter of documents whose sets are compared


# --- frequency order -------------------------------------------------------------------------------------------------

def frequency_classes(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The frequency class of every cell of the sketch: an array of fixed size, over all n-grams of all texts."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in slices(batch):
                grams, _ = shingles(texts_of(part), width)
                total += np.bincount((grams & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if total.any():
            from pyspark import TaskContext

            salt = TaskContext.get().partitionId() % 256
            blocks = total.reshape(-1, CELL_BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(blocks)), pa.int32()), pa.array([salt] * len(blocks), pa.int32()),
                 pa.array([b.astype(np.uint32).tobytes() for b in blocks], pa.binary())], ["block", "salt", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELL_BLOCK, np.int64)
        for c in frame["counts"]:  # 4 bytes a cell from a task, 8 once added up
            total += np.frombuffer(c, np.uint32 if len(c) == 4 * CELL_BLOCK else np.int64)
        return pd.DataFrame({"block": frame["block"][:1], "salt": frame["salt"][:1], "counts": [total.tobytes()]})

    schema = "block int, salt int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema)
    rows = rows.groupBy("block", "salt").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    total = np.zeros((CELLS // CELL_BLOCK, CELL_BLOCK), np.int64)
    for r in rows.collect():  # CELLS numbers, however many documents there are
        total[r.block] = np.frombuffer(r.counts, np.int64)
    total = total.ravel()
    scale = np.log2(1 + total / max(1.0, total.mean())) * 2
    return np.minimum(scale, (1 << CLASS_BITS) - 1).astype(np.uint8)


def ordered_codes(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Distinct n-grams as codes that sort from rare to frequent."""
    high = classes[(grams & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
    return np.unique(high << np.uint64(64 - CLASS_BITS) | grams >> np.uint64(CLASS_BITS))


def needed(a, b, share: int = SHARE):
    """The least overlap of sets of sizes a and b that link."""
    return -(-(share * (a + b)) // (100 + share))


def prefix_size(n: int, share: int = SHARE) -> int:
    """Of a set of n: the overlap with any set it links with is at least ceil(share * n / 100)."""
    return n - -(-share * n // 100) + 1


def bitmap(codes: np.ndarray) -> bytes:
    """Per bit the parity of the codes that fall on it: two bitmaps differ in no more bits than the sets in members.

    Bits are a power of two, and the halves of a bitmap laid over each other are the bitmap of half the size.
    """
    size = max(8 * BITMAP_BYTES, 1 << (2 * len(codes) - 1).bit_length())
    bits = np.bincount((codes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def stacked(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of one length, folded to `size` bytes, as rows of 64-bit words."""
    rows = np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)
    while rows.shape[1] * 8 > size:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def folded(map_: bytes, size: int) -> bytes:
    return stacked([map_], size).tobytes() if len(map_) > size else map_


class Bitmaps:
    """Bitmaps of different lengths; a pair is compared at the length of the shorter one."""

    def __init__(self, maps: list[bytes]):
        self.size = np.array([len(m) for m in maps])
        self.place = np.zeros(len(maps), np.int64)
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        sizes = np.unique(self.size).tolist()
        for size in sizes:
            own = np.flatnonzero(self.size == size)
            self.place[own] = np.arange(len(own))
            for shorter in (s for s in sizes if s <= size):
                self.rows[size, shorter] = stacked([maps[i] for i in own.tolist()], shorter)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which bitmap a[i] and bitmap b[i] differ."""
        result = np.zeros(len(a), np.int64)
        kind = self.size[a] * (1 << 32) + self.size[b]
        for k in np.unique(kind).tolist():
            at = np.flatnonzero(kind == k)
            one, other = k >> 32, k & 0xFFFFFFFF
            shorter = min(one, other)
            for some in np.array_split(at, len(at) * shorter // (32 << 20) + 1):
                x, y = self.rows[one, shorter][self.place[a[some]]], self.rows[other, shorter][self.place[b[some]]]
                result[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return result


def set_table(docs: DataFrame, classes: np.ndarray, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """(doc_id, n, node, prefix, bitmap, sketch) of every document; node is NULL for empty sets."""
    held = docs.sparkSession.sparkContext.broadcast(classes)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                grams, bounds = shingles(texts_of(part), width)
                sizes, nodes, heads, maps = [], [], [], []
                for start, end in zip(bounds[:-1], bounds[1:]):
                    codes = ordered_codes(grams[start:end], held.value)
                    sizes.append(len(codes))
                    nodes.append(xxhash.xxh3_64_intdigest(codes.tobytes()) - (1 << 63) if len(codes) else None)
                    heads.append(codes[:prefix_size(len(codes), share)].view(np.int64) if len(codes) else [])
                    maps.append(bitmap(codes) if len(codes) else None)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                     pa.array(heads, pa.list_(pa.int64())), pa.array(maps, pa.binary()),
                     pa.array([m and folded(m, SKETCH_BYTES) for m in maps], pa.binary())],
                    ["doc_id", "n", "node", "prefix", "bitmap", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(build, "doc_id long, n long, node long, prefix array<long>, bitmap binary, sketch binary")


def _bits_of(ids: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of `size` bits (a power of two) for each id; NULL is an id like any other."""
    raw = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    code = mixed(raw ^ np.where(ids.is_null().to_numpy(zero_copy_only=False), np.uint64(1 << 63), np.uint64(0)))
    mask = np.uint64(size - 1)
    return (code & mask).astype(np.int64), ((code >> np.uint64(32)) & mask).astype(np.int64)


def id_filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of `doc_id`, 16 bits and more an id up to a fixed size; beyond it lets more ids through."""
    least, most = FILTER_BITS
    size = min(most, max(least, 1 << (16 * wanted.count()).bit_length()))
    block = size // 512  # bytes of one of 64 pieces

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for places in _bits_of(batch.column(0), size):
                np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        full = [b for b in range(64) if bits[b * block:(b + 1) * block].any()]
        if full:
            salt = TaskContext.get().partitionId() % 256
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([salt] * len(full), pa.int32()),
                 pa.array([bits[b * block:(b + 1) * block].tobytes() for b in full], pa.binary())],
                ["block", "salt", "bits"])

    def either(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in frame["bits"]])
        return pd.DataFrame({"block": frame["block"][:1], "salt": frame["salt"][:1], "bits": [total.tobytes()]})

    schema = "block int, salt int, bits binary"
    rows = wanted.select("doc_id").mapInArrow(mark, schema)
    rows = rows.groupBy("block", "salt").applyInPandas(either, schema).groupBy("block").applyInPandas(either, schema)
    result = np.zeros(size // 8, np.uint8)
    for r in rows.collect():  # `size` bits, however many documents there are
        result[r.block * block:(r.block + 1) * block] = np.frombuffer(r.bits, np.uint8)
    return result


def _marked(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def whole_sets(docs: DataFrame, wanted: DataFrame, classes: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(node, codes) of the `wanted` (doc_id) rows at least, from the whole texts.

    A filter of the ids stands where the texts are read, so that texts are not shuffled; a few more sets may pass.
    """
    held = docs.sparkSession.sparkContext.broadcast((classes, id_filter(wanted)))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, bits = held.value
        for batch in batches:
            first, second = _bits_of(column(batch, "doc_id"), 8 * len(bits))
            batch = batch.filter(pa.array(_marked(bits, first) & _marked(bits, second)))
            for part in slices(batch):
                grams, bounds = shingles(texts_of(part), width)
                sets = [ordered_codes(grams[s:e], classes) for s, e in zip(bounds[:-1], bounds[1:])]
                nodes = [xxhash.xxh3_64_intdigest(c.tobytes()) - (1 << 63) for c in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array([c.view(np.int64) for c in sets], pa.list_(pa.int64()))],
                    ["node", "codes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(build, "node long, codes array<long>").dropDuplicates(["node"])


# --- index lists -----------------------------------------------------------------------------------------------------

def position_bound(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """The most two sets can share that share an n-gram at positions p1 and p2 (from 0)."""
    return F.least(p1, p2) + F.least(n1 - p1, n2 - p2)


def worth(n1: Column, p1: Column, n2: Column, p2: Column, share: int = SHARE) -> Column:
    """Whether sizes, and positions of a shared n-gram, allow two sets to link."""
    least = F.ceil(share * (n1 + n2) / F.lit(100.0 + share) - 1e-9)
    return (F.least(n1, n2) >= least) & (position_bound(n1, p1, n2, p2) >= least)


def index_lists(sets: DataFrame) -> DataFrame:
    """(gram, node, n, pos, k, rep, rep_n, rep_pos) of the lists with k >= 2 different sets.

    Entries are shuffled once, by n-gram; what else is asked of a list is asked where its entries lie.
    The representative of a list is its set with the smallest hash, so that lists of the same sets have the same one.
    """
    together = Window.partitionBy("gram")
    entries = sets.filter("node IS NOT NULL").select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    entries = entries.select("gram", "node", F.expr("shiftleft(n, 32) + pos").alias("place"))
    several = entries.withColumn("low", F.min("node").over(together)).withColumn("high", F.max("node").over(together))
    shared = several.filter("low < high").select("gram", "node", "place").distinct()
    first = F.min(F.struct(F.xxhash64("node").alias("h"), "node", "place")).over(together).alias("first")
    heads = shared.select("gram", "node", "place", F.count("*").over(together).alias("k"), first)
    n, pos = "shiftright({0}, 32)", "{0} & 4294967295L"
    return write_out(heads.select(
        "gram", "node", F.expr(n.format("place")).alias("n"), F.expr(pos.format("place")).alias("pos"), "k",
        F.col("first.node").alias("rep"), F.expr(n.format("first.place")).alias("rep_n"),
        F.expr(pos.format("first.place")).alias("rep_pos")), "join-index")


def representative_pairs(lists: DataFrame, share: int = SHARE) -> DataFrame:
    """(a, b): every set of a list with the list's representative, where size and position allow a link."""
    near = worth(F.col("n"), F.col("pos"), F.col("rep_n"), F.col("rep_pos"), share)
    return lists.filter((F.col("node") != F.col("rep")) & near).select(
        F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists whose sets are in several components, with `component`, and `home`, the representative's component.

    A list of two sets is done once the representative's answers are known.
    """
    members = lists.filter("k > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    together = Window.partitionBy("gram")
    ends = members.withColumn("low", F.min("component").over(together)).withColumn("high", F.max("component").over(together))
    home = F.max(F.when(F.col("node") == F.col("rep"), F.col("component"))).over(together)
    return ends.withColumn("home", home).filter("low < high").drop("low", "high")


def several_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The n-grams whose lists hold sets of several components."""
    placed = members.select("gram", "node").join(labels, "node", "left").select(
        "gram", F.coalesce("component", "node").alias("component"))
    ends = placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return ends.filter("low < high").select("gram")


def with_answers(members: DataFrame, answers: DataFrame) -> DataFrame:
    """Add `most` and `least`, bounds of what a set shares with its list's representative.

    `answers` (a, b, most, least) are those of compared pairs; of other pairs only the position's bound is known.
    """
    own = F.col("node") == F.col("rep")
    by_position = position_bound(F.col("n"), F.col("pos"), F.col("rep_n"), F.col("rep_pos"))
    pair = members.withColumn("a", F.least("node", "rep")).withColumn("b", F.greatest("node", "rep"))
    known = pair.join(answers, ["a", "b"], "left").drop("a", "b")
    return known.withColumn("most", F.when(own, F.col("n")).otherwise(F.least(by_position, F.coalesce("most", by_position)))
                            ).withColumn("least", F.when(own, F.col("n")).otherwise(F.coalesce("least", F.lit(0).cast("long"))))


def within_reach(members: DataFrame, share: int = SHARE) -> DataFrame:
    """Without the sets of the representative's component that cannot link with any set of their list outside of it.

    Derived from the representative's answers: a set inside shares with a set outside at most what the outer one shares
    with the representative and the inner one has beside it, and the other way round.
    """
    outside = F.col("component") != F.col("home")
    outer = members.filter(outside).groupBy("gram").agg(
        F.max("most").alias("outer_most"), F.max(F.col("n") - F.col("least")).alias("outer_rest"),
        F.min("n").alias("outer_n"))
    bound = F.least(F.col("outer_most") + F.col("n") - F.col("least"), F.col("most") + F.col("outer_rest"))
    least = F.ceil(share * (F.col("n") + F.col("outer_n")) / F.lit(100.0 + share) - 1e-9)
    return members.join(outer, "gram").filter(outside | (bound >= least)).drop("outer_most", "outer_rest", "outer_n")


# --- walking a list --------------------------------------------------------------------------------------------------

class Lists:
    """Rows of several lists (or pairs of their blocks) as arrays, in blocks of one list, side and large component."""

    def __init__(self, group, side, component, n, pos, most, least):
        code = np.unique(component, return_inverse=True)[1].astype(np.int64)
        pair = group * (code.max(initial=0) + 1) + code
        times = np.unique(pair, return_inverse=True, return_counts=True)
        large = np.where(times[2][times[1]] >= STRIPE, code + 1, 0)
        self.order = np.lexsort((pos, n, large, side, group))
        self.group, self.side, self.comp, self.n, self.pos, self.most, self.least = (
            x[self.order] for x in (group, side, code, n, pos, most, least))
        large = large[self.order]
        new = np.ones(len(n), bool)
        new[1:] = (np.diff(self.group) != 0) | (np.diff(self.side) != 0) | (np.diff(large) != 0)
        runs = np.flatnonzero(new)
        inside = np.arange(len(n)) - np.repeat(runs, np.diff(np.append(runs, len(n))))
        self.start = np.flatnonzero(inside % STRIPE == 0)
        self.size = np.diff(np.append(self.start, len(n)))
        self.single = large[self.start]  # the one component of a block, 0 if it may hold several

    def _over(self, f, values: np.ndarray) -> np.ndarray:
        return f.reduceat(values, self.start)

    def block_pairs(self, share: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of blocks of one list that hold sets which may link."""
        group, side = self.group[self.start], self.side[self.start]
        end = np.searchsorted(group, group, side="right")
        count = end - np.arange(len(group))
        i = np.repeat(np.arange(len(group)), count)
        j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + i
        low, high = self._over(np.minimum, self.n), self._over(np.maximum, self.n)
        before, after = self._over(np.maximum, self.pos), self._over(np.maximum, self.n - self.pos)
        most, rest = self._over(np.maximum, self.most), self._over(np.maximum, self.n - self.least)
        least = needed(low[i], low[j], share)
        may = (self.single[i] == 0) | (self.single[i] != self.single[j])
        may &= (side[i] != side[j]) | (side[i] == 2)
        may &= (100 * high[i] >= share * low[j]) & (100 * high[j] >= share * low[i])
        may &= np.minimum(before[i], before[j]) + np.minimum(after[i], after[j]) >= least
        may &= np.minimum(most[i] + rest[j], most[j] + rest[i]) >= least
        return i[may], j[may]

    def pairs(self, share: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that component, size, position and derived bound leave, some at a time; counts those tested."""
        i, j = self.block_pairs(share)
        self.tested = 0
        count = self.size[i] * self.size[j]
        for some in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(count) // CHUNK)) + 1):
            c = count[some]
            inside = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            wide = np.repeat(self.size[j[some]], c)
            a = np.repeat(self.start[i[some]], c) + inside // wide
            b = np.repeat(self.start[j[some]], c) + inside % wide
            self.tested += len(a)
            may = (a < b) & (self.comp[a] != self.comp[b])
            a, b = a[may], b[may]
            n_a, n_b, p_a, p_b = self.n[a], self.n[b], self.pos[a], self.pos[b]
            least = needed(n_a, n_b, share)
            may = (np.minimum(n_a, n_b) >= least)
            may &= np.minimum(p_a, p_b) + np.minimum(n_a - p_a, n_b - p_b) >= least
            may &= np.minimum(self.most[a] + n_b - self.least[b], self.most[b] + n_a - self.least[a]) >= least
            yield a[may], b[may]


def _root(parent: dict, i) -> object:
    while parent.setdefault(i, i) != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forests(frame: pd.DataFrame, barred: set, share: int = SHARE, extra: int = 0,
            left: set | None = None) -> list[tuple[int, int, int]]:
    """(gram, a, b): pairs that may link and together join all that each list could join.

    `frame` has rows of whole groups (gram, first, second). Up to `extra` more pairs a set, those with the highest
    bounds, save further rounds when some do not link. Pairs in `barred`, (gram, a, b), have been looked at. `left` takes
    the (gram, node) of pairs that are neither given nor barred.
    """
    if not len(frame):
        return []
    gram, first, second = (frame[c].to_numpy(np.int64) for c in ("gram", "first", "second"))
    new = np.ones(len(frame), bool)
    new[1:] = (np.diff(gram) != 0) | (np.diff(first) != 0) | (np.diff(second) != 0)
    lists = Lists(np.cumsum(new) - 1, *[frame[c].to_numpy(np.int64) for c in ("side", "component", "n", "pos", "most", "least")])
    maps = Bitmaps(frame["sketch"].tolist())
    found = []
    for a, b in lists.pairs(share):
        if len(a):
            margin = (lists.n[a] + lists.n[b] - maps.differ(lists.order[a], lists.order[b])) // 2
            margin -= needed(lists.n[a], lists.n[b], share)
            good = margin >= 0
            found.append(np.stack([a[good], b[good], margin[good]], axis=1))
    edges = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    nodes, gram = frame["node"].to_numpy(np.int64)[lists.order], gram[lists.order]
    parent: dict = {}
    degree, result = np.zeros(len(nodes), np.int64), []
    for a, b, _ in edges[np.argsort(-edges[:, 2], kind="stable")].tolist():
        pair = (int(gram[a]), int(min(nodes[a], nodes[b])), int(max(nodes[a], nodes[b])))
        if pair in barred:
            continue
        x, y = _root(parent, (lists.group[a], lists.comp[a])), _root(parent, (lists.group[b], lists.comp[b]))
        if x != y or degree[a] < extra and degree[b] < extra:
            parent[x] = y
            degree[[a, b]] += 1
            result.append(pair)
        elif left is not None:
            left.update(((pair[0], pair[1]), (pair[0], pair[2])))
    return result


WALKED = "gram long, first int, second int, side int, node long, n long, pos long, most long, least long, component long, sketch binary"


def walk(members: DataFrame, seen: DataFrame | None, share: int = SHARE, extra: int = 0) -> DataFrame:
    """(gram, a, b): forests of the lists, and with NULL as b the sets a of pairs that are left for the next round.

    A list above BLOCK sets is dealt to blocks, and every two blocks are one group.

    `seen` (gram, a, b) are pairs that the lists gave before. Rows of a group lie together in one task, many groups a task.
    """
    blocks = F.ceil(F.col("k") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("first", F.least("mine", "other")).withColumn("second", F.greatest("mine", "other"))
    side = F.when(F.col("first") == F.col("second"), 2).otherwise((F.col("mine") == F.col("second")).cast("int"))
    names = [c.split()[0] for c in WALKED.split(", ")]
    dealt = dealt.withColumn("side", side).select(*names)
    if seen is not None:
        # Pairs seen before travel with the groups of their list: `side` is -1, node and n are the pair.
        groups = dealt.select("gram", "first", "second").distinct()
        rest = [F.lit(0).cast("long").alias(c) for c in names[6:-1]]
        old = seen.join(groups, "gram").select("gram", "first", "second", F.lit(-1).alias("side"), F.col("a").alias("node"),
                                               F.col("b").alias("n"), *rest, F.lit(None).cast("binary").alias("sketch"))
        dealt = dealt.unionByName(old)
    rows = dealt.repartition("gram", "first", "second").sortWithinPartitions("gram", "first", "second")

    def give(frame: pd.DataFrame) -> pa.RecordBatch:
        before = frame[frame["side"] < 0]
        barred = set(zip(before["gram"].tolist(), before["node"].tolist(), before["n"].tolist()))
        left: set[tuple[int, int]] = set()
        pairs = forests(frame[frame["side"] >= 0].reset_index(drop=True), barred, share, extra, left)
        pairs += [(gram, node, None) for gram, node in left]
        columns = zip(*pairs) if pairs else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["gram", "a", "b"])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch.to_pandas())
            if sum(map(len, held)) < WALK_ROWS:
                continue
            frame = pd.concat(held, ignore_index=True)
            last = frame[["gram", "first", "second"]].iloc[-1]
            whole = ~(frame[["gram", "first", "second"]] == last).all(axis=1)
            if whole.any():  # the last group may go on in the next batch
                yield give(frame[whole])
            held = [frame[~whole]]
        if held:
            yield give(pd.concat(held, ignore_index=True))

    return rows.mapInArrow(find, "gram long, a long, b long")


# --- verification ----------------------------------------------------------------------------------------------------

def bitmap_bounds(pairs: DataFrame, nodes: DataFrame, share: int = SHARE) -> DataFrame:
    """(a, b, most, good): the most two sets can share by their bitmaps, and whether that allows a link."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("bitmap").alias(f"m_{name}"))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            maps, at = Bitmaps(batch.column(4).to_pylist() + batch.column(5).to_pylist()), np.arange(len(a))
            most = (n_a + n_b - maps.differ(at, at + len(a))) // 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(most), pa.array(most >= needed(n_a, n_b, share))],
                                             ["a", "b", "most", "good"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "m_a", "m_b")
    return both.mapInArrow(check, "a long, b long, most long, good boolean")


def verify(pairs: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """(a, b, overlap, linked) of every pair, from whole sets."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("codes").alias(f"c_{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    overlap = F.size(F.array_intersect("c_a", "c_b")).cast("long")
    counted = both.select("a", "b", overlap.alias("overlap"), (F.size("c_a") + F.size("c_b")).alias("sum"))
    return counted.select("a", "b", "overlap",
                          (100 * F.col("overlap") >= share * (F.col("sum") - F.col("overlap"))).alias("linked"))


def link_components(docs: DataFrame, sets: DataFrame, classes: np.ndarray, width: int = WIDTH,
                    share: int = SHARE) -> DataFrame:
    """(node, component) of the sets that link with another one."""
    lists = index_lists(sets)
    nodes = write_out(sets.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("sketch").alias("sketch"),
        F.min("doc_id").alias("doc_id")), "join-nodes")

    def compare(pairs: DataFrame) -> DataFrame:
        """(a, b, most, least, linked): by bitmaps, then on the whole sets of the pairs that these leave."""
        bounds = write_out(bitmap_bounds(pairs, nodes, share), "join-bounds")
        good = bounds.filter("good").select("a", "b")
        ends = good.select(F.col("a").alias("node")).unionByName(good.select(F.col("b").alias("node"))).distinct()
        wanted = write_out(ends.join(nodes, "node").select("doc_id"), "join-wanted")
        whole = write_out(whole_sets(docs, wanted, classes, width), "join-sets")
        exact = verify(good, whole, share)
        both = bounds.join(exact, ["a", "b"], "left")
        return both.select("a", "b", F.coalesce("overlap", "most").alias("most"),
                           F.coalesce("overlap", F.lit(0).cast("long")).alias("least"),
                           F.coalesce("linked", F.lit(False)).alias("linked"))

    checked = write_out(compare(representative_pairs(lists, share)), "join-answers")
    links = checked.filter("linked").select("a", "b")
    labels = components(links)
    members = with_answers(open_lists(lists, labels), checked.select("a", "b", "most", "least"))
    members = write_out(within_reach(members, share).join(nodes.select("node", "sketch"), "node").drop("home"), "join-open")
    seen, round_ = None, 0
    while True:
        walked = write_out(walk(members, seen, share, 4 ** (round_ + 1)), "join-forest")
        found = walked.filter("b IS NOT NULL")
        if found.isEmpty():
            return labels
        new = write_out(found.select("a", "b").distinct(), "join-new")
        links = write_out(links.unionByName(compare(new).filter("linked").select("a", "b")), "join-links")
        labels = components(links)
        # Candidates only become fewer: a set without a pair left is done in its list for good. So is a list whose sets left
        # are all linked.
        left = walked.filter("b IS NULL").select("gram", F.col("a").alias("node")).distinct()
        grams = write_out(several_components(left, labels), "join-grams")
        members = members.join(left.join(grams, "gram"), ["gram", "node"], "left_semi").drop("component")
        members = write_out(members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")),
                            "join-left")
        seen = found if seen is None else seen.unionByName(found)
        seen = write_out(seen.join(left.withColumnRenamed("node", "a"), ["gram", "a"], "left_semi")
                         .join(left.withColumnRenamed("node", "b"), ["gram", "b"], "left_semi").select("gram", "a", "b").distinct(),
                         "join-seen")
        round_ += 1


def join_components(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; the component's id is its smallest document's."""
    classes = frequency_classes(docs, width)
    sets = write_out(set_table(docs, classes, width, share), "join-table")
    labels = link_components(docs, sets, classes, width, share)
    narrow = sets.select("doc_id", "n", "node").join(labels, "node", "left")
    narrow = narrow.withColumn("group", F.coalesce("component", "node"))
    smallest = narrow.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return narrow.join(smallest, "group", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
