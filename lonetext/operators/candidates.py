"""Approximate neighbour search: random-projection hash tables over every row, exact distances to the candidates.

A table cuts space by `bits` random hyperplanes through the centre of the data; vectors on the same sides share a bucket.
A query looks into its own bucket of each table and, in the order of its distance to the planes, into the buckets across
its nearest ones. Every location is stored once per table, in buckets that are cut into pieces when they are crowded, so
the stored side is shuffled once, while the index is built, and a search only moves queries. Queries that find fewer
neighbours than asked for are searched exactly.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..common import matrix, write_bucketed, write_out
from .neighbours import BLOCK_ROWS, TIE_DECIMALS, Cells, _squared, distinct_vectors

BUCKET_ROWS = 256  # rows a bucket holds on average, which sets the number of planes unless it is given
PIECE_ROWS = 2_048  # rows of a crowded bucket in one task
QUERY_BLOCK = 65_536  # queries that are searched at a time: at most so many meet one piece
TILES = 4_096  # most files of the stored buckets; a file may hold many pieces


class HashTables:
    """Drop-in for `Cells` where neighbours may be missed; `nearest` has the same columns."""

    def __init__(self, train: DataFrame, seed: int = 42, tables: int = 8, bits: int | None = None, probes: int = 4,
                 bucket_rows: int = BUCKET_ROWS, piece_rows: int = PIECE_ROWS, query_block: int = QUERY_BLOCK):
        """`tables` and `probes` raise the recall and the work, `bits` lowers both."""
        self.train, self.seed, self.tables, self.probes, self.query_block = train, seed, tables, probes, query_block
        self.spark = train.sparkSession
        self.locations = write_out(distinct_vectors(train), "locations")
        self.size, self.rows = self.locations.agg(F.count("*"), F.sum("w")).first()
        if not self.size:
            raise ValueError("no training rows")
        self.bits = max(0, int(np.ceil(np.log2(self.size / bucket_rows)))) if bits is None else bits
        dim = self.locations.select(F.size("vec")).first()[0]
        centre = self.locations.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
        self.centre = np.array([r.m for r in centre.orderBy("i").collect()])  # one number per dimension
        self.planes = np.random.default_rng(seed).normal(size=(tables, dim, self.bits))
        coded = self.locations.withColumn("key", F.explode(self._keys(0)("vec")))
        crowd = coded.groupBy("key").agg(F.count("*").alias("n"))
        self.keys = write_out(crowd.select("key", F.ceil(F.col("n") / piece_rows).cast("int").alias("pieces")), "hash-keys")
        piece = F.pmod(F.xxhash64("loc"), F.col("pieces"))
        stored = coded.join(self.keys, "key").select(F.xxhash64("key", piece).alias("tile"), "loc", "w", "vec")
        tiles = -(-self.size * tables // piece_rows)
        self.stored = write_bucketed(stored, "hash-buckets", "tile", min(TILES, max(tiles, self.spark.sparkContext.defaultParallelism)))

    def _keys(self, probes: int):
        """A vector's bucket in every table, and `probes` more per table across the planes nearest to it."""
        shared = self.spark.sparkContext.broadcast((self.planes, self.centre))
        bits, tables = self.bits, self.tables

        @F.pandas_udf("array<long>")
        def keys(vec: pd.Series) -> pd.Series:
            planes, centre = shared.value
            x, found = matrix(vec) - centre, []
            for t in range(tables):
                side = x @ planes[t]
                code = (side > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64)
                near = np.argsort(np.abs(side), axis=1, kind="stable")[:, :probes]
                flips = np.concatenate([np.zeros((len(x), 1), np.int64), 1 << near], axis=1)
                found.append((t << 48) + (code[:, None] ^ flips))
            return pd.Series(list(np.concatenate(found, axis=1)))

        return keys

    def nearest(self, queries: DataFrame, m: int) -> DataFrame:
        """(qid, nbr, w, d, place): the m nearest of the candidates of each (qid, vec) query, by exact distance.

        Queries whose candidates stand for fewer than m locations are searched exactly.
        """
        queries = write_out(queries.select("qid", "vec"), "hash-queries")
        blocks = max(1, -(-queries.count() // self.query_block))
        place = F.pmod(F.xxhash64("qid", F.lit(self.seed)), F.lit(blocks))
        parts = [write_out(self._search(queries.filter(place == b) if blocks > 1 else queries, m), "hash-found")
                 for b in range(blocks)]
        found = reduce(DataFrame.unionByName, parts)
        wanted = min(m, self.size)
        full = found.groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") >= wanted).select("qid")
        short = write_out(queries.join(full, "qid", "left_anti"), "hash-short")
        self.short = short.count()
        if not self.short:
            return found
        exact = Cells(self.train, self.seed).nearest(short, m)
        return found.join(full, "qid", "left_semi").unionByName(exact.select(*found.columns))

    def _search(self, queries: DataFrame, m: int) -> DataFrame:
        visits = queries.withColumn("key", F.explode(F.array_distinct(self._keys(self.probes)("vec")))).join(self.keys, "key")
        visits = visits.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("pieces") - 1).cast("long"))))
        visits = visits.select(F.xxhash64("key", "piece").alias("tile"), "qid", F.col("vec").alias("query"))
        centre = self.centre

        def best(batch: pd.DataFrame, piece: pd.DataFrame) -> pd.DataFrame:
            if not len(batch) or not len(piece):
                return pd.DataFrame({"qid": [], "nbr": [], "w": [], "d": []})
            y, loc, w = matrix(piece["vec"]) - centre, piece["loc"].to_numpy(), piece["w"].to_numpy()
            k, out = min(m, len(loc)), []
            for start in range(0, len(batch), BLOCK_ROWS):
                rows = batch.iloc[start:start + BLOCK_ROWS]
                x = matrix(rows["query"]) - centre
                d2 = _squared(x, y)
                cut = np.partition(d2, k - 1, axis=1)[:, k - 1] if k else np.zeros(len(x))
                r, c = np.nonzero(d2 <= cut[:, None] * (1 + 1e-9) + 1e-9)
                d = np.sqrt(((x[r] - y[c]) ** 2).sum(1))
                order = np.lexsort((loc[c], np.round(d, TIE_DECIMALS), r))
                r, c, d = r[order], c[order], d[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append(pd.DataFrame({"qid": rows["qid"].to_numpy()[r[keep]], "nbr": loc[c[keep]], "w": w[c[keep]],
                                         "d": d[keep]}))
            return pd.concat(out)

        met = visits.groupBy("tile").cogroup(self.stored.groupBy("tile")).applyInPandas(
            best, "qid long, nbr long, w long, d double")
        order = Window.partitionBy("qid").orderBy(F.round("d", TIE_DECIMALS), "nbr")
        once = met.groupBy("qid", "nbr").agg(F.first("w").alias("w"), F.min("d").alias("d"))
        return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= m)


def recall(index: HashTables, queries: DataFrame, m: int) -> DataFrame:
    """(n_queries, n_true, n_found): how many of the m exact neighbours the index finds, over all `queries` (qid, vec)."""
    truth = Cells(index.train, index.seed).nearest(queries, m).select("qid", "nbr")
    got = index._search(write_out(queries.select("qid", "vec"), "hash-queries"), m).select("qid", "nbr", F.lit(1).alias("hit"))
    both = truth.join(got, ["qid", "nbr"], "left")
    return both.agg(F.countDistinct("qid").alias("n_queries"), F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
