"""Sharding: best-fit-decreasing packing of indivisible groups into equal shards.

Equal texts make a group that stays together. Groups are first packed, in parallel and by
decreasing size, into blocks of a small part of a shard's capacity; a group larger than a
block is a block of its own. The blocks, a number bounded by ``blocks`` and the tasks, are
then packed best-fit-decreasing into shards of fixed capacity: the tightest shard that has
room is found in a balanced tree keyed by remaining capacity. The least capacity for which
the given number of shards is enough is found by bisection.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


class Tightest:
    """Bins by remaining capacity in a treap: a search tree by (left, name) that random
    priorities (a hash, so a task that is run again builds the same) keep balanced."""

    def __init__(self) -> None:
        self.root = 0
        # Node k is at place k of each list; 0 is no node.
        self.keys: list[tuple[int, int]] = [(0, 0)]
        self.ranks, self.smaller, self.larger = [0], [0], [0]

    def _split(self, node: int, key: tuple[int, int]) -> tuple[int, int]:
        """Trees of the keys below ``key`` and of the others."""
        if not node:
            return 0, 0
        if self.keys[node] < key:
            low, high = self._split(self.larger[node], key)
            self.larger[node] = low
            return node, high
        low, high = self._split(self.smaller[node], key)
        self.smaller[node] = high
        return low, node

    def _join(self, low: int, high: int) -> int:
        """One tree of two, all keys of the first below those of the second."""
        if not low or not high:
            return low or high
        if self.ranks[low] > self.ranks[high]:
            self.larger[low] = self._join(self.larger[low], high)
            return low
        self.smaller[high] = self._join(low, self.smaller[high])
        return high

    def add(self, left: int, name: int) -> None:
        node, key = len(self.keys), (left, name)
        self.keys.append(key)
        self.ranks.append(zlib.crc32(node.to_bytes(8, "little")))
        self.smaller.append(0)
        self.larger.append(0)
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, node), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (left, name) of least left that has room for ``size``."""
        low, high = self._split(self.root, (size, -1))
        if not high:
            self.root = low
            return None
        above, node = 0, high
        while self.smaller[node]:
            above, node = node, self.smaller[node]
        if above:
            self.smaller[above] = self.larger[node]
        else:
            high = self.larger[node]
        self.root = self._join(low, high)
        return self.keys[node]


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """(bin of each size, number of bins); ``sizes`` fall. A size over the capacity has its own bin."""
    tree, bins, out = Tightest(), 0, []
    for size in sizes:
        found = tree.take(size)
        left, name = found or (capacity, bins)
        bins += found is None
        if left > size:
            tree.add(left - size, name)
        out.append(name)
    return out, bins


def shards_of(sizes: list[int], shards: int) -> list[int]:
    """Best-fit-decreasing into ``shards`` at the least capacity that is enough for them."""
    low = max([-(-sum(sizes) // shards), *sizes[:1], 1])
    high = max(2 * low, 1)
    while best_fit_decreasing(sizes, high)[1] > shards:
        high *= 2
    while low < high:
        middle = (low + high) // 2
        if best_fit_decreasing(sizes, middle)[1] <= shards:
            high = middle
        else:
            low = middle + 1
    return best_fit_decreasing(sizes, high)[0]


def shard(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", blocks: int = 2_000) -> DataFrame:
    """id, size, text_crc32, shard, slot for each row.

    size: UTF-8 bytes of the text and 1. Null and empty texts make one group. Slots are
    gapless from 0 in each shard; they are counted in runs of at most about
    1 / (4 * ``blocks``) of all rows, so neither a shard nor a large group is numbered in one
    task. The driver sees the blocks (at most about twice ``blocks``, and one for each task)
    and the runs' counts, five times ``blocks`` or so, at any size of the corpus.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("g")), "sizes")
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total, n_rows = (x or 0 for x in rows.agg(F.sum("size"), F.count("*")).first())
    room, numbered = max(1, total // blocks), max(1, n_rows // (4 * blocks))

    def fill(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, tree, made = TaskContext.get().partitionId() << 32, Tightest(), 0
        for batch in batches:  # by decreasing size
            names = []
            for size in batch["bytes"].tolist():
                found = tree.take(size)
                left, name = found or (room, made)
                made += found is None
                if left > size:
                    tree.add(left - size, name)
                names.append(base + name)
            yield batch.assign(block=names)

    placed = stored(groups.repartition("g").sortWithinPartitions(F.desc("bytes"), "g").mapInPandas(fill, "g string, bytes long, n long, block long"), "blocks")
    heads = placed.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    heads.sort(key=lambda r: (-r.bytes, r.block))
    shard_of = shards_of([r.bytes for r in heads], shards)
    spark = docs.sparkSession
    table = [(r.block, s, max(1, -(-r.n // numbered))) for r, s in zip(heads, shard_of, strict=True)]
    plan = spark.createDataFrame(table, "block long, shard int, runs int")
    run = F.pmod(F.xxhash64("id", "text_crc32"), F.col("runs"))
    told = rows.join(placed.select("g", "block"), "g").join(F.broadcast(plan), "block").select("id", "size", "text_crc32", "shard", "block", run.cast("int").alias("run"))
    told = stored(told, "told")
    counts = sorted(told.groupBy("shard", "block", "run").count().collect())
    first, at = [], {}
    for r in counts:
        first.append((r.block, r.run, at.get(r.shard, 0)))
        at[r.shard] = at.get(r.shard, 0) + r["count"]
    starts = spark.createDataFrame(first, "block long, run int, first long")
    order = Window.partitionBy("block", "run").orderBy("id", "text_crc32", "size")
    out = told.withColumn("nth", F.row_number().over(order)).join(F.broadcast(starts), ["block", "run"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"))
