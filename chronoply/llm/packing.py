"""Packing of token sequences: bounded-space online best-fit.

Each task packs its own stream of pieces into sequences of fixed capacity. It keeps a
fixed number of open sequences. A bitset has a bit for each amount of free space that some
open sequence has, so the tightest one that fits is found by one shift and its lowest set
bit. When all places are taken, the fullest closes first. Ids are counted where the text is
read; only small piece rows are shuffled (with ``keep_ids`` also their ids).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frames, small_batches, stored
from .tokens import MEMO_ENTRIES, coder, end_mark


class OpenBins:
    """Fixed number of open sequences, found by free space."""

    def __init__(self, capacity: int, places: int) -> None:
        self.capacity, self.places = capacity, places
        self.mask, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        one = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.open -= 1
        return one

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            one = self._take(free)
        else:
            if self.open == self.places:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            one, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.mask |= 1 << left
            self.by_free[left].append(one)
            self.open += 1
        return one, self.capacity - free


def pieces(docs: DataFrame, tokenizer: str, *, spaces: bool = True, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, memo: int = MEMO_ENTRIES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as little-endian 32-bit bytes).

    A document of more than ``capacity`` ids is cut; its first piece takes what is over.
    Null text counts as empty (one end id). Repeated rows and null ids are packed as they are.
    ``memo`` bounds the pieces of text whose ids a worker remembers, twice over.
    """
    wide = capacity * 4

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, end = coder(tokenizer, spaces, memo), end_mark(end_id)
        for batch in frames(batches):
            rows = []
            for doc, ids in zip(batch["doc_id"], code.encode(batch["text"].tolist()), strict=True):
                ids += end
                cuts = range(len(ids) % wide or wide, len(ids) + 1, wide)
                start = 0
                for k, stop in enumerate(cuts):
                    part = ids[start:stop]
                    rows.append((doc, k, start // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                    start = stop
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = chosen.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long, ids binary")
    out = out.withColumn("doc_id", F.col("doc_id").cast(id_type))
    with small_batches(docs.sparkSession):  # texts are encoded once, however often their pieces are read
        return stored(out if keep_ids else out.drop("ids"), "pieces")


def pack(parts: DataFrame, *, capacity: int = 1024, open_bins: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to piece rows (which need ``length``, 1 to capacity).

    Rows are dealt by a hash of the document and put in a fixed order, so a task that is run
    again packs the same way. Each run of ``open_bins`` rows enters by falling length, so long
    pieces come first, yet short ones are there before long ones' sequences close. A task
    leaves at most ``open_bins`` sequences partly filled.
    """
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")

    def fill(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch["length"].tolist()
            placed = [(0, 0)] * len(lengths)
            for k in range(0, len(lengths), open_bins):
                for row in sorted(range(k, min(k + open_bins, len(lengths))), key=lengths.__getitem__, reverse=True):
                    placed[row] = bins.place(lengths[row])
            yield batch.assign(sequence_id=[base + s for s, _ in placed], offset=[o for _, o in placed])

    key = F.xxhash64(id_col, "piece", "length", "ids_crc32")  # also spreads rows that have no id
    dealt = parts.repartition(key).sortWithinPartitions(key, id_col, "piece", "length", "ids_crc32")
    return dealt.mapInPandas(fill, schema)
