"""Token-id files with Elias-Fano document boundaries.

Texts are dealt by ranges of the document's id, so the files' order is that of the ids, and
encoded where they arrive. A task writes segments: one concatenated id array, and the
document boundaries in it as an Elias-Fano code (low bits packed, high bits in unary, positions
of every 64th set bit as a select structure). The ids of the documents rise too and are kept
the same way, as distances from the segment's first. A reader finds a document's ids by two
selects, without decoding the others; selects of many documents are answered together. A segment is a row of a Parquet file with binary columns, written by
Spark to any store that Spark can write, and read back from there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frames, scratch, setting, small_batches
from .tokens import coder, end_mark

SEGMENT = "part int, segment int, n_docs long, n_nulls long, n_ids long, width int, low_bits int, low binary, high binary, picks binary, first_doc long, doc_low_bits int, doc_low binary, doc_high binary, doc_picks binary, ids binary"
#: Set bits between two entries of the select structure.
PICK = 64
#: The number of set bits of each byte, and the places of the first, second, ... of them.
_ONES = np.array([b.bit_count() for b in range(256)])
_PLACES = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)])


class EliasFano:
    """A rising sequence of n numbers below a bound in about n * (2 + log2(bound / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, picks: bytes) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, np.frombuffer(high, np.uint8)
        self.picks = np.frombuffer(picks, "<u4")

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
        """(low_bits, low, high, picks) of rising values."""
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        high = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        bits[high] = 1
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel()
        return low_bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), high[::PICK].astype("<u4").tobytes()

    def select(self, k: int) -> int:
        """The k-th value."""
        return int(self.selects(np.array([k]))[0])

    def selects(self, ks: np.ndarray) -> np.ndarray:
        """The k-th values, each from the pick before it and at most a few bytes of each array."""
        at = self.picks[ks // PICK].astype(np.int64)
        need, byte, place, todo = ks % PICK, at >> 3, np.zeros(len(ks), np.int64), np.arange(len(ks))
        bits = self.high[byte] & (0xFF << (at & 7)).astype(np.uint8)
        while len(todo):
            ones = _ONES[bits]
            here = need < ones
            place[todo[here]] = byte[here] * 8 + _PLACES[bits[here], need[here]]
            todo, need, byte = todo[~here], (need - ones)[~here], byte[~here] + 1
            bits = self.high[byte]
        low = self._low(ks * self.low_bits, min(self.low_bits, 32))
        if self.low_bits > 32:
            low |= self._low(ks * self.low_bits + 32, self.low_bits - 32) << 32
        return ((place - ks) << self.low_bits) | low

    def _low(self, start: np.ndarray, width: int) -> np.ndarray:
        """``width`` (32 at most) of the low bits from each start."""
        found = np.zeros(len(start), np.int64)
        padded = np.frombuffer(self.low + bytes(8), np.uint8)
        for k in range(5):
            found |= padded[(start >> 3) + k].astype(np.int64) << (8 * k)
        return (found >> (start & 7)) & ((1 << width) - 1)

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (high.astype(np.int64) << self.low_bits) | (low << np.arange(self.low_bits)).sum(axis=1)


def write(docs: DataFrame, path: str, tokenizer: str, *, spaces: bool = False, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, width: int = 2, segment_ids: int = 2_000_000) -> None:
    """Write the token files. Null text counts as empty; ids are stored in ``width`` bytes.

    A row with a null id comes first. Rows with one id come in the order of a hash of their texts,
    by which a hot id is dealt too; repeated rows are written as often as they are there. Other
    columns, whatever their names, aren't. An empty table has no segments. A segment closes at ``segment_ids`` ids; one longer document makes a segment of its own.
    """

    def segments(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, end = coder(tokenizer, spaces), end_mark(end_id)
        part, k, total = TaskContext.get().partitionId(), 0, 0
        names: list[int] = []
        nulls = 0
        bodies: list[bytes] = []
        lengths: list[int] = []

        def closed() -> pd.DataFrame:
            ends = np.cumsum(lengths)
            first = names[0] if names else 0
            docs_in = np.array(names, np.int64) - first
            row = (part, k, len(lengths), nulls, int(ends[-1]), width, *EliasFano.encode(ends - 1), first, *EliasFano.encode(docs_in), b"".join(bodies))
            return pd.DataFrame([row], columns=[x.split()[0] for x in SEGMENT.split(", ")])

        for batch in frames(batches, 256):
            for doc, raw in zip(batch["doc_id"].tolist(), code.encode(batch["text"].tolist()), strict=True):
                told = np.frombuffer(raw + end, "<u4")
                if int(told.max()) >> (8 * width):
                    raise ValueError(f"an id doesn't fit in {width} bytes")
                ids, n = told.astype(f"<u{width}").tobytes(), len(told)
                if lengths and total + n > segment_ids:
                    yield closed()
                    k, total, nulls = k + 1, 0, 0
                    for x in (names, bodies, lengths):
                        x.clear()
                total += n
                if doc is None:
                    nulls += 1
                else:
                    names.append(int(doc))
                bodies.append(ids)
                lengths.append(n)
        if lengths:
            yield closed()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = chosen.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    # As text: a null would turn a pandas column of ids into floats.
    made = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(segments, SEGMENT)
    with small_batches(docs.sparkSession), setting(docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        made.write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Segment totals are added up per file part, then within it, so no task sees all segments
    of a large corpus.
    """
    files = spark.read.schema(SEGMENT).parquet(path)
    heads = files.select("part", "segment", "n_ids")
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part of the write
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(over), F.lit(0)).alias("base"))
    starts = heads.select("part", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner")).join(parts, "part").select("part", "segment", (F.col("base") + F.col("inner")).alias("first"))

    def documents(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                ends = EliasFano(s.n_docs, s.low_bits, s.low, s.high, s.picks)
                told = EliasFano(s.n_docs - s.n_nulls, s.doc_low_bits, s.doc_low, s.doc_high, s.doc_picks)
                stops = ends.selects(np.arange(s.n_docs)) + 1
                starts = np.concatenate(([0], stops[:-1]))
                names = [None] * s.n_nulls + (told.selects(np.arange(s.n_docs - s.n_nulls)) + s.first_doc).tolist()
                ids = np.frombuffer(s.ids, f"<u{s.width}").astype("<u4").tobytes()
                yield pd.DataFrame({
                    "part": s.part, "segment": s.segment, "doc_id": pd.array(names, dtype="Int64"),
                    "inner_start": starts, "n_tokens": stops - starts,
                    "ids_crc32": [zlib.crc32(ids[a * 4 : b * 4]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)],
                })

    rows = files.mapInPandas(documents, "part int, segment int, doc_id long, inner_start long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "segment"]).select("doc_id", (F.col("first") + F.col("inner_start")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return scratch(spark, "tokens")
