"""Removal of long word sequences that stand earlier in the corpus, by recompression.

A window is a number of consecutive words. The first Spark round has a few high-level symbols of
each document, one at least inside every window, and counts them over the corpus: a symbol that
is there once tells that the windows around it are unique. Nothing but these symbols is
shuffled, and partial counts meet first, so a hot passage costs a row a task. The second round
names the other windows by all their symbols and keeps the earliest place of each name; the
places go back to their documents, whose other windows stand earlier somewhere.

Nothing gathers more in a task than belongs to one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, workspace
from .recompression import keys, pieces, window_names

#: Bits of a place for the window's number in its document; the others tell the document's rank.
BITS = 28
#: Bits of a span for its number of windows.
SPAN = 8


def _by_text(of_chunk: Callable, names: list[str], kinds: list[pa.DataType]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Applies ``of_chunk(batch, words)`` to batches' whole texts and gives the columns that it yields."""

    def applied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            for columns in of_chunk(batch, words):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return applied


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists of numbers: all of them, and where each row's begin."""
    column = batch.column(name)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], sizes.cumsum()))


def _unique(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of a document's n windows are inside of its unique symbols' spans."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, spans >> SPAN, 1)
    np.add.at(edge, (spans >> SPAN) + (spans & ((1 << SPAN) - 1)), -1)
    return edge.cumsum()[:n] > 0


def _symbols(width: int) -> Callable:
    """A row for each high-level symbol and stretch of windows that it stands for."""

    def of_chunk(batch: pa.RecordBatch, words: list[list[bytes]]) -> Iterator[list]:
        tid = batch.column("t0").to_numpy(zero_copy_only=False)
        for docs, at, bounds, flat in pieces(words, width):
            piece, place, key, where = keys(flat, bounds, width)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (where[1:] != where[:-1]) | (piece[1:] != piece[:-1])
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(key)))
            yield [key[begin].view(np.int64), tid[docs[piece[begin]]], (at[piece[begin]] + place[begin]) << SPAN | count]

    return _by_text(of_chunk, ["key", "t0", "span"], [pa.int64()] * 3)


def _repeated(width: int) -> Callable:
    """The name and the place of each window outside of unique symbols' spans."""

    def of_chunk(batch: pa.RecordBatch, words: list[list[bytes]]) -> Iterator[list]:
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        spans, ends = _lists(batch, "spans")
        parts: list[list[bytes]] = []
        home: list[tuple[int, int]] = []
        for k, w in enumerate(words):
            n = len(w) - width + 1
            if n > 1 << BITS or rank[k] >> (63 - BITS):
                raise ValueError("a place doesn't fit: too many documents, or words in one")
            if n < 1:
                continue
            # Stretches of windows that may be repeated; their words, and nothing else, are parsed.
            free = np.flatnonzero(np.diff(np.concatenate(([False], ~_unique(spans[ends[k] : ends[k + 1]], n), [False]))))
            for low, high in free.reshape(-1, 2).tolist():
                parts.append(w[low : high + width - 1])
                home.append((int(rank[k]), low))
        where = np.array(home, np.int64).reshape(-1, 2)
        for docs, at, bounds, flat in pieces(parts, width):
            piece, place, one, two = window_names(flat, bounds, width)
            own = where[docs[piece]]
            yield [one.view(np.int64), two.view(np.int64), own[:, 0] << BITS | own[:, 1] + at[piece] + place]

    return _by_text(of_chunk, ["one", "two", "place"], [pa.int64()] * 3)


def _cut(width: int) -> Callable:
    """Each document without the words of windows that are neither unique nor the first."""

    def of_chunk(batch: pa.RecordBatch, words: list[list[bytes]]) -> Iterator[list]:
        (spans, ends), (firsts, stops) = _lists(batch, "spans"), _lists(batch, "firsts")
        left, gone = [], []
        for k, w in enumerate(words):
            n = max(0, len(w) - width + 1)
            stays = _unique(spans[ends[k] : ends[k + 1]], n)
            stays[firsts[stops[k] : stops[k + 1]]] = True
            edge = np.zeros(len(w) + 1, np.int32)
            again = np.flatnonzero(~stays)
            edge[again] += 1
            edge[again + width] -= 1
            inside = edge.cumsum()[:-1] > 0
            gone.append(int(inside.sum()))
            left.append(b" ".join([x for x, drop in zip(w, inside.tolist(), strict=True) if not drop] if gone[-1] else w))
        ids = batch.column("doc_id")
        yield [ids, [len(w) for w in words], gone, pa.array(left, pa.binary()).cast(pa.string())]

    return of_chunk


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and two digests of both."""
    row = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return row.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("t0"), F.xxhash64(F.lit(1), "text", "doc_id").alias("t1"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Distinct documents' ranks by id (nulls first), then by digests: a range deal, and the counts of its parts."""
    dealt = rows.select("doc_id", "t0", "t1").distinct().repartitionByRange("doc_id", "t0", "t1").sortWithinPartitions("doc_id", "t0", "t1")
    dealt = stored(dealt.select("t0", "t1", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k")), "ranks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    alone = F.count("*").over(Window.partitionBy("t0")) == 1
    return dealt.join(parts, "part").select("t0", "t1", (F.col("base") + F.col("k")).alias("rank"), alone.alias("alone"))


def _in_lists(rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    return rows.groupBy(by).agg(F.collect_list(value).alias(name))


def remove_repeats(docs: DataFrame, *, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by spaces, of every row.

    A word goes if a window over it has a word sequence that also starts earlier: in a document of
    a smaller id, or before it in the same one. Null and empty texts have no words; a text of fewer
    than ``width`` words keeps all. A null id comes before others. Of rows with one id and other
    texts, the order is that of a digest; rows of one id and text are one document, and each
    gets its result. Other columns are dropped, whatever their names. An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    rows = _named(docs, id_col, text_col)
    with workspace(spark), small_batches(spark, 500):
        found = rows.select("t0", "text").mapInArrow(_symbols(width), "key long, t0 long, span long")
        once = found.groupBy("key").agg(F.count("*").alias("n"), F.min("t0").alias("t0"), F.min("span").alias("span")).where("n = 1")
        # Digests of 64 bits: documents that share one, by chance, have no unique symbols, and all their windows are named.
        spans = F.when(F.col("alone"), F.col("spans"))
        marks = stored(_ranked(rows).join(_in_lists(once, "t0", F.col("span"), "spans"), "t0", "left").select("t0", "t1", "rank", spans.alias("spans")), "symbols")
        named = rows.select("t0", "t1", "text").join(marks, ["t0", "t1"]).select("rank", "text", "spans").mapInArrow(_repeated(width), "one long, two long, place long")
        first = named.groupBy("one", "two").agg(F.min("place").alias("place"))
        firsts = _in_lists(first.select(F.shiftright("place", BITS).alias("rank"), F.col("place").bitwiseAND((1 << BITS) - 1).alias("at")), "rank", F.col("at"), "firsts")
        marks = stored(marks.join(firsts, "rank", "left").drop("rank"), "repeats", lasting=True)
    out = rows.join(marks, ["t0", "t1"]).select("doc_id", "text", "spans", "firsts")
    kind = docs.schema[id_col].dataType
    made = _by_text(_cut(width), ["doc_id", "n_words", "n_removed", "kept"], [None, pa.int64(), pa.int64(), pa.string()])
    schema = f"doc_id {kind.simpleString()}, n_words long, n_removed long, kept string"
    return out.mapInArrow(made, schema)
