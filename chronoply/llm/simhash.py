"""Near-duplicate groups by SimHash, found with Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last one shortened).
The perfect binary Golay code (23, 12, 7) maps each 23-bit word to the one codeword within
3 bits. Words that differ in at most one bit share a key if one of them gives the indices of
all codewords that its own one-bit neighbourhood decodes to (1 or 6) and the other just its
own. A flipped bit flips the segment's parity, so parity decides who gives which.

Fingerprints that differ in at most 3 bits either agree in one segment and differ by at most
one bit in another, or differ by one bit in each segment. The first case is met by keys of
an exact segment and a codeword index (35 bits), the second by keys of three indices. Keys
are this long so that unrelated fingerprints rarely meet, whatever the size of the corpus.
Members of a key are verified bit by bit; each key gives a spanning forest of its links, not
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, small_batches, stored

#: Generator polynomial of the binary Golay code.
GOLAY = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(parity of each 12-bit message, error pattern of each syndrome)."""

    def rest(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    parity = np.array([rest(m << 11) for m in range(4096)], dtype=np.int64)
    errors = np.zeros(2048, dtype=np.int64)
    flips = [1 << k for k in range(23)]
    for a in flips:
        errors[rest(a)] = a
        for b in flips:
            if b < a:
                errors[rest(a | b)] = a | b
                for c in flips:
                    if c < b:
                        errors[rest(a | b | c)] = a | b | c
    return parity, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    parity, errors = _golay()
    syndrome = parity[words >> 11] ^ (words & 0x7FF)
    return (words ^ errors[syndrome]) >> 11


def _near(words: np.ndarray, bits: int) -> np.ndarray:
    """Codeword indices of each word and of its one-bit neighbours; -1 in place of repeats."""
    ball = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(bits))], axis=1)
    keys = np.sort(decode(ball), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of the fingerprint each belongs to)."""
    raw = prints.astype(np.uint64)
    words = [((raw >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [decode(w) for w in words]
    near = [_near(w, n) for w, (_, n) in zip(words, SEGMENTS, strict=True)]
    even = [np.bitwise_count(w) % 2 == 0 for w in words]
    rows, keys = [], []

    def give(tag: int, chosen: np.ndarray, base: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> None:
        """Keys of the chosen rows: base, and one index of each part at its shift."""
        at, key = np.flatnonzero(chosen), base[chosen]
        for shift, values in parts:
            v = values[at]
            ok = v >= 0
            n = ok.sum(axis=1)
            key, at = np.repeat(key, n) | (v[ok] << shift), np.repeat(at, n)
        rows.append(at)
        keys.append(key | (tag << 40))

    zero = np.zeros(len(raw), np.int64)
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                give(tag, even[j], words[i] << 12, [(0, near[j])])
                give(tag, ~even[j], words[i] << 12, [(0, own[j][:, None])])
                tag += 1
    give(tag, even[0], zero, [(0, near[0]), (12, near[1]), (24, own[2][:, None])])
    give(tag, ~even[0], zero, [(0, own[0][:, None]), (12, own[1][:, None]), (24, near[2])])
    return np.concatenate(keys), np.concatenate(rows)


def _print(text: str | None, words: int) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """64-bit SimHash (long) over word shingles with repeats; 0 for null or no words."""

    @pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_print(t, words) for t in batch], dtype="int64")

    return simhash(text.cast("string"))


def _forest(group: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning links of the fingerprints of one key: each is scanned against those not yet reached."""
    links, todo = [], np.unique(group)
    while len(todo) > 1:
        reach, todo = [todo[0]], todo[1:]
        while reach and len(todo):
            one = reach.pop()
            near = np.bitwise_count(todo ^ one) <= most
            if near.any():
                found = todo[near]
                links += [(one, x) for x in found]
                reach += list(found)
                todo = todo[~near]
    return links


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Distinct links (a, b) between different fingerprints of at most ``most`` (3 at most)
    bits, enough to join all that are linked. ``prints`` has distinct non-null longs ``fp``."""
    if most > 3:
        raise ValueError("the keys find differences of 3 bits at most")

    def emit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            for k in range(0, len(values), 5_000):
                part = values[k : k + 5_000]
                keys, rows = keys_of(part)
                yield pd.DataFrame({"key": keys, "fp": part[rows]})

    def verify(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def linked(k: np.ndarray, f: np.ndarray) -> pd.DataFrame:
            cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            a, b = f[two], f[two + 1]
            near = np.bitwise_count(a ^ b) <= most
            out = [np.stack([a[near], b[near]], axis=1)]
            for at, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if found := _forest(f[at : at + n], most):
                    out.append(np.array(found, dtype=np.uint64))
            pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]].view(np.int64)
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

        for batch in batches:
            k = np.concatenate([held_k, batch["key"].to_numpy(np.int64)])
            f = np.concatenate([held_f, batch["fp"].to_numpy(np.int64).view(np.uint64)])
            last = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if last:
                yield linked(k[:last], f[:last])
            held_k, held_f = k[last:], f[last:]
        if len(held_k):
            yield linked(held_k, held_f)

    keyed = prints.select("fp").mapInPandas(emit, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return keyed.mapInPandas(verify, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root the smallest node reachable, by alternating
    large and small stars. Each round is written to the shared folder; it ends when a round
    changes nothing."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = stored(small.where("a <> b").distinct(), "stars")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """One row for each input row: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most ``most`` bits, itself
    included. Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows are kept; a null id takes part in links but is never the smallest, unless
    its whole component has no id (then component_id is null).
    """
    with small_batches(docs.sparkSession):
        rows = stored(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp")), "prints")
    out = classes(rows, links(rows.select("fp").distinct(), most))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fp, component_id for each row of (id, fp), whose fp are joined by edges (a, b):
    component_id is the smallest id of all rows whose fp are reachable."""
    first = rows.groupBy("fp").agg(F.min("id").alias("least_id"))
    roots = components(edges)
    known = first.join(roots, first.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    linked = known.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("least_id").alias("least_root"))
    final = known.join(least, "root", "left").select("fp", F.coalesce("least_root", "least_id").alias("component_id"))
    return rows.join(final, "fp").select("id", "fp", "component_id")


def keep_first(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stand for their component: those with its smallest id.
    ``found`` tells the component_id of each id.

    Rows that repeat an id stay or go together. Rows without an id can't be told apart by it
    and always stay.
    """
    name = fresh(docs, "__gone")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def keep_one(docs: DataFrame, chosen: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each row (id, text_hash, n) of ``chosen``. Of the ``n`` rows that
    have both id and hash, the one of the least hash of all columns."""
    name, text, rows = (fresh(docs, c) for c in ("__kept", "__hash", "__rows"))
    told = stored(chosen.select(F.col(id_col).alias(name), F.col("text_hash").alias(text), F.col("n").alias(rows)), "chosen")
    same = F.col(id_col).eqNullSafe(F.col(name)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(text))
    alone = docs.join(told.where(F.col(rows) == 1), same, "left_semi")
    repeated = docs.join(told.where(F.col(rows) > 1), same, "left_semi")
    one = repeated.groupBy(id_col, F.xxhash64(F.col(text_col).cast("string")).alias(text)).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias(rows))
    return alone.union(one.select(f"{rows}.*"))
