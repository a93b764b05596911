"""Damerau-Levenshtein distances of many pairs at once.

The distance counts insertions, deletions, replacements and swaps of neighbours, and lets edits
come between swapped items. A row of the table of one pair needs the two rows before it: of all
swaps, only those whose items are neighbours in one of the two sequences can be best. Rows of
many pairs of like length are worked out together, a column at a time never: an insertion's
chain along a row is a running minimum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

#: Cells of a row over all pairs that are worked out together.
CELLS = 1 << 15


def _codes(pairs: list[tuple[Sequence, Sequence]]) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers for the items of all sequences, one after another, and each one's length."""
    sizes = np.array([len(s) for pair in pairs for s in pair])
    items = np.empty(int(sizes.sum()), object)
    items[:] = [x for pair in pairs for s in pair for x in s]
    return pd.factorize(items, use_na_sentinel=False)[0].astype(np.int32), sizes


def _padded(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    at = np.arange(int(sizes.max(initial=0)))
    inside = at < sizes[:, None]
    out = np.full(inside.shape, fill, np.int32)
    out[inside] = codes[(begins[:, None] + at)[inside]]
    return out


def swap_distances(pairs: list[tuple[Sequence, Sequence]]) -> np.ndarray:
    """The distance of each pair of sequences of hashable items (null is an item like others)."""
    found = np.zeros(len(pairs), np.int32)
    codes, sizes = _codes(pairs)
    begins = np.cumsum(sizes) - sizes
    # Rows belong to the shorter sequence of a pair; pairs of like lengths go together.
    swap = sizes[0::2] > sizes[1::2]
    short, long = 2 * np.arange(len(pairs)) + swap, 2 * np.arange(len(pairs)) + ~swap
    order = np.lexsort((sizes[short], sizes[long]))
    at = 0
    while at < len(order):
        # The longest of those that fit decides the width.
        stop = min(len(order), at + max(1, CELLS // (int(sizes[long[order[at]]]) + 1)))
        while stop > at + 1 and (stop - at) * (int(sizes[long[order[stop - 1]]]) + 1) > 2 * CELLS:
            stop = at + (stop - at) // 2
        part = order[at:stop]
        s, t = short[part], long[part]
        found[part] = _together(_padded(codes, begins[s], sizes[s], -1), _padded(codes, begins[t], sizes[t], -2), sizes[s], sizes[t])
        at = stop
    return found


def _together(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Distances of padded sequences; a's rows end at ``rows``, b's columns at ``columns``."""
    n, width = b.shape
    kind = np.int16 if width + a.shape[1] < 8_000 else np.int32
    far = kind(np.iinfo(kind).max // 3)
    column = np.arange(width + 1, dtype=kind)
    before = np.full((n, width + 1), far, kind)  # row i - 2
    last = np.broadcast_to(column, (n, width + 1)).copy()  # row i - 1
    #: For each column: the cell before the last row that has its item and the column before it, less
    #: that row's number; and whether the row before has its item.
    swap_in_b, same_before = np.full((n, width), far, kind), np.zeros((n, width), bool)
    out = np.where(rows == 0, columns, 0).astype(np.int32)
    for i in range(1, a.shape[1] + 1):
        same = a[:, i - 1 : i] == b
        now = np.empty_like(last)
        now[:, 0] = i
        cost = now[:, 1:]
        np.minimum(last[:, :-1] + ~same, last[:, 1:] + kind(1), out=cost)
        # Swapped items that are neighbours in b: a's item is in the column before.
        np.minimum(cost[:, 1:], np.where(same[:, :-1], swap_in_b[:, 1:] + kind(i), far), out=cost[:, 1:])
        # Swapped items that are neighbours in a: the column's item is in the row before. Any earlier
        # place of a's item will do, so the least is a running minimum.
        if i > 1:
            reach = np.where(same, before[:, :-1] - column[1:], far)
            np.minimum.accumulate(reach, axis=1, out=reach)
            np.minimum(cost[:, 1:], np.where(same_before[:, 1:], reach[:, :-1] + column[2:], far), out=cost[:, 1:])
        if width > 1:
            swap_in_b[:, 1:] = np.where(same[:, 1:], last[:, : width - 1] - kind(i), swap_in_b[:, 1:])
        now -= column
        np.minimum.accumulate(now, axis=1, out=now)
        now += column
        before, last, same_before = last, now, same
        ends = rows == i
        if ends.any():
            out[ends] = now[ends, columns[ends]]
    return out
