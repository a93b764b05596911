"""Consistent symbols of word sequences, by recompression.

Words have names, which are digests. A round gives new names to runs of one symbol and then to
pairs: a bit of each name, another one in every round, tells left symbols from right ones, and a
left symbol followed by a right one becomes a pair. A new name is a digest of the names that it
stands for, so every task of every executor gives the same name to the same words and no table
of names has to be shared. Whether two neighbours are joined depends on nothing but the two, so
equal stretches of words get equal symbols but near their ends.

Where the ends lose their certainty is known from the stretch alone: a right symbol at its
begin may belong to a pair that starts before it, a left symbol at its end to one that ends
after it; of a run, the outer symbols stay by themselves and only those between become one.
Popping what is uncertain, round by round, leaves a core whose symbols every equal stretch has.
The popped symbols and the last core tell a stretch's words, and so name it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Rounds before keys are chosen, and neighbouring symbols of a key.
ROUNDS, NEIGHBOURS = 3, 3
#: Words that are parsed at once.
CHUNK = 200_000
#: Words whose names a worker keeps.
MEMO = 500_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_RUN, _PAIR, _KEY, _POP, _END, _LANE = (np.uint64(k << 32) for k in range(1, 7))
_memo: dict[bytes, int] = {}


def mix(a: np.ndarray, b: np.ndarray | np.uint64, salt: np.uint64) -> np.ndarray:
    """A digest of two names, in order."""
    x = (a * _A) ^ (b * _B + salt)
    x ^= x >> np.uint64(32)
    x *= _C
    return x ^ (x >> np.uint64(29))


def word_names(words: list[bytes]) -> np.ndarray:
    """A 64-bit name of each word."""
    new = set(words).difference(_memo)
    if len(_memo) + len(new) > MEMO:
        _memo.clear()
        new = set(words)
    _memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def second_names(words: list[bytes]) -> np.ndarray:
    """Other 64 bits of each word's name."""
    known = {w: xxhash.xxh3_64_intdigest(w, 1) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def pieces(texts: list[list[bytes]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Texts' words in chunks: (text, place of its first word in that text, bounds in the chunk) of
    each piece, and the words. Pieces of one text overlap by width - 1 words, so that each
    window is in one piece."""
    held: list[tuple[int, int, list[bytes]]] = []
    size = 0
    for k, words in enumerate(texts):
        for at in range(0, max(1, len(words) - width + 1), CHUNK):
            part = words[at : at + CHUNK + width - 1] if len(words) > CHUNK else words
            if len(part) >= width:
                held.append((k, at, part))
                size += len(part)
            if size >= CHUNK:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, int, list[bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    bounds = np.concatenate(([0], np.cumsum([len(p) for _, _, p in held])))
    return np.array([k for k, _, _ in held]), np.array([at for _, at, _ in held]), bounds, [w for _, _, p in held for w in p]


class Parse:
    """The symbols of a chunk's pieces and the cores of all their windows, round by round."""

    def __init__(self, lanes: list[np.ndarray], bounds: np.ndarray, width: int) -> None:
        n = len(lanes[0])
        #: Names, the first lane of which decides; where symbols start; how many words they have; whether a piece starts there.
        self.lanes, self.start, self.length = lanes, np.arange(n), np.ones(n, np.int64)
        self.first = np.zeros(n, bool)
        self.first[bounds[:-1]] = True
        count = np.diff(bounds) - width + 1
        #: The windows' pieces and places in the chunk; those that have a core; the first and last symbol of it.
        self.piece = np.repeat(np.arange(len(count)), count)
        self.window = np.arange(count.sum()) + np.repeat(bounds[:-1] - np.cumsum(count) + count, count)
        self.live = np.arange(len(self.window))
        self.low, self.high = self.window.copy(), self.window + width - 1
        self.round = 0

    def _drop(self, gone: np.ndarray) -> None:
        self.live, self.low, self.high = self.live[~gone], self.low[~gone], self.high[~gone]

    def _merge(self, keep: np.ndarray, named) -> None:
        """Join each symbol that isn't kept to the one before; ``named(lane, first ones, sizes)`` names all."""
        index = np.flatnonzero(keep)
        sizes = np.diff(np.append(index, len(keep)))
        self.lanes = [np.where(sizes > 1, named(x, index, sizes), x[index]) for x in self.lanes]
        self.length, self.start, self.first = np.add.reduceat(self.length, index), self.start[index], self.first[index]
        at = np.cumsum(keep) - 1
        self.low, self.high = at[self.low], at[self.high]

    def runs(self, ended, popped=None) -> None:
        """Name runs; ``ended(windows, low, high, lanes)``: those whose core is one run, ``popped(windows, low, high, left,
        right, lanes)``: the others, with the numbers of symbols that they lose on both sides."""
        name, m = self.lanes[0], len(self.lanes[0])
        same = np.zeros(m + 1, bool)
        same[1:m] = (name[1:] == name[:-1]) & ~self.first[1:]
        each = np.arange(m)
        begin = np.maximum.accumulate(np.where(same[:m], 0, each))
        end = np.minimum.accumulate(np.where(same[1:], m, each)[::-1])[::-1]
        gone = end[self.low] >= self.high
        ended(self.live[gone], self.low[gone], self.high[gone])
        self._drop(gone)
        low, high = end[self.low], begin[self.high]
        if popped:
            popped(self.live, self.low, self.high, low - self.low, self.high - high)
        self.low, self.high = low, high
        inner = same[:m] & same[1:]
        keep = np.ones(m, bool)
        keep[1:] = ~(inner[1:] & inner[:-1])
        if not keep.all():
            self._merge(keep, lambda x, at, sizes: mix(x[at], sizes.astype(np.uint64), _RUN))

    def pairs(self, ended, popped=None) -> None:
        """Name pairs, and pop what may pair with something outside."""
        name, m = self.lanes[0], len(self.lanes[0])
        left = (name >> np.uint64(self.round % 64)) & np.uint64(1) == 1
        lose_low, lose_high = ~left[self.low], left[self.high]
        gone = (self.low + 1 == self.high) & lose_low & lose_high
        ended(self.live[gone], self.low[gone], self.high[gone])
        if popped:
            popped(self.live[~gone], self.low[~gone], self.high[~gone], lose_low[~gone].astype(np.int64), lose_high[~gone].astype(np.int64))
        lose_low, lose_high = lose_low[~gone], lose_high[~gone]
        self._drop(gone)
        self.low, self.high = self.low + lose_low, self.high - lose_high
        keep = np.ones(m, bool)
        keep[1:] = ~(left[:-1] & ~left[1:] & ~self.first[1:])
        self._merge(keep, lambda x, at, sizes: mix(x[at], x[np.minimum(at + 1, m - 1)], _PAIR))
        self.round += 1

    def salt(self, kind: np.uint64) -> np.uint64:
        return kind + np.uint64(self.round)


def keys(words: list[bytes], bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, place in it, key, place of the key's symbols in the chunk) of every window: the least digest of
    neighbouring symbols in its core after the rounds, or of the last core before that if there were fewer.
    Equal windows have equal keys."""
    parse = Parse([word_names(words)], bounds, width)
    key, where = np.zeros(len(parse.window), np.uint64), np.zeros(len(parse.window), np.int64)

    def ended(windows: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        name = parse.lanes[0]
        key[windows], where[windows] = mix(mix(name[low], name[high], _END), (high - low).astype(np.uint64), parse.salt(_KEY)), parse.start[low]

    for _ in range(ROUNDS):
        parse.runs(ended)
        parse.pairs(ended)
    name, m = parse.lanes[0], len(parse.lanes[0])
    few = parse.high - parse.low + 1 < NEIGHBOURS
    ended(parse.live[few], parse.low[few], parse.high[few])
    parse._drop(few)
    digest = name.copy()
    for k in range(1, NEIGHBOURS):
        digest[: m - k] = mix(digest[: m - k], name[k:], parse.salt(_KEY))
    # The least digest of any range, from those of ranges of 1, 2, 4, ... symbols.
    low, span = parse.low, parse.high - parse.low - NEIGHBOURS + 2
    levels = np.frexp(span)[1] - 1
    least, places = [digest], [np.arange(m)]
    for k in range(int(levels.max(initial=0))):
        x, at, step = least[-1], places[-1], min(1 << k, m)
        y, to = np.append(x[step:], x[m - step :]), np.append(at[step:], at[m - step :])
        least.append(np.where(x <= y, x, y))
        places.append(np.where(x <= y, at, to))
    least, places = np.stack(least), np.stack(places)
    other = low + span - (1 << levels)
    one, two = least[levels, low], least[levels, other]
    key[parse.live] = np.where(one <= two, one, two)
    where[parse.live] = parse.start[np.where(one <= two, places[levels, low], places[levels, other])]
    return parse.piece, parse.window - bounds[parse.piece], key, where


def window_names(words: list[bytes], bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, place in it, 128 bits of its name) of every window: a digest of all that is popped from
    it until its core is one run or two symbols, and of those."""
    parse = Parse([word_names(words), second_names(words)], bounds, width)
    n = len(parse.window)
    sides, made = np.zeros((2, 2, n), np.uint64), np.zeros((2, n), np.uint64)  # left and right of each lane

    def ended(windows: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        for k, name in enumerate(parse.lanes):
            core = mix(mix(name[low], name[high], _END), (high - low).astype(np.uint64), parse.salt(_LANE))
            made[k, windows] = mix(mix(sides[k, 0, windows], sides[k, 1, windows], _END), core, parse.salt(_KEY))

    def popped(windows: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        for side, at, lost in ((0, low, left), (1, high, right)):
            some = np.flatnonzero(lost)
            for k, name in enumerate(parse.lanes):
                what = mix(name[at[some]], lost[some].astype(np.uint64), parse.salt(_POP))
                sides[k, side, windows[some]] = mix(sides[k, side, windows[some]], what, parse.salt(_POP))

    while len(parse.live):
        parse.runs(ended, popped)
        parse.pairs(ended, popped)
    return parse.piece, parse.window - bounds[parse.piece], made[0], made[1]
