"""Recompression and removal of repeated windows against plain Python and SQL."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoply.llm import queries, recompression, substrings
from test_queries import SF


def brute(rows: list[tuple], width: int = 20) -> Counter:
    """(doc_id, words, words removed, kept text) of each row; rows of one id are in no order but where they are equal."""
    seen: set[tuple] = set()
    out = Counter()
    for key in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (key[1] or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if g in seen:
                gone[k : k + width] = [True] * width
            seen.add(g)
        out[key[0], len(w), sum(gone), b" ".join(x for x, y in zip(w, gone, strict=True) if not y).decode()] += rows.count(key)
    return out


def result(df) -> Counter:
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


def make(spark, rows):
    return spark.createDataFrame([(d, t, "?", None, 1) for d, t in rows], "doc_id long, text string, kept string, key string, t0 int").repartition(5)


def test_query(spark):
    assert not oracle.differs(spark, oracle.connection(SF), queries.op11_repeats, queries.oracle_sql()["op11_repeats"], SF)


@pytest.mark.parametrize("width", [20, 5, 1])
def test_odd_documents(spark, width):
    rng = random.Random(width)
    words = lambda n, of=50: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    passage, same = words(60, 10_000), "x " * 300
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, words(19)), (5, passage)] + [(6, f"{words(30)}\n{passage}\t{words(30)}")] * 2
    rows += [(7, same), (8, same + "y " * 100), (9, "a b " * 90), (10, "b a b " * 60), (11, passage.replace("w", "W")), (12, words(3_000, 3)), (13, words(50) + "\xa0é漢字 \x00 " + passage[:200])]
    rows += [(20 + k, f"{passage} {words(20)}") for k in range(200)] + [(None, passage), (-5, passage[:150])]
    got = substrings.remove_repeats(make(spark, rows), width=width)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"] and result(got) == brute(rows, width)


def test_rows_of_one_id(spark):
    """Equal rows are one document; of other texts with one id, one is before the other."""
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    got = result(substrings.remove_repeats(make(spark, [(1, a), (1, a), (1, f"{a} {b}"), (2, b)])))
    assert got[1, 40, 0, a] + got[1, 80, 40, b] == 3 or got[1, 40, 40, ""] + got[1, 80, 0, f"{a} {b}"] == 3
    assert got[2, 40, 40, ""] == 1


def test_no_documents(spark):
    assert substrings.remove_repeats(make(spark, []).where(F.lit(False))).count() == 0


def windows(texts: list[list[bytes]], of, width: int) -> list[tuple]:
    """(window's words, what ``of`` tells of it) of all windows."""
    out = []
    for docs, at, bounds, flat in recompression.pieces(texts, width):
        piece, place, *told = of(flat, bounds, width)
        for k in range(len(piece)):
            own = texts[docs[piece[k]]][at[piece[k]] + place[k] :][:width]
            out.append((tuple(own), tuple(int(t[k]) for t in told[:2])))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=90), min_size=1, max_size=6), st.integers(1, 24))
def test_equal_windows_have_equal_symbols_and_names(texts, width):
    want = Counter(tuple(t[k : k + width]) for t in texts for k in range(len(t) - width + 1))
    keys = windows(texts, lambda *a: (*(x := recompression.keys(*a))[:2], x[2]), width)
    names = windows(texts, recompression.window_names, width)
    for found in (keys, names):
        assert Counter(w for w, _ in found) == want
        assert all(len({t for x, t in found if x == w}) == 1 for w in want)
    assert len({t for _, t in names}) == len(want)


def test_long_texts_are_parsed_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    text = [b"%d" % k for k in rng.integers(0, 4, 3_000)]
    whole = dict(windows([text], recompression.window_names, 20))
    monkeypatch.setattr(recompression, "CHUNK", 100)
    assert Counter(windows([text, text[:500]], recompression.window_names, 20)) == Counter((tuple(t[k : k + 20]), whole[tuple(t[k : k + 20])]) for t in (text, text[:500]) for k in range(len(t) - 19))
