"""Whitening against the same in plain NumPy and Python's whole numbers."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from chronoply.llm import queries, whitening
from test_queries import SF

SCHEMA = "vec_id long, embedding array<double>, n long, state string, vector array<int>"


def brute(pairs: list[tuple], components: int = 8):
    """By vec_id: n, the exact deviation, whitened up to sign; shares of variance."""
    good = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in pairs if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(good), [sum(x) for x in zip(*(v for _, v in good), strict=True)]
    centred = {i: [n * c - s for c, s in zip(v, sums, strict=True)] for i, v in good}
    y = np.array(list(centred.values()), float) / n
    e, axes = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(e)[::-1][:components]
    return n, {i: sum(c * c for c in v) for i, v in centred.items()}, dict(zip(centred, y @ axes[:, order] / np.sqrt(e[order]), strict=True)), e[order] / e.sum()


def agrees(got: list, pairs: list[tuple]) -> None:
    n, deviation, white, shares = brute(pairs)
    assert len(got) == n * len(shares) and {r.n for r in got} == {n}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for k, share in enumerate(shares):
        own = {r.vec_id: r for r in got if r.component == k + 1}
        ids = sorted(own)
        a, b = np.array([own[i].whitened for i in ids]), np.array([white[i][k] for i in ids])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
        assert all(r.explained == pytest.approx(share, rel=1e-9) for r in own.values())


def test_query(spark):
    pairs = duckdb.execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    agrees(queries.op12_whiten(spark, SF).collect(), pairs)


def test_odd_vectors_and_names(spark):
    rng = np.random.default_rng(5)
    pairs = [(k, (rng.normal(size=10) * np.arange(1, 11)).tolist()) for k in range(300)]
    odd = [(900, None), (901, []), (902, [None] * 10), (903, [float("nan")] * 10), (904, [1.0] * 9 + [float("-inf")]), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x", None) for i, v in pairs + odd], SCHEMA).repartition(7)
    agrees(whitening.whiten(df).collect(), pairs)


def test_repeats_flat_and_empty(spark):
    make = lambda rows: spark.createDataFrame([(i, v, None, None, None) for i, v in rows], SCHEMA)
    got = whitening.whiten(make([(1, [0.0, 5.0]), (1, [0.0, 5.0]), (None, [4.0, 5.0]), (None, [4.0, 5.0])])).collect()
    assert len(got) == 4 and {r.component for r in got} == {1} and sorted(round(abs(r.whitened), 9) for r in got) == [1.0] * 4 and got[0].explained == 1
    for rows in ([], [(1, None)], [(1, [3.0, 3.0]), (2, [3.0, 3.0])]):
        none = whitening.whiten(make(rows))
        assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_exact_beyond_64_bits(spark):
    """Sums and deviations stay exact; a deviation that a long can't hold is null."""
    huge = spark.createDataFrame([(k, [float(k) * 2.0**44, 1.0]) for k in range(200)], "vec_id long, embedding array<double>")
    got = whitening.whiten(huge).where("component = 1").collect()
    assert [r.deviation for r in got] == [None] * 200
    assert got[0].identity_error < 1e-9
    assert whitening._squares(np.array([[3 << 30, 4 << 30]])) == [None] and whitening._squares(np.array([[3 << 28, 4 << 28]])) == [25 << 56]


def test_a_large_dimension_is_refused(spark):
    df = spark.createDataFrame([(1, [1.0] * 5)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="more than 4"):
        whitening.whiten(df, max_dim=4)
