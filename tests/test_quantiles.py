"""Exact quantiles against NumPy, with ties, infinities and wrong sketches."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoply.operators import quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.731, 0.75, 0.999, 1.0]
ROWS = 30_000


def values() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    return {
        "plain": rng.normal(size=ROWS), "ties": rng.integers(0, 7, ROWS).astype(float), "one": np.full(ROWS, 2.5), "edge": np.where(np.arange(ROWS) < ROWS // 2, 1.0, 2.0),
        "wide": rng.normal(size=ROWS) ** 9, "ends": np.concatenate([np.full(ROWS // 3, -math.inf), rng.normal(size=ROWS // 3), np.full(ROWS // 3, math.inf)]), "few": rng.normal(size=30), "single": np.array([7.0]),
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(g, float(x)) for g, xs in values().items() for x in xs] + [("few", None), ("few", math.nan), ("none", None), (None, 3.0), (None, 5.0)]
    return spark.createDataFrame(rows, "g string, x double").repartition(6).cache()


def want(xs: np.ndarray, share: float) -> float:
    s, place = np.sort(xs), share * (len(xs) - 1)
    low, high = s[math.floor(place)], s[math.ceil(place)]
    return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high


@pytest.mark.parametrize("most", [50_000, 500, 3])
def test_groups(table, most):
    got = {r.g: r for r in quantiles.quantiles(table, "x", SHARES, ["g"], most=most).collect()}
    assert set(got) == {*values(), "none", None} and got["none"].quantiles == [None] * len(SHARES) and got["none"].n == 0
    assert got["few"].n == 30 and got[None].quantiles[3] == 4.0
    for g, xs in values().items():
        assert got[g].quantiles == [pytest.approx(want(xs, s), abs=1e-12) for s in SHARES], g


def test_wrong_sketches(spark, table, monkeypatch):
    """A sketch's bracket beside the rank costs passes, not the result."""
    monkeypatch.setattr(quantiles, "_near", lambda steps, share: (steps[200], steps[210]))
    got = quantiles.quantiles(table.where("g = 'wide'"), "x", [0.3, 0.5, 0.9], most=1_000).first()
    assert got.quantiles == [pytest.approx(want(values()["wide"], s)) for s in (0.3, 0.5, 0.9)]


def test_no_rows_and_whole_numbers(spark, table):
    assert quantiles.quantiles(table.limit(0), "x", [0.5]).collect()[0].quantiles == [None]
    assert quantiles.quantiles(table.limit(0), "x", [0.5], ["g"]).count() == 0
    assert quantiles.quantiles(spark.range(1_000_001).withColumn("id", F.col("id") * 3), "id", [0.25, 0.5]).first().quantiles == [750_000.0, 1_500_000.0]


def test_too_many_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "GROUPS", 5)
    with pytest.raises(ValueError, match="more than 5"):
        quantiles.quantiles(spark.range(9), "id", [0.5], ["id"])
