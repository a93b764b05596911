"""Length-stratified splits of many cases of one length."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronoply.operators import splits


@pytest.mark.parametrize("bins", [1, 5])
def test_hot_length(spark, bins):
    """Two thirds of the cases have one length; the longest of each bin go to test, of equals the last ids."""
    df = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 17 + 1).otherwise(9).alias("n")).repartition(7)
    got = {r.id: (r.bin, r.split) for r in splits.length_stratified(df, "id", "n", 0.25, bins).collect()}
    groups = defaultdict(list)
    for r in df.collect():
        groups[min((r.n - 1) * bins // 17, bins - 1)].append((r.n, r.id))
    want = {}
    for b, cases in groups.items():
        for k, (_, i) in enumerate(sorted(cases, reverse=True)):
            want[i] = (b, "test" if k < max(1, len(cases) // 4) else "train")
    assert got == want


def test_odd_tables(spark):
    one = splits.length_stratified(spark.sql("SELECT 'a' AS c, 3 AS n, 'x' AS more"), "c", "n")
    assert [tuple(r) for r in one.select("c", "n", "more", "bin", "split").collect()] == [("a", 3, "x", 0, "test")]
    assert splits.length_stratified(spark.sql("SELECT 'a' AS c, 3 AS n").limit(0), "c", "n").count() == 0
