"""Recipes on a log whose next events follow from the ones before."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoply import recipes
from chronoply.operators import attention
from chronoply.spec import LogSpec

SPEC = LogSpec("c", "e", "t", "i")


@pytest.fixture(scope="module")
def log(spark):
    rows = spark.range(600).selectExpr("id AS i", "id DIV 10 AS c", "CASE (id + id DIV 10) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'z' END AS e", "timestamp_seconds(id * 10) AS t", "CAST(id % 7 AS DOUBLE) AS value")
    odd = spark.sql("SELECT 9000L AS i, 900L AS c, 'never seen' AS e, timestamp_seconds(1) AS t, 0D AS value")
    return rows.union(odd).cache()


def test_every_recipe(spark, log, tmp_path):
    for name in recipes.RECIPES:
        quick = {} if name == "prefix" else {"maxIter": 10}
        model, figures = recipes.train(log, SPEC, name, test_size=0.3, **quick)
        assert figures["accuracy"] > 0.85 and 0 < figures["f1"] <= 1 and figures["n"] > 0, name
        model.save(str(tmp_path / name))
    with pytest.raises(KeyError, match="No recipe other"):
        recipes.train(log, SPEC, "other")
    with pytest.raises(ValueError, match="Unknown config fields"):
        recipes.train(log, SPEC, "prefix", hops=2)


def test_parts_keep_cases_whole(log):
    train, test = recipes.parts(log, SPEC, 0.5, 7)
    assert train.join(test, "c").count() == 0
    known = {r.e for r in train.select("e").distinct().collect()}
    assert {r.e for r in test.select("e").distinct().collect()} <= known
    assert train.groupBy("c").count().where("count NOT IN (1, 10)").count() == 0


def test_heads(spark):
    df = spark.createDataFrame([([0.2, 0.4], [0.5, 1.0]), ([0.6], None), (None, [1.0])], "alpha array<double>, decay array<double>")
    alpha, decay = attention.over_heads(F.col("alpha")), attention.decay_or_one(F.col("decay"))
    got = [tuple(x if x is None else round(x, 6) for x in r) for r in df.select(alpha, decay).collect()]
    assert got == [(0.3, 0.75), (0.6, 1.0), (None, 1.0)]
