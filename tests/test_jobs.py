"""Saved models, the functional API, the puzzle job and principal components of errors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoply import api, models
from chronoply.operators import metrics
from chronoply.sources import games
from chronoply.spec import LogSpec

SPEC = LogSpec("c", "e", "t", "i")


def _log(spark):
    rows = spark.range(300).selectExpr("id AS i", "id DIV 6 AS c", "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'z' END AS e", "timestamp_seconds(id * 10) AS t", "CAST(id % 7 AS DOUBLE) AS value")
    return rows


def test_model_is_saved_and_loaded(spark, tmp_path):
    log = _log(spark)
    made = api.fit(log, SPEC, mode="time_decay_status", numeric=("value",))
    api.save(made, str(tmp_path / "m"))
    back = api.load(str(tmp_path / "m"))
    assert back.config == made.config and back.spec.case == "c" and back.bounds == made.bounds
    assert api.predict(back, log).select("i", "pred", "proba").orderBy("i").collect() == api.predict(made, log).select("i", "pred", "proba").orderBy("i").collect()
    assert api.evaluate(back, log) == api.evaluate(made, log)
    assert api.evaluate(back, log)["accuracy"] > 0.8
    with pytest.raises(RuntimeError):
        models.ChainClassifier(SPEC).save(str(tmp_path / "n"))


def test_puzzle_job(spark, tmp_path):
    rows = [(f"p{k:03}", f"mateIn{1 + k % 7} short" if k % 5 else None) for k in range(200)] + [("p001", "mateIn2 short")]
    got = games.puzzle_splits(spark.createDataFrame(rows, "PuzzleId string, Themes string"), 1, 5)
    want = sorted(k for k, t in rows if t and int(t[6]) <= 5)
    assert sorted(r.PuzzleId for r in got.collect()) == want
    assert got.where("mate_n NOT BETWEEN 1 AND 5").count() == 0
    n = len(set(want))
    sizes = {r.split: r.n for r in got.groupBy("split").agg(F.countDistinct("PuzzleId").alias("n")).collect()}
    assert sizes == {"train": n * 8 // 10, "val": n * 9 // 10 - n * 8 // 10, "test": n - n * 9 // 10}
    games.write_splits(got, str(tmp_path / "s"))
    assert games.read_split(spark, str(tmp_path / "s"), "test").count() == got.where("split = 'test'").count()
    assert games.puzzle_splits(spark.createDataFrame(rows, "PuzzleId string, Themes string"), 1, 5, most=20).count() == 20


def test_played_best(spark):
    df = spark.createDataFrame([("e4", "e4"), ("e4", "d4"), (None, "d4"), (None, None)], "played string, best string")
    assert [tuple(r) for r in games.with_played_best(df, "played", "best").collect()] == [("e4", "e4")]
    assert tuple(games.played_best_counts(df, "played", "best").first()) == (1, 3)


def test_error_components(spark):
    x = np.random.default_rng(3).normal(size=(60, 4)) * [5, 3, 1, 0.1]
    rows = [(k, k % 2, 0 if k % 3 else None, x[k].tolist()) for k in range(60)]
    got = metrics.error_components(spark.createDataFrame(rows, "i int, label int, pred int, v array<double>"), "label", "pred", "v").collect()
    wrong = [k for k, label, pred, _ in rows if label != pred]
    assert sorted(r.i for r in got) == wrong
    part = x[wrong]
    _, axes = np.linalg.eigh(np.cov(part.T))
    for r in got:
        assert np.allclose(np.abs(r.components), np.abs(x[r.i] @ axes[:, ::-1][:, :2]), atol=1e-6)
    same = spark.createDataFrame([(1, 1, [0.5])], "label int, pred int, v array<double>")
    assert metrics.error_components(same, "label", "pred", "v").count() == 0
