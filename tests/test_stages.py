"""Encoder, classifiers and context tree as ML stages: pipelines, folds, saved models, attention."""

from __future__ import annotations

import math
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from chronoply import api, stages
from chronoply.encoder import LogEncoder, LogEncoderModel
from chronoply.operators import graphs
from chronoply.prefix import PrefixTree, PrefixTreeModel
from chronoply.spec import LogSpec

SPEC = LogSpec("c", "e", "t", "i")
NAMES = {"case": "c", "time": "t", "tie": "i"}


@pytest.fixture(scope="module")
def log(spark):
    """What comes next is told by the event two before."""
    rows = []
    for c in range(40):
        kinds = ["abz"[c // 3**k % 3] for k in range(3)]
        for k in range(3, 14):
            kinds.append({"a": "z", "b": "a", "z": "b"}[kinds[k - 3]])
        rows += [(c * 100 + k, c, e, c * 1000 + k * 7 + k * k % 5, float(k % 4), "red" if c % 3 else "blue") for k, e in enumerate(kinds)]
    df = spark.createDataFrame(rows, "i int, c int, e string, s long, value double, kind_of_case string")
    return df.withColumn("t", F.timestamp_seconds("s")).drop("s").cache()


def test_hops_against_a_loop(spark, log):
    weight = F.when(F.col("value") > 0, 0.5 * F.col("value"))
    got = graphs.hop_messages(log, SPEC, "value", weight, 3).orderBy("i").collect()
    arrays = graphs.hop_messages(log.withColumn("v", F.array("value", F.lit(1.0))), SPEC, "v", weight, 2).orderBy("i").collect()
    state: dict = {}
    for r, a in zip(got, arrays, strict=True):
        before = state.get(r.c)  # of the event before: its value and messages
        w = 0.5 * r.value if r.value > 0 else 0.0
        want = [w * x for x in before[:3]] if before else [0.0] * 3
        assert [r.hop_1, r.hop_2, r.hop_3] == pytest.approx(want)
        assert [list(x) for x in (a.hop_1, a.hop_2)] == [[] if not before else [pytest.approx(want[0]), pytest.approx(w)], [] if not before or before[3] is None else [pytest.approx(want[1]), pytest.approx(w * before[3])]]
        state[r.c] = (r.value, *want[:2], w if before else None)
    plan = graphs.hop_messages(log, SPEC, "value", weight, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_kind_weights(spark):
    df = spark.createDataFrame([("p", "x")] * 4 + [("q", "x"), ("q", "y")] + [("r", "y")] * 2 + [(None, "x"), ("p", None)], "k string, y string")
    got = dict(graphs.kind_weights(df, "k", "y").collect())
    whole = -(5 / 8 * math.log(5 / 8) + 3 / 8 * math.log(3 / 8))
    assert got == {"p": 1.0, "q": pytest.approx(max(0.0, 1 - math.log(2) / whole)), "r": 1.0}
    assert dict(graphs.kind_weights(df.where("y = 'x'"), "k", "y").collect()) == {"p": 0.0, "q": 0.0}


def test_more_hops_tell_more(spark, log):
    accuracy = {}
    for hops in (1, 2):
        accuracy[hops] = api.EventPipeline(SPEC, hops=hops, maxIter=30).fit(log).evaluate(log)["accuracy"]
    assert accuracy[2] > 0.8 > accuracy[1] + 0.1
    for mode in stages.MODES:
        assert api.EventPipeline(SPEC, mode=mode, hops=2, maxIter=10, encoder={"numbers": ["value"]}).fit(log).evaluate(log)["accuracy"] > 0.4


def test_pipeline_is_saved_and_loaded_elsewhere(spark, log, tmp_path):
    made = api.EventPipeline(SPEC, hops=2, mode="time_decay_status", maxIter=15, encoder={"numbers": ["value"], "caseCategories": ["kind_of_case"], "caseNumbers": ["value"], "medians": True}).fit(log)
    path = str(tmp_path / "m")
    made.save(path)
    made.save(path)  # over the one before
    want = {r.i: (r.pred, [round(p, 9) for p in r.probability]) for r in made.predict(log).collect()}
    back = api.EventPipeline.load(path)
    assert {r.i: (r.pred, [round(p, 9) for p in r.probability]) for r in back.predict(log).collect()} == want
    assert back.classifier.getOrDefault("hops") == 2 and back.encoder.getOrDefault("numbers") == ["value"]
    log.write.parquet(str(tmp_path / "log"))
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from pyspark.ml import PipelineModel
got = PipelineModel.load({path!r}).transform(spark.read.parquet({str(tmp_path / "log")!r})).select("i", "prediction").collect()
print("PREDICTED", sorted((r.i, int(r.prediction)) for r in got))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200).stdout
    names = made.model.stages[0].learnt["events"]
    assert f"PREDICTED {sorted((i, names.index(p)) for i, (p, _) in want.items())}" in said
    estimator = made.build()
    estimator.save(str(tmp_path / "e"))
    again = Pipeline.load(str(tmp_path / "e")).getStages()
    assert again[0].getOrDefault("caseNumbers") == ["value"] and again[1].getOrDefault("mode") == "time_decay_status"


def test_folds_keep_cases_whole(spark, log):
    folds = stages.with_folds(log, "c", 3)
    assert folds.groupBy("c").agg(F.countDistinct("fold").alias("n")).where("n <> 1").count() == 0 and folds.select("fold").distinct().count() == 3
    made = api.EventPipeline(SPEC, maxIter=15)
    assert made.tune(log, {"hops": [1, 2], "decay": [0.01]}, folds=3) == {"hops": 2, "decay": 0.01}
    assert made.model.stages[1].getOrDefault("hops") == 2 and made.evaluate(log)["accuracy"] > 0.8


def test_errors(spark, log):
    with pytest.raises(RuntimeError):
        api.EventPipeline(SPEC).predict(log)
    with pytest.raises(TypeError):
        api.EventPipeline(SPEC, other=1)
    for bad, text in (({"mode": "other"}, "Unknown mode"), ({"mostFeatures": 3}, "more than 3")):
        with pytest.raises(ValueError, match=text):
            api.EventPipeline(SPEC, **bad).fit(log)
    with pytest.raises(ValueError, match="no labelled"):
        api.EventPipeline(SPEC).fit(log.limit(0))


def test_attention_of_a_fitted_model(spark, log):
    """Scores of edges from the model's own coefficients."""
    made = api.EventPipeline(SPEC, hops=2, mode="time_decay", maxIter=15).fit(log)
    coded = made.model.stages[0].transform(log)
    model = made.model.stages[1]
    got = {r.i: r for r in model.edge_scores(coded).collect()}
    matrix, width = model.parts["regression"].coefficientMatrix.toArray(), model.learnt["width"]
    rows = sorted(model._told(coded).collect(), key=lambda r: r.i)
    scores: dict = {}
    for r in rows:
        if len(r["__hop_1"]):
            scores.setdefault(r.c, {})[r.i] = float(np.array(r["__x"])[width:] @ matrix[int(r["__told"])][width:])
    assert set(got) == {i for own in scores.values() for i in own} and len(got) == 40 * 13
    for own in scores.values():
        top = max(own.values())
        total = sum(math.exp(x - top) for x in own.values())
        assert all(got[i].score == pytest.approx(x) and got[i].importance == pytest.approx(math.exp(x - top) / total) for i, x in own.items())


def test_case_features(spark, log):
    made = LogEncoder(**NAMES, event="e", caseCategories=["kind_of_case"], caseNumbers=["value"]).fit(log.withColumn("value", F.col("c").cast("double")))
    got = {tuple(r.case_features) for r in made.transform(log.withColumn("value", F.col("c").cast("double"))).where("c IN (0, 39)").collect()}
    assert got == {(1.0, 0.0, 0.0), (1.0, 0.0, 1.0)} and "__case_value" not in made.transform(log).columns
    window = made.windows(log, 3).first()
    assert len(window.case_features) == 3 and len(window.window) == 3


def tree(rows, depth, least):
    """The context tree in plain Python: share of each label after a context, mixed with the shorter one's."""
    counts: dict = {}
    for w, y in rows:
        back = tuple(reversed(w))[:depth]
        for k in range(len(back) + 1):
            counts.setdefault(back[:k], Counter())[y] += 1
    labels = sorted({y for _, y in rows})

    def share(context, y):
        c = counts[context]
        n = sum(c.values())
        return c[y] / n if not context else (c[y] + len(c) * share(context[:-1], y)) / (n + len(c))

    def told(w):
        back = tuple(reversed(w))[:depth]
        known = max((k for k in range(len(back) + 1) if sum(counts.get(back[:k], Counter()).values()) >= least), default=0)
        best = max(labels, key=lambda y: (share(back[:known], y), -y))
        return best, share(back[:known], best), known

    return told


def test_context_tree(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [([int(x) for x in rng.integers(0, 4, rng.integers(0, 5))], int(y)) for y in rng.choice(4, 400, p=[0.1, 0.2, 0.3, 0.4])]
    schema = "k int, window array<struct<label:int,gap:double>>, target int"
    df = spark.createDataFrame([(k, [(x, 0.0) for x in w], y) for k, (w, y) in enumerate(rows)] + [(999, None, 1)], schema).repartition(4)
    for depth, least in ((0, 1), (2, 1), (3, 5)):
        model = PrefixTree(depth=depth, least=least).fit(df)
        want = tree(rows, depth, least)
        got = {r.k: r for r in model.transform(df).collect()}
        for k, (w, _) in enumerate(rows):
            y, p, size = want(w)
            assert (got[k].prediction, got[k].context_size) == (y, size) and got[k].share == pytest.approx(p)
        assert (got[999].prediction, got[999].context_size) == (want([])[0], 0)
    model.save(str(tmp_path / "t"))
    back = PrefixTreeModel.load(str(tmp_path / "t"))
    assert back.transform(df).select("k", "prediction", "share").orderBy("k").collect() == model.transform(df).select("k", "prediction", "share").orderBy("k").collect()
    empty = PrefixTree().fit(df.limit(0)).transform(df.limit(3))
    assert {r.prediction for r in empty.collect()} == {None}


def test_encoder_in_a_pipeline(spark, log, tmp_path):
    made = Pipeline(stages=[LogEncoder(**NAMES, event="e", numbers=["value"])]).fit(log)
    made.save(str(tmp_path / "p"))
    back = PipelineModel.load(str(tmp_path / "p"))
    assert isinstance(back.stages[0], LogEncoderModel) and back.stages[0].learnt == made.stages[0].learnt and back.stages[0].uid == made.stages[0].uid


def test_table_of_cases(spark, log):
    """A row for each case: first known values, unseen categories as zeros, missing numbers as -1."""
    numbered = log.withColumn("value", F.col("c").cast("double"))
    made = LogEncoder(**NAMES, event="e", caseCategories=["kind_of_case"], caseNumbers=["value"]).fit(numbered.where("kind_of_case = 'red'"))
    got = {r.c: list(r.case_features) for r in made.cases(numbered.withColumn("value", F.when(F.col("c") == 2, -1.0).otherwise(F.col("value")))).collect()}
    assert len(got) == 40 and got[2] == [1.0, -1.0] and got[0][0] == 0.0
    assert all(x[1] == pytest.approx((c - 1) / 37) for c, x in got.items() if c != 2)  # red cases are 1 to 38
    assert LogEncoder(**NAMES, event="e").fit(log).cases(log).where(F.size("case_features") > 0).count() == 0


def test_hops_share_a_window(spark):
    """All hops are told by one window; arrays' messages multiply in the order of the steps, and are empty without an event before."""
    rows = [(0, k, [float(k + 1), 0.5], [0.1, 0.7, 0.3, None, 0.9][k]) for k in range(5)] + [(1, 0, None, 0.2), (1, 1, [3.0], 0.4)]
    df = spark.createDataFrame(rows, "c int, i int, v array<double>, w double")
    made = graphs.hop_messages(df, LogSpec("c", "i", "i", "i"), "v", F.col("w"), 3)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    for case in (0, 1):
        own = sorted((r for r in made.collect() if r.c == case), key=lambda r: r.i)
        last = [r.v for r in own]
        for k in range(1, 4):
            last = [[], *([x * (own[n + 1].w or 0.0) for x in (before or [])] for n, before in enumerate(last[:-1]))]
            assert [r[f"hop_{k}"] for r in own] == last
