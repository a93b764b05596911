"""Event classifiers as Spark ML stages: encoder and classifier in one pipeline, and case-wise folds.

    Pipeline(stages=[LogEncoder(...), HopClassifier(case=..., hops=2)])

The classifier takes what ``LogEncoderModel`` adds. An event's block of features is its label, its
own and its case's features; messages of several hops bring the blocks of the events before,
weighted by time and by how much the kind of transition tells. Spark ML's multinomial regression
is fitted on blocks and messages.
"""

from __future__ import annotations

from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import graphs
from .persistence import Learnt
from .spec import LogSpec

MODES = ("basic", "time_decay", "status", "time_decay_status")


class _HopParams(Params):
    case = Param(Params._dummy(), "case", "column of the case", TypeConverters.toString)
    time = Param(Params._dummy(), "time", "column of the time", TypeConverters.toString)
    tie = Param(Params._dummy(), "tie", "column that orders events of one time", TypeConverters.toString)
    mode = Param(Params._dummy(), "mode", f"one of {', '.join(MODES)}", TypeConverters.toString)
    hops = Param(Params._dummy(), "hops", "events before that send messages", TypeConverters.toInt)
    decay = Param(Params._dummy(), "decay", "of a message in a second", TypeConverters.toFloat)
    labelCol = Param(Params._dummy(), "labelCol", "column of the label to tell, a whole number from 0", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "column of the prediction", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "column of the labels' shares", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "steps of the regression", TypeConverters.toInt)
    regParam = Param(Params._dummy(), "regParam", "ridge of the regression", TypeConverters.toFloat)
    mostFeatures = Param(Params._dummy(), "mostFeatures", "features that a row may have", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(case="case", time="time", tie="tie", mode="basic", hops=1, decay=0.01, labelCol="next_label", predictionCol="prediction", probabilityCol="probability", maxIter=50, regParam=1e-3, mostFeatures=20_000)

    def spec(self) -> LogSpec:
        return LogSpec(self.getOrDefault("case"), "label", self.getOrDefault("time"), self.getOrDefault("tie"))

    def blocks(self, rows: DataFrame, learnt: dict[str, Any]) -> DataFrame:
        """Adds ``__hop_0`` (the event's own block), the messages ``__hop_1`` and so on, and ``__x``, all in one vector."""
        spec, hops, mode = self.spec(), self.getOrDefault("hops"), self.getOrDefault("mode")
        labels = F.transform(F.sequence(F.lit(0), F.lit(learnt["labels"] - 1)), lambda k: (k == F.col("label")).cast("double"))
        own = F.transform(F.concat(labels, "features", "case_features"), lambda x: F.coalesce(x, F.lit(0.0)))
        weight = F.lit(1.0)
        if mode.startswith("time_decay"):
            weight = weight * F.exp(-F.lit(self.getOrDefault("decay")) * S.seconds_between(F.col(spec.time), F.lag(spec.time).over(spec.ordered())))
        if mode.endswith("status"):
            told = F.array(*map(F.lit, learnt["weights"])) if learnt["weights"] else F.array().cast("array<double>")
            weight = weight * F.coalesce(F.get(told, F.lag("kind").over(spec.ordered())), F.lit(0.0))
        made = graphs.hop_messages(rows.withColumn("__hop_0", own), spec, "__hop_0", weight, hops, "__hop")
        # Without an event before, a message is as long as others and 0.
        zeros = F.array_repeat(F.lit(0.0), learnt["width"])
        sent = [F.when(F.size(f"__hop_{k}") == 0, zeros).otherwise(F.col(f"__hop_{k}")) for k in range(1, hops + 1)]
        return made.withColumn("__x", array_to_vector(F.concat("__hop_0", *sent)))


class HopClassifier(Estimator, _HopParams, DefaultParamsWritable, DefaultParamsReadable):
    @keyword_only
    def __init__(self, *, case: str = "case", time: str = "time", tie: str = "tie", mode: str = "basic", hops: int = 1, decay: float = 0.01, labelCol: str = "next_label", predictionCol: str = "prediction", probabilityCol: str = "probability", maxIter: int = 50, regParam: float = 1e-3, mostFeatures: int = 20_000) -> None:
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> HopModel:
        """Rows without a label are left out of the fit, not of the messages. An empty log is an error."""
        get = self.getOrDefault
        if get("mode") not in MODES:
            raise ValueError(f"Unknown mode: {get('mode')}")
        head = dataset.agg(F.max("label").alias("label"), F.max(get("labelCol")).alias("target"), F.max(F.size("features") + F.size("case_features")).alias("features"), F.max("kind").alias("kind")).first()
        if head.target is None:
            raise ValueError("no labelled events")
        learnt: dict[str, Any] = {"labels": head.label + 1, "width": head.label + 1 + head.features, "weights": []}
        if learnt["width"] * (get("hops") + 1) > get("mostFeatures"):
            raise ValueError(f"more than {get('mostFeatures')} features")
        if get("mode").endswith("status") and head.kind is not None:
            # Of an edge to this event, what follows is the event's own target.
            edges = dataset.withColumn("__in", F.lag("kind").over(self.spec().ordered()))
            told = dict(graphs.kind_weights(edges, "__in", get("labelCol")).collect())  # a row for each kind that the encoder knows
            learnt["weights"] = [told.get(k, 0.0) for k in range(head.kind + 1)]
        rows = self.blocks(dataset, learnt).where(F.col(get("labelCol")).isNotNull()).select("__x", F.col(get("labelCol")).cast("double").alias("__y"))
        fitted = LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__told", rawPredictionCol="__raw", probabilityCol="__shares", maxIter=get("maxIter"), regParam=get("regParam"), family="multinomial").fit(rows)
        return self._copyValues(HopModel(learnt, parts={"regression": fitted}))


class HopModel(Learnt, _HopParams):
    def __init__(self, learnt: dict[str, Any] | None = None, tables: dict[str, DataFrame] | None = None, parts: dict[str, Model] | None = None) -> None:
        super().__init__(learnt, tables, parts)
        self._defaults()

    def _told(self, dataset: DataFrame) -> DataFrame:
        """The rows with their blocks, ``__told`` (the likeliest label) and ``__shares`` (of all)."""
        return self.parts["regression"].transform(self.blocks(dataset, self.learnt))

    def _plain(self, rows: DataFrame) -> DataFrame:
        return rows.drop("__x", "__told", "__raw", "__shares", *(f"__hop_{k}" for k in range(self.getOrDefault("hops") + 1)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = self._told(dataset)
        return self._plain(told.withColumns({self.getOrDefault("predictionCol"): F.col("__told"), self.getOrDefault("probabilityCol"): vector_to_array("__shares")}))

    def edge_scores(self, dataset: DataFrame) -> DataFrame:
        """The events with ``score``, what the messages over the edge to each add to the score of the
        label that is told for it, and ``importance``, the score's share (softmax) in its case. A
        case's first event has no edge and no row."""
        spec, hops, width = self.spec(), self.getOrDefault("hops"), self.learnt["width"]
        matrix = self.parts["regression"].coefficientMatrix.toArray()
        # As many numbers as mostFeatures allows, times the labels; they are told once, not for each row.
        rows = [(k, row[width:].tolist()) for k, row in enumerate(matrix)]
        coefficients = F.broadcast(dataset.sparkSession.createDataFrame(rows, "__label int, __c array<double>"))
        sent = F.slice(vector_to_array("__x"), width + 1, width * hops)
        told = self._told(dataset).where(F.size("__hop_1") > 0).join(coefficients, F.col("__told") == F.col("__label"))
        score = F.aggregate(F.zip_with(sent, "__c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        made = graphs.grouped_softmax(told.withColumn("score", score), spec.case, "score")
        return self._plain(made.withColumn("importance", F.exp("log_prob")).drop("log_prob", "__c", "__label"))


def with_folds(log: DataFrame, case: str, folds: int, name: str = "fold", seed: int = 42) -> DataFrame:
    """Adds the number of a fold, for ``CrossValidator(foldCol=...)``: a seeded hash of the case, so that no
    case is in two folds and its windows and messages stay whole."""
    return log.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), F.col(case)), F.lit(folds)).cast("int"))


def label_name(labels: list[str], label: Column) -> Column:
    """The name of a label's number."""
    return F.get(F.array(*map(F.lit, labels)), label.cast("int"))
