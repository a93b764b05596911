"""Next-event and outcome models: a name registry, the baseline and chain-message classifiers.

Spark-first: on a chain a graph layer is one hop from the event before, weighted by time decay
and by kind of transition. These messages are window expressions, and the classifier on them
is the multinomial regression of Spark ML, fitted by distributed passes over the rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .spec import LogSpec, with_overrides

_models: dict[str, Callable] = {}


def register(name: str) -> Callable:
    def add(make: Callable) -> Callable:
        _models[name] = make
        return make

    return add


def get(name: str) -> Callable:
    if name not in _models:
        raise KeyError(f"No model {name}; there are {available()}")
    return _models[name]


def available() -> list[str]:
    return sorted(_models)


@register("most_frequent")
@dataclass
class MostFrequent:
    """Predicts the commonest label; of equals, the first in order."""

    label: str = "label"
    value: object = None

    def fit(self, df: DataFrame) -> MostFrequent:
        top = df.groupBy(self.label).count().orderBy(F.desc("count"), self.label).first()
        return replace(self, value=top and top[0])

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("pred", F.lit(self.value))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.value,)], ["most_frequent"]).coalesce(1).write.mode("overwrite").json(path)

    def load(self, spark: SparkSession, path: str) -> MostFrequent:
        return replace(self, value=spark.read.json(path).first()[0])


@dataclass(frozen=True)
class ChainConfig:
    """mode: basic, time_decay, status or time_decay_status."""

    mode: str = "basic"
    numeric: tuple[str, ...] = ()
    status: str | None = None
    decay: float = 0.01
    max_iter: int = 50
    ridge: float = 1e-3
    most: int = 10_000


@register("chain")
class ChainClassifier:
    """Labels of events from their own features and the message of the event before."""

    def __init__(self, spec: LogSpec, config: ChainConfig | None = None, **overrides: object) -> None:
        self.spec, self.config = spec, with_overrides(config or ChainConfig(), **overrides)
        if self.config.mode not in ("basic", "time_decay", "status", "time_decay_status"):
            raise ValueError(f"Unknown mode: {self.config.mode}")
        self.labels: list[str] = []
        self.events: list[str] = []
        self.bounds: dict[str, tuple[float, float]] = {}
        self.model: LogisticRegressionModel | None = None

    def _features(self, log: DataFrame) -> DataFrame:
        s, c, w = self.spec, self.config, self.spec.ordered()
        own = [(F.col(s.event) == e).cast("double") for e in self.events]
        own += [S.min_max(F.col(n), F.lit(lo), F.lit(hi)) for n, (lo, hi) in self.bounds.items()]
        gap = S.seconds_between(F.col(s.time), F.lag(s.time).over(w))
        weight = F.exp(-F.lit(c.decay) * gap) if c.mode.startswith("time_decay") else F.lit(1.0)
        sent = [F.coalesce(F.lag(x).over(w) * weight, F.lit(0.0)) for x in own]
        if c.mode.endswith("status"):
            kind = F.concat(F.lag(c.status or s.event).over(w), F.lit("→"), F.col(c.status or s.event))
            sent += [F.coalesce((kind == f"{a}→{b}").cast("double"), F.lit(0.0)) for a in self.events for b in self.events]
        return log.withColumn("features", array_to_vector(F.transform(F.array(*own, *sent), lambda x: F.coalesce(x, F.lit(0.0)))))

    def labelled(self, log: DataFrame, outcome: str | None = None) -> DataFrame:
        """Adds ``label``: the next event (EOS at a case's end), or the case's outcome column."""
        s = self.spec
        if outcome:
            return log.withColumn("label", F.last(F.col(outcome).cast("string"), ignorenulls=True).over(s.ordered().rowsBetween(-(1 << 62), 1 << 62))).where("label IS NOT NULL")
        return log.withColumn("label", F.coalesce(F.lead(s.event).over(s.ordered()), F.lit("EOS")))

    def fit(self, log: DataFrame, outcome: str | None = None) -> ChainClassifier:
        """Vocabularies are collected: event types and labels, at most ``most`` of each, and so many features."""
        s = self.spec
        rows = self.labelled(log, outcome)
        self.events, self.labels = self._names(log, s.event), self._names(rows, "label")
        kinds = len(self.events) ** 2 if self.config.mode.endswith("status") else 0
        if kinds + 2 * len(self.events) > self.config.most:
            raise ValueError(f"more than {self.config.most} features; HopClassifier weights kinds of transition instead")
        ends = log.agg(*(f(n).alias(f"{f.__name__}{k}") for k, n in enumerate(self.config.numeric) for f in (F.min, F.max))).first() if self.config.numeric else ()
        self.bounds = {n: (float(ends[2 * k] or 0), float(ends[2 * k + 1] or 0)) for k, n in enumerate(self.config.numeric)}
        index = F.array_position(F.array(*map(F.lit, self.labels)), F.col("label")) - 1
        made = self._features(rows).select("features", index.cast("double").alias("y"))
        self.model = LogisticRegression(labelCol="y", maxIter=self.config.max_iter, regParam=self.config.ridge, family="multinomial").fit(made)
        return self

    def _names(self, df: DataFrame, column: str) -> list[str]:
        found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(self.config.most + 1).collect()
        if len(found) > self.config.most:
            raise ValueError(f"more than {self.config.most} values of {column}")
        return sorted(r[0] for r in found)

    def save(self, path: str) -> None:
        """The fitted regression, and beside it the names, bounds and settings, under ``path``."""
        if self.model is None:
            raise RuntimeError("fit first")
        self.model.write().overwrite().save(f"{path}/model")
        told = {"spec": asdict(self.spec), "config": asdict(self.config), "labels": self.labels, "events": self.events, "bounds": self.bounds}
        SparkSession.active().createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> ChainClassifier:
        told = json.loads(SparkSession.active().read.text(f"{path}/settings").first()[0])
        config = {k: tuple(v) if isinstance(v, list) else v for k, v in told["config"].items()}
        made = cls(LogSpec(**told["spec"] | {"features": tuple(told["spec"]["features"])}), ChainConfig(**config))
        made.labels, made.events = told["labels"], told["events"]
        made.bounds = {n: (low, high) for n, (low, high) in told["bounds"].items()}
        made.model = LogisticRegressionModel.load(f"{path}/model")
        return made

    def predict_proba(self, log: DataFrame) -> DataFrame:
        """The rows with ``proba``, an array in the order of ``labels``."""
        if self.model is None:
            raise RuntimeError("fit first")
        return self.model.transform(self._features(log)).withColumn("proba", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")

    def predict(self, log: DataFrame) -> DataFrame:
        told = self.predict_proba(log)
        best = F.array_position("proba", F.array_max("proba")).cast("int")
        return told.withColumn("pred", F.get(F.array(*map(F.lit, self.labels)), best - 1))

    def score(self, log: DataFrame, outcome: str | None = None) -> float:
        told = self.predict(self.labelled(log, outcome))
        return told.agg(F.coalesce(F.avg((F.col("label") == F.col("pred")).cast("int")), F.lit(0.0))).first()[0]
