"""The library as functions: fit, predict, evaluate, save and load of a registered model on a log; and as
one object of an encoder and a classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.param import Param
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoder import LogEncoder
from .models import ChainClassifier
from .spec import LogSpec
from .stages import HopClassifier, label_name, with_folds


def fit(log: DataFrame, spec: LogSpec, *, outcome: str | None = None, **config: object) -> ChainClassifier:
    """A fitted classifier of the next event, or of each case's ``outcome`` column."""
    return ChainClassifier(spec, **config).fit(spec.validate(log), outcome)


def predict(model: ChainClassifier, log: DataFrame) -> DataFrame:
    """The rows with ``pred`` and ``proba``."""
    return model.predict(model.spec.validate(log))


def evaluate(model: ChainClassifier, log: DataFrame, *, outcome: str | None = None) -> dict[str, float]:
    """The share of right predictions (0 for an empty log)."""
    return {"accuracy": model.score(model.spec.validate(log), outcome)}


def save(model: ChainClassifier, path: str) -> None:
    model.save(path)


def load(path: str) -> ChainClassifier:
    return ChainClassifier.load(path)


class EventPipeline:
    """Encoder and classifier of a log as one ML pipeline: build, fit or tune, evaluate, predict, save, load."""

    def __init__(self, spec: LogSpec, *, encoder: dict[str, object] | None = None, **classifier: object) -> None:
        """``encoder``: columns for :class:`LogEncoder`; the rest goes to :class:`HopClassifier`. Unknown names are errors."""
        self.spec = spec
        names = {"case": spec.case, "time": spec.time, "tie": spec.tie}
        self.encoder = LogEncoder(**names, event=spec.event, **(encoder or {}))
        self.classifier = HopClassifier(**names, **classifier)
        self.model: PipelineModel | None = None

    def build(self) -> Pipeline:
        return Pipeline(stages=[self.encoder, self.classifier])

    def fit(self, log: DataFrame) -> EventPipeline:
        self.model = self.build().fit(self.spec.validate(log))
        return self

    def tune(self, log: DataFrame, grid: dict[str, list], *, folds: int = 3, seed: int = 42) -> dict[str, object]:
        """Fits with the values of the classifier's params in ``grid`` that are most often right over folds of
        whole cases, and returns them. The folds' encoder is fitted on each fold's own cases."""
        maps: list[dict[Param, object]] = [{}]
        for name, values in grid.items():
            maps = [m | {self.classifier.getParam(name): v} for m in maps for v in values]
        search = CrossValidator(estimator=self.build(), estimatorParamMaps=maps, evaluator=self._evaluator(), numFolds=folds, foldCol="__fold")
        found = search.fit(with_folds(self.spec.validate(log), self.spec.case, folds, "__fold", seed))
        self.model = found.bestModel
        best = max(range(len(maps)), key=lambda k: (found.avgMetrics[k], -k))
        return {p.name: v for p, v in maps[best].items()}

    def _evaluator(self) -> MulticlassClassificationEvaluator:
        return MulticlassClassificationEvaluator(labelCol=self.classifier.getOrDefault("labelCol"), predictionCol=self.classifier.getOrDefault("predictionCol"), metricName="accuracy")

    def _fitted(self) -> PipelineModel:
        if self.model is None:
            raise RuntimeError("fit first")
        return self.model

    def evaluate(self, log: DataFrame) -> dict[str, float]:
        """The share of events whose next one is told (0 for an empty log)."""
        told = self._fitted().transform(self.spec.validate(log))
        right = F.avg((F.col(self.classifier.getOrDefault("labelCol")) == F.col(self.classifier.getOrDefault("predictionCol"))).cast("int"))
        return {"accuracy": told.agg(F.coalesce(right, F.lit(0.0))).first()[0]}

    def predict(self, log: DataFrame) -> DataFrame:
        """The log with ``pred``, the name of the next event (EOS at a case's end), and the shares of all names."""
        told = self._fitted().transform(self.spec.validate(log))
        names = self._fitted().stages[0].learnt["events"]
        return told.withColumn("pred", label_name(names, F.col(self.classifier.getOrDefault("predictionCol")))).select(*log.columns, "pred", self.classifier.getOrDefault("probabilityCol"))

    def save(self, path: str) -> None:
        self._fitted().write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> EventPipeline:
        model = PipelineModel.load(path)
        encoder, classifier = model.stages
        made = cls(encoder.spec())
        made.model = model
        encoder._copyValues(made.encoder)
        classifier._copyValues(made.classifier)
        return made
