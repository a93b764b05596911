"""Recipes: from a log to a fitted model and its figures on cases that it hasn't seen.

    model, figures = train(log, spec, "time_decay_status", encoder={"numbers": ["value"]})

Each recipe is a config whose fields can be overridden by name. Cases are split whole, by hash; the
encoder learns from the training part. Events that it hasn't met there are left out of the
test part, with their cases, as no label stands for them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import EventPipeline
from .encoder import LogEncoder
from .operators import metrics, splits
from .prefix import PrefixTree
from .spec import LogSpec, with_overrides


@dataclass(frozen=True)
class HopRecipe:
    """Chains of events, messages from the events before."""

    mode: str = "basic"
    hops: int = 1
    decay: float = 0.01
    maxIter: int = 50
    regParam: float = 1e-3
    test_size: float = 0.2
    seed: int = 42


@dataclass(frozen=True)
class PrefixRecipe:
    """Windows of events, a context tree over their labels."""

    size: int = 3
    depth: int = 3
    least: int = 2
    test_size: float = 0.2
    seed: int = 42


RECIPES: dict[str, HopRecipe | PrefixRecipe] = {
    "basic": HopRecipe(), "status": HopRecipe("status"), "time_decay": HopRecipe("time_decay"), "time_decay_status": HopRecipe("time_decay_status"), "prefix": PrefixRecipe(),
}


def parts(log: DataFrame, spec: LogSpec, test_size: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Training and test cases; of these, those whose events all are in training cases too."""
    told = splits.split_by_case(spec.validate(log), spec.case, test_size, seed)
    train, test = (told.where(F.col("split") == name).drop("split") for name in ("train", "test"))
    odd = test.join(train.select(spec.event).distinct(), spec.event, "left_anti").select(spec.case).distinct()
    return train, test.join(odd, spec.case, "left_anti")


def train(log: DataFrame, spec: LogSpec, recipe: str = "basic", *, encoder: dict[str, object] | None = None, **overrides: object) -> tuple[PipelineModel, dict[str, float]]:
    """The fitted stages (of the prefix recipe: encoder and tree) and accuracy, macro F1 and n on the test cases."""
    if recipe not in RECIPES:
        raise KeyError(f"No recipe {recipe}; there are {sorted(RECIPES)}")
    config = with_overrides(RECIPES[recipe], **overrides)
    train_part, test_part = parts(log, spec, config.test_size, config.seed)
    fit: Callable = _prefix if isinstance(config, PrefixRecipe) else _hops
    model, told = fit(train_part, test_part, spec, config, encoder or {})
    told = told.select(F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred"))
    figures = metrics.accuracy(told, "label", "pred").first()
    by_class = metrics.report(told, "label", "pred").agg(F.coalesce(F.avg("f1"), F.lit(0.0))).first()
    return model, {"accuracy": figures.accuracy, "f1": by_class[0], "n": figures.n}


def _hops(train_part: DataFrame, test_part: DataFrame, spec: LogSpec, config: HopRecipe, encoder: dict) -> tuple[PipelineModel, DataFrame]:
    made = EventPipeline(spec, encoder=encoder, mode=config.mode, hops=config.hops, decay=config.decay, maxIter=config.maxIter, regParam=config.regParam).fit(train_part)
    told = made.model.transform(test_part)
    return made.model, told.select(F.col("next_label").alias("label"), F.col("prediction").alias("pred"))


def _prefix(train_part: DataFrame, test_part: DataFrame, spec: LogSpec, config: PrefixRecipe, encoder: dict) -> tuple[PipelineModel, DataFrame]:
    coder = LogEncoder(case=spec.case, event=spec.event, time=spec.time, tie=spec.tie, **encoder).fit(train_part)
    tree = PrefixTree(depth=config.depth, least=config.least).fit(coder.windows(train_part, config.size))
    told = tree.transform(coder.windows(test_part, config.size))
    return PipelineModel([coder, tree]), told.select(F.col("target").alias("label"), F.col("prediction").alias("pred"))
