"""Next events from prefixes: a context tree with back-off, as tables.

A context is the run of labels before an event, of any length up to ``depth``. The tree counts
which labels follow each context. A context's shares mix its counts with the shares of the
context that is one shorter, by Witten and Bell's weight: the more kinds of label follow it, the
less its own counts say. Fitting is one aggregation over all contexts and a join for each
length, between contexts and their shorter ones, of which each has no more children than there
are labels, so no key is hot. A prefix takes the prediction of its longest known context.
"""

from __future__ import annotations

from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .persistence import Learnt
from .scratch import scratch


class _TreeParams(Params):
    windowCol = Param(Params._dummy(), "windowCol", "column of the windows, arrays of structs with a label", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "column of the label that follows", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "column of the prediction", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "column of the prediction's share", TypeConverters.toString)
    depth = Param(Params._dummy(), "depth", "labels of the longest context", TypeConverters.toInt)
    least = Param(Params._dummy(), "least", "times that a context must be seen", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(windowCol="window", labelCol="target", predictionCol="prediction", probabilityCol="share", depth=3, least=2)

    def labels(self) -> Column:
        return F.transform(self.getOrDefault("windowCol"), lambda x: x["label"])


class PrefixTree(Estimator, _TreeParams, DefaultParamsWritable, DefaultParamsReadable):
    """Fits on windows with the label after each, such as ``LogEncoderModel.windows`` makes."""

    @keyword_only
    def __init__(self, *, windowCol: str = "window", labelCol: str = "target", predictionCol: str = "prediction", probabilityCol: str = "share", depth: int = 3, least: int = 2) -> None:
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PrefixTreeModel:
        depth, least = self.getOrDefault("depth"), self.getOrDefault("least")
        rows = dataset.select(self.labels().alias("w"), F.col(self.getOrDefault("labelCol")).cast("int").alias("label")).where("label IS NOT NULL AND w IS NOT NULL")
        known = rows.select("label", F.slice(F.reverse("w"), 1, depth).alias("w"))
        # Contexts are kept from the last label back, so a shorter one is a beginning of a longer.
        each = known.groupBy("w", "label").agg(F.count("*").alias("n"))  # equal windows meet before their contexts are told
        each = each.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w")), lambda k: F.slice("w", 1, k))).alias("context"), "label", "n")
        pairs = each.groupBy("context", "label").agg(F.sum("n").alias("n"))
        heads = pairs.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where(F.col("total") >= least)
        pairs = _written(pairs.join(heads, "context"), "pairs")
        contexts = _written(self._levels(pairs, depth), "contexts")
        root = contexts.where(F.size("context") == 0).first()
        return self._copyValues(PrefixTreeModel({"fallback": root and root.prediction, "share": root and root.share}, {"contexts": contexts}))

    def _levels(self, pairs: DataFrame, depth: int) -> DataFrame:
        """context, total, kinds, prediction and share of every kept context."""
        level = pairs.where(F.size("context") == 0).withColumn("p", F.col("n") / F.col("total"))
        best = level.groupBy("context").agg(*_best())
        made = best
        for k in range(1, depth + 1):
            shorter = F.slice("context", 1, k - 1)
            above = level.select(F.col("context").alias("up"), F.col("label").alias("up_label"), F.col("p").alias("up_p"))
            own = pairs.where(F.size("context") == k).withColumn("up", shorter)
            level = own.join(above, (own["up"] == above["up"]) & (own["label"] == above["up_label"])).drop(above["up"]).withColumn("p", (F.col("n") + F.col("kinds") * F.col("up_p")) / (F.col("total") + F.col("kinds")))
            # A label that never followed here may be likelier than all that did.
            told = level.groupBy("context").agg(*_best(), F.collect_set("label").alias("seen")).withColumn("up", shorter)
            over = best.select(F.col("context").alias("up"), F.col("prediction").alias("up_label"), F.col("share").alias("up_share"))
            lent = F.when(F.array_contains("seen", F.col("up_label")), 0.0).otherwise(F.col("kinds") * F.col("up_share") / (F.col("total") + F.col("kinds")))
            told = told.join(over, "up").withColumn("lent", lent)
            takes = (F.col("lent") > F.col("share")) | ((F.col("lent") == F.col("share")) & (F.col("up_label") < F.col("prediction")))
            best = told.select("context", "total", "kinds", F.when(takes, F.col("up_label")).otherwise(F.col("prediction")).alias("prediction"), F.when(takes, F.col("lent")).otherwise(F.col("share")).alias("share"))
            made = made.union(best)
        return made


def _written(df: DataFrame, name: str) -> DataFrame:
    """Worked out once, in the folder that executors share."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _best() -> list[Column]:
    """Of the labels of a context: the likeliest, of equals the least."""
    by = F.struct(F.col("p"), -F.col("label"))
    return [F.first("total").alias("total"), F.first("kinds").alias("kinds"), F.max_by("label", by).alias("prediction"), F.max("p").alias("share")]


class PrefixTreeModel(Learnt, _TreeParams):
    """``tables["contexts"]``: the tree, a row for each context."""

    def __init__(self, learnt: dict[str, Any] | None = None, tables: dict[str, DataFrame] | None = None) -> None:
        super().__init__(learnt, tables)
        self._defaults()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds the prediction, its share and ``context_size``, the labels of the context that gave it. A
        prefix without a known context takes the tree's root; without any, null.

        Distinct contexts are told first and joined back, so frequent prefixes are looked up once.
        """
        name = {n: self.getOrDefault(n) for n in ("predictionCol", "probabilityCol")}
        rows = dataset.withColumn("__w", F.coalesce(F.slice(F.reverse(self.labels()), 1, self.getOrDefault("depth")), F.array().cast("array<int>")))
        asked = rows.select("__w").distinct()
        sizes = F.transform(F.sequence(F.lit(1), F.size("__w")), lambda k: F.slice("__w", 1, k))
        each = asked.where(F.size("__w") > 0).select("__w", F.explode(sizes).alias("context"))
        met = each.join(self.tables["contexts"], "context").groupBy("__w").agg(F.max_by(F.struct("prediction", "share", F.size("context").alias("size")), F.size("context")).alias("__t"))
        root = F.struct(F.lit(self.learnt["fallback"]).cast("int").alias("prediction"), F.lit(self.learnt["share"]).cast("double").alias("share"), F.lit(0).alias("size"))
        told = rows.join(met, "__w", "left").withColumn("__t", F.coalesce("__t", root))
        return told.withColumns({name["predictionCol"]: F.col("__t.prediction").cast("double"), name["probabilityCol"]: F.col("__t.share"), "context_size": F.col("__t.size")}).drop("__w", "__t")
