"""Prediction metrics over (case, pos, label, pred, top-k) rows and per-case sequences."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from .distances import swap_distances


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """0 for no rows."""
    return df.agg(F.coalesce(F.avg((F.col(label) == F.col(pred)).cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def top_k(scores: Column, k: int) -> Column:
    """Indices of the k highest scores of an array, ties to the lower index."""
    return F.transform(F.slice(F.array_sort(F.transform(scores, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), 1, k), lambda x: x["i"])


def sequences(df: DataFrame, case: str, pos: str, *columns: str) -> DataFrame:
    made = F.array_sort(F.collect_list(F.struct(pos, *columns)))
    return df.groupBy(case).agg(made.alias("__s")).select(case, *(F.col("__s")[c].alias(c) for c in columns))


def errors_by_position(df: DataFrame, pos: str, label: str, pred: str) -> DataFrame:
    return df.where(F.col(label) != F.col(pred)).groupBy(pos).agg(F.count("*").alias("errors"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(label, pred).agg(F.count("*").alias("n"))


def report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall and F1 of each class from the confusion counts."""
    pairs = confusion(df, label, pred)
    true = pairs.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).alias("hit"))
    said = pairs.groupBy(F.col(pred).alias("class")).agg(F.sum("n").alias("said"))
    both = true.join(said, "class", "full_outer").na.fill(0, ["support", "hit", "said"])
    p, r = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return both.select("class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


@pandas_udf(IntegerType())
def swap_distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of arrays or texts; null counts as empty."""
    for left, right in pairs:
        yield pd.Series(swap_distances([("" if x is None else x, "" if y is None else y) for x, y in zip(left, right, strict=True)]))


def similarity(pred: str, true: str) -> Column:
    """1 less the swap distance over the longer length; 0 where one is empty, null where both are."""
    longer = F.greatest(F.size(pred), F.size(true))
    return F.when(F.least(F.size(pred), F.size(true)) > 0, 1 - swap_distance(pred, true) / longer).when(longer > 0, F.lit(0.0))


def _shared_grams(most: int) -> Callable:
    """For each order up to ``most``: how many n-grams of the first sequence the second has too, each counted
    as often as both have it. Counts of n-grams make it linear in the sequences."""

    @pandas_udf(ArrayType(IntegerType()))
    def shared(have: pd.Series, want: pd.Series) -> pd.Series:
        def grams(seq: list, n: int) -> Counter:
            return Counter(zip(*(seq[k:] for k in range(n)), strict=False))

        return pd.Series([[(grams(list(a), n) & grams(list(b), n)).total() for n in range(1, most + 1)] for a, b in zip(have, want, strict=True)])

    return shared


def bleu(df: DataFrame, pred: str, true: str, most: int = 4) -> DataFrame:
    """Average sentence BLEU of non-empty pairs of arrays of strings: 0 without a common word,
    else counts of 0 are raised to 0.1; orders up to the shorter length."""
    some = df.where((F.size(pred) > 0) & (F.size(true) > 0)).select(F.size(pred).alias("p"), F.size(true).alias("t"), _shared_grams(most)(pred, true).alias("hits"))
    orders = F.least(F.lit(most), "p", "t")
    # Log of the clipped share of the prediction's n-grams, by order.
    logs = F.transform(F.slice("hits", F.lit(1), orders), lambda hit, k: F.log(F.greatest(hit.cast("double"), F.lit(0.1)) / (F.col("p") - k)))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / orders
    brief = F.when(F.col("p") > F.col("t"), 1.0).otherwise(F.exp(1 - F.col("t") / F.col("p")))
    score = F.when(F.get("hits", F.lit(0)) > 0, brief * F.exp(mean)).otherwise(0.0)
    return some.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("bleu"), F.count("*").alias("n"))


def weighted(df: DataFrame, loss: str, hit: str, weight: str) -> DataFrame:
    """Loss and accuracy weighted by the size of each part; 0 without weight."""
    total = F.sum(weight)
    return df.agg(F.coalesce(F.try_divide(F.sum(F.col(loss) * F.col(weight)), total), F.lit(0.0)).alias("loss"), F.coalesce(F.try_divide(F.sum(F.col(hit) * F.col(weight)), total), F.lit(0.0)).alias("accuracy"))


def error_components(df: DataFrame, label: str, pred: str, features: str, k: int = 2) -> DataFrame:
    """The rows whose ``pred`` isn't their ``label``, with ``components``: their features on the
    errors' first ``k`` principal components.

    Rows without features are left out; without errors there are no rows. The covariance is
    summed by the tasks, a matrix of the features' number squared comes to the driver.
    """
    wrong = df.where(~F.col(label).eqNullSafe(F.col(pred)) & F.col(features).isNotNull())
    told = wrong.withColumn("__x", array_to_vector(F.col(features).cast("array<double>")))
    if told.isEmpty():
        return wrong.withColumn("components", F.array().cast("array<double>"))
    made = PCA(k=k, inputCol="__x", outputCol="__c").fit(told).transform(told)
    return made.withColumn("components", vector_to_array("__c")).drop("__x", "__c")
