"""Encoders: one-hot blocks, masked scales, label ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import min_max
from ..spec import LogSpec
from .quantiles import quantiles
from .sequences import next_events, vocabulary

MISSING = "<NO_DESC>"


def known(col: str) -> Column:
    """-1 stands for a missing number."""
    return F.nullif(F.col(col).cast("double"), F.lit(-1.0))


def min_max_masked(df: DataFrame, col: str, name: str) -> DataFrame:
    ends = df.agg(F.min(known(col)).alias("lo"), F.max(known(col)).alias("hi"))
    return df.join(F.broadcast(ends)).withColumn(name, min_max(known(col), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def min_max_median(df: DataFrame, col: str, name: str) -> DataFrame:
    """Missing values take the median of the known ones before scaling."""
    ends = df.agg(F.min(known(col)).alias("lo"), F.max(known(col)).alias("hi"))
    middle = F.lit(quantiles(df.select(known(col).alias("v")), "v", [0.5]).first().quantiles[0]).cast("double")
    return df.join(F.broadcast(ends)).withColumn(name, min_max(F.coalesce(known(col), middle), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def categories(df: DataFrame, column: Column, most: int = 10_000, extra: tuple[str, ...] = ()) -> list[str]:
    """The distinct values in order, at most ``most``: a vocabulary is held by the driver."""
    got = df.select(column.cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} values in a vocabulary")
    return sorted({r.v for r in got} | set(extra))


def one_hot(col: Column, values: list[str], masked: bool = True) -> list[Column]:
    """A column for each value; a masked missing value makes the whole block -1."""
    hit = [(col == v).cast("int") for v in values]
    return [F.when(col == MISSING, F.lit(-1)).otherwise(F.coalesce(h, F.lit(0))) if masked else F.coalesce(h, F.lit(0)) for h in hit]


def label_ids(log: DataFrame, spec: LogSpec, end: str = "EOS") -> DataFrame:
    """event_id_in and next_id over the alphabetical vocabulary with ``end``."""
    vocab = vocabulary(log, spec.event, "__id", (end,))
    rows = next_events(log, spec, end)
    now, then = vocab.select(F.col(spec.event).alias("__a"), F.col("__id").alias("label")), vocab.select(F.col(spec.event).alias("__b"), F.col("__id").alias("next_label"))
    return rows.join(now, rows[spec.event] == F.col("__a")).join(then, F.col("next_event") == F.col("__b")).drop("__a", "__b")


def looked_up(df: DataFrame, col: str, vocab: DataFrame, key: str, value: str, default: int = -1) -> DataFrame:
    """The value that a vocabulary has for the column, ``default`` for unknown keys."""
    named = vocab.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return df.join(named, F.col(col) == F.col("__k"), "left").withColumn(value, F.coalesce("__v", F.lit(default))).drop("__k", "__v")


def named(df: DataFrame, col: str, vocab: DataFrame, key: str, value: str) -> DataFrame:
    """The inverse: the key whose value the column has, null for a value of no key (such as that of unknown ones)."""
    told = vocab.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return df.join(told, F.col(col) == F.col("__v"), "left").withColumn(key, F.col("__k")).drop("__k", "__v")


def without_feature(features: Column, at: int) -> Column:
    """An array of features with that at place ``at`` set to 0, and missing values (-1) to 0."""
    return F.transform(features, lambda x, i: F.when((i == at) | (x == -1), F.lit(0.0)).otherwise(x))
