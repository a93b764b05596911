"""Splits that depend on a hash of the key alone, or on exact shares of its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import scratch


def key_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def unit(key: str, seed: int) -> Column:
    """A number in [0, 1) from the key's hash."""
    return F.conv(F.substring(key_hash(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_split(df: DataFrame, key: str, seed: int = 42, train: float = 0.8, val: float = 0.9) -> DataFrame:
    u = unit(key, seed)
    return df.withColumn("split", F.when(u < train, "train").when(u < val, "val").otherwise("test"))


def ranked(keys: DataFrame, key: str, seed: int) -> DataFrame:
    """Distinct keys with their rank (from 0) by hash and the number of keys.

    Ranks are counted inside the hash's first three digits and added to the sums of the 4096
    prefixes before, so no task orders all keys.
    """
    named = keys.select(key).distinct().withColumn("__h", key_hash(key, seed)).withColumn("__b", F.substring("__h", 1, 3))
    sums = named.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("__b", before.alias("__base")).join(F.broadcast(sums.agg(F.sum("__n").alias("n_keys"))))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) - 1
    return named.withColumn("__p", place).join(F.broadcast(base), "__b").select(key, (F.col("__base") + F.col("__p")).alias("rank"), "n_keys")


def split_by_case(df: DataFrame, case: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole cases; the first ceil(n * test_size) by hash are the test split."""
    cases = ranked(df, case, seed).select(case, F.when(F.col("rank") < F.ceil(F.col("n_keys") * test_size), "test").otherwise("train").alias("split"))
    return df.join(cases, case)


def split_three(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """80, 10 and 10 per cent of the keys, cut at whole numbers."""
    cut = F.when(F.col("rank") < F.floor(F.col("n_keys") * 0.8), "train").when(F.col("rank") < F.floor(F.col("n_keys") * 0.9), "val").otherwise("test")
    return df.join(ranked(df, key, seed).select(key, cut.alias("split")), key)


def _placed(df: DataFrame, group: str, part: Column, order: list[Column]) -> DataFrame:
    """Rows with __p (from 1) in ``order`` within the group, and __n, the group's rows. ``part``
    rises with the order: rows are numbered inside it, and parts are added up before it, so no
    task orders a whole group."""
    named = df.withColumn("__b", part)
    sums = named.groupBy(group, "__b").agg(F.count("*").alias("__c"))
    rising = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(group, "__b", F.coalesce(F.sum("__c").over(rising), F.lit(0)).alias("__base"), F.sum("__c").over(Window.partitionBy(group)).alias("__n"))
    inside = F.row_number().over(Window.partitionBy(group, "__b").orderBy(*order))
    return named.withColumn("__i", inside).join(base, [group, "__b"]).withColumn("__p", F.col("__base") + F.col("__i")).drop("__b", "__i", "__base")


def _placed_by_range(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The same of any order: rows are dealt by ranges of group and order, so neither a hot group nor many
    equals of one value meet in a task. The deal is written once, as its parts are read twice."""
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = dealt.withColumns({"__part": F.spark_partition_id(), "__k": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    path = scratch(df.sparkSession, "placed")
    dealt.write.parquet(path)
    rows = df.sparkSession.read.schema(dealt.schema).parquet(path)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the deal
    parts = rows.groupBy("__part").agg(F.count("*").alias("__c")).select("__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    placed = rows.join(F.broadcast(parts), "__part").withColumn("__p", F.col("__base") + F.col("__k"))
    heads = placed.groupBy(group).agg(F.min("__p").alias("__first"), F.count("*").alias("__n"))  # a row for each group
    return placed.join(F.broadcast(heads), group).withColumn("__p", F.col("__p") - F.col("__first") + 1).drop("__part", "__k", "__base", "__first")


def stratified(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """A share of each label, by hash order within it."""
    h = key_hash(key, seed)
    placed = _placed(df, label, F.substring(h, 1, 3), [h, F.col(key)])
    return placed.withColumn("split", F.when(F.col("__p") <= F.round(F.col("__n") * test_size), "test").otherwise("train")).drop("__p", "__n")


def length_stratified(cases: DataFrame, case: str, length: str, test_size: float = 0.2, bins: int = 5) -> DataFrame:
    """Within equal-width bins of length the longest max(1, int(n * test_size)) go to test."""
    ends = F.broadcast(cases.agg(F.min(length).alias("__lo"), F.max(length).alias("__hi")))
    binned = cases.join(ends).withColumn("bin", F.least(F.floor((F.col(length) - F.col("__lo")) * bins / (F.col("__hi") + 1 - F.col("__lo"))), F.lit(bins - 1)).cast("int")).drop("__lo", "__hi")
    placed = _placed_by_range(binned, "bin", [F.desc(length), F.desc(case)])
    return placed.withColumn("split", F.when(F.col("__p") <= F.greatest(F.lit(1), F.floor(F.col("__n") * test_size)), "test").otherwise("train")).drop("__p", "__n")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))
