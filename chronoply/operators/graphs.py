"""Chain graphs of cases and message passing on edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seconds_between
from ..spec import LogSpec

MODES = {
    "basic": ("dt", "node_time"),
    "time_decay": ("node_time",),
    "status": ("dt", "edge_type"),
    "time_decay_status": ("dt", "node_time", "edge_type"),
}


def chain_edges(log: DataFrame, spec: LogSpec, mode: str, status: str | None = None) -> DataFrame:
    """One row per edge j to j+1 of a case with the payload of the mode. All windows share one order."""
    if mode not in MODES:
        raise ValueError(f"Unknown mode: {mode}")
    w, t = spec.ordered(), F.unix_seconds(F.col(spec.time).cast("timestamp"))
    status = status or spec.event
    rows = log.select(
        spec.case, (F.row_number().over(w) - 1).alias("src"), F.row_number().over(w).alias("dst"), F.lead(spec.tie).over(w).isNotNull().alias("__inner"),
        seconds_between(F.lead(spec.time).over(w), F.col(spec.time)).alias("dt"),
        ((F.max(t).over(spec.whole()) - t) / (F.max(t).over(spec.whole()) - F.min(t).over(spec.whole()) + F.lit(1e-8))).alias("node_time"),
        F.concat(F.col(status), F.lit("→"), F.lead(status).over(w)).alias("edge_type"),
    ).where("__inner")
    if "dt" in MODES[mode]:
        ends = rows.agg(F.min("dt").alias("lo"), F.max("dt").alias("hi"))
        rows = rows.join(F.broadcast(ends)).withColumn("dt", F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((F.col("dt") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return rows.select(spec.case, "src", "dst", *MODES[mode])


def chain_messages(log: DataFrame, spec: LogSpec, value: str, weight: Column) -> DataFrame:
    """One step of message passing on chains: ``weight`` (of the edge to the event before) times
    that event's value, 0 at a case's first. One window serves node numbers and messages."""
    w = spec.ordered()
    return log.select(spec.case, (F.row_number().over(w) - 1).alias("node"), F.coalesce(weight * F.lag(value).over(w), F.lit(0.0)).alias("message"))


def hop_messages(log: DataFrame, spec: LogSpec, value: str, weight: Column, hops: int, name: str = "hop") -> DataFrame:
    """Messages of 1 to ``hops`` steps on chains, as columns ``hop_1`` and so on: an event's message of k steps
    is ``weight`` (of the edge that leads to it; null counts as 0) times the message of k - 1 steps, or
    for the first the ``value``, of the event before. Values are numbers or arrays of them; an
    array's message is empty where there is no event before. One window has the values and weights of all steps."""
    w = spec.ordered()
    many = log.schema[value].dataType.typeName() == "array"
    rows = log.withColumn("__weight", F.coalesce(weight, F.lit(0.0)))
    back = {f"__{c}_{k}": F.lag(c, k).over(w) for c, most in (("__weight", hops - 1), (value, hops)) for k in range(1, most + 1)}
    rows = rows.withColumns(back)
    sending = lambda ws: lambda x: reduce(lambda a, b: a * b, reversed(ws), x)
    weights = [F.col("__weight"), *(F.col(f"____weight_{k}") for k in range(1, hops))]
    for k in range(1, hops + 1):
        sent = F.col(f"__{value}_{k}")
        if many:
            sent = F.transform(F.coalesce(sent, F.array().cast("array<double>")), sending(weights[:k]))
        else:
            sent = reduce(lambda a, b: F.coalesce(b * a, F.lit(0.0)), reversed(weights[:k]), sent)
        rows = rows.withColumn(f"{name}_{k}", sent)
    return rows.drop("__weight", *back)


def kind_weights(edges: DataFrame, kind: str, target: str) -> DataFrame:
    """kind, weight: how much a kind of edge tells of what follows it: 1 less the entropy of the target
    after that kind, over the target's entropy among all edges; 0 where all is one target."""
    pairs = edges.where(F.col(kind).isNotNull() & F.col(target).isNotNull()).groupBy(kind, target).agg(F.count("*").alias("n"))
    # Of counts c with the sum n, the entropy is log n - sum(c log c) / n.
    of_kind = pairs.groupBy(kind).agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("own"))
    whole = pairs.groupBy(target).agg(F.sum("n").alias("n")).agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("all"))
    told = of_kind.join(F.broadcast(whole))  # one row
    return told.select(kind, F.when(F.col("all") > 1e-12, F.greatest(1 - F.col("own") / F.col("all"), F.lit(0.0))).otherwise(0.0).alias("weight"))


def message_passing(edges: DataFrame, nodes: DataFrame, graph: str, value: str, weight: Column) -> DataFrame:
    """Sum over incoming edges of weight times the source's value; 0 without one."""
    sent = edges.join(nodes.select(graph, F.col("node").alias("src"), value), [graph, "src"]).groupBy(graph, F.col("dst").alias("node")).agg(F.sum(weight * F.col(value)).alias("__m"))
    return nodes.join(sent, [graph, "node"], "left").select(graph, "node", F.coalesce("__m", F.lit(0.0)).alias("message"))


def endpoints(edges: DataFrame, nodes: DataFrame, key: str, value: str) -> DataFrame:
    """Edges with the values of both ends."""
    a, b = (nodes.select(F.col(key).alias(side), F.col(value).alias(f"{side}_{value}")) for side in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst")


def grouped_softmax(df: DataFrame, group: str, score: str, floor: float = 1e-12) -> DataFrame:
    w = Window.partitionBy(group)
    raised = df.withColumn("__x", F.exp(F.col(score) - F.max(score).over(w)))
    return raised.withColumn("log_prob", F.log(F.greatest(F.col("__x") / F.sum("__x").over(w), F.lit(floor)))).drop("__x")


def argmax(df: DataFrame, group: str, score: str, index: str) -> DataFrame:
    """The first index of the highest score."""
    return df.groupBy(group).agg(F.max_by(index, F.struct(F.col(score), -F.col(index))).alias("best"), F.max(score).alias("top_score"))


def offsets(df: DataFrame, group: str) -> DataFrame:
    """Rows per group and those of all groups before it. Groups are counted first; ranges of
    them are summed apart and then together, so no task sees all groups."""
    counts = df.groupBy(group).agg(F.count("*").alias("n")).repartitionByRange(group).withColumn("__p", F.spark_partition_id())
    parts = counts.groupBy("__p").agg(F.sum("n").alias("__n"), F.min(group).alias("__g"))
    base = parts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("__p").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("__in", inner).join(F.broadcast(base), "__p").select(group, "n", (F.col("__base") + F.col("__in")).alias("first"))


def mean_pool(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean of each place of the vectors of a group (long form)."""
    return df.select(group, F.posexplode(vector).alias("place", "x")).groupBy(group, "place").agg(F.avg("x").alias("mean"))
