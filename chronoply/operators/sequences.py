"""Ordered event logs: next events, gaps, windows, per-case values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seconds_between
from ..spec import LogSpec


def first_known(col: str, by: Column) -> Column:
    """The first non-null value in the log's order (an aggregate)."""
    return F.min_by(col, F.when(F.col(col).isNotNull(), by))


def last_known(col: str, by: Column) -> Column:
    return F.max_by(col, F.when(F.col(col).isNotNull(), by))


def sequence_table(log: DataFrame, spec: LogSpec, columns: list[str]) -> DataFrame:
    """One row per case with each column's first non-null value."""
    return log.groupBy(spec.case).agg(*(first_known(c, spec.rank()).alias(c) for c in columns))


def outcomes(log: DataFrame, spec: LogSpec, column: str) -> DataFrame:
    """Last non-null value per case, cases without one left out, with its alphabetical id."""
    if column not in log.columns:
        raise ValueError(f"Outcome column not found: {column}")
    last = log.groupBy(spec.case).agg(last_known(column, spec.rank()).cast("string").alias("outcome")).where("outcome IS NOT NULL")
    return last.join(vocabulary(last, "outcome", "label_id"), "outcome").select(spec.case, "outcome", "label_id")


def vocabulary(df: DataFrame, column: str, name: str = "id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values with ids from 0 in order of value; the window sees distinct values only."""
    values = df.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    if extra:
        values = values.union(df.sparkSession.createDataFrame([(x,) for x in extra], values.schema)).distinct()
    return values.withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)


def first_seen(log: DataFrame, column: str, order: Column, name: str = "id") -> DataFrame:
    """Distinct values with ids by first appearance."""
    seen = log.groupBy(column).agg(F.min(order).alias("__at"))
    return seen.select(column, (F.row_number().over(Window.orderBy("__at")) - 1).alias(name))


def next_events(log: DataFrame, spec: LogSpec, end: str = "EOS") -> DataFrame:
    return log.withColumn("next_event", F.coalesce(F.lead(spec.event).over(spec.ordered()), F.lit(end)))


def time_gaps(log: DataFrame, spec: LogSpec) -> DataFrame:
    """Seconds since the case's previous event; null at its first."""
    return log.withColumn("gap_s", seconds_between(F.col(spec.time), F.lag(spec.time).over(spec.ordered())))


def scaled_gaps(log: DataFrame, spec: LogSpec) -> DataFrame:
    """Gaps on the scale from the least to the largest gap of the whole log."""
    gaps = time_gaps(log, spec).where("gap_s IS NOT NULL")
    ends = gaps.agg(F.min("gap_s").alias("lo"), F.max("gap_s").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((F.col("gap_s") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return gaps.join(F.broadcast(ends)).withColumn("scaled_gap", scaled).drop("lo", "hi")


def node_times(log: DataFrame, spec: LogSpec) -> DataFrame:
    """Whole seconds to the case's end over the longest such time of the case; not for its last event."""
    t = F.unix_seconds(F.col(spec.time).cast("timestamp"))
    ahead = F.max(t).over(spec.whole()) - t
    timed = log.withColumn("node_time", ahead / (F.max(t).over(spec.whole()) - F.min(t).over(spec.whole()) + F.lit(1e-8)))
    return timed.withColumn("__next", F.lead(spec.event).over(spec.ordered())).where("__next IS NOT NULL").drop("__next")


def transitions(log: DataFrame, spec: LogSpec, status: str | None = None) -> DataFrame:
    status = status or spec.event
    pair = F.concat(F.col(status).cast("string"), F.lit("→"), F.lead(status).over(spec.ordered()).cast("string"))
    return log.withColumn("transition", pair)


def min_case_length(log: DataFrame, spec: LogSpec, least: int) -> DataFrame:
    return log.withColumn("case_size", F.count("*").over(spec.whole())).where(F.col("case_size") >= least)


def without_singletons(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label occurs more than once, by a semi-join with the counted labels."""
    often = df.groupBy(label).count().where("count > 1").select(label)
    return df.join(often, label, "left_semi")


def prefix_windows(log: DataFrame, spec: LogSpec, size: int, end: str = "EOS") -> DataFrame:
    """Every run of ``size`` events of a case, with the event that follows."""
    w = spec.ordered()
    rows = log.withColumn("__n", F.row_number().over(w)).withColumn("window", F.collect_list(spec.event).over(w.rowsBetween(1 - size, 0)))
    return rows.withColumn("label", F.coalesce(F.lead(spec.event).over(w), F.lit(end))).where(F.col("__n") >= size).withColumn("window_no", F.col("__n") - size).drop("__n")


def fill_times(log: DataFrame, spec: LogSpec) -> DataFrame:
    """A missing time takes the last known one of the case by tie-break order, else the next, else epoch."""
    past = Window.partitionBy(spec.case).orderBy(spec.tie).rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(spec.case).orderBy(spec.tie).rowsBetween(0, Window.unboundedFollowing)
    filled = F.coalesce(F.last(spec.time, ignorenulls=True).over(past), F.first(spec.time, ignorenulls=True).over(future), F.lit("1970-01-01").cast("timestamp_ntz"))
    return log.withColumn(spec.time, filled)


def case_features(log: DataFrame, spec: LogSpec, columns: list[str]) -> DataFrame:
    """Each event with its case's first known values, without a join."""
    w = spec.ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return log.withColumns({f"case_{c}": F.first(c, ignorenulls=True).over(w) for c in columns})


def per_case_arrays(log: DataFrame, spec: LogSpec, value: str, name: str) -> DataFrame:
    """The values of a case in the log's order."""
    made = F.array_sort(F.collect_list(F.struct(spec.time, spec.tie, F.col(value).alias("__v"))))
    return log.groupBy(spec.case).agg(made.alias("__s")).select(spec.case, F.transform("__s", lambda x: x["__v"]).alias(name))


def clock_spent(moves: DataFrame, game: str, colour: str, order: str, clock: str, increment: Column) -> DataFrame:
    """Time spent since the colour's last known clock; rows that spent nothing are left out."""
    before = Window.partitionBy(game, colour).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return moves.withColumn("spent", F.last(clock, ignorenulls=True).over(before) - F.col(clock) + increment).where("spent > 0")


def early_stop(history: DataFrame, run: str, epoch: str, loss: str, patience: int, delta: float = 0.0) -> DataFrame:
    """best_so_far, stale (epochs since it) and stop for each epoch."""
    w = Window.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = history.withColumn("better", (before.isNull() | (F.col(loss) < before - delta)).cast("int"))
    block = better.withColumn("__b", F.sum("better").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stale = F.row_number().over(Window.partitionBy(run, "__b").orderBy(epoch)) - 1
    return block.withColumn("stale", stale).withColumn("stop", F.col("stale") >= patience).drop("__b")
