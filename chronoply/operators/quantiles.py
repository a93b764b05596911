"""Exact quantiles of any number of values, by rank.

Spark's ``percentile`` holds every distinct value of a group in one aggregator. Here a sketch
(KLL, of a fixed size) tells two values between which the rank lies, almost surely; a pass counts
the values below, at and between them, which is exact, and sketches those between. What lies
between shrinks by some hundred times a pass, and is sorted when it is small. A sketch that was
wrong costs a pass more, never a wrong result. State is bounded in every task, and so is what
the driver holds: some numbers for each group and rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: Values that are sorted at once, and groups that the driver holds.
MOST, GROUPS = 50_000, 10_000
#: Size of a sketch, and how far from the rank its values are taken (twice its usual error).
SIZE = 2_000
NEAR = 4.0 / SIZE**0.9
#: Steps of the shares that a sketch is asked for.
STEPS = 256


@dataclass
class _Rank:
    """A rank of a group (from 0): its value, or the open interval that holds it, with the values up to
    its low end, those inside, and the ends to try next."""

    rank: int
    low: float
    high: float
    before: int
    inside: int
    a: float
    b: float
    value: float | None = None

    def told(self, below: int, at_a: int, between: int, at_b: int, steps: list[float] | None, most: int) -> None:
        """Narrows the interval by the counts around a and b; ``steps`` are shares of those between."""
        r, middle, over = self.rank, below + at_a, below + at_a + between + at_b
        if r < below:
            self.high, self.inside = self.a, below - self.before
        elif r < middle:
            self.value = self.a
        elif r < middle + between:
            self.low, self.high, self.before, self.inside = self.a, self.b, middle, between
            if between > most and steps:
                self.a, self.b = _near(steps, (r - middle) / between)
                return
        elif r < over:
            self.value = self.b
        else:
            self.low, self.inside, self.before = self.b, self.before + self.inside - over, over
        self.a, self.b = self.low, self.high


def _sketched(value: Column, inside: Column) -> Column:
    """The values at even shares of those inside, by a sketch; null without values."""
    sketch = F.kll_sketch_agg_double(F.when(inside, value), SIZE)
    shares = F.array(*(F.lit(k / STEPS) for k in range(STEPS + 1)))
    return F.when(F.count_if(inside) > 0, F.kll_sketch_get_quantile_double(sketch, shares))


def _near(steps: list[float], share: float) -> tuple[float, float]:
    """Values between which a share lies, as the sketch has it."""
    low, high = math.floor((share - NEAR) * STEPS), math.ceil((share + NEAR) * STEPS)
    low, high = (min(max(k, 0), STEPS) for k in (low, high))
    return steps[min(low, high)], steps[max(low, high)]


def _grouped(rows: DataFrame, names: list[str], tried: list[tuple[Row, list[_Rank | None]]]) -> DataFrame:
    """Rows with their group's ranks, intervals' ends and trial ends as arrays. The joined table has a row for
    each group, of which there are at most GROUPS."""
    spark = rows.sparkSession
    doubles = [StructField(n, ArrayType(DoubleType())) for n in ("low", "high", "a", "b")]
    schema = StructType([*rows.select(*names).schema, StructField("ranks", ArrayType(LongType())), *doubles])
    listed = [(*(key[n] for n in names), [r and r.rank for r in ranks], *([r and getattr(r, c) for r in ranks] for c in ("low", "high", "a", "b"))) for key, ranks in tried]
    ends = F.broadcast(spark.createDataFrame(listed, schema).withColumnsRenamed({n: f"__{n}" for n in names}))
    same = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]
    return rows.join(ends, same) if names else rows.crossJoin(ends)


def _pass(rows: DataFrame, names: list[str], active: list[tuple[Row, list[_Rank | None]]], most: int) -> None:
    """One scan for the ranks of all groups: counts around their trial ends."""
    width = max(len(r) for _, r in active)
    told, v = [], F.col("v")
    for k in range(width):
        a, b = F.get("a", F.lit(k)), F.get("b", F.lit(k))
        inside = (v > a) & (v < b)
        counts = [F.count_if(v < a), F.count_if(v == a), F.count_if(inside), F.count_if((v == b) & (b > a))]
        told.append(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(counts)), _sketched(v, inside).alias("steps")))
    made = {tuple(r[n] for n in names): r for r in _grouped(rows, names, active).groupBy(*names).agg(F.array(*told).alias("told")).collect()}
    for key, ranks in active:
        for rank, x in zip(ranks, made[tuple(key[n] for n in names)].told, strict=False):
            if rank and rank.value is None:
                rank.told(x.c0, x.c1, x.c2, x.c3, x.steps, most)


def _sorted(rows: DataFrame, names: list[str], small: list[tuple[Row, list[_Rank | None]]]) -> None:
    """Ranks whose intervals hold few values: those are sorted."""
    width, v = max(len(r) for _, r in small), F.col("v")
    picks = []
    for k in range(width):
        inside = (v > F.get("low", F.lit(k))) & (v < F.get("high", F.lit(k)))
        picks.append(F.array_sort(F.collect_list(F.when(inside, v))))
    grouped = _grouped(rows, names, small).groupBy(*names).agg(F.array(*picks).alias("picks"), F.any_value("ranks").alias("ranks"), F.array(*(F.count_if(v <= F.get("low", F.lit(k))) for k in range(width))).alias("before"))
    value = F.transform("picks", lambda x, k: F.get(x, (F.get("ranks", k) - F.get("before", k)).cast("int")))
    made = {tuple(r[n] for n in names): r for r in grouped.select(*names, value.alias("found")).collect()}
    for key, ranks in small:
        for rank, x in zip(ranks, made[tuple(key[n] for n in names)].found, strict=False):
            if rank:
                rank.value = x


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), *, most: int = MOST) -> DataFrame:
    """A row for each group: its columns, ``n`` (values) and ``quantiles`` (an array in the order of ``shares``), each
    between the two nearest ranks by linear interpolation.

    Null and NaN are no values; a group without values has null quantiles. Whole numbers beyond 2**53 are
    taken as doubles. More than GROUPS groups are an error. Without ``by`` there is one row.
    """
    names = list(by)
    told = F.col(value).cast("double")
    rows = df.select(*names, F.when(~F.isnan(told), told).alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        v = F.col("v")
        heads = rows.groupBy(*names).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("top"), F.count_if(v == -math.inf).alias("minus"), F.count_if(v == math.inf).alias("plus"), _sketched(v, v.isNotNull()).alias("steps")).limit(GROUPS + 1).collect()
        if len(heads) > GROUPS:
            raise ValueError(f"quantiles of more than {GROUPS} groups")
        groups: list[tuple[Row, list[_Rank]]] = []
        for head in heads:
            found: dict[int, _Rank] = {}
            for share in shares:
                for r in {math.floor(share * (head.n - 1)), math.ceil(share * (head.n - 1))} if head.n else ():
                    end = head.top if r == head.n - 1 else head.least if r == 0 else None
                    low, high = (-math.inf, math.inf) if head.n <= most else _near(head.steps, share)
                    end = -math.inf if r < head.minus else math.inf if r >= head.n - head.plus else end
                    found.setdefault(r, _Rank(r, -math.inf, math.inf, head.minus, head.n - head.minus - head.plus, low, high, end))
            groups.append((head, list(found.values())))
        while active := [(h, [r if r.value is None and r.inside > most else None for r in ranks]) for h, ranks in groups]:
            active = [(h, ranks) for h, ranks in active if any(ranks)]
            if not active:
                break
            _pass(rows, names, active, most)
        small = [(h, [r if r.value is None else None for r in ranks]) for h, ranks in groups]
        if small := [(h, ranks) for h, ranks in small if any(ranks)]:
            _sorted(rows, names, small)
    finally:
        rows.unpersist()
    made = []
    for head, ranks in groups:
        at = {r.rank: r.value for r in ranks}
        made.append((*(head[n] for n in names), head.n, [_between(at, share * (head.n - 1)) if head.n else None for share in shares]))
    schema = StructType([*df.select(*names).schema, StructField("n", LongType()), StructField("quantiles", ArrayType(DoubleType()))])
    return df.sparkSession.createDataFrame(made, schema)


def _between(at: dict[int, float | None], place: float) -> float | None:
    low, high = math.floor(place), math.ceil(place)
    return at[low] if low == high or at[low] == at[high] else (high - place) * at[low] + (place - low) * at[high]  # type: ignore[operator]
