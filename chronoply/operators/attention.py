"""Statistics of importance over positions: bins of length, dominance, windows, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def over_heads(weights: Column) -> Column:
    """The mean of an edge's weights over heads; null for null or no heads."""
    return F.when(F.size(weights) > 0, F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) / F.size(weights))


def decay_or_one(decay: Column) -> Column:
    """The mean decay over heads, 1 where a model has none."""
    return F.coalesce(over_heads(decay), F.lit(1.0))


def length_bins(sequences: DataFrame, length: str, width: int) -> DataFrame:
    """Sequences in each [k * width, (k + 1) * width), empty bins up to the longest included."""
    counts = sequences.groupBy(F.floor(F.col(length) / width).alias("bin")).count()
    top = sequences.agg(F.floor(F.max(length) / width).alias("top")).where("top IS NOT NULL")
    every = top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "top")).alias("bin"))
    return every.join(counts, "bin", "left").select((F.col("bin") * width).alias("min_len"), ((F.col("bin") + 1) * width).alias("max_len"), F.coalesce("count", F.lit(0)).alias("n"))


def quantile_edges(sequences: DataFrame, length: str, bins: int) -> DataFrame:
    """bin, min_len, max_len: [floor(q_i), ceil(q_i+1) + 1); neighbours overlap, the first match counts."""
    q = quantiles(sequences, length, [k / bins for k in range(bins + 1)]).withColumnRenamed("quantiles", "q")
    return q.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "q").select("bin", F.floor(F.get("q", F.col("bin"))).alias("min_len"), (F.ceil(F.get("q", F.col("bin") + 1)) + 1).alias("max_len"))


def in_ranges(df: DataFrame, length: str, ranges: DataFrame) -> DataFrame:
    """The first range [min_len, max_len) that holds the length. ``ranges`` is a table of a few
    rows made from parameters; it becomes one array literal column, so no row is multiplied."""
    listed = ranges.agg(F.array_sort(F.collect_list(F.struct("bin", "min_len", "max_len"))).alias("__r"))
    met = df.join(F.broadcast(listed)).withColumn("__m", F.get(F.filter("__r", lambda r: (F.col(length) >= r["min_len"]) & (F.col(length) < r["max_len"])), F.lit(0)))
    return met.where("__m IS NOT NULL").withColumn("bin", F.col("__m.bin")).drop("__r", "__m")


def top_positions(points: DataFrame, case: str, k: int = 3) -> DataFrame:
    """The k most important positions of each sequence, ties to the earlier one. points: case, pos, imp."""
    w = Window.partitionBy(case).orderBy(F.desc("imp"), "pos")
    return points.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dominance(top: DataFrame) -> DataFrame:
    """Per bin and rank: the most frequent position, its per cent and the mean importance."""
    seen = top.groupBy("bin", "rank", "pos").agg(F.count("*").alias("hits"), F.sum("imp").alias("total"))
    all_ = seen.groupBy("bin", "rank").agg(F.max_by("pos", F.struct("hits", -F.col("pos"))).alias("node"), F.max("hits").alias("hits"), F.sum("hits").alias("n"), F.sum("total").alias("total"))
    return all_.select("bin", "rank", "node", F.round(100.0 * F.col("hits") / F.col("n"), 2).alias("percent"), F.round(F.col("total") / F.col("n"), 4).alias("mean_importance"))


def heatmap_long(top: DataFrame) -> DataFrame:
    """bin, pos, mean_importance over all positions: the mean over all importances of the ranks
    in which the bin has the position."""
    ranks = top.groupBy("bin", "rank").agg(F.sum("imp").alias("total"), F.count("imp").alias("n"))
    seen = top.select("bin", "rank", "pos").distinct()
    return seen.join(F.broadcast(ranks), ["bin", "rank"]).groupBy("bin", "pos").agg((F.sum("total") / F.sum("n")).alias("mean_importance"))


def critical_windows(top: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per bin and position: mean importance, and hits over the bin's sequences."""
    n = sequences.groupBy("bin").agg(F.count("*").alias("n"))
    return top.groupBy("bin", "pos").agg(F.avg("imp").alias("mean_importance"), F.count("*").alias("hits")).join(F.broadcast(n), "bin").withColumn("frequency", F.col("hits") / F.col("n"))


def window_metrics(points: DataFrame, case: str) -> DataFrame:
    """Per sequence: peak, share of positions above half of it, and the peak's relative place."""
    peak = points.groupBy(case, "bin").agg(F.max("imp").alias("peak"), F.min_by("pos", F.struct(-F.col("imp"), "pos")).alias("at"), F.max("n").alias("n"), F.sort_array(F.collect_list("imp")).alias("__v"))
    wide = F.size(F.filter("__v", lambda x: x > F.col("peak") * 0.5))
    return peak.select(case, "bin", "peak", (wide / F.col("n")).alias("span"), (F.col("at") / F.col("n")).alias("peak_at"))


def summary(metrics: DataFrame) -> DataFrame:
    parts = [f(c).alias(f"{n}_{c}") for c in ("peak", "span", "peak_at") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    middle = quantiles(metrics, "peak", [0.5], ["bin"]).select("bin", F.get("quantiles", F.lit(0)).alias("median_peak"))
    return metrics.groupBy("bin").agg(F.count("*").alias("n"), *parts).join(F.broadcast(middle), "bin")  # a row for each bin


def pairwise_t(metrics: DataFrame, value: str = "peak") -> DataFrame:
    """Student's t with equal variances and Cohen's d for every pair of bins. There is one row
    for each bin before the pairs are made, and bins are a parameter."""
    per = metrics.groupBy("bin").agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n > 1")
    a, b = (per.select(*(F.col(c).alias(f"{c}_{s}") for c in per.columns)) for s in ("a", "b"))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    d = (F.col("m_a") - F.col("m_b")) / F.col("sp")
    pairs = a.join(b, F.col("bin_a") < F.col("bin_b")).withColumn("sp", pooled).where("sp > 0")
    return pairs.select("bin_a", "bin_b", (d / F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b"))).alias("t"), d.alias("d"), (F.col("n_a") + F.col("n_b") - 2).alias("df"))


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom: the finite trigonometric sum."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    square = F.cos(angle) ** 2
    odd = df % 2 == 1
    # Each term is the one before times cos squared and a ratio of whole numbers.
    terms = F.sequence(F.lit(1), F.greatest(F.floor((df - 2) / 2), F.lit(1)).cast("int"))
    ratio = lambda k: F.when(odd, 2.0 * k / (2 * k + 1)).otherwise((2.0 * k - 1) / (2 * k))
    more = F.when(df >= 4, F.aggregate(terms, F.struct(F.lit(1.0).alias("last"), F.lit(1.0).alias("sum")), lambda a, k: F.struct((a["last"] * square * ratio(k)).alias("last"), (a["sum"] + a["last"] * square * ratio(k)).alias("sum")), lambda a: a["sum"])).otherwise(1.0)
    inside = F.when(df == 1, 2 / F.pi() * angle).when(odd, 2 / F.pi() * (angle + F.sin(angle) * F.cos(angle) * more)).otherwise(F.sin(angle) * more)
    return F.greatest(1 - inside, F.lit(0.0))


def with_stars(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds p and stars: one star below alpha / 2, two below alpha / 4."""
    told = tests.withColumn("p", p_value(F.col("t"), F.col("df")))
    return told.withColumn("stars", F.repeat(F.lit("*"), sum(((F.col("p") < alpha / 2**k).cast("int") for k in (1, 2)), F.lit(0))))


def top_comparisons(tests: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` comparisons with stars: by stars, then the least p, then the greatest d."""
    return tests.where("stars <> ''").orderBy(F.desc(F.length("stars")), "p", F.desc("d")).limit(n)


def correlation(points: DataFrame, kind: str, x: str, y: str, top: int = 3, least: int = 10) -> DataFrame:
    """Pearson correlation of the commonest kinds with more than ``least`` rows, and of all rows."""
    whole = points.agg(F.lit("all").alias(kind), F.count("*").alias("n"), F.corr(x, y).alias("r"))
    each = points.groupBy(kind).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).orderBy(F.desc("n"), kind).limit(top).where(F.col("n") > least)
    return whole.union(each.select(kind, "n", "r"))
