"""Queries of fitted encoders, mixed times, clock tables and samples, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..encoder import LogEncoder
from ..functions import scalars as S
from ..operators import attention as A
from ..operators import encoding, metrics, sequences, splits
from ..operators.quantiles import quantiles
from ..sources import games
from .analysis_queries import _PRED, _TT, binned, predictions
from .log_queries import SPEC, W, log, query

# The encoder is fitted on each case's first two events without one category, so that this one
# and some kinds of transition are never seen; it encodes the whole log.

_FIT = f"""WITH o AS (SELECT *, row_number() OVER ({W}) AS n, lead(us) OVER ({W}) AS nx, CASE WHEN k >= 90 THEN '<NO_DESC>' ELSE 'k' || CAST(k // 10 AS VARCHAR) END AS cat, CASE WHEN k % 11 = 0 THEN -1 ELSE value END AS num, lead(event_type) OVER ({W}) AS nt FROM log),
t AS (SELECT * FROM o WHERE n <= 2),
c AS (SELECT DISTINCT cat FROM t WHERE cat <> 'k3'),
v AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS id FROM (SELECT DISTINCT event_type AS e FROM t UNION SELECT 'EOS')),
tt AS (SELECT event_type || '→' || lead(event_type) OVER ({W}) AS pair FROM t WHERE cat <> 'k3'),
kv AS (SELECT pair, row_number() OVER (ORDER BY pair) - 1 AS id FROM (SELECT pair FROM tt WHERE pair IS NOT NULL UNION SELECT 'UNK')),
b AS (SELECT min(nullif(num, -1)) AS lo, max(nullif(num, -1)) AS hi FROM t WHERE cat <> 'k3')
"""


def _coded(spark, d):
    df = log(spark, d).withColumn("cat", F.when(F.col("k") >= 90, encoding.MISSING).otherwise(F.concat(F.lit("k"), F.floor(F.col("k") / 10).cast("string"))))
    df = df.withColumn("num", F.when(F.col("k") % 11 == 0, -1.0).otherwise(F.col("value")))
    first = df.withColumn("n", F.row_number().over(SPEC.ordered())).where("n <= 2 AND cat <> 'k3'").drop("n")
    made = LogEncoder(case="user_id", event="event_type", time="ts", tie="event_id", categories=["cat"], numbers=["num"]).fit(first)
    return df, made


@query(_FIT + " SELECT event_id, v.id AS label, coalesce(v2.id, (SELECT id FROM v WHERE e = 'EOS')) AS next_label, CASE WHEN nt IS NOT NULL THEN coalesce(kv.id, (SELECT id FROM kv WHERE pair = 'UNK')) END AS kind, (o.cat = '<NO_DESC>' OR o.cat IN (SELECT cat FROM c)) AS seen, round(CASE WHEN num = -1 THEN -1 ELSE (num - lo) / (hi - lo) END, 6) AS scaled FROM o JOIN v ON v.e = event_type LEFT JOIN v v2 ON v2.e = nt LEFT JOIN kv ON kv.pair = event_type || '→' || nt, b")
def encode_unseen(spark, d):
    """Unseen categories are zeros, unseen transitions UNK, missing numbers -1."""
    df, made = _coded(spark, d)
    block = F.slice("features", 1, F.size("features") - 1)
    out = made.transform(df)
    return out.select("event_id", *(F.col(c).cast("bigint").alias(c) for c in ("label", "next_label", "kind")), F.exists(block, lambda x: x != 0).alias("seen"), F.round(F.element_at("features", -1), 6).alias("scaled"))


_JAVA = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'"]


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE us // 1000000 END AS s FROM log")
def parse_mixed_times(spark, d):
    """Times that were written in four forms, and texts that are no time, parsed again."""
    form = F.expr("CASE event_id % 5 " + " ".join(f"""WHEN {k} THEN date_format(ts, "{f}")""" for k, f in enumerate(_JAVA)) + " ELSE 'no time' END")
    return log(spark, d).select("event_id", F.unix_seconds(S.parse_time(form)).alias("s"))


@query("WITH t AS (SELECT CAST(round_even(k / 10.0, 0) * 10 AS BIGINT) AS bucket, avg(value) AS m FROM log WHERE k >= 50 GROUP BY bucket), f AS (SELECT m AS d FROM t ORDER BY bucket LIMIT 1) SELECT event_id, ply, round(coalesce(m, d) * (1 + 0.1 * ply), 2) AS clock FROM log l LEFT JOIN t ON t.bucket = CAST(round_even(l.k / 10.0, 0) * 10 AS BIGINT), f, (SELECT unnest(range(0, 3)) AS ply)")
def simulated_clock_table(spark, d):
    """Simulated clocks by a table of means; a rating without a bucket takes the smallest one's."""
    df = log(spark, d).withColumn("bucket", S.half_even_bucket(F.col("k"), 10))
    table = df.where("k >= 50").groupBy("bucket").agg(F.avg("value").alias("m"))
    smallest = table.agg(F.min_by("m", "bucket").alias("least"))
    base = df.join(table, "bucket", "left").join(F.broadcast(smallest)).withColumn("m", F.coalesce("m", "least"))
    plies = base.select("event_id", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("ply"))
    return plies.select("event_id", "ply", S.simulated_clock(F.col("m"), F.col("ply")).alias("clock"))


@query(f"WITH n AS (SELECT *, least(ln(1 + k) / ln(601), 1) AS c FROM log), x AS (SELECT event_id, exp(c * ln(601)) - 1 AS s, lag(exp(c * ln(601)) - 1) OVER ({W}) AS p FROM n) SELECT event_id, round(greatest(s - p, 0), 4) AS delta FROM x WHERE p IS NOT NULL")
def chain_deltas(spark, d):
    norm = S.clock_norm(F.col("k").cast("double"))
    rows = log(spark, d).withColumn("norm", norm).withColumn("before", F.lag("norm").over(SPEC.ordered())).where("before IS NOT NULL")
    return rows.select("event_id", F.round(S.chain_delta(F.col("norm"), F.col("before")), 4).alias("delta"))


@query("WITH m AS (SELECT event_type AS part, count(*) AS w, avg(value) AS loss, avg(CASE WHEN k >= 50 THEN 1.0 ELSE 0.0 END) AS hit FROM log GROUP BY event_type) SELECT round(sum(loss * w) / sum(w), 6) AS loss, round(sum(hit * w) / sum(w), 6) AS accuracy FROM m")
def weighted_metrics(spark, d):
    parts = log(spark, d).groupBy("event_type").agg(F.count("*").alias("w"), F.avg("value").alias("loss"), F.avg((F.col("k") >= 50).cast("double")).alias("hit"))
    return metrics.weighted(parts, "loss", "hit", "w").select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query("WITH t AS (SELECT event_id, 'mateIn' || CAST(1 + k % 12 AS VARCHAR) || CASE WHEN k % 3 = 0 THEN ' short' ELSE ' long' END AS themes, k FROM log), n AS (SELECT *, CAST(regexp_extract(themes, 'mateIn([0-9]+)', 1) AS INTEGER) AS mate FROM t) SELECT event_id, mate, mate BETWEEN 1 AND 5 AS strict, mate BETWEEN 1 AND 5 OR mate >= 10 AS loose FROM n")
def theme_mates(spark, d):
    """Mate depth of themes; a loose filter of 1 to 5 also takes those that begin alike."""
    themes = F.concat(F.lit("mateIn"), (1 + F.col("k") % 12).cast("string"), F.when(F.col("k") % 3 == 0, " short").otherwise(" long"))
    df = log(spark, d).select("event_id", themes.alias("Themes"))
    strict, loose = (games.with_theme(df, 1, 5, strict=s).select("event_id", F.lit(True).alias(n)) for s, n in ((True, "strict"), (False, "loose")))
    made = df.join(strict, "event_id", "left").join(loose, "event_id", "left").na.fill(False, ["strict", "loose"])
    return made.select("event_id", S.first_theme_mate(F.col("Themes")).alias("mate"), "strict", "loose")


@query(f"SELECT user_id, CAST(row_number() OVER (ORDER BY md5('7:' || CAST(user_id AS VARCHAR)), user_id) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT user_id FROM log)")
def seeded_shuffle(spark, d):
    """Cases in the order of a seeded hash."""
    return splits.ranked(log(spark, d), "user_id", 7).select("user_id", F.col("rank").cast("bigint").alias("place"))


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM log) WHERE CAST(concat('0x', substring(md5('7:' || CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.3")
def hash_sample(spark, d):
    """A sample of 30 per cent of the cases, by hash: the same cases each time."""
    return log(spark, d).select("user_id").distinct().where(splits.unit("user_id", 7) < 0.3)


@query(_PRED + ", s AS (SELECT user_id, count(*) AS n, bool_or(label <> pred) AS wrong FROM p GROUP BY user_id) SELECT wrong, count(*) AS cases, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) AS mean, round(median(n), 6) AS middle FROM s GROUP BY wrong")
def error_length_stats(spark, d):
    s = predictions(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.bool_or(F.col("label") != F.col("pred")).alias("wrong"))
    middle = quantiles(s, "n", [0.5], ["wrong"]).select("wrong", F.round(F.get("quantiles", F.lit(0)), 6).alias("middle"))
    return s.groupBy("wrong").agg(F.count("*").alias("cases"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean")).join(F.broadcast(middle), "wrong")


@query(_PRED + ", k AS (SELECT user_id, avg((label = pred) :: INT) AS top1, avg((label = pred OR label = 'click') :: INT) AS top2, bool_and(label = pred OR label = 'click') AS whole FROM p GROUP BY user_id) SELECT round(avg(top1), 6) AS top1, round(avg(top2), 6) AS top2, round(avg(whole :: INT), 6) AS whole, count(*) AS n FROM k")
def topk_accuracies(spark, d):
    p = predictions(spark, d)
    hit = F.array_contains(F.array("pred", F.lit("click")), F.col("label"))
    per = p.groupBy("user_id").agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("top1"), F.avg(hit.cast("int")).alias("top2"), F.bool_and(hit).alias("whole"))
    return per.agg(F.round(F.avg("top1"), 6).alias("top1"), F.round(F.avg("top2"), 6).alias("top2"), F.round(F.avg(F.col("whole").cast("int")), 6).alias("whole"), F.count("*").alias("n"))


@query(_TT + ", x AS (SELECT bin_a, bin_b, df, dm / sp / sqrt(1 / na + 1 / nb) AS t FROM pr WHERE sp > 0), i AS (SELECT *, (unnest(range(0, 20001)) + 0.0) / 20000 AS u FROM x), y AS (SELECT bin_a, bin_b, df, t, sum((CASE WHEN u = 0 OR u = 1 THEN 1 WHEN CAST(round(u * 20000) AS INTEGER) % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(atan(abs(t) / sqrt(df)) * u), df - 1)) * atan(abs(t) / sqrt(df)) / 60000 AS area, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) * 2 / sqrt(pi()) AS c FROM i GROUP BY bin_a, bin_b, df, t) SELECT bin_a, bin_b, round(greatest(1 - c * area, 0), 5) AS p, CAST(1 - c * area < 0.025 AS INTEGER) + CAST(1 - c * area < 0.0125 AS INTEGER) AS stars FROM y")
def ttest_stars(spark, d):
    """p and stars of each pair of bins; the SQL integrates the density."""
    got = A.with_stars(A.pairwise_t(A.window_metrics(binned(spark, d)[0], "user_id")))
    return got.select(F.col("bin_a").cast("bigint").alias("bin_a"), F.col("bin_b").cast("bigint").alias("bin_b"), F.round("p", 5).alias("p"), F.length("stars").alias("stars"))


@query(f"WITH e AS (SELECT min(value) AS lo, max(value) AS hi, min(g) AS glo, max(g) AS ghi FROM (SELECT value, (lead(us) OVER ({W}) - us) / 1e6 AS g FROM log)), x AS (SELECT user_id, ts, event_id, (value - lo) / (hi - lo) AS v, (CAST(lead(us) OVER ({W}) - us AS DOUBLE) / 1e6 - glo) / (ghi - glo) AS g, coalesce(lead(event_type) OVER ({W}), 'EOS') AS target FROM log, e) SELECT user_id, row_number() OVER ({W}) - 5 AS window_no, round(avg(v) OVER w, 6) AS mean_value, round(avg(coalesce(g, -1)) OVER w, 6) AS mean_gap, target FROM x WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER ({W}) >= 5")
def feature_windows(spark, d):
    """The fitted encoder's windows of five events: means of a scaled number and of the scaled gaps."""
    df = log(spark, d)
    made = LogEncoder(case="user_id", event="event_type", time="ts", tie="event_id", numbers=["value"]).fit(df)
    mean = lambda of: F.aggregate(F.transform("window", of), F.lit(0.0), lambda a, x: a + x) / 5
    target = F.get(F.array(*map(F.lit, made.learnt["events"])), F.col("target"))
    return made.windows(df, 5).select("user_id", F.col("window_no").cast("bigint").alias("window_no"), F.round(mean(lambda x: F.element_at(x["features"], -1)), 6).alias("mean_value"), F.round(mean(lambda x: x["gap"]), 6).alias("mean_gap"), target.alias("target"))


@query(f"SELECT src, dst FROM (SELECT event_id AS src, lead(event_id) OVER ({W}) AS dst, event_type || '→' || lead(event_type) OVER ({W}) AS kind FROM log) WHERE kind IN ('view→click', 'click→purchase')")
def edge_type_filter(spark, d):
    rows = sequences.transitions(log(spark, d), SPEC).withColumn("dst", F.lead("event_id").over(SPEC.ordered()))
    return rows.where(F.col("transition").isin("view→click", "click→purchase")).select(F.col("event_id").alias("src"), "dst")


@query("WITH x AS (SELECT event_id, user_id, value / 100 AS s FROM log), y AS (SELECT *, exp(s - max(s) OVER (PARTITION BY user_id)) AS e FROM x), z AS (SELECT event_id, user_id, -ln(greatest(e / sum(e) OVER (PARTITION BY user_id), 1e-12)) AS nll, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM y) SELECT round(avg(nll), 6) AS loss, count(*) AS n FROM z WHERE r = 1")
def grouped_loss(spark, d):
    """Mean negative log likelihood of each group's true choice (its first event)."""
    from ..operators import graphs

    made = graphs.grouped_softmax(log(spark, d).withColumn("s", F.col("value") / 100), "user_id", "s")
    return made.groupBy("user_id").agg(F.min_by("log_prob", "event_id").alias("lp")).agg(F.round(F.avg(-F.col("lp")), 6).alias("loss"), F.count("*").alias("n"))
