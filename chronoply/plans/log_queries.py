"""Queries over the events table seen as a log, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..encoder import LogEncoder
from ..functions import scalars as S
from ..operators import encoding, graphs, metrics, sequences, splits
from ..operators.quantiles import quantiles
from ..spec import LogSpec

SPEC = LogSpec("user_id", "event_type", "ts", "event_id", ("value",))
#: Kinds of event, for the SQL, whose columns must be named; the queries learn them.
TYPES = ["click", "purchase", "signup", "view", "error"]
Q: dict = {}
SQL: dict[str, str] = {}


def log(spark: SparkSession, d: str) -> DataFrame:
    """The events with k of their JSON properties; columns are pruned per query."""
    df = SPEC.validate(spark.read.parquet(f"{d}/events.parquet"))
    return df.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH log AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) AS us FROM events)" + (", " + sql.lstrip()[5:] if sql.lstrip().startswith("WITH ") else "\n" + sql)
        return f

    return add


W = "PARTITION BY user_id ORDER BY ts, event_id"


@query("SELECT event_id, user_id, event_type, value FROM log")
def scan_events_validated(spark, d):
    return log(spark, d).select("event_id", "user_id", "event_type", "value")


@query(f"SELECT event_id, coalesce(lead(event_type) OVER ({W}), 'EOS') AS next_event FROM log")
def next_event_labels(spark, d):
    return sequences.next_events(log(spark, d), SPEC).select("event_id", "next_event")


@query(f"SELECT event_id, round((us - lag(us) OVER ({W})) / 1e6, 6) AS gap_s FROM log")
def time_gaps(spark, d):
    return sequences.time_gaps(log(spark, d), SPEC).select("event_id", F.round("gap_s", 6).alias("gap_s"))


@query(f"WITH g AS (SELECT event_id, (us - lag(us) OVER ({W})) / 1e6 AS gap FROM log) SELECT event_id, round((gap - min(gap) OVER ()) / (max(gap) OVER () - min(gap) OVER ()), 6) AS scaled_gap FROM g WHERE gap IS NOT NULL")
def scaled_time_gaps(spark, d):
    return sequences.scaled_gaps(log(spark, d), SPEC).select("event_id", F.round("scaled_gap", 6).alias("scaled_gap"))


@query(f"WITH t AS (SELECT event_id, user_id, us // 1000000 AS s, lead(event_id) OVER ({W}) AS nx FROM log), m AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS hi, min(s) OVER (PARTITION BY user_id) AS lo FROM t) SELECT event_id, round((hi - s) / (hi - lo + 1e-8), 6) AS node_time FROM m WHERE nx IS NOT NULL")
def node_times(spark, d):
    return sequences.node_times(log(spark, d), SPEC).select("event_id", F.round("node_time", 6).alias("node_time"))


@query(f"WITH t AS (SELECT event_type || '→' || lead(event_type) OVER ({W}) AS transition FROM log) SELECT transition, count(*) AS n FROM t WHERE transition IS NOT NULL GROUP BY transition")
def transition_counts(spark, d):
    return sequences.transitions(log(spark, d), SPEC).where("transition IS NOT NULL").groupBy("transition").agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT DISTINCT event_type || '→' || lead(event_type) OVER ({W}) AS transition FROM log) SELECT transition, row_number() OVER (ORDER BY transition) AS id FROM (SELECT transition FROM t WHERE transition IS NOT NULL UNION SELECT 'UNK')")
def transition_vocab(spark, d):
    v = sequences.vocabulary(sequences.transitions(log(spark, d), SPEC), "transition", extra=("UNK",))
    return v.select("transition", (F.col("id") + 1).cast("bigint").alias("id"))


@query("SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM log)")
def label_vocab(spark, d):
    return sequences.vocabulary(log(spark, d), "event_type").withColumn("id", F.col("id").cast("bigint"))


@query("SELECT event_type, row_number() OVER (ORDER BY a) - 1 AS id FROM (SELECT event_type, min(event_id) AS a FROM log GROUP BY event_type)")
def label_encode_first_seen(spark, d):
    return sequences.first_seen(log(spark, d), "event_type", F.col("event_id")).withColumn("id", F.col("id").cast("bigint"))


@query("WITH v AS (SELECT event_type, row_number() OVER (ORDER BY a) - 1 AS id FROM (SELECT event_type, min(event_id) AS a FROM log WHERE event_type <> 'view' GROUP BY event_type)) SELECT event_id, coalesce(id, -1) AS id, CASE WHEN id IS NOT NULL THEN l.event_type END AS back FROM log l LEFT JOIN v ON v.event_type = l.event_type")
def label_lookup_unseen(spark, d):
    """Ids by first appearance in a part of the log, -1 for events that it hasn't; and the way back."""
    df = log(spark, d)
    vocab = sequences.first_seen(df.where("event_type <> 'view'"), "event_type", F.col("event_id"))
    coded = encoding.looked_up(df.select("event_id", "event_type"), "event_type", vocab, "event_type", "id").select("event_id", F.col("id").cast("bigint").alias("id"))
    back = encoding.named(coded.withColumnRenamed("id", "code"), "code", vocab, "event_type", "id")
    return back.select("event_id", F.col("code").alias("id"), F.col("event_type").alias("back"))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, arg_min(k, (ts, event_id)) FILTER (WHERE k IS NOT NULL) AS k FROM log GROUP BY user_id")
def sequence_table(spark, d):
    return sequences.sequence_table(log(spark, d), SPEC, ["event_type", "k"])


@query("WITH o AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS outcome FROM log GROUP BY user_id) SELECT user_id, outcome, dense_rank() OVER (ORDER BY outcome) - 1 AS label_id FROM o")
def outcome_labels(spark, d):
    return sequences.outcomes(log(spark, d), SPEC, "event_type").withColumn("label_id", F.col("label_id").cast("bigint"))


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM log GROUP BY event_type) ORDER BY n DESC, event_type LIMIT 1")
def most_frequent_event(spark, d):
    return log(spark, d).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(1)


@query("WITH top AS (SELECT event_type AS best FROM log GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1) SELECT round(avg(CASE WHEN event_type = best THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM log, top")
def baseline_accuracy(spark, d):
    df = log(spark, d)
    best = df.groupBy("event_type").count().orderBy(F.desc("count"), "event_type").limit(1).select(F.col("event_type").alias("best"))
    return metrics.accuracy(df.join(F.broadcast(best)), "event_type", "best").select(F.round("accuracy", 6).alias("accuracy"), "n")


@query("WITH s AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS case_size FROM log) SELECT event_id, case_size FROM s WHERE case_size >= 60")
def min_case_length(spark, d):
    return sequences.min_case_length(log(spark, d), SPEC, 60).select("event_id", "case_size")


@query("SELECT event_id FROM log WHERE user_id IN (SELECT user_id FROM log WHERE event_type = 'purchase' AND k >= 90)")
def semi_join_cases(spark, d):
    df = log(spark, d)
    chosen = df.where("event_type = 'purchase' AND k >= 90").select("user_id").distinct()
    return df.join(chosen, "user_id", "left_semi").select("event_id")


@query("WITH g AS (SELECT user_id, count(*) AS n_gaps FROM log WHERE event_type = 'purchase' GROUP BY user_id) SELECT DISTINCT l.user_id, coalesce(n_gaps, 0) AS n_purchases FROM log l LEFT JOIN g USING (user_id)")
def sequence_left_join(spark, d):
    df = log(spark, d)
    seq = df.select("user_id").distinct()
    got = sequences.per_case_arrays(df.where("event_type = 'purchase'"), SPEC, "value", "bought")
    return seq.join(got, "user_id", "left").select("user_id", F.coalesce(F.size("bought"), F.lit(0)).cast("bigint").alias("n_purchases")).withColumn("n_purchases", F.greatest("n_purchases", F.lit(0)))


@query("SELECT event_id, first_value(event_type) OVER w AS case_event_type, first_value(k) OVER w AS case_k FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def case_features_on_events(spark, d):
    return sequences.case_features(log(spark, d), SPEC, ["event_type", "k"]).select("event_id", "case_event_type", "case_k")


@query("WITH b AS (SELECT *, CAST(round(value, 0) AS BIGINT) AS lab FROM log) SELECT event_id, lab FROM b WHERE lab IN (SELECT lab FROM b GROUP BY lab HAVING count(*) > 1)")
def filter_singletons(spark, d):
    df = log(spark, d).withColumn("lab", F.round("value", 0).cast("bigint"))
    return sequences.without_singletons(df, "lab").select("event_id", "lab")


_WIN = f"WITH w AS (SELECT event_id, user_id, row_number() OVER ({W}) AS n, string_agg(event_type, ',') OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS win, coalesce(lead(event_type) OVER ({W}), 'EOS') AS label FROM log)"


@query(_WIN + " SELECT event_id, n - 10 AS window_no, win, label FROM w WHERE n >= 10")
def prefix_windows(spark, d):
    got = sequences.prefix_windows(log(spark, d), SPEC, 10)
    return got.select("event_id", F.col("window_no").cast("bigint").alias("window_no"), F.array_join("window", ",").alias("win"), "label")


@query(_WIN + " SELECT user_id, n - 10 AS window_no, unnest(range(0, 9)) AS src, unnest(range(1, 10)) AS dst FROM w WHERE n >= 10")
def prefix_graph(spark, d):
    got = sequences.prefix_windows(log(spark, d), SPEC, 10)
    pairs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.size("window").cast("bigint") - 2)).alias("src")
    return got.select("user_id", F.col("window_no").cast("bigint").alias("window_no"), pairs).withColumn("dst", F.col("src") + 1)


@query("WITH x AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE us END AS u FROM log) SELECT event_id, coalesce(last_value(u IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(u IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS us FROM x")
def fill_timestamps(spark, d):
    holed = log(spark, d).withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    return sequences.fill_times(holed, SPEC).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("WITH c AS (SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - value AS spent FROM log) SELECT event_id, round(spent, 6) AS spent FROM c WHERE spent > 0")
def clock_spent(spark, d):
    df = log(spark, d).withColumn("at", F.struct("ts", "event_id"))
    return sequences.clock_spent(df, "user_id", "event_type", "at", "value", F.lit(0.0)).select("event_id", F.round("spent", 6).alias("spent"))


@query("WITH c AS (SELECT k, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - value AS spent FROM log) SELECT CAST(round_even(k / 10.0, 0) * 10 AS BIGINT) AS bucket, round(avg(spent), 2) AS avg_s, count(*) AS n FROM c WHERE spent > 0 AND k <> 0 GROUP BY bucket HAVING count(*) >= 20")
def avg_gap_by_bucket(spark, d):
    df = log(spark, d).withColumn("at", F.struct("ts", "event_id"))
    spent = sequences.clock_spent(df, "user_id", "event_type", "at", "value", F.lit(0.0)).where("k <> 0")
    return spent.groupBy(S.half_even_bucket(F.col("k"), 10).alias("bucket")).agg(F.round(F.avg("spent"), 2).alias("avg_s"), F.count("*").alias("n")).where("n >= 20")


@query("SELECT event_id, CAST(round_even(k / 10.0, 0) * 10 AS BIGINT) AS bucket FROM log")
def bucket_half_even(spark, d):
    return log(spark, d).select("event_id", S.half_even_bucket(F.col("k"), 10).alias("bucket"))


@query("WITH t AS (SELECT CAST(round_even(k / 10.0, 0) * 10 AS BIGINT) AS bucket, avg(value) AS m FROM log WHERE k >= 50 GROUP BY bucket) SELECT event_id, round(coalesce(m, 15.0), 6) AS seconds FROM log l LEFT JOIN t ON t.bucket = CAST(round_even(l.k / 10.0, 0) * 10 AS BIGINT)")
def bucket_lookup(spark, d):
    df = log(spark, d).withColumn("bucket", S.half_even_bucket(F.col("k"), 10))
    table = df.where("k >= 50").groupBy("bucket").agg(F.avg("value").alias("m"))
    return df.join(table, "bucket", "left").select("event_id", F.round(F.coalesce("m", F.lit(15.0)), 6).alias("seconds"))


@query("SELECT event_id, round(least(ln(1 + greatest(value, 0)) / ln(601), 1), 6) AS norm, round(exp(least(ln(1 + greatest(value, 0)) / ln(601), 1) * ln(601)) - 1, 4) AS seconds FROM log")
def clock_norm(spark, d):
    n = S.clock_norm(F.col("value"))
    return log(spark, d).select("event_id", F.round(n, 6).alias("norm"), F.round(S.clock_denorm(n), 4).alias("seconds"))


@query("SELECT event_id, ply, round((5.0 + k / 3000.0 * 55.0) * (1 + 0.1 * ply), 6) AS clock FROM log, (SELECT unnest(range(0, 3)) AS ply)")
def simulated_clock(spark, d):
    return log(spark, d).select("event_id", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("ply")).select("event_id", "ply", F.round(S.simulated_seconds(F.col("k")) * (F.lit(1) + F.lit(0.1) * F.col("ply")), 6).alias("clock"))


@query(f"SELECT event_id, round(greatest(k - lag(k) OVER ({W}), 0), 6) AS delta FROM log QUALIFY lag(k) OVER ({W}) IS NOT NULL")
def chain_edges(spark, d):
    lag = F.lag("k").over(SPEC.ordered())
    return log(spark, d).select("event_id", F.greatest(F.col("k") - lag, F.lit(0)).alias("delta"), lag.alias("was")).where("was IS NOT NULL").drop("was")


@query("SELECT event_id, k // 60 AS m, k % 60 AS s, k AS seconds, CAST(NULL AS INTEGER) AS none FROM log")
def parse_clock(spark, d):
    m, s = F.floor(F.col("k") / 60).cast("int"), F.col("k") % 60
    comment = F.format_string("{ [%%clk %d:%02d] }", m, s)
    return log(spark, d).select("event_id", m.alias("m"), s.alias("s"), S.parse_clock(comment).alias("seconds"), S.parse_clock(F.lit("no clock")).alias("none"))


@query("WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS loss FROM log), b AS (SELECT *, min(loss) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r), c AS (SELECT *, sum(CASE WHEN before IS NULL OR loss < before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch) AS blk FROM b), e AS (SELECT *, row_number() OVER (PARTITION BY user_id, blk ORDER BY epoch) - 1 AS stale FROM c) SELECT user_id, min(epoch) AS stop_epoch FROM e WHERE stale >= 3 GROUP BY user_id")
def early_stopping(spark, d):
    runs = log(spark, d).select("user_id", F.row_number().over(SPEC.ordered()).cast("bigint").alias("epoch"), F.col("value").alias("loss"))
    return sequences.early_stop(runs, "user_id", "epoch", "loss", 3).where("stop").groupBy("user_id").agg(F.min("epoch").alias("stop_epoch"))


# Encoders


@query("WITH x AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE value END AS v FROM log), y AS (SELECT event_id, nullif(v, -1) AS v FROM x) SELECT event_id, round(coalesce((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), -1), 6) AS scaled FROM y")
def minmax_masked(spark, d):
    df = log(spark, d).withColumn("v", F.when(F.col("event_id") % 10 == 0, -1.0).otherwise(F.col("value")))
    return encoding.min_max_masked(df, "v", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("WITH x AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS v FROM log), s AS (SELECT min(v) AS lo, max(v) AS hi, median(v) AS mid FROM x) SELECT event_id, round((coalesce(v, mid) - lo) / (hi - lo), 6) AS scaled FROM x, s")
def minmax_median(spark, d):
    df = log(spark, d).withColumn("v", F.when(F.col("event_id") % 10 == 0, -1.0).otherwise(F.col("value")))
    return encoding.min_max_median(df, "v", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("SELECT l_returnflag, count(*) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {s}), 6) AS q{k}" for k, s in enumerate((0.01, 0.25, 0.5, 0.99))) + " FROM lineitem GROUP BY l_returnflag")
def price_quantiles(spark, d):
    """Exact quantiles of a wide column by group, by rank."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    got = quantiles(items, "l_extendedprice", [0.01, 0.25, 0.5, 0.99], ["l_returnflag"], most=5_000)
    return got.select("l_returnflag", "n", *(F.round(F.get("quantiles", F.lit(k)), 6).alias(f"q{k}") for k in range(4)))


@query("SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-8), 6) AS scaled FROM log WINDOW w AS (PARTITION BY user_id)")
def minmax_per_case(spark, d):
    lo, hi = F.min("value").over(SPEC.whole()), F.max("value").over(SPEC.whole())
    return log(spark, d).select("event_id", F.round((F.col("value") - lo) / (hi - lo + F.lit(1e-8)), 6).alias("scaled"))


_HOT = ", ".join(f"CASE WHEN c = '<NO_DESC>' THEN -1 WHEN c = '{t}' THEN 1 ELSE 0 END AS is_{t}" for t in TYPES)


@query(f"WITH x AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '<NO_DESC>' ELSE event_type END AS c FROM log) SELECT event_id, {_HOT} FROM x")
def onehot_masked(spark, d):
    df = log(spark, d).withColumn("c", F.when(F.col("event_id") % 10 == 0, encoding.MISSING).otherwise(F.col("event_type")))
    types = encoding.categories(df.where(F.col("c") != encoding.MISSING), F.col("c"))
    return df.select("event_id", *(c.alias(f"is_{t}") for t, c in zip(types, encoding.one_hot(F.col("c"), types), strict=True)))


@query(f"WITH v AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS id FROM (SELECT DISTINCT event_type AS e FROM log UNION SELECT 'EOS')), n AS (SELECT event_id, event_type, coalesce(lead(event_type) OVER ({W}), 'EOS') AS nx FROM log) SELECT event_id, a.id AS label, b.id AS next_label FROM n JOIN v a ON a.e = event_type JOIN v b ON b.e = nx")
def encode_label_event(spark, d):
    return encoding.label_ids(log(spark, d), SPEC).select("event_id", F.col("label").cast("bigint").alias("label"), F.col("next_label").cast("bigint").alias("next_label"))


@query(f"SELECT event_id, {_HOT.replace('c =', 'event_type =')}, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS f_value FROM log")
def encode_event_features(spark, d):
    df = encoding.min_max_masked(log(spark, d), "value", "f_value")
    types = encoding.categories(df, F.col("event_type"))
    return df.select("event_id", *(c.alias(f"is_{t}") for t, c in zip(types, encoding.one_hot(F.col("event_type"), types), strict=True)), F.round("f_value", 6).alias("f_value"))


@query(f"WITH s AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS c, arg_min(k, (ts, event_id)) AS k FROM log GROUP BY user_id) SELECT user_id, {_HOT}, round((k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()), 6) AS f_k FROM s")
def encode_sequence_features(spark, d):
    """The fitted encoder's features of cases, in place of constant categories."""
    df = log(spark, d)
    made = LogEncoder(case="user_id", event="event_type", time="ts", tie="event_id", caseCategories=["event_type"], caseNumbers=["k"]).fit(df)
    types = made.learnt["caseCategories"]["event_type"]
    found = made.cases(df)
    return found.select("user_id", *(F.get("case_features", F.lit(i)).cast("int").alias(f"is_{t}") for i, t in enumerate(types)), F.round(F.element_at("case_features", -1), 6).alias("f_k"))


@query("WITH c AS (SELECT user_id, count(*) AS n, sum(k) AS total FROM log GROUP BY user_id) SELECT user_id, n AS n_real, greatest(100, max(n) OVER ()) - n AS n_pad, total FROM c")
def pad_and_mask(spark, d):
    arr = sequences.per_case_arrays(log(spark, d), SPEC, "k", "ks")
    longest = arr.agg(F.greatest(F.lit(100), F.max(F.size("ks"))).alias("longest"))
    arr = arr.crossJoin(F.broadcast(longest)).withColumn("p", S.pad(F.col("ks"), F.col("longest")))
    real = S.unpad(F.col("p"))
    return arr.select("user_id", F.size(real).cast("bigint").alias("n_real"), (F.size("p") - F.size(real)).cast("bigint").alias("n_pad"), F.aggregate(real, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT event_id, round(value, 6) AS f0, CAST(0 AS DOUBLE) AS f1, CASE WHEN k = -1 THEN CAST(0 AS DOUBLE) ELSE CAST(k AS DOUBLE) END AS f2, CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE k % 5 END AS DOUBLE) AS f3 FROM log")
def ablate_time(spark, d):
    made = log(spark, d).select("event_id", F.array(F.round("value", 6), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"), F.col("k").cast("double"), F.when(F.col("event_id") % 4 == 0, -1.0).otherwise(F.col("k") % 5)).alias("x"))
    told = made.select("event_id", encoding.without_feature(F.col("x"), 1).alias("x"))
    return told.select("event_id", *(F.get("x", F.lit(k)).alias(f"f{k}") for k in range(4)))


_X = "((value - 10) / 10)"
#: x times the normal distribution: its Taylor series near 0, else its continued fraction.
_Z = f"({_X} / sqrt(2))"
_SERIES = "list_sum(list_transform(range(0, 60), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(z, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) * 2 / sqrt(pi())".replace("z", _Z)
_FRACTION = f"(exp(-{_Z} * {_Z}) / sqrt(pi()) / list_reduce(range(40, 0, -1), lambda a, n: abs({_Z}) + n / 2.0 / a, CAST(abs({_Z}) AS DOUBLE)))"
_GELU = f"0.5 * {_X} * (1 + CASE WHEN abs({_Z}) < 2.5 THEN {_SERIES} ELSE sign({_Z}) * (1 - {_FRACTION}) END)"


@query(f"SELECT event_id, round(greatest({_X}, 0), 6) AS relu, round(CASE WHEN {_X} > 0 THEN {_X} ELSE exp({_X}) - 1 END, 6) AS elu, round({_GELU}, 5) AS gelu, round(CASE WHEN {_X} > 0 THEN {_X} ELSE 0.01 * {_X} END, 6) AS leaky_relu FROM log")
def activations(spark, d):
    x = (F.col("value") - 10) / 10
    return log(spark, d).select("event_id", *(F.round(S.activation(n, x), 5 if n == "gelu" else 6).alias(n) for n in ("relu", "elu", "gelu", "leaky_relu")))


# Graphs

_EDGES = f"WITH e AS (SELECT user_id, row_number() OVER ({W}) - 1 AS src, row_number() OVER ({W}) AS dst, (lead(us) OVER ({W}) - us) / 1e6 AS gap, us // 1000000 AS s, event_type || '→' || lead(event_type) OVER ({W}) AS edge_type, lead(event_id) OVER ({W}) AS nx FROM log), m AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS hi, min(s) OVER (PARTITION BY user_id) AS lo FROM e), f AS (SELECT user_id, src, dst, round((hi - s) / (hi - lo + 1e-8), 6) AS node_time, edge_type, round((gap - min(gap) OVER ()) / (max(gap) OVER () - min(gap) OVER ()), 6) AS dt FROM m WHERE nx IS NOT NULL)"


def _graph(mode):
    def run(spark, d):
        e = graphs.chain_edges(log(spark, d), SPEC, mode)
        return e.select("user_id", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), *(c if c == "edge_type" else F.round(c, 6).alias(c) for c in graphs.MODES[mode]))

    run.__name__ = f"graph_{mode}"
    return run


for _mode, _cols in graphs.MODES.items():
    query(_EDGES + f" SELECT user_id, src, dst, {', '.join(_cols)} FROM f")(_graph(_mode))


@query(_EDGES + f", n AS (SELECT user_id, row_number() OVER ({W}) - 1 AS node, value FROM log), h AS (SELECT user_id, src, dst, exp(-0.01 * gap) AS w FROM m WHERE nx IS NOT NULL) SELECT n.user_id AS g, n.node, round(coalesce(w * p.value, 0), 6) AS message FROM n LEFT JOIN h ON h.user_id = n.user_id AND h.dst = n.node LEFT JOIN n p ON p.user_id = n.user_id AND p.node = h.src")
def message_passing_step(spark, d):
    gap = S.seconds_between(F.col("ts"), F.lag("ts").over(SPEC.ordered()))
    out = graphs.chain_messages(log(spark, d), SPEC, "value", F.exp(F.lit(-0.01) * gap))
    return out.select(F.col("user_id").alias("g"), F.col("node").cast("bigint").alias("node"), F.round("message", 6).alias("message"))


@query(f"WITH p AS (SELECT user_id AS g, row_number() OVER ({W}) - 1 AS node, value FROM log) SELECT b.g, b.node, round(0.5 * a.value, 6) AS message FROM p a JOIN p b ON a.g = b.g AND a.node + 1 = b.node UNION ALL SELECT g, node, 0 FROM p WHERE node = 0")
def message_passing_edges(spark, d):
    """The same step on any edge table: here half the value along each edge of the chain."""
    n = log(spark, d).select(F.col("user_id").alias("g"), (F.row_number().over(SPEC.ordered()) - 1).cast("bigint").alias("node"), "value")
    e = n.select("g", F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    return graphs.message_passing(e, n, "g", "value", F.lit(0.5)).select("g", "node", F.round("message", 6).alias("message"))


@query(f"WITH e AS (SELECT event_id AS src, lead(event_id) OVER ({W}) AS dst FROM log) SELECT src, dst, a.value AS src_value, b.value AS dst_value FROM e JOIN log a ON a.event_id = src JOIN log b ON b.event_id = dst")
def edge_endpoint_join(spark, d):
    df = log(spark, d)
    e = df.select(F.col("event_id").alias("src"), F.lead("event_id").over(SPEC.ordered()).alias("dst")).where("dst IS NOT NULL")
    return graphs.endpoints(e, df, "event_id", "value").select("src", "dst", "src_value", "dst_value")


@query(f"SELECT event_id, round(exp(-0.01 * (us - lag(us) OVER ({W})) / 1e6), 6) AS weight FROM log QUALIFY lag(us) OVER ({W}) IS NOT NULL")
def time_decay_weights(spark, d):
    return sequences.time_gaps(log(spark, d), SPEC).where("gap_s IS NOT NULL").select("event_id", F.round(F.exp(F.lit(-0.01) * F.col("gap_s")), 6).alias("weight"))


@query("WITH x AS (SELECT event_id, user_id, value / 100 AS s FROM log), y AS (SELECT *, exp(s - max(s) OVER (PARTITION BY user_id)) AS e FROM x) SELECT event_id, round(ln(greatest(e / sum(e) OVER (PARTITION BY user_id), 1e-12)), 6) AS log_prob FROM y")
def grouped_softmax(spark, d):
    df = log(spark, d).withColumn("s", F.col("value") / 100)
    return graphs.grouped_softmax(df, "user_id", "s").select("event_id", F.round("log_prob", 6).alias("log_prob"))


@query("SELECT user_id, event_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM log) WHERE r = 1")
def argmax_per_group(spark, d):
    return graphs.argmax(log(spark, d), "user_id", "value", "event_id").select("user_id", "best")


@query("WITH c AS (SELECT user_id, count(*) AS n FROM log GROUP BY user_id) SELECT user_id, n, coalesce(sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) :: BIGINT AS first FROM c")
def group_offsets(spark, d):
    return graphs.offsets(log(spark, d), "user_id")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS events FROM log GROUP BY user_id")
def group_sequences(spark, d):
    return sequences.per_case_arrays(log(spark, d), SPEC, "event_type", "e").select("user_id", F.array_join("e", ",").alias("events"))


@query("SELECT label, p - 1 AS place, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS p FROM embeddings) GROUP BY label, p")
def mean_pool_embeddings(spark, d):
    got = graphs.mean_pool(spark.read.parquet(f"{d}/embeddings.parquet"), "label", F.col("embedding").cast("array<double>"))
    return got.select("label", F.col("place").cast("bigint").alias("place"), F.round("mean", 6).alias("mean"))


# Splits

_H = "md5('42:' || CAST(user_id AS VARCHAR))"
_RANK = f"WITH c AS (SELECT user_id, row_number() OVER (ORDER BY {_H}, user_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM log))"


@query(f"SELECT DISTINCT user_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT user_id, CAST(concat('0x', substring({_H}, 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM log)")
def hash_split(spark, d):
    return splits.hash_split(log(spark, d).select("user_id").distinct(), "user_id")


@query(_RANK + " SELECT event_id, CASE WHEN r < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM log JOIN c USING (user_id)")
def split_by_case(spark, d):
    return splits.split_by_case(log(spark, d), "user_id").select("event_id", "split")


@query(_RANK + " SELECT user_id, CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM c")
def split_80_10_10(spark, d):
    return splits.split_three(log(spark, d).select("user_id").distinct(), "user_id").select("user_id", "split")


@query(_RANK + ", s AS (SELECT event_id, user_id, r < ceil(n * 0.2) AS test FROM log JOIN c USING (user_id)) SELECT count(*) AS shared FROM (SELECT user_id FROM s WHERE test INTERSECT SELECT user_id FROM s WHERE NOT test)")
def split_disjointness(spark, d):
    s = splits.split_by_case(log(spark, d), "user_id")
    return splits.overlap(s.where("split = 'train'"), s.where("split = 'test'"), "user_id").agg(F.count("*").alias("shared"))


@query("WITH o AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS outcome FROM log GROUP BY user_id), r AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY md5('42:' || CAST(user_id AS VARCHAR)), user_id) AS p, count(*) OVER (PARTITION BY outcome) AS n FROM o) SELECT user_id, CASE WHEN p <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r")
def stratified_split(spark, d):
    return splits.stratified(sequences.outcomes(log(spark, d), SPEC, "event_type"), "user_id", "outcome").select("user_id", "split")


@query("WITH l AS (SELECT user_id, count(*) AS len FROM log GROUP BY user_id), b AS (SELECT *, least(floor((len - min(len) OVER ()) * 5 / (max(len) OVER () + 1 - min(len) OVER ())), 4) AS bin FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY len DESC, user_id DESC) AS p, count(*) OVER (PARTITION BY bin) AS n FROM b) SELECT user_id, CAST(bin AS INTEGER) AS bin, CASE WHEN p <= greatest(1, floor(n * 0.2)) THEN 'test' ELSE 'train' END AS split FROM r")
def length_stratified_split(spark, d):
    cases = log(spark, d).groupBy("user_id").agg(F.count("*").alias("len"))
    return splits.length_stratified(cases, "user_id", "len").select("user_id", "bin", "split")


@query("SELECT 'event' AS origin, event_id AS id, CAST(NULL AS VARCHAR) AS text FROM log UNION ALL SELECT 'item', item_id, text FROM benchmark")
def merge_splits(spark, d):
    a = log(spark, d).select(F.lit("event").alias("origin"), F.col("event_id").alias("id"))
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(F.lit("item").alias("origin"), F.col("item_id").alias("id"), "text")
    return a.unionByName(b, allowMissingColumns=True).select("origin", "id", "text")


@query("SELECT doc_id, coalesce(regexp_matches(text, 'the|der'), false) AS hit FROM documents")
def theme_filter(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.coalesce(F.col("text").rlike("the|der"), F.lit(False)).alias("hit"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50")
def filtered_limit(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en'").select("doc_id").orderBy("doc_id").limit(50)


@query("SELECT event_id, upper(event_type) AS loud FROM log WHERE event_type LIKE '%purchase%'")
def prefilter_then_udf(spark, d):
    return log(spark, d).where(F.instr("event_type", "purchase") > 0).select("event_id", F.upper("event_type").alias("loud"))
