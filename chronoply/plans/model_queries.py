"""Queries of fitted models, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..encoder import LogEncoder
from ..functions import scalars as S
from ..operators import graphs, splits
from ..prefix import PrefixTree
from ..scratch import scratch
from ..sources import committed
from ..stages import HopClassifier
from .log_queries import SPEC, W, log, query

DEPTH, LEAST = 3, 5


def encoded(spark, d):
    """The log and an encoder fitted on it."""
    df = log(spark, d)
    return df, LogEncoder(case="user_id", event="event_type", time="ts", tie="event_id", numbers=["value"], caseCategories=["event_type"]).fit(df)


def _tree_sql() -> str:
    """Counts and mixed shares of each length of context, level by level."""
    made = [f"x AS (SELECT user_id, row_number() OVER ({W}) AS rn, event_type AS c1, lag(event_type) OVER ({W}) AS c2, lag(event_type, 2) OVER ({W}) AS c3, coalesce(lead(event_type) OVER ({W}), 'EOS') AS y FROM log)", "f AS (SELECT * FROM x WHERE rn >= 4)"]
    made += ["l0 AS (SELECT y, count(*) / sum(count(*)) OVER () AS p FROM f GROUP BY y)", "b0 AS (SELECT y, p FROM l0 ORDER BY p DESC, y LIMIT 1)"]
    for k in range(1, DEPTH + 1):
        cs = ", ".join(f"c{i}" for i in range(1, k + 1))
        up = " AND ".join(f"u.c{i} = a.c{i}" for i in range(1, k)) or "true"
        own = " AND ".join(f"s.c{i} = a.c{i}" for i in range(1, k + 1))
        made += [
            f"n{k} AS (SELECT {cs}, y, count(*) AS n FROM f GROUP BY {cs}, y)",
            f"h{k} AS (SELECT {cs}, sum(n) AS total, count(*) AS kinds FROM n{k} GROUP BY {cs} HAVING sum(n) >= {LEAST})",
            f"l{k} AS (SELECT a.*, (a.n + a.kinds * u.p) / (a.total + a.kinds) AS p FROM (SELECT * FROM n{k} JOIN h{k} USING ({cs})) a JOIN l{k - 1} u ON {up} AND u.y = a.y)",
            f"o{k} AS (SELECT * FROM l{k} QUALIFY row_number() OVER (PARTITION BY {cs} ORDER BY p DESC, y) = 1)",
            f"t{k} AS (SELECT a.*, u.y AS uy, CASE WHEN EXISTS (SELECT 1 FROM l{k} s WHERE {own} AND s.y = u.y) THEN 0 ELSE a.kinds * u.p / (a.total + a.kinds) END AS lent FROM o{k} a JOIN b{k - 1} u ON {up})",
            f"b{k} AS (SELECT {cs}, CASE WHEN lent > p OR (lent = p AND uy < y) THEN uy ELSE y END AS y, greatest(lent, p) AS p FROM t{k})",
        ]
    joins = " ".join(f"LEFT JOIN b{k} ON " + " AND ".join(f"b{k}.c{i} = f.c{i}" for i in range(1, k + 1)) for k in range(1, DEPTH + 1))
    down = range(DEPTH, -1, -1)
    size = "CASE " + " ".join(f"WHEN b{k}.y IS NOT NULL THEN {k}" for k in range(DEPTH, 0, -1)) + " ELSE 0 END"
    return "WITH " + ",\n".join(made) + f"\nSELECT user_id, rn - 4 AS window_no, f.y AS target, coalesce({', '.join(f'b{k}.y' for k in down)}) AS pred, round(coalesce({', '.join(f'b{k}.p' for k in down)}), 6) AS share, CAST({size} AS BIGINT) AS context_size FROM f {joins}, b0"


@query(_tree_sql())
def prefix_model_predictions(spark, d):
    """The context tree of the encoder's windows, and its prediction after each of them."""
    df, encoder = encoded(spark, d)
    windows = encoder.windows(df, 4)
    told = PrefixTree(depth=DEPTH, least=LEAST).fit(windows).transform(windows)
    names = F.array(*map(F.lit, encoder.learnt["events"]))
    name = lambda c: F.get(names, F.col(c).cast("int"))
    return told.select("user_id", F.col("window_no").cast("bigint").alias("window_no"), name("target").alias("target"), name("prediction").alias("pred"), F.round("share", 6).alias("share"), F.col("context_size").cast("bigint").alias("context_size"))


_HOPS = f"""WITH x AS (SELECT user_id, ts, event_id, value, coalesce(lead(event_type) OVER ({W}), 'EOS') AS y, lag(event_type) OVER ({W}) || '→' || event_type AS kind, (us - lag(us) OVER ({W})) / 1e6 AS gap FROM log),
n AS (SELECT kind, y, count(*) AS n FROM x WHERE kind IS NOT NULL GROUP BY kind, y),
h AS (SELECT kind, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS own FROM n GROUP BY kind),
a AS (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS whole FROM (SELECT y, sum(n) AS n FROM n GROUP BY y)),
w AS (SELECT kind, greatest(1 - own / whole, 0) AS weight FROM h, a),
e AS (SELECT user_id, ts, event_id, value, coalesce(exp(-0.0001 * gap) * weight, 0) AS c FROM x LEFT JOIN w USING (kind)),
one AS (SELECT *, coalesce(c * lag(value) OVER ({W}), 0) AS h1 FROM e)
SELECT event_id, round(1000 * h1, 6) AS hop_1, round(1000000 * coalesce(c * lag(h1) OVER ({W}), 0), 6) AS hop_2 FROM one"""


@query(_HOPS)
def two_hop_messages(spark, d):
    """Messages of one and two steps, weighted by time and by what the kind of transition tells."""
    w = SPEC.ordered()
    df = log(spark, d).withColumn("kind", F.concat(F.lag("event_type").over(w), F.lit("→"), F.col("event_type"))).withColumn("y", F.coalesce(F.lead("event_type").over(w), F.lit("EOS")))
    weights = graphs.kind_weights(df, "kind", "y")  # a row for each kind of transition
    rows = df.join(F.broadcast(weights), "kind", "left")
    gap = S.seconds_between(F.col("ts"), F.lag("ts").over(w))
    got = graphs.hop_messages(rows, SPEC, "value", F.exp(-F.lit(0.0001) * gap) * F.col("weight"), 2)
    return got.select("event_id", F.round(1000 * F.col("hop_1"), 6).alias("hop_1"), F.round(1_000_000 * F.col("hop_2"), 6).alias("hop_2"))


@query("WITH s AS (SELECT *, CAST(concat('0x', substring(md5('42:' || CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM log), t AS (SELECT *, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM s) SELECT split, count(*) AS n, sum(k) AS total FROM t WHERE split <> 'train' OR k >= 50 GROUP BY split")
def committed_splits(spark, d):
    """Splits written with a manifest, one of them replaced by itself, read as a whole table."""
    path = scratch(spark, "splits")
    df = splits.hash_split(log(spark, d), "user_id").select("event_id", "k", "split")
    committed.write(df, path, ["split"])
    committed.write(df.where("split = 'train' AND k >= 50"), path, ["split"], only_parts=True)
    if not committed.ready(spark, path, df.schema):
        raise RuntimeError("the table isn't whole")
    return committed.read(spark, path).groupBy("split").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query()
def fitted_attention(spark, d):
    """Each edge's share of a case, by what a fitted classifier's coefficients make of its messages. The fit is
    a regression, which SQL can't tell; tests/test_stages.py holds the shares against its coefficients."""
    df, encoder = encoded(spark, d)
    # The fit and the scores read the encoded log five times; kept on disk, it also keeps its deal and order.
    coded = encoder.transform(df).select("user_id", "ts", "event_id", "label", "next_label", "kind", "features", "case_features").persist(StorageLevel.DISK_ONLY)
    model = HopClassifier(case="user_id", time="ts", tie="event_id", mode="time_decay_status", hops=2, decay=0.0001, maxIter=10).fit(coded)
    return model.edge_scores(coded).select("user_id", "event_id", "score", "importance")
