"""Queries on importance, predictions and boards, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import attention as A
from ..operators import boards, metrics, sequences
from .log_queries import SPEC, SQL, Q, W, log, query

_ATT = f"""WITH att AS (SELECT user_id, event_id, event_type, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, value / max(value) OVER (PARTITION BY user_id) * exp(-0.01 * k) AS imp FROM log),
lens AS (SELECT DISTINCT user_id, n FROM att),
rng AS (SELECT bin, floor(q[bin + 1]) AS lo, ceil(q[bin + 2]) + 1 AS hi FROM (SELECT quantile_cont(n, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM lens), (SELECT unnest(range(0, 4)) AS bin)),
cb AS (SELECT user_id, n, min(bin) AS bin FROM lens JOIN rng ON n >= lo AND n < hi GROUP BY user_id, n),
ab AS (SELECT att.*, bin FROM att JOIN cb USING (user_id)),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY imp DESC, pos) AS rank FROM ab) WHERE rank <= 3)
"""


def points(spark, d):
    """Pseudo-importance of each event: its value over the case's largest, decayed by k."""
    imp = F.col("value") / F.max("value").over(SPEC.whole()) * F.exp(F.lit(-0.01) * F.col("k"))
    return log(spark, d).select("user_id", "event_id", "event_type", (F.row_number().over(SPEC.ordered()) - 1).cast("bigint").alias("pos"), F.count("*").over(SPEC.whole()).alias("n"), imp.alias("imp"))


def binned(spark, d):
    lens = log(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    ranges = A.quantile_edges(lens, "n", 4)
    return A.in_ranges(points(spark, d), "n", ranges), A.in_ranges(lens, "n", ranges)


@query(_ATT + "SELECT user_id, pos, round(imp, 6) AS imp FROM att")
def attention_long(spark, d):
    return points(spark, d).select("user_id", "pos", F.round("imp", 6).alias("imp"))


@query("SELECT event_id, round((value / 100 + k / 100.0 + 0.5) / 3, 6) AS weight, round(CASE WHEN k % 2 = 0 THEN (k / 100.0 + 1) / 2 ELSE 1 END, 6) AS decay FROM log")
def head_means(spark, d):
    """Weights of three heads as one, and decays where there are any."""
    share = F.col("k") / 100
    rows = log(spark, d).select("event_id", F.array(F.col("value") / 100, share, F.lit(0.5)).alias("weights"), F.when(F.col("k") % 2 == 0, F.array(share, F.lit(1.0))).alias("decays"))
    return rows.select("event_id", F.round(A.over_heads(F.col("weights")), 6).alias("weight"), F.round(A.decay_or_one(F.col("decays")), 6).alias("decay"))


@query(_ATT + ", t AS (SELECT max(n) // 10 AS top FROM lens), b AS (SELECT unnest(range(0, top + 1)) AS bin FROM t) SELECT bin * 10 AS min_len, (bin + 1) * 10 AS max_len, count(user_id) AS n FROM b LEFT JOIN lens ON lens.n // 10 = bin GROUP BY bin")
def length_bins(spark, d):
    return A.length_bins(points(spark, d).select("user_id", "n").distinct(), "n", 10)


@query(_ATT + "SELECT r.bin, CAST(lo AS BIGINT) AS min_len, CAST(hi AS BIGINT) AS max_len, count(user_id) AS n FROM rng r LEFT JOIN cb ON cb.bin = r.bin GROUP BY ALL")
def quantile_bins(spark, d):
    lens = points(spark, d).select("user_id", "n").distinct()
    ranges = A.quantile_edges(lens, "n", 4)
    counts = A.in_ranges(lens, "n", ranges).groupBy("bin").count()
    return ranges.join(F.broadcast(counts), "bin", "left").select(F.col("bin").cast("bigint").alias("bin"), F.col("min_len").cast("bigint").alias("min_len"), F.col("max_len").cast("bigint").alias("max_len"), F.coalesce("count", F.lit(0)).alias("n"))


@query(_ATT + ", s AS (SELECT bin, rank, pos, count(*) AS hits, sum(imp) AS total FROM tp GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY bin, rank ORDER BY hits DESC, pos) AS o, sum(hits) OVER (PARTITION BY bin, rank) AS n, sum(total) OVER (PARTITION BY bin, rank) AS tt FROM s) SELECT bin, rank, pos AS node, round(100.0 * hits / n, 2) AS percent, round(tt / n, 4) AS mean_importance FROM r WHERE o = 1")
def rank_dominance(spark, d):
    got = A.dominance(A.top_positions(binned(spark, d)[0], "user_id"))
    return got.select(F.col("bin").cast("bigint").alias("bin"), F.col("rank").cast("bigint").alias("rank"), "node", F.col("percent").cast("double").alias("percent"), "mean_importance")


@query(_ATT + ", r AS (SELECT bin, rank, sum(imp) AS total, count(imp) AS n FROM tp GROUP BY bin, rank), s AS (SELECT DISTINCT bin, rank, pos FROM tp) SELECT bin, pos, round(sum(total) / sum(n), 6) AS mean_importance FROM s JOIN r USING (bin, rank) GROUP BY bin, pos")
def importance_heatmap(spark, d):
    got = A.heatmap_long(A.top_positions(binned(spark, d)[0], "user_id"))
    return got.select(F.col("bin").cast("bigint").alias("bin"), "pos", F.round("mean_importance", 6).alias("mean_importance"))


Q["importance_heatmap_long"], SQL["importance_heatmap_long"] = importance_heatmap, SQL["importance_heatmap"]


@query(_ATT + ", c AS (SELECT bin, count(*) AS m FROM cb GROUP BY bin) SELECT bin, pos, round(avg(imp), 6) AS mean_importance, count(*) AS hits, round(count(*) / any_value(m), 6) AS frequency FROM tp JOIN c USING (bin) GROUP BY bin, pos")
def critical_windows(spark, d):
    p, lens = binned(spark, d)
    got = A.critical_windows(A.top_positions(p, "user_id"), lens)
    return got.select(F.col("bin").cast("bigint").alias("bin"), "pos", F.round("mean_importance", 6).alias("mean_importance"), "hits", F.round("frequency", 6).alias("frequency"))


_WM = _ATT + ", p AS (SELECT user_id, bin, n, max(imp) AS peak, arg_min(pos, (-imp, pos)) AS top_pos FROM ab GROUP BY ALL), wm AS (SELECT p.user_id, p.bin, peak, count(*) FILTER (WHERE imp > 0.5 * peak) / any_value(p.n) AS span, any_value(top_pos) / any_value(p.n) AS peak_at FROM p JOIN ab USING (user_id) GROUP BY p.user_id, p.bin, peak)"


@query(_WM + " SELECT user_id, bin, round(peak, 6) AS peak, round(span, 6) AS span, round(peak_at, 6) AS peak_at FROM wm")
def window_metrics(spark, d):
    got = A.window_metrics(binned(spark, d)[0], "user_id")
    return got.select("user_id", F.col("bin").cast("bigint").alias("bin"), *(F.round(c, 6).alias(c) for c in ("peak", "span", "peak_at")))


@query(_WM + " SELECT bin, count(*) AS n, round(median(peak), 6) AS median_peak, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS sd_{c}" for c in ("peak", "span", "peak_at")) + " FROM wm GROUP BY bin")
def window_metrics_summary(spark, d):
    got = A.summary(A.window_metrics(binned(spark, d)[0], "user_id"))
    return got.select(F.col("bin").cast("bigint").alias("bin"), "n", *(F.round(c, 6).alias(c) for c in got.columns if c not in ("bin", "n")))


_TT = _WM + ", g AS (SELECT bin, count(*) AS n, avg(peak) AS m, var_samp(peak) AS v FROM wm GROUP BY bin HAVING count(*) > 1), pr AS (SELECT a.bin AS bin_a, b.bin AS bin_b, a.n + b.n - 2 AS df, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS sp, a.m - b.m AS dm, a.n AS na, b.n AS nb FROM g a JOIN g b ON a.bin < b.bin)"


@query(_TT + " SELECT bin_a, bin_b, round(dm / sp / sqrt(1 / na + 1 / nb), 6) AS t, round(dm / sp, 6) AS d, df FROM pr WHERE sp > 0")
def pairwise_ttest(spark, d):
    got = A.pairwise_t(A.window_metrics(binned(spark, d)[0], "user_id"))
    return got.select(F.col("bin_a").cast("bigint").alias("bin_a"), F.col("bin_b").cast("bigint").alias("bin_b"), F.round("t", 6).alias("t"), F.round("d", 6).alias("d"), "df")


#: p by Simpson's rule over the density, in the angle whose tangent is t over the root of df.
_P = """, tx AS (SELECT bin_a, bin_b, df, dm / sp AS d, dm / sp / sqrt(1 / na + 1 / nb) AS t FROM pr WHERE sp > 0),
ti AS (SELECT *, (unnest(range(0, 20001)) + 0.0) / 20000 AS u FROM tx),
ty AS (SELECT bin_a, bin_b, df, d, t, sum((CASE WHEN u = 0 OR u = 1 THEN 1 WHEN CAST(round(u * 20000) AS INTEGER) % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(atan(abs(t) / sqrt(df)) * u), df - 1)) * atan(abs(t) / sqrt(df)) / 60000 AS area, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) * 2 / sqrt(pi()) AS c FROM ti GROUP BY bin_a, bin_b, df, d, t),
tp_ AS (SELECT bin_a, bin_b, d, round(greatest(1 - c * area, 0), 5) AS p, CAST(1 - c * area < 0.45 AS INTEGER) + CAST(1 - c * area < 0.225 AS INTEGER) AS stars FROM ty)"""


@query(_TT + _P + " SELECT bin_a, bin_b, stars, p, round(d, 6) AS d FROM tp_ WHERE stars > 0 ORDER BY stars DESC, p, d DESC LIMIT 3")
def top_significant(spark, d):
    """The comparisons with the most stars, then the least p, then the largest d (stars from p < 0.45 on, as
    the events' values are drawn alike in all bins)."""
    tests = A.with_stars(A.pairwise_t(A.window_metrics(binned(spark, d)[0], "user_id")), alpha=0.9).withColumn("p", F.round("p", 5))
    got = A.top_comparisons(tests, 3).select("*", F.length("stars").alias("n_stars")).drop("stars").withColumnRenamed("n_stars", "stars")
    return got.select("stars", "p", F.col("bin_a").cast("bigint").alias("bin_a"), F.col("bin_b").cast("bigint").alias("bin_b"), F.round("d", 6).alias("d"))


@query(_ATT + ", e AS (SELECT event_type, count(*) AS n, corr(n, imp) AS r FROM att GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 3) SELECT event_type, n, round(r, 6) AS r FROM e WHERE n > 10 UNION ALL SELECT 'all', count(*), round(corr(n, imp), 6) FROM att")
def edge_correlation(spark, d):
    p = points(spark, d).withColumnRenamed("n", "length")
    return A.correlation(p, "event_type", "length", "imp").select("event_type", "n", F.round("r", 6).alias("r"))


@query(_ATT + ", f AS (SELECT user_id FROM lens WHERE n >= 50 AND n <= 90 ORDER BY user_id LIMIT 1) SELECT pos, event_type, round(imp, 6) AS imp FROM att JOIN f USING (user_id)")
def importance_timeline(spark, d):
    p = points(spark, d)
    first = p.where("n BETWEEN 50 AND 90").agg(F.min("user_id").alias("user_id"))
    return p.join(F.broadcast(first), "user_id").select("pos", "event_type", F.round("imp", 6).alias("imp"))


@query(_ATT + "SELECT user_id, n FROM lens WHERE n >= 50 AND n <= 90 ORDER BY user_id LIMIT 1")
def first_long_sequence(spark, d):
    return points(spark, d).select("user_id", "n").distinct().where("n BETWEEN 50 AND 90").orderBy("user_id").limit(1)


# Predictions: the next event is said to be the present one; second choice is 'click'.

_PRED = f"WITH p AS (SELECT user_id, row_number() OVER ({W}) - 1 AS pos, coalesce(lead(event_type) OVER ({W}), 'EOS') AS label, event_type AS pred FROM log)"


def predictions(spark, d):
    df = sequences.next_events(log(spark, d), SPEC)
    return df.select("user_id", (F.row_number().over(SPEC.ordered()) - 1).cast("bigint").alias("pos"), F.col("next_event").alias("label"), F.col("event_type").alias("pred"))


@query(_PRED + ", t AS (SELECT label AS class, count(*) AS support, count(*) FILTER (WHERE label = pred) AS hit FROM p GROUP BY label), s AS (SELECT pred AS class, count(*) AS said FROM p GROUP BY pred), b AS (SELECT coalesce(t.class, s.class) AS class, coalesce(support, 0) AS support, coalesce(hit, 0) AS hit, coalesce(said, 0) AS said FROM t FULL JOIN s ON t.class = s.class) SELECT class, round(CASE WHEN said = 0 THEN 0 ELSE hit / said END, 6) AS precision, round(CASE WHEN support = 0 THEN 0 ELSE hit / support END, 6) AS recall, round(CASE WHEN hit = 0 THEN 0 ELSE 2.0 * hit / (said + support) END, 6) AS f1, support FROM b")
def classification_report(spark, d):
    return metrics.report(predictions(spark, d), "label", "pred").select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(_PRED + " SELECT 'position' AS kind, CAST(pos AS VARCHAR) AS item, count(*) AS n FROM p WHERE label <> pred GROUP BY pos UNION ALL SELECT 'pair', pred || '>' || label, count(*) FROM p WHERE label <> pred GROUP BY pred, label")
def sequence_errors(spark, d):
    p = predictions(spark, d)
    a = metrics.errors_by_position(p, "pos", "label", "pred").select(F.lit("position").alias("kind"), F.col("pos").cast("string").alias("item"), F.col("errors").alias("n"))
    b = metrics.confusion(p.where("label <> pred"), "label", "pred").select(F.lit("pair"), F.concat("pred", F.lit(">"), "label"), "n")
    return a.union(b)


@query(_PRED + " SELECT user_id, count(*) AS n, count(*) FILTER (WHERE label = pred) AS hits, bool_and(label = pred) AS exact FROM p GROUP BY user_id")
def sequence_metrics(spark, d):
    s = metrics.sequences(predictions(spark, d), "user_id", "pos", "label", "pred")
    same = F.zip_with("label", "pred", lambda a, b: a == b)
    return s.select("user_id", F.size("label").cast("bigint").alias("n"), F.size(F.filter(same, lambda x: x)).cast("bigint").alias("hits"), F.forall(same, lambda x: x).alias("exact"))


@query(_PRED + ", c AS (SELECT user_id, bool_and(label = pred OR label = 'click') AS all_in FROM p GROUP BY user_id) SELECT round(avg(all_in :: INT), 6) AS accuracy, count(*) AS n FROM c")
def sequence_topk_accuracy(spark, d):
    p = predictions(spark, d).withColumn("topk", F.array("pred", F.lit("click")))
    per = p.groupBy("user_id").agg(F.bool_and(F.array_contains("topk", F.col("label"))).alias("all_in"))
    return per.agg(F.round(F.avg(F.col("all_in").cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


@query("WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM x), h AS (SELECT vec_id, bool_or(i = label) AS hit FROM r WHERE k <= 3 GROUP BY vec_id) SELECT round(avg(hit :: INT), 6) AS accuracy, count(*) AS n FROM h")
def top_k_accuracy(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    hit = F.array_contains(metrics.top_k(F.col("embedding"), 3), F.col("label"))
    return e.agg(F.round(F.avg(hit.cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


@query(_PRED + " SELECT pred || '>' || label AS pair, count(*) AS n FROM p WHERE label <> pred AND label <> 'click' GROUP BY ALL ORDER BY n DESC, pair LIMIT 5")
def topk_sequence_analysis(spark, d):
    p = predictions(spark, d).where(~F.array_contains(F.array("pred", F.lit("click")), F.col("label")))
    return p.groupBy(F.concat("pred", F.lit(">"), "label").alias("pair")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(5)


def error_components(spark, d):
    """Rows whose largest component isn't their label, on two principal components (no SQL:
    the components come from an iterative solver)."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    best = F.get(metrics.top_k(F.col("embedding"), 1), F.lit(0))
    return metrics.error_components(e.withColumn("best", best), "label", "best", "embedding").select("vec_id", "label", "best", "components")


Q["error_components"] = error_components


@query(_PRED + " SELECT user_id FROM p GROUP BY user_id HAVING bool_or(label <> pred) ORDER BY user_id LIMIT 3")
def error_sequences(spark, d):
    s = metrics.sequences(predictions(spark, d), "user_id", "pos", "label", "pred")
    wrong = F.exists(F.zip_with("label", "pred", lambda a, b: a != b), lambda x: x)
    return s.where(wrong).select("user_id").orderBy("user_id").limit(3)


@query(f"WITH v AS (SELECT e, chr(CAST(64 + row_number() OVER (ORDER BY e) AS INTEGER)) AS c FROM (SELECT DISTINCT event_type AS e FROM log UNION SELECT 'EOS')), q AS (SELECT user_id, ts, event_id, event_type AS pred, coalesce(lead(event_type) OVER ({W}), 'EOS') AS label FROM log), p AS (SELECT user_id, ts, event_id, x.c AS b, y.c AS a FROM q JOIN v x ON x.e = pred JOIN v y ON y.e = label), s AS (SELECT user_id, string_agg(a, '' ORDER BY ts, event_id) AS t, string_agg(b, '' ORDER BY ts, event_id) AS g FROM p GROUP BY user_id) SELECT user_id, round(1 - damerau_levenshtein(g, t) / greatest(length(g), length(t)), 6) AS similarity, g = t AS exact FROM s")
def dls_exact_match(spark, d):
    s = metrics.sequences(predictions(spark, d), "user_id", "pos", "label", "pred")
    return s.select("user_id", F.round(metrics.similarity("pred", "label"), 6).alias("similarity"), (F.col("pred") == F.col("label")).alias("exact"))


_BLEU = _PRED + ", s AS (SELECT user_id, list(label ORDER BY pos) AS t, list(pred ORDER BY pos) AS p FROM p GROUP BY user_id), n AS (SELECT user_id, t, p, unnest(range(1, 5)) AS n FROM s), g AS (SELECT user_id, n, list_transform(range(1, CAST(len(p) - n + 2 AS BIGINT)), lambda i: array_to_string(p[i : i + n - 1], ' ')) AS hp, list_transform(range(1, CAST(len(t) - n + 2 AS BIGINT)), lambda i: array_to_string(t[i : i + n - 1], ' ')) AS ht FROM n WHERE n <= least(len(p), len(t))), a AS (SELECT user_id, n, x, count(*) AS c FROM (SELECT user_id, n, unnest(hp) AS x FROM g) GROUP BY ALL), b AS (SELECT user_id, n, x, count(*) AS c FROM (SELECT user_id, n, unnest(ht) AS x FROM g) GROUP BY ALL), m AS (SELECT a.user_id, a.n, sum(least(a.c, coalesce(b.c, 0))) AS hit, sum(a.c) AS total FROM a LEFT JOIN b USING (user_id, n, x) GROUP BY a.user_id, a.n), l AS (SELECT user_id, avg(ln((CASE WHEN hit > 0 THEN hit ELSE 0.1 END) / total)) AS lg, max(CASE WHEN n = 1 THEN hit END) AS one FROM m GROUP BY user_id)"


@query(_BLEU + " SELECT round(avg(CASE WHEN one = 0 THEN 0 ELSE exp(lg) * (CASE WHEN len(p) > len(t) THEN 1 ELSE exp(1 - len(t) / len(p)) END) END), 6) AS bleu, count(*) AS n FROM l JOIN s USING (user_id)")
def bleu(spark, d):
    return metrics.bleu(metrics.sequences(predictions(spark, d), "user_id", "pos", "label", "pred"), "pred", "label").select(F.round("bleu", 6).alias("bleu"), "n")


# Boards: a position for each user of the log, told by digests of its id. Half of the squares are empty;
# there are more kings than in a game, so pins and checks are many.

_DIGITS, _LETTERS = "0123456789abcdef", "........PpNbRqKk"
_SQ = f"""WITH u AS (SELECT user_id, count(*) AS n FROM log GROUP BY user_id),
h AS (SELECT user_id AS pos_id, n, translate(md5(CAST(user_id AS VARCHAR) || ':0') || md5(CAST(user_id AS VARCHAR) || ':1'), '{_DIGITS}', '{_LETTERS}') AS x FROM u),
f AS (SELECT pos_id, replace(replace(replace(array_to_string(list_transform(range(0, 8), lambda r: substr(x, CAST(8 * r + 1 AS BIGINT), 8)), '/'), '....', '4'), '..', '2'), '.', '1') || CASE WHEN n % 2 = 0 THEN ' w ' ELSE ' b ' END || CASE n % 3 WHEN 0 THEN 'KQkq' WHEN 1 THEN 'Kq' ELSE '-' END || ' - 0 1' AS fen FROM h),
"""+r"""b AS (SELECT pos_id, fen, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(fen, ' ', 1), '1', '.', 'g'), '2', '..', 'g'), '3', '...', 'g'), '4', '....', 'g'), '5', '.....', 'g'), '6', '......', 'g'), '7', '.......', 'g'), '8', '........', 'g'), '/', '') AS s FROM f),
n AS (SELECT pos_id, fen, (7 - i // 8) * 8 + i % 8 AS sq, replace(substr(s, i + 1, 1), '.', '') AS piece FROM b, (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS i)),
nodes AS (SELECT pos_id, sq, piece, CASE WHEN piece = '' THEN 0 ELSE instr('pnbrqk', lower(piece)) END AS piece_type, CASE WHEN piece = '' THEN -1 WHEN piece = lower(piece) THEN 0 ELSE 1 END AS colour, (split_part(fen, ' ', 2) = 'w') :: INT AS turn, (instr(split_part(fen, ' ', 3), 'K') > 0) :: INT AS castle_wk, (instr(split_part(fen, ' ', 3), 'Q') > 0) :: INT AS castle_wq, (instr(split_part(fen, ' ', 3), 'k') > 0) :: INT AS castle_bk, (instr(split_part(fen, ' ', 3), 'q') > 0) :: INT AS castle_bq FROM n),
geo AS (SELECT * FROM (VALUES """ + ", ".join(f"('{p}', {r}, {f}, {k})" for p, r, f, k in boards.geometry()) + """) g(shape, dr, df, reach)),
ray AS (SELECT pos_id, sq AS src, piece, colour, dr, df, step, (sq // 8 + dr * step) * 8 + sq % 8 + df * step AS dst FROM nodes JOIN geo ON shape = CASE WHEN piece = 'P' THEN 'P' ELSE lower(piece) END, (SELECT unnest(range(1, 8)) AS step) WHERE piece <> '' AND step <= reach AND sq // 8 + dr * step BETWEEN 0 AND 7 AND sq % 8 + df * step BETWEEN 0 AND 7),
held AS (SELECT pos_id, sq AS dst, colour AS c2, lower(piece) AS p2 FROM nodes WHERE piece <> ''),
att AS (SELECT r.pos_id, src, r.dst, colour FROM (SELECT *, (SELECT count(*) FROM ray q JOIN held h ON h.pos_id = q.pos_id AND h.dst = q.dst WHERE q.pos_id = r0.pos_id AND q.src = r0.src AND q.dr = r0.dr AND q.df = r0.df AND q.step < r0.step) AS b FROM ray r0) r WHERE b = 0),
line AS (SELECT r.*, c2, p2, row_number() OVER w AS nth, lag(r.dst) OVER w AS fst, lag(c2) OVER w AS fc FROM ray r JOIN held h ON h.pos_id = r.pos_id AND h.dst = r.dst WHERE lower(piece) IN ('b', 'r', 'q') WINDOW w AS (PARTITION BY r.pos_id, src, dr, df ORDER BY step)),
pin AS (SELECT pos_id, src AS attacker, fst AS pinned FROM line WHERE nth = 2 AND p2 = 'k' AND c2 <> colour AND fc = c2)
"""


def positions(spark, d):
    """pos_id, fen: the user's number of events tells the side to move and the rights."""
    users = log(spark, d).groupBy(F.col("user_id").alias("pos_id")).agg(F.count("*").alias("n"))
    key = F.col("pos_id").cast("string")
    letters = F.translate(F.concat(F.md5(F.concat(key, F.lit(":0"))), F.md5(F.concat(key, F.lit(":1")))), _DIGITS, _LETTERS)
    board = F.concat_ws("/", *(F.substring(letters, 8 * r + 1, 8) for r in range(8)))
    for dots, digit in (("....", "4"), ("..", "2"), (".", "1")):
        board = F.replace(board, F.lit(dots), F.lit(digit))
    side, n = F.when(F.col("n") % 2 == 0, " w ").otherwise(" b "), F.col("n") % 3
    return users.select("pos_id", F.concat(board, side, F.when(n == 0, "KQkq").when(n == 1, "Kq").otherwise("-"), F.lit(" - 0 1")).alias("fen"))


@query(_SQ + "SELECT * FROM nodes")
def board_nodes(spark, d):
    return boards.squares(positions(spark, d))


@query(_SQ + "SELECT pos_id, src, CAST(dst AS INTEGER) AS dst FROM att")
def board_attacks(spark, d):
    return boards.attacks(positions(spark, d)).select("pos_id", "src", "dst")


@query(_SQ + "SELECT pos_id, attacker, CAST(pinned AS INTEGER) AS pinned FROM pin")
def board_pins(spark, d):
    return boards.pins(positions(spark, d))


@query(_SQ + "SELECT pos_id, src, CAST(dst AS INTEGER) AS dst, 1 AS edge_type FROM att UNION ALL SELECT pos_id, attacker, CAST(pinned AS INTEGER), 2 FROM pin UNION ALL SELECT DISTINCT pos_id, 0, 0, 0 FROM nodes WHERE pos_id NOT IN (SELECT pos_id FROM att)")
def board_edges(spark, d):
    return boards.edges(positions(spark, d))


@query(_SQ + "SELECT DISTINCT a.pos_id FROM att a JOIN nodes n ON n.pos_id = a.pos_id AND n.sq = a.dst WHERE n.colour <> a.colour AND ((n.piece = 'K' AND n.turn = 1) OR (n.piece = 'k' AND n.turn = 0))")
def board_checks(spark, d):
    """Positions whose side to move is in check."""
    return boards.checks(positions(spark, d))


@query(_SQ + ", c AS (SELECT pos_id, src, count(*) AS n FROM att GROUP BY pos_id, src) SELECT n.pos_id, sq, piece, chr(CAST(97 + sq % 8 AS INTEGER)) || CAST(sq // 8 + 1 AS VARCHAR) AS name, coalesce(c.n, 0) AS n_attacks FROM nodes n LEFT JOIN c ON c.pos_id = n.pos_id AND c.src = n.sq")
def position_view(spark, d):
    """Every square with its name and what its piece attacks."""
    p = positions(spark, d)
    n = boards.attacks(p).groupBy("pos_id", F.col("src").alias("sq")).agg(F.count("*").alias("n"))
    return boards.squares(p).join(n, ["pos_id", "sq"], "left").select("pos_id", "sq", "piece", S.square_name(F.col("sq")).alias("name"), F.coalesce("n", F.lit(0)).alias("n_attacks"))


@query(_SQ + "SELECT sq, chr(CAST(97 + sq % 8 AS INTEGER)) || CAST(sq // 8 + 1 AS VARCHAR) AS name, count(*) AS held FROM nodes WHERE piece <> '' GROUP BY sq")
def square_names(spark, d):
    """The squares that pieces stand on, by name, and in how many positions."""
    held = boards.squares(positions(spark, d)).where("piece <> ''").groupBy("sq").agg(F.count("*").alias("held"))
    return held.select("sq", S.square_name(F.col("sq")).alias("name"), "held")
