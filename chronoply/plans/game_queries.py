"""Queries of game archives, which Spark makes from the events, with the same in DuckDB SQL.

Each user's events are written as one game: kinds of event stand for moves, ``k`` for clocks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import game_text
from ..functions import scalars as S
from ..operators import sequences
from ..scratch import scratch
from ..sources import games, pgn
from .log_queries import SPEC, W, log, query

_SAN = {"click": "e4", "purchase": "Nf3", "signup": "O-O", "view": "Bxb5+", "error": "e8=Q#"}
_SQL_SAN = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SAN.items()) + " ELSE 'd4' END"


def written_games(spark, d):
    """A path with a PGN archive of the events: tags, clocks on two moves of three, and variations
    in variations, whose moves aren't the game's."""
    kinds = F.create_map(*(F.lit(x) for pair in _SAN.items() for x in pair))
    rows = log(spark, d).select("user_id", "ts", "event_id", "k", F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("d4")).alias("san"))
    cases = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "san", "k"))).alias("s"))
    number = lambda i: F.concat((F.floor(i / 2) + 1).cast("string"), F.when(i % 2 == 0, ". ").otherwise("... "))
    clock = lambda x: F.format_string(" { [%%clk 0:%02d:%02d] }", F.floor(x["k"] / 60).cast("int"), x["k"] % 60)
    aside = F.lit(" ( 1. a3 { [%clk 0:59:59] } ( 1. b3 b6 ) 1... a6 ) $3")
    move = lambda x, i: F.concat(number(i), x["san"], F.when(i % 3 == 2, "").otherwise(clock(x)), F.when(i % 5 == 4, aside).otherwise(""))
    head = F.concat(F.lit('[Event "events"]\n[Site "user '), F.col("user_id").cast("string"), F.lit('"]\n[WhiteElo "'), (1000 + F.col("user_id") % 7 * 100).cast("string"), F.lit('"]\n\n'))
    path = scratch(spark, "pgn")
    cases.select(F.concat(head, F.array_join(F.transform("s", move), " "), F.lit(" 1/2-1/2\n")).alias("value")).write.text(path)
    return path


@query(f"SELECT 'user ' || CAST(user_id AS VARCHAR) AS site, CAST(row_number() OVER ({W}) - 1 AS INTEGER) AS ply, {_SQL_SAN} AS san, CASE WHEN (row_number() OVER ({W}) - 1) % 3 <> 2 THEN k END AS clock_s FROM log WHERE user_id % 7 IN (2, 5)")
def archive_moves(spark, d):
    """Moves of an archive's games of two ratings: the source leaves the other games out, a
    table function makes the rows."""
    chosen = pgn.read_pgn(spark, written_games(spark, d), ["Site", "WhiteElo"]).where(F.col("WhiteElo").isin("1200", "1500"))
    moved = chosen.select("Site", "text").lateralJoin(game_text.annotated_moves(F.col("text").outer(), F.lit("clk")))
    clock = S.parse_clock(F.concat(F.lit("[%clk "), F.col("clk"), F.lit("]")))
    return moved.select(F.col("Site").alias("site"), "ply", "san", clock.cast("int").alias("clock_s"))


@query(f"WITH m AS (SELECT user_id, row_number() OVER ({W}) - 1 AS ply, k FROM log), c AS (SELECT *, CASE WHEN ply % 3 <> 2 THEN k END AS c FROM m), s AS (SELECT user_id, ply, last_value(c IGNORE NULLS) OVER (PARTITION BY user_id, ply % 2 ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - c + 2 AS spent FROM c) SELECT 'user ' || CAST(user_id AS VARCHAR) AS site, count(*) AS n, CAST(sum(spent) AS BIGINT) AS spent FROM s WHERE spent > 0 GROUP BY user_id")
def archive_clock_spent(spark, d):
    """Time spent by game of an archive; a game is told by its file and place."""
    made = games.archive(spark, written_games(spark, d), headers=["Site"])
    moved = made.lateralJoin(game_text.annotated_moves(F.col("text").outer(), F.lit("clk")))
    moved = moved.select("game_id", "Site", "ply", "colour", S.parse_clock(F.concat(F.lit("[%clk "), F.col("clk"), F.lit("]"))).alias("clock_s"))
    spent = sequences.clock_spent(moved, "game_id", "colour", "ply", "clock_s", F.lit(2))
    return spent.groupBy("game_id", F.col("Site").alias("site")).agg(F.count("*").alias("n"), F.sum("spent").cast("bigint").alias("spent")).drop("game_id")


_CODED = "list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda x: CASE length(x) % 4 WHEN 1 THEN 'e4' WHEN 3 THEN 'O-O' ELSE 'move' END)"


@query(f"WITH w AS (SELECT doc_id, unnest(list_filter({_CODED}, lambda x: x <> 'move')) AS san FROM documents) SELECT doc_id, count(*) AS n_moves, count_if(san = 'O-O') AS n_castled FROM w GROUP BY doc_id")
def text_to_moves(spark, d):
    """One row to none or many: the words of documents, coded by their length, some of them as moves."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")
    size = F.length
    coded = F.array_join(F.transform(words, lambda x: F.when(size(x) % 4 == 1, "e4").when(size(x) % 4 == 3, "O-O").otherwise("move")), " ")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", coded.alias("text"))
    game_text.register(spark)
    moved = spark.sql("SELECT d.doc_id, m.san FROM {docs} d, LATERAL annotated_moves(d.text, '') m", docs=docs)
    return moved.groupBy("doc_id").agg(F.count("*").alias("n_moves"), F.count_if(F.col("san") == "O-O").alias("n_castled"))


_THEMES = "SELECT CAST(event_id AS VARCHAR) AS id, 1 + k % 12 AS mate FROM log"


@query(f"WITH t AS ({_THEMES}), c AS (SELECT id, mate FROM t WHERE mate <= 5 OR mate >= 10), r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS p, count(*) OVER () AS n FROM c) SELECT id, CAST(mate AS INTEGER) AS mate_n, CASE WHEN p < floor(n * 0.8) THEN 'train' WHEN p < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM r")
def puzzle_split_job(spark, d):
    """Puzzles of mate in 1 to 5 (by a theme's beginning, so mate in 10 too), split by ids."""
    themes = F.concat(F.lit("long mateIn"), (1 + F.col("k") % 12).cast("string"), F.lit(" endgame"))
    rows = log(spark, d).select(F.col("event_id").cast("string").alias("PuzzleId"), themes.alias("Themes"))
    return games.puzzle_splits(rows, 1, 5).select(F.col("PuzzleId").alias("id"), F.col("mate_n").cast("int").alias("mate_n"), "split")


@query(f"WITH b AS (SELECT event_type, lead(event_type) OVER ({W}) AS best FROM log) SELECT count_if(coalesce(event_type = best, false)) AS kept, count_if(NOT coalesce(event_type = best, false)) AS skipped FROM b")
def played_best(spark, d):
    """Rows whose move is the best one (here: the next), and those left out; a missing move is no match."""
    rows = log(spark, d).withColumn("best", F.lead("event_type").over(SPEC.ordered()))
    return games.played_best_counts(rows, "event_type", "best")


@query(f"WITH b AS (SELECT event_id, event_type, lead(event_type) OVER ({W}) AS best FROM log) SELECT event_id FROM b WHERE event_type = best")
def played_best_rows(spark, d):
    rows = log(spark, d).withColumn("best", F.lead("event_type").over(SPEC.ordered()))
    return games.with_played_best(rows, "event_type", "best").select("event_id")


@query("WITH m AS (SELECT event_id, k % 25 - 12 AS n FROM log WHERE k % 2 = 0) SELECT event_id, n BETWEEN 1 AND 10 AS own FROM m WHERE abs(n) BETWEEN 1 AND 10")
def mate_annotations(spark, d):
    """Moves that an annotation calls a mate in 1 to 10, for the side to move or for the other."""
    n = (F.col("k") % 25 - 12).cast("int")
    said = F.when(F.col("k") % 2 == 0, F.format_string("[%%eval #%d] [%%clk 0:01:00]", n)).otherwise(F.format_string("[%%eval %d.5]", n))
    rows = log(spark, d).select("event_id", said.alias("comment"))
    pawns, mate = S.parse_eval(F.col("comment"))
    moved = rows.withColumns({"eval_pawns": pawns, "eval_mate": mate})
    either, own = games.mate_moves(moved, either_side=True), games.mate_moves(moved).select("event_id", F.lit(True).alias("own"))
    return either.select("event_id").join(own, "event_id", "left").select("event_id", F.coalesce("own", F.lit(False)).alias("own"))
