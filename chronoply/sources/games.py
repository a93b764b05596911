"""Game archives, puzzle tables and event logs as DataFrames.

Compressed text (zst, gz) is read by Spark itself; such a file is one split, so the readers
deal its rows out again before any work on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import sequences, splits
from ..spec import LogSpec
from . import committed
from .pgn import read_pgn

PUZZLES = "PuzzleId string, FEN string, Moves string, Rating int, RatingDeviation int, Popularity int, NbPlays int, Themes string, GameUrl string, OpeningTags string"
_SAN = r"((?:[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?|O-O-O|O-O)[+#]?)[!?]*\s*(?:\{([^}]*)\})?"


def events_csv(spark: SparkSession, path: str, spec: LogSpec) -> DataFrame:
    """A log with a header line; missing columns are an error."""
    return spec.validate(spark.read.csv(path, header=True, inferSchema=True))


def puzzles(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    df = spark.read.schema(PUZZLES).csv(path, header=True)
    return df.repartition(partitions) if partitions else df


def with_theme(df: DataFrame, low: int, high: int, *, strict: bool = False, themes: str = "Themes") -> DataFrame:
    """Puzzles of mate in ``low`` to ``high``. Loose: a theme's beginning is enough, so mate in
    1 also finds mate in 10. Rows without themes never match."""
    names = [f"mateIn{n}" for n in range(low, high + 1)]
    whole = F.arrays_overlap(F.split(themes, r"\s+"), F.array(*map(F.lit, names)))
    return df.where(F.coalesce(whole if strict else F.col(themes).rlike("|".join(names)), F.lit(False)))


def first_puzzles(df: DataFrame, n: int, key: str = "PuzzleId") -> DataFrame:
    """The ``n`` rows of least key: the same rows however the file is split."""
    return df.orderBy(key).limit(n)


def external_games(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """The ``pgn`` column of a CSV with line ends in its fields; ``n`` counts rows without one too."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if "pgn" not in df.columns:
        raise ValueError(f"No column pgn; there are {df.columns}")
    return (df.limit(n) if n else df).select(F.col("pgn").alias("text")).where("text IS NOT NULL")


def archive(spark: SparkSession, path: str, partitions: int | None = None, *, headers: Sequence[str] = ()) -> DataFrame:
    """game_id, text and the asked headers: one row for each game of a PGN archive. The id is the game's
    file and its first byte there, so equal games keep apart."""
    df = read_pgn(spark, path, headers).select(F.concat_ws("#", "file", "at").alias("game_id"), "text", *headers)
    return df.repartition(partitions, "game_id") if partitions else df


def header(text: Column, name: str) -> Column:
    """A tag's value, or null."""
    found = F.regexp_extract(text, rf'\[{name} "([^"]*)"\]', 1)
    return F.when(found != "", found)


def with_headers(games: DataFrame, *names: str) -> DataFrame:
    return games.select("*", *(header(F.col("text"), n).alias(n) for n in names))


def moves(games: DataFrame, *keep: str) -> DataFrame:
    """game_id, ply (from 0), colour, san, comment, clock_s, eval_pawns, eval_mate of each main-line move."""
    body = F.regexp_replace(F.regexp_replace("text", r'(?m)^\[\w+ "[^"]*"\]\s*', ""), r"\([^()]*\)", "")
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(_SAN), F.lit(1)).alias("san"), F.regexp_extract_all(body, F.lit(_SAN), F.lit(2)).alias("comment"))
    rows = games.select("game_id", *keep, F.posexplode(pairs).alias("ply", "m"))
    pawns, mate = S.parse_eval(F.col("m.comment"))
    colour = F.when(F.col("ply") % 2 == 0, "white").otherwise("black")
    return rows.select("game_id", *keep, "ply", colour.alias("colour"), F.col("m.san").alias("san"), F.col("m.comment").alias("comment"), S.parse_clock(F.col("m.comment")).alias("clock_s"), pawns.alias("eval_pawns"), mate.alias("eval_mate"))


def mate_moves(moved: DataFrame, low: int = 1, high: int = 10, *, either_side: bool = False) -> DataFrame:
    """Moves annotated with a mate in ``low`` to ``high``: for the side to move, or for either side."""
    n = F.abs("eval_mate") if either_side else F.col("eval_mate")
    return moved.where(F.instr("comment", "#") > 0).where(n.between(low, high))


def seconds_by_rating(games: DataFrame, *, size: int = 100, least: int = 20) -> DataFrame:
    """bucket, avg_s, n: the mean time per move by half-even rating bucket.

    Games with a missing, zero or odd rating are left out, and buckets of fewer than ``least`` moves.
    """
    tagged = with_headers(games, "WhiteElo", "BlackElo", "TimeControl")
    tagged = tagged.withColumns({c: F.col(c).try_cast("int") for c in ("WhiteElo", "BlackElo")}).where("WhiteElo <> 0 AND BlackElo <> 0")
    moved = moves(tagged, "WhiteElo", "BlackElo", "TimeControl")
    spent = sequences.clock_spent(moved, "game_id", "colour", "ply", "clock_s", S.parse_increment(F.col("TimeControl")))
    rating = F.when(F.col("colour") == "white", F.col("WhiteElo")).otherwise(F.col("BlackElo"))
    return spent.groupBy(S.half_even_bucket(rating, size).alias("bucket")).agg(F.round(F.avg("spent"), 2).alias("avg_s"), F.count("*").alias("n")).where(F.col("n") >= least)


def write_rating_table(table: DataFrame, path: str) -> None:
    table.select(F.col("bucket").cast("string").alias("bucket"), "avg_s").write.mode("overwrite").json(path)


def read_rating_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket string, avg_s double").json(path).select(F.col("bucket").cast("bigint").alias("bucket"), "avg_s")


def with_played_best(df: DataFrame, played: str, best: str) -> DataFrame:
    """Rows whose played move is the best one. A missing move is no match; those left out are counted
    by :func:`played_best_counts`."""
    return df.where(F.coalesce(F.col(played) == F.col(best), F.lit(False)))


def played_best_counts(df: DataFrame, played: str, best: str) -> DataFrame:
    """One row: kept, skipped."""
    same = F.coalesce(F.col(played) == F.col(best), F.lit(False))
    return df.agg(F.count_if(same).alias("kept"), F.count_if(~same).alias("skipped"))


def puzzle_splits(df: DataFrame, low: int = 1, high: int = 5, *, most: int | None = None, seed: int = 42, key: str = "PuzzleId") -> DataFrame:
    """Puzzles of mate in ``low`` to ``high`` with ``mate_n`` and ``split``: 80, 10 and 10 per cent
    of the ids, in the order of a seeded hash. Rows that repeat an id share a split; ``most``
    keeps that many rows of least id."""
    chosen = with_theme(df, low, high)
    chosen = first_puzzles(chosen, most, key) if most else chosen
    made = splits.split_three(chosen.select(key).where(F.col(key).isNotNull()).distinct(), key, seed).select(key, "split")
    return chosen.withColumn("mate_n", S.first_theme_mate(F.col("Themes"))).join(made, key)


def write_splits(df: DataFrame, path: str, split: str = "split", *, only_parts: bool = False) -> None:
    """A folder for each split, and a manifest at the end; a reader of one split never opens the others.
    ``only_parts``: splits that ``df`` has no rows of stay."""
    committed.write(df, path, [split], only_parts=only_parts)


def read_split(spark: SparkSession, path: str, name: str, split: str = "split") -> DataFrame:
    df = committed.read(spark, path, **{split: name})
    if df.isEmpty():
        raise FileNotFoundError(f"No rows of split {name} in {path}")
    return df.drop(split)
