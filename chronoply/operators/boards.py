"""Board positions as tables: squares, attacks and pins from FEN, by geometry inside each row."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Piece letters in the order of their codes 1 to 6.
PIECES = "pnbrqk"
#: What :func:`geometry` calls pieces.
SHAPES = "P" + PIECES
STRAIGHT = [(0, 1), (0, -1), (1, 0), (-1, 0)]
SLANTED = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
LEAPS = [(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)]


def geometry() -> list[tuple[str, int, int, int]]:
    """(piece, rank step, file step, reach); a white pawn is P, any other piece is lower case."""
    rows = [("P", 1, f, 1) for f in (-1, 1)] + [("p", -1, f, 1) for f in (-1, 1)] + [("n", r, f, 1) for r, f in LEAPS]
    for piece, steps, reach in (("b", SLANTED, 7), ("r", STRAIGHT, 7), ("q", STRAIGHT + SLANTED, 7), ("k", STRAIGHT + SLANTED, 1)):
        rows += [(piece, r, f, reach) for r, f in steps]
    return rows


def placement(fen: Column) -> Column:
    """The board as 64 letters from a1 on, a dot for an empty square."""
    board = F.split(fen, " ")[0]
    for n in range(1, 9):
        board = F.regexp_replace(board, str(n), "." * n)
    return F.array_join(F.reverse(F.split(board, "/")), "")


def _at(placed: Column, sq: Column) -> Column:
    return F.substring(placed, sq + 1, F.lit(1))


def _colour(piece: Column) -> Column:
    return F.when(piece == ".", -1).when(F.lower(piece) == piece, 0).otherwise(1)


def squares(positions: DataFrame, fen: str = "fen", key: str = "pos_id") -> DataFrame:
    """64 rows per position: sq (0 is a1), piece letter ('' if empty), type 0-6, colour -1, 0, 1."""
    rows = positions.select(key, F.split(F.col(fen), " ").alias("__f"), F.posexplode(F.split(placement(F.col(fen)), "")).alias("sq", "__c")).where("sq < 64")
    turn, rights = F.col("__f")[1], F.col("__f")[2]
    return rows.select(
        key, "sq", F.when(F.col("__c") == ".", "").otherwise(F.col("__c")).alias("piece"), F.instr(F.lit(PIECES), F.lower("__c")).alias("piece_type"), _colour(F.col("__c")).alias("colour"),
        (turn == "w").cast("int").alias("turn"), *((F.instr(rights, c) > 0).cast("int").alias(f"castle_{n}") for c, n in zip("KQkq", ("wk", "wq", "bk", "bq"), strict=True)),
    )


# A position is one row, and all that is told of it is worked out inside that row: no join, no deal.


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once for a row, however often the functions inside ask for it.
    A column of an inner select isn't: the optimizer puts its expression into each of these functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _paths() -> Column:
    """For each shape and square the squares of its lines, in order; none for shape 0. One constant, for the planner too."""

    def path(sq: int, dr: int, df: int, reach: int) -> list[int]:
        steps = [(sq // 8 + dr * k, sq % 8 + df * k) for k in range(1, reach + 1)]
        return [r * 8 + f for r, f in steps if 0 <= r < 8 and 0 <= f < 8]

    lines = lambda shape, sq: [p for piece, *move in geometry() if piece == shape and (p := path(sq, *move))]
    told = [[[] for _ in range(64)], *([lines(shape, sq) for sq in range(64)] for shape in SHAPES)]
    return F.from_json(F.lit(json.dumps(told)), "array<array<array<array<int>>>>")


def _lines(placed: Column) -> Column:
    """Each piece's lines: src, piece, colour, and path, the squares of one direction in order."""
    held = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda sq: F.struct(sq.alias("sq"), _at(placed, sq).alias("piece"))), lambda x: x["piece"] != ".")
    shapes = F.array(*map(F.lit, SHAPES))

    def of(paths: Column, x: Column) -> Column:
        shape = F.array_position(shapes, F.when(x["piece"] == "P", "P").otherwise(F.lower(x["piece"]))).cast("int")
        return F.transform(F.get(F.get(paths, shape), x["sq"]), lambda p: F.struct(x["sq"].alias("src"), x["piece"].alias("piece"), _colour(x["piece"]).alias("colour"), p.alias("path")))

    return _let(_paths(), lambda paths: F.flatten(F.transform(held, lambda x: of(paths, x))))


def _attacked(placed: Column, lines: Column) -> Column:
    """src, dst, colour: up to and with the first piece in a line's way."""

    def seen(line: Column) -> Column:
        met = F.transform(line["path"], lambda d: _at(placed, d) != ".")
        return F.slice(line["path"], F.lit(1), F.array_position(F.concat(met, F.array(F.lit(True))), True).cast("int"))

    return F.flatten(F.transform(lines, lambda x: F.transform(seen(x), lambda d: F.struct(x["src"].alias("src"), d.alias("dst"), x["colour"].alias("colour")))))


def _pinned(placed: Column, lines: Column) -> Column:
    """attacker, pinned: sliders with exactly one piece, of the other colour, before its king."""

    def met(line: Column) -> Column:
        return _let(F.filter(line["path"], lambda d: _at(placed, d) != "."), lambda hits: of(line, hits))

    def of(line: Column, hits: Column) -> Column:
        first, second = F.get(hits, F.lit(0)), F.get(hits, F.lit(1))
        ok = line["piece"].rlike("[brqBRQ]") & (F.lower(_at(placed, second)) == "k") & (_colour(_at(placed, second)) != line["colour"]) & (_colour(_at(placed, first)) != line["colour"])
        return F.when(F.size(hits) > 1, F.when(ok, F.struct(line["src"].alias("attacker"), first.alias("pinned"))))

    return F.filter(F.transform(lines, met), lambda x: x.isNotNull())


def _told(fen: str, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of a position's placement and lines."""
    return _let(placement(F.col(fen)), lambda placed: _let(_lines(placed), lambda lines: use(placed, lines)))


def attacks(positions: DataFrame, fen: str = "fen", key: str = "pos_id") -> DataFrame:
    """(key, src, dst, colour): squares that a piece attacks, up to and with the first piece in its way."""
    return positions.select(key, F.explode(_told(fen, _attacked)).alias("a")).select(key, "a.*")


def pins(positions: DataFrame, fen: str = "fen", key: str = "pos_id") -> DataFrame:
    """(key, attacker, pinned)."""
    return positions.select(key, F.explode(_told(fen, _pinned)).alias("p")).select(key, "p.*")


def checks(positions: DataFrame, fen: str = "fen", key: str = "pos_id") -> DataFrame:
    """Positions whose side to move has an attacked king."""
    white = F.split(F.col(fen), " ")[1] == "w"

    def given(placed: Column, lines: Column) -> Column:
        own = _let(white, lambda w: F.struct(F.when(w, "K").otherwise("k").alias("king"), F.when(w, 0).otherwise(1).alias("by")))
        return _let(own, lambda o: F.exists(_attacked(placed, F.filter(lines, lambda x: x["colour"] == o["by"])), lambda a: _at(placed, a["dst"]) == o["king"]))

    return positions.where(_told(fen, given)).select(key)


def edges(positions: DataFrame, fen: str = "fen", key: str = "pos_id") -> DataFrame:
    """Attack (1) and pin (2) edges; a position without any gets the self edge (0, 0) of type 0."""
    edge = lambda a, b, kind: F.struct(a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"))

    def found(placed: Column, lines: Column) -> Column:
        return F.concat(F.transform(_attacked(placed, lines), lambda x: edge(x["src"], x["dst"], 1)), F.transform(_pinned(placed, lines), lambda x: edge(x["attacker"], x["pinned"], 2)))

    every = _let(_told(fen, found), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(edge(F.lit(0), F.lit(0), 0))))
    return positions.select(key, F.explode(every).alias("e")).select(key, "e.*")
