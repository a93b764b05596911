"""Squares, attacks, pins and checks of known positions, and against a plain walk over the board."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronoply.operators import boards

FENS = [
    (1, "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"),
    (2, "4k3/8/8/8/1b6/2N5/8/4K3 w - - 0 1"),
    (3, "r3k2r/8/8/8/8/8/8/R3K2R b Kq - 0 1"),
    (4, "4k3/8/8/8/8/8/4q3/4K3 w - - 0 1"),
    (5, "8/8/8/8/8/8/8/8 w - - 0 1"),
]


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(FENS, "pos_id int, fen string")


def name(sq: int) -> str:
    return "abcdefgh"[sq % 8] + str(sq // 8 + 1)


def test_known_positions(known):
    held = {(r.pos_id, name(r.sq)): r for r in boards.squares(known).collect()}
    assert len(held) == 320 and held[1, "e1"].piece == "K" and held[1, "d8"].piece == "q" and held[1, "e4"].colour == -1
    assert (held[3, "a1"].turn, held[3, "a1"].castle_wk, held[3, "a1"].castle_wq, held[3, "a1"].castle_bk, held[3, "a1"].castle_bq) == (0, 1, 0, 0, 1)
    seen = {(r.pos_id, name(r.src), name(r.dst)) for r in boards.attacks(known).collect()}
    assert (1, "g1", "f3") in seen and (1, "e2", "d3") in seen and (1, "e2", "e3") not in seen and (1, "a1", "a2") in seen and (1, "a1", "a3") not in seen
    assert {(r.pos_id, name(r.attacker), name(r.pinned)) for r in boards.pins(known).collect()} == {(2, "b4", "c3")}
    assert [r.pos_id for r in boards.checks(known).collect()] == [4]
    edges = boards.edges(known)
    assert [tuple(r) for r in edges.where("pos_id = 5").collect()] == [(5, 0, 0, 0)]
    assert edges.where("edge_type = 1").count() == len(seen) and edges.where("edge_type = 2").count() == 1
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def walk(board: dict[tuple[int, int], str]) -> tuple[set, set]:
    """Attacked and pinned squares, a step at a time."""
    attacked, pinned = set(), set()
    for (rank, file), piece in board.items():
        shape = "P" if piece == "P" else piece.lower()
        for p, dr, df, reach in boards.geometry():
            if p != shape:
                continue
            met = []
            for k in range(1, reach + 1):
                to = (rank + dr * k, file + df * k)
                if not (0 <= to[0] < 8 and 0 <= to[1] < 8):
                    break
                if not met:
                    attacked.add((rank * 8 + file, to[0] * 8 + to[1]))
                if to in board:
                    met.append(to)
            if shape in "brq" and len(met) > 1:
                a, b = (board[t] for t in met[:2])
                if b.lower() == "k" and b.isupper() != piece.isupper() and a.isupper() != piece.isupper():
                    pinned.add((rank * 8 + file, met[0][0] * 8 + met[0][1]))
    return attacked, pinned


def test_random_positions(spark):
    rng = random.Random(6)
    made, want = [], {}
    for n in range(60):
        board = {(r, f): rng.choice("PNBRQKpnbrqk") for r in range(8) for f in range(8) if rng.random() < 0.3}
        rows = ["".join(board.get((r, f), "1") for f in range(8)) for r in range(7, -1, -1)]
        made.append((n, "/".join(rows) + " w - - 0 1"))
        want[n] = walk(board)
    df = spark.createDataFrame(made, "k int, f string").repartition(4)
    got = {n: (set(), set()) for n, _ in made}
    for r in boards.attacks(df, "f", "k").collect():
        got[r.k][0].add((r.src, r.dst))
    for r in boards.pins(df, "f", "k").collect():
        got[r.k][1].add((r.attacker, r.pinned))
    assert got == want and any(p for _, p in want.values())
    assert boards.edges(df.where(F.lit(False)), "f", "k").count() == 0


def test_placement_is_told_once(spark):
    """A fen that is worked out by a query isn't worked out again for each square, piece or line."""
    df = spark.createDataFrame(FENS, "k int, f string").select("k", F.concat(F.substring("f", 1, 200), F.lit("")).alias("f"))
    for told, times in ((boards.attacks, 1), (boards.pins, 1), (boards.edges, 1), (boards.checks, 2)):  # checks: the turn, too
        assert told(df, "f", "k")._jdf.queryExecution().optimizedPlan().toString().count("substring(f#") == times, told.__name__
