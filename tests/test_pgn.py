"""The PGN source: ranges of bytes, packed files, headers and filters."""

from __future__ import annotations

import gzip
import io
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from chronoply.operators import sequences
from chronoply.sources import games, pgn

GAME = '[Event "Blitz"]\n[White "{}"]\n[WhiteElo "{}"]\n\n1. e4 {{ [%clk 0:05:00] é }} 1... e5 {{ [%clk 0:05:00] }} 2. d4 {{ [%clk 0:04:5{}] }} 1-0\n\n'


def whole(data: bytes) -> list[tuple[int, bytes]]:
    return list(pgn.games_of(io.BytesIO(data).read, 0, 0, None))


def split(data: bytes, size: int) -> list[tuple[int, bytes]]:
    got = []
    for k in range(0, len(data), size):
        file = io.BytesIO(data)
        file.seek(first := max(0, k - pgn._BEFORE))
        got += pgn.games_of(file.read, first, k, min(k + size, len(data)))
    return got


@pytest.mark.parametrize("block", [1, 5, 64, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_files_cut_anywhere(monkeypatch, block, end):
    """However a file is cut, inside of games too, each game is read once, by the range it begins in."""
    monkeypatch.setattr(pgn, "BLOCK", block)
    rng = random.Random(block)
    texts = [GAME.format(f"p{k}", rng.randrange(3000), k % 10) + ("% no game\n[Event in a comment\n\n" if k % 3 == 0 else "") for k in range(12)]
    for before in ("", "﻿", "; a note\n\n", "\n \n\n"):
        data = (before + "".join(texts)).replace("\n", end).encode()
        want = whole(data)
        assert len(want) == 12 and all(data[at:].startswith(b'[Event "Blitz"]') for at, _ in want)
        assert b"".join(t for _, t in want) == data[want[0][0] :]
        for size in (1, 7, 100, len(want[0][1]), len(data)):
            assert split(data, size) == want
    assert whole(b"") == [] and whole(b"no game\n") == []


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pgn")
    texts = [GAME.format(f"p{k % 5}", 1000 + k, k % 3) for k in range(40)] + ['[Event "no elo"]\n\n1. d4 *\n\n']
    (path / "a.pgn").write_text("".join(texts))
    (path / "b.pgn.zst").write_bytes(zstandard.compress("".join(texts[:7]).encode()) + zstandard.compress("".join(texts[7:9]).encode()))
    (path / "c.pgn.gz").write_bytes(gzip.compress("".join(texts[:3]).encode()))
    (path / "_skipped").write_text("".join(texts))
    return path


def test_files_and_headers(spark, folder):
    df = pgn.read_pgn(spark, str(folder), ["White", "WhiteElo"], splitBytes=1000)
    assert df.columns == ["file", "at", "text", "White", "WhiteElo"] and df.rdd.getNumPartitions() > 6
    assert {r.f: r.n for r in df.groupBy(F.element_at(F.split("file", "/"), -1).alias("f")).agg(F.count("*").alias("n")).collect()} == {"a.pgn": 41, "b.pgn.zst": 9, "c.pgn.gz": 3}
    assert df.select("file", "at").distinct().count() == 53 and df.where("White IS NULL").count() == 1
    assert pgn.headers('[A "x \\"y\\""]\n[A "z"]\n[B ""]\n\n[C "not a tag"]') == {"A": 'x "y"', "B": ""}
    with pytest.raises(Exception, match="nowhere"):
        pgn.read_pgn(spark, str(folder / "nowhere")).count()


def test_filters_are_pushed(spark, folder):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    conditions = ["White = 'p1'", "White <> 'p1'", "White IN ('p1', 'p2')", "NOT White IN ('p1', NULL)", "WhiteElo >= '1010' AND WhiteElo < '1020'", "White IS NULL", "White IS NOT NULL", "White <=> 'p3'", "White LIKE 'p%'", "White LIKE '%1'", "file LIKE '%a.pgn'", "at = 0", "text LIKE '%Blitz%'", "White = 'p1' OR White = 'p2'", "length(White) = 2"]
    try:
        told = {}
        for on in ("false", "true"):
            spark.conf.set(key, on)
            df = pgn.read_pgn(spark, str(folder), ["White", "WhiteElo"], splitBytes=700)
            told[on] = [df.where(c).select("file", "at").orderBy("file", "at").collect() for c in conditions]
        assert told["true"] == told["false"]
        plan = df.where("White = 'p1' AND text LIKE '%x%'")._jdf.queryExecution().executedPlan().toString()
        assert "Filter" in plan and "White#" in plan and "= p1" not in plan.split("PushedFilters")[0].split("BatchScan")[0]
    finally:
        spark.conf.set(key, before)
    reader = pgn.PushingReader(pgn.PgnSource({"headers": "White"}).schema(), {"path": str(folder)})
    from pyspark.sql.datasource import EqualTo, StringEndsWith

    left = EqualTo(("text",), "x")
    assert list(reader.pushFilters([EqualTo(("White",), "p1"), left, StringEndsWith(("file",), "a.pgn")])) == [left]
    assert {p.path for p in reader.partitions()} == {str(folder / "a.pgn")}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 8


def test_equal_games_keep_apart(spark, tmp_path):
    """The clocks of two games of one text don't mix."""
    text = GAME.format("x", 1500, 5)
    (tmp_path / "g.pgn").write_text(text * 3)
    moved = games.moves(games.archive(spark, str(tmp_path / "g.pgn")))
    spent = sequences.clock_spent(moved, "game_id", "colour", "ply", "clock_s", F.lit(0)).collect()
    assert [(r.ply, r.spent) for r in spent] == [(2, 5)] * 3 and len({r.game_id for r in spent}) == 3
