"""Moves of a game's text as a table function."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoply.functions import game_text

TEXT = """[Event "x [%clk 1:00:00]"]
[Site "1. e4"]

{ before } 1. e4! { [%clk 0:05:00] [%eval 0.3] } {two} (1. c4 (1. d4 {deep} d5) 1... c5) 1... e5?? ; to the end 2. a3
2.Nf3 $1 Nc6 3. Bb5+ a6 4. Bxc6 dxc6 5. O-O O-O-O 6. e8=Q# { open to the end"""


def test_main_line():
    got = list(game_text.main_line(TEXT))
    assert [m[2] for m in got] == ["e4", "e5", "Nf3", "Nc6", "Bb5+", "a6", "Bxc6", "dxc6", "O-O", "O-O-O", "e8=Q#"]
    assert [m[:2] for m in got[:3]] == [(0, "white"), (1, "black"), (2, "white")]
    assert got[0][3:] == ("!", "[%clk 0:05:00] [%eval 0.3] two") and got[1][3:] == ("??", "to the end 2. a3") and got[-1][4] == "open to the end"
    for none in ("", "\n", '[Event "e4"]\n', "( e4 e5", "words e44 xe4x", "{ e4 }", ") 1-0"):
        assert list(game_text.main_line(none)) == []


def test_table_function(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "1. d4 {[%eval #-3]} *")], "id int, text string")
    got = df.lateralJoin(game_text.annotated_moves(F.col("text").outer(), F.lit("eval, clk"))).drop("text")
    assert got.columns == ["id", "ply", "colour", "san", "mark", "comment", "eval", "clk"]
    rows = got.orderBy("id", "ply").collect()
    assert [r.id for r in rows] == [1] * 11 + [4] and (rows[0].eval, rows[0].clk) == ("0.3", "0:05:00") and (rows[1].eval, rows[-1].eval) == (None, "#-3")
    game_text.register(spark)
    assert spark.sql("SELECT count(*) AS n FROM {df} d, LATERAL annotated_moves(d.text, NULL) m", df=df).first().n == 12
    for call in ("annotated_moves(1, 'clk')", "annotated_moves('e4', 'a b')"):
        with pytest.raises(Exception, match="game's text|no names"):
            spark.sql(f"SELECT * FROM {call}").collect()
