"""Sources, sinks, streams, models and job control on small fixtures."""

from __future__ import annotations

import math
from datetime import UTC, datetime

import pytest
import zstandard
from pyspark.sql import functions as F

from chronoply import control, models
from chronoply.encoder import LogEncoder, LogEncoderModel
from chronoply.functions import scalars
from chronoply.operators import attention, metrics
from chronoply.sources import games
from chronoply.spec import LogSpec
from chronoply.streaming import logs

PGN = """[Event "Blitz"]
[WhiteElo "1250"]
[BlackElo "1350"]
[TimeControl "300+2"]

1. e4 { [%eval 0.2] [%clk 0:05:00] } 1... e5 { [%clk 0:05:00] } 2. Nf3 { [%eval #3] [%clk 0:04:50] } 2... Nc6 3. Bb5 { [%clk 0:04:48] } 3... a6 { [%eval #-2] [%clk 0:04:40] } 1-0

[Event "Odd"]
[WhiteElo "?"]
[BlackElo "1500"]

1. d4 (1. c4 c5) 1... d5 1/2-1/2
"""


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pgn") / "games.pgn.zst"
    path.write_bytes(zstandard.compress(PGN.encode()))
    return games.archive(spark, str(path))


def test_games(archive):
    assert archive.count() == 2
    moved = games.moves(games.with_headers(archive, "Event"), "Event").orderBy("Event", "ply").collect()
    assert [(r.ply, r.colour, r.san, r.clock_s) for r in moved[:6]] == [(0, "white", "e4", 300), (1, "black", "e5", 300), (2, "white", "Nf3", 290), (3, "black", "Nc6", None), (4, "white", "Bb5", 288), (5, "black", "a6", 280)]
    assert [r.san for r in moved[6:]] == ["d4", "d5"]
    assert moved[0].eval_pawns == 0.2 and moved[2].eval_mate == 3 and moved[5].eval_mate == -2
    assert [r.ply for r in games.mate_moves(games.moves(archive)).collect()] == [2]
    assert sorted(r.ply for r in games.mate_moves(games.moves(archive), either_side=True).collect()) == [2, 5]


def test_rating_table(spark, archive, tmp_path):
    table = games.seconds_by_rating(archive, least=1)
    want = {1200: 8.0, 1400: 22.0}  # (12 + 4) / 2; 300 - 280 + 2, the move without a clock passed over
    assert {r.bucket: r.avg_s for r in table.collect()} == want
    games.write_rating_table(table, str(tmp_path / "t"))
    assert {r.bucket: r.avg_s for r in games.read_rating_table(spark, str(tmp_path / "t")).collect()} == want


def test_puzzles(spark, tmp_path):
    lines = [games.PUZZLES.replace(" string", "").replace(" int", "").replace(" ", ""), "b,f,e2e4,1500,1,1,1,mateIn10 long,u,", "a,f,e2e4,1500,1,1,1,mateIn2 short,u,", "c,f,e2e4,1500,1,1,1,,u,"]
    (tmp_path / "p.csv.zst").write_bytes(zstandard.compress("\n".join(lines).encode()))
    df = games.puzzles(spark, str(tmp_path / "p.csv.zst"))
    assert sorted(r.PuzzleId for r in games.with_theme(df, 1, 5).collect()) == ["a", "b"]
    assert [r.PuzzleId for r in games.with_theme(df, 1, 5, strict=True).collect()] == ["a"]
    assert [r.PuzzleId for r in games.first_puzzles(df, 1).collect()] == ["a"]


def test_external_and_splits(spark, tmp_path):
    (tmp_path / "e.csv").write_text('id,pgn\n1,"[Event ""x""]\n\n1. e4"\n2,\n')
    assert games.external_games(spark, str(tmp_path / "e.csv")).first().text == '[Event "x"]\n\n1. e4'
    with pytest.raises(ValueError, match="No column pgn"):
        (tmp_path / "f.csv").write_text("id\n1\n")
        games.external_games(spark, str(tmp_path / "f.csv"))
    games.write_splits(spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test")), str(tmp_path / "s"))
    assert games.read_split(spark, str(tmp_path / "s"), "train").count() == 8
    with pytest.raises(FileNotFoundError):
        games.read_split(spark, str(tmp_path / "s"), "val")


def test_log_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("case,event,time\nA,a,2024-01-01 10:00:00\n")
    assert games.events_csv(spark, str(tmp_path / "l.csv"), LogSpec()).count() == 1
    with pytest.raises(ValueError, match="feature 0: no column 'value'"):
        games.events_csv(spark, str(tmp_path / "l.csv"), LogSpec(features=("value",)))


def test_streams(spark, tmp_path):
    spec = LogSpec("user_id", "event_type", "ts", "event_id")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("counts", logs.window_counts(stream, spec), "complete"), ("gaps", logs.gaps(stream, spec), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
    lag = F.lag("ts").over(spec.ordered())
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(lag.cast("timestamp"))) / 1e6
    want = events.select("event_id", F.round(gap, 6).alias("gap_s")).where("gap_s IS NOT NULL").collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, spark.table("gaps").select("tie", F.round("gap_s", 6)).collect()))


def test_models(spark, tmp_path):
    assert models.available() == ["chain", "most_frequent"]
    with pytest.raises(KeyError):
        models.get("other")
    spec = LogSpec("case", "event", "time", "tie")
    rows = [(c, "abc"[k % 3], k * 10, k, float(k)) for c in range(20) for k in range(9)]
    log = spark.createDataFrame(rows, "case int, event string, time int, tie int, value double").withColumn("time", F.timestamp_seconds("time"))
    for mode in ("basic", "time_decay", "status", "time_decay_status"):
        assert models.ChainClassifier(spec, mode=mode, numeric=("value",)).fit(log).score(log) > 0.85
    with pytest.raises(ValueError, match="Unknown"):
        models.ChainClassifier(spec, mode="other")
    most = models.MostFrequent("event").fit(log)
    assert most.value == "a"
    most.save(spark, str(tmp_path / "m"))
    assert models.MostFrequent("event").load(spark, str(tmp_path / "m")).value == "a"


def test_control(tmp_path):
    state, calls = control.JobState(str(tmp_path / "s.json")), []
    assert control.run_step(state, "one", lambda: True, lambda: calls.append(1) or {"rows": 3})
    assert not control.run_step(control.JobState(str(tmp_path / "s.json")), "one", lambda: True, lambda: calls.append(1))
    assert control.JobState(str(tmp_path / "s.json")).meta("one", "rows") == 3
    with pytest.raises(ZeroDivisionError):
        control.run_step(state, "two", lambda: True, lambda: 1 / 0)
    assert not state.done("two") and "ZeroDivision" in state.meta("two", "error")
    (tmp_path / "s.json").write_text("{")
    assert control.JobState(str(tmp_path / "s.json")).steps == {}

    @control.retry(3, 0.0)
    def flaky():
        calls.append(2)
        if calls.count(2) < 3:
            raise OSError
        return "well"

    assert flaky() == "well"


def test_spec_tells_what_is_wrong(spark):
    df = spark.createDataFrame([([1], 2)], "case array<int>, time int")
    assert len(LogSpec().problems(df)) == 3  # no event, a nested case, a time that is a number


def test_distances_and_bleu(spark):
    rows = [(["a", "b", "c"], ["a", "c", "b"]), ([], []), ([], ["a"]), (None, ["a"]), (["a", "b"], ["c", "d"])]
    df = spark.createDataFrame(rows, "p array<string>, t array<string>")
    got = [r.s for r in df.select(metrics.similarity("p", "t").alias("s")).collect()]
    assert [g if g is None else round(g, 6) for g in got[:3]] == [round(2 / 3, 6), None, 0.0] and got[4] == 0.0
    assert metrics.bleu(spark.createDataFrame(rows[-1:], df.schema), "p", "t").first().bleu == 0.0
    assert round(metrics.bleu(spark.createDataFrame([(["a", "b"], ["a", "b"])], df.schema), "p", "t").first().bleu, 6) == 1.0


def test_erf_gelu_and_p(spark):
    xs = [-7.0, -3.0, -0.5, 0.0, 0.1, 1.0, 2.5, 5.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", scalars.erf(F.col("x")).alias("e"), scalars.activation("gelu", F.col("x")).alias("g")).collect()
    assert all(abs(r.e - math.erf(r.x)) < 1e-14 and abs(r.g - r.x * (1 + math.erf(r.x / math.sqrt(2))) / 2) < 1e-13 for r in got)
    # Two-sided p from tables of the distribution.
    known = [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.228, 10, 0.05), (2.947, 15, 0.01), (0.0, 7, 1.0)]
    p = spark.createDataFrame([(t, df_) for t, df_, _ in known], "t double, df long").select(attention.p_value(F.col("t"), F.col("df")).alias("p")).collect()
    assert all(abs(r.p - want) < 2e-4 for r, (_, _, want) in zip(p, known, strict=True))


def test_log_encoder(spark, tmp_path):
    rows = [("A", "a", 0, 1, "x", 2.0), ("A", "b", 5, 2, "y", -1.0), ("A", "a", 20, 3, "x", 4.0), ("B", "c", 7, 4, "<NO_DESC>", 3.0)]
    schema = "case string, event string, time timestamp, tie int, cat string, num double"
    log = spark.createDataFrame([(c, e, datetime.fromtimestamp(t, UTC), k, g, n) for c, e, t, k, g, n in rows], schema)
    made = LogEncoder(categories=["cat"], numbers=["num"]).fit(log)
    assert made.learnt["events"] == ["EOS", "a", "b", "c"] and made.learnt["kinds"] == ["UNK", "a→b", "b→a"]
    made.save(str(tmp_path / "m"))
    again = LogEncoderModel.load(str(tmp_path / "m"))
    new = log.where("case = 'A'").replace({"y": "z"}, subset="cat")
    got = [(r.label, r.next_label, r.kind, r.gap, list(r.features)) for r in again.transform(new).orderBy("tie").collect()]
    assert got == [(1, 2, 1, 0.0, [0, 1, 0, 0.0]), (2, 1, 2, 1.0, [0, 0, 0, -1.0]), (1, 0, None, None, [0, 1, 0, 1.0])]
    filled = LogEncoder(categories=["cat"], numbers=["num"], medians=True).fit(log).transform(log).where("tie = 2").first()
    assert filled.features[-1] == 0.5
    with pytest.raises(Exception, match="unseen event: d"):
        again.transform(log.replace({"b": "d"}, subset="event")).collect()
    with pytest.raises(ValueError, match="more than 1 values"):
        LogEncoder(most=1).fit(log)
    assert [(r.window_no, len(r.window), r.target) for r in again.windows(log, 2).orderBy("window_no").collect()] == [(0, 2, 1), (1, 2, 0)]


def test_mixed_times(spark):
    texts = ["2024-03-01 10:00:00", "2024-03-01T10:00:00Z", "2024-03-01T12:00:00+02:00", "2024/03/01 10:00", "01.03.2024 10:00:00", "20240301", "soon", "", None]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_seconds(scalars.parse_time(F.col("t"))).alias("s")).collect()]
    assert got == [1709287200] * 5 + [1709251200] + [None] * 3
