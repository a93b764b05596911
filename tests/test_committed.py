"""Tables with manifests: whole or not there."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from chronoply import control
from chronoply.sources import committed, games


@pytest.fixture
def table(spark):
    return spark.range(100).select("id", F.when(F.col("id") < 80, "tr+ain 1").when(F.col("id") < 90, "val").otherwise("te%st").alias("split"), F.array("id").alias("v"))


def test_parts_and_totals(spark, table, tmp_path):
    path = str(tmp_path / "a b" / "t")
    committed.write(table, path, ["split"])
    assert committed.ready(spark, path) and committed.told(spark, path)["rows"] == 100
    assert committed.read(spark, path, split="tr+ain 1").count() == 80 and committed.read(spark, path).count() == 100
    assert {r.rows for r in spark.read.parquet(f"{path}/_manifest/files").groupBy(F.substring_index("file", "/", 1).alias("d")).agg(F.sum("rows").alias("rows")).collect()} == {80, 10}
    committed.write(table.where("split = 'val'").limit(4), path, ["split"], only_parts=True)
    assert committed.ready(spark, path) and committed.told(spark, path)["rows"] == 94 and committed.read(spark, path, split="val").count() == 4
    committed.write(table.where("split = 'val'"), path, ["split"])
    assert committed.read(spark, path).count() == 10
    with pytest.raises(ValueError, match="No parts by id"):
        committed.read(spark, path, id=3)
    with pytest.raises(ValueError, match="told by columns"):
        committed.write(table, path, only_parts=True)


def test_what_is_not_whole_is_not_ready(spark, table, tmp_path):
    path = str(tmp_path / "t")
    assert not committed.ready(spark, path)
    with pytest.raises(FileNotFoundError):
        committed.read(spark, path)
    committed.write(table, path, ["split"])
    schema = table.schema
    assert committed.ready(spark, path, schema, least=100) and not committed.ready(spark, path, least=101)
    assert not committed.ready(spark, path, StructType(schema.fields[:2])) and not committed.ready(spark, path, StructType([schema["split"], schema["v"]]).add("id", "string"))
    files = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "_manifest" not in d]
    shutil.move(files[0], tmp_path / "gone")
    assert not committed.ready(spark, path)
    shutil.copy(files[1], files[0])  # a file of other bytes
    assert not committed.ready(spark, path) or os.path.getsize(files[1]) == os.path.getsize(tmp_path / "gone")
    shutil.move(tmp_path / "gone", files[0])
    assert committed.ready(spark, path)
    shutil.copy(files[0], files[0].replace("part-", "part-9"))
    assert not committed.ready(spark, path)


def test_a_step_that_died_is_redone(spark, table, tmp_path):
    path, state, done = str(tmp_path / "t"), control.JobState(str(tmp_path / "s.json")), []
    ready = lambda: committed.ready(spark, path, table.schema)
    work = lambda: done.append(1) or committed.write(table, path, ["split"])

    def dies():
        committed._remove(spark, f"{path}/_manifest")
        table.limit(3).write.mode("append").partitionBy("split").parquet(path)
        raise OSError("lost")

    assert control.run_step(state, "one", ready, work) and not control.run_step(state, "one", ready, work)
    with pytest.raises(OSError):
        control.run_step(state, "one", lambda: False, dies)
    assert not ready() and control.run_step(state, "one", ready, work) and committed.read(spark, path).count() == 100
    assert not control.run_step(state, "one", ready, work) and len(done) == 2
    dies_quietly = path + "/split=val"
    shutil.rmtree(dies_quietly)  # the state says done, the files say no
    assert control.run_step(state, "one", ready, work) and len(done) == 3


def test_no_rows_and_csv(spark, table, tmp_path):
    path = str(tmp_path / "t")
    committed.write(table.limit(0), path, ["split"])
    assert committed.ready(spark, path, table.schema) and committed.read(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        games.read_split(spark, path, "val")
    committed.write(spark.range(3), str(tmp_path / "u"))
    assert committed.read(spark, str(tmp_path / "u")).schema[0].dataType == LongType()
    committed.write_csv(table.where("id > 97"), str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, inferSchema=True)
    assert back.orderBy("id").select("id", "split", F.from_json("v", "array<bigint>").alias("v")).collect() == table.where("id > 97").orderBy("id").collect()
    assert len([f for f in os.listdir(tmp_path / "c") if f.startswith("part-")]) == 1
