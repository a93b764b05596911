"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local master,
    where driver and tasks share a disk, goes without the setting."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or f"{tempfile.gettempdir()}/checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/chronoply-{name}-{uuid.uuid4().hex}"
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(made)
    return path


#: Tables that are written within a :func:`workspace`, by the thread that writes them.
_open: ContextVar[list[str] | None] = ContextVar("_open", default=None)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """What :func:`stored` writes inside is deleted at the end, but for what is ``lasting``."""
    made: list[str] = []
    token = _open.set(made)
    try:
        yield
    finally:
        _open.reset(token)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting for what is run inside; its own comes back afterwards."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, compression: str = "snappy", lasting: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.
    What it shuffled is deleted when it is written. ``lasting``: beyond the :func:`workspace` around."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if (made := _open.get()) is not None and not lasting:
        made.append(path)
    schema = df.schema
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` would also change other alphabets, so texts that
    hold capital letters outside ASCII go through ``translate``."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(text.rlike(r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\x{130}\x{2160}-\x{216F}\x{24B6}-\x{24CF}]]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What is run inside gives Python workers whole texts in batches of ``rows``, which bounds
    their memory. The session's own setting comes back afterwards."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def frames(batches: Iterable[pd.DataFrame], rows: int = 2_000) -> Iterator[pd.DataFrame]:
    """Batches of at most ``rows`` rows, none of them empty."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows]


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(n))
