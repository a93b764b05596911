"""Tables of files that are there whole or not at all: a manifest is written last and checked by readers.

Beside the files, ``_manifest/files`` has a row for each of them (its place, bytes and rows) and
``_manifest/told`` one with the schema and the totals. A writer takes the manifest away before it
touches a file and writes it anew when all are there, ``told`` at the end, so a writer that dies
leaves a table that isn't ready. Parts can be replaced by themselves; the manifest then tells of all.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "_manifest"


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _inside(spark: SparkSession, path: str, told: Column) -> Column:
    """A file's place in the table's folder, of a path or its encoded form."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    return F.substring(told, F.instr(told, root + "/") + len(root) + 1, F.length(told))


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes of what lies there; the files aren't opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(_inside(spark, path, F.col("path")).alias("file"), F.col("length").alias("bytes"))


def write(df: DataFrame, path: str, by: Sequence[str] = (), *, only_parts: bool = False) -> None:
    """Writes ``df``, a folder for each value of ``by``, and the manifest. ``only_parts`` replaces the folders
    that ``df`` has rows for and leaves the others; else the table is replaced.

    Rows are counted from the files, so the manifest tells what was written. A table without
    rows is one file without rows, or, with ``by``, no files.
    """
    if only_parts and not by:
        raise ValueError("parts are told by columns")
    spark = df.sparkSession
    _remove(spark, f"{path}/{MANIFEST}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if only_parts else "static").partitionBy(*by).parquet(path)
    schema = StructType([*[f for f in df.schema if f.name not in by], *[f for f in df.schema if f.name in by]])
    written = spark.read.schema(schema).parquet(path)
    # Encoded: a plus is itself there.
    place = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    rows = written.select(_inside(spark, path, place).alias("file")).groupBy("file").agg(F.count("*").alias("rows"))
    files = _listing(spark, path).join(rows, "file", "left").select("file", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"))
    files.write.parquet(f"{path}/{MANIFEST}/files")
    total = spark.read.parquet(f"{path}/{MANIFEST}/files").agg(F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    told = json.dumps({"schema": schema.jsonValue(), "by": list(by), "files": total.files, "rows": total.rows})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{path}/{MANIFEST}/told")


def told(spark: SparkSession, path: str) -> dict | None:
    """What the manifest tells (schema, by, files, rows); None if there is none."""
    try:
        found = spark.read.text(f"{path}/{MANIFEST}/told").first()
        return json.loads(found[0]) if found else None
    except (AnalysisException, ValueError):
        return None


def _kinds(schema: StructType) -> list[tuple[str, str]]:
    return sorted((f.name, f.dataType.simpleString()) for f in schema)


def ready(spark: SparkSession, path: str, schema: StructType | None = None, *, least: int = 0) -> bool:
    """Whether a table is there whole: with a manifest, of the asked columns and types, of ``least`` rows or
    more, and with the manifest's files and no others, each of the bytes it was written with."""
    head = told(spark, path)
    if head is None or head["rows"] < least or (schema is not None and _kinds(schema) != _kinds(StructType.fromJson(head["schema"]))):
        return False
    known = spark.read.parquet(f"{path}/{MANIFEST}/files").select("file", F.col("bytes").alias("known"))
    differs = _listing(spark, path).join(known, "file", "full_outer").where(~F.col("bytes").eqNullSafe(F.col("known")))
    return differs.isEmpty()


def read(spark: SparkSession, path: str, **parts: object) -> DataFrame:
    """The table, or the rows of the given parts (other folders aren't opened). A table without a manifest is an error."""
    head = told(spark, path)
    if head is None:
        raise FileNotFoundError(f"No whole table in {path}")
    df = spark.read.schema(StructType.fromJson(head["schema"])).parquet(path)
    for name, value in parts.items():
        if name not in head["by"]:
            raise ValueError(f"No parts by {name}; there are {head['by']}")
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """A table of results as CSV with a header; arrays, maps and structs are JSON texts. Other programs
    read it, so there is one file; its rows are a result's, not a log's."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({n: F.to_json(n) for n in nested}).coalesce(1).write.mode("overwrite").csv(path, header=True)
