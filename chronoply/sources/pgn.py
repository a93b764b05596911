"""PGN archives as a Spark data source.

    read_pgn(spark, path, ["WhiteElo", "BlackElo"]).where("WhiteElo >= '2000'")

A row is a game: its file, the byte where it begins there (which no other game has, equal as
their texts may be), its text and the asked headers. Plain files are split by ranges of bytes:
a range has the games that begin in it, and reads on to the end of its last one. Packed files
(zst, gz) are one range each, read as a stream, and count the bytes unpacked. Filters on the
file leave files out, those on headers leave games out before Spark sees them.

Stores are those of ``pyarrow.fs``, local paths among them.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: A game begins with this tag, at the file's begin or after an empty line.
_BEGIN = re.compile(rb"\n[ \t\r]{0,32}\n(?:\xef\xbb\xbf)?(?=\[Event )")
_TAG = re.compile(r'^\[(\w+) "((?:[^"\\]|\\.)*)"\]', re.MULTILINE)
#: Bytes that are read at once, and games of an Arrow batch.
BLOCK, BATCH = 1 << 20, 256
#: Bytes that hold an empty line and the tag's begin.
_BEFORE = 64


@dataclass
class Range(InputPartition):
    """The games of a file that begin in [start, stop); no stop: all of a packed file."""

    path: str
    start: int
    stop: int | None


def headers(text: str) -> dict[str, str]:
    """The tags before a game's moves; of a repeated one, the first."""
    end = re.search(r"\n[ \t\r]*\n", text)
    found: dict[str, str] = {}
    for name, value in _TAG.findall(text[: end.start()] if end else text):
        found.setdefault(name, re.sub(r"\\(.)", r"\1", value))
    return found


def games_of(read: Callable[[int], bytes], first: int, start: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(byte, text) of the games that begin in [start, stop) of what ``read`` gives from byte ``first`` on.
    One game and a block are held at a time."""
    # held[0] is byte ``at``; the open game begins at held[begun]; there is no begin before held[seen] any more.
    held, at, begun, seen = (b"\n\n", -2, None, 0) if first == 0 else (b"", first, None, 0)
    while block := read(BLOCK):
        held += block
        for found in _BEGIN.finditer(held, seen):
            place = found.end()
            if begun is not None:
                yield at + begun, held[begun:place]
            if stop is not None and at + place >= stop:
                return
            begun = place if at + place >= start else None
            seen = place
        seen = max(seen, len(held) - _BEFORE)
        if begun is None and stop is not None and at + seen >= stop:
            return
        cut = seen if begun is None else begun
        held, at, begun, seen = held[cut:], at + cut, None if begun is None else 0, seen - cut
    if begun is not None:
        yield at + begun, held[begun:]


def matches(told: Filter, row: dict[str, Any]) -> bool | None:
    """SQL's verdict on a row: true, false or unknown."""
    if isinstance(told, Not):
        inner = matches(told.child, row)
        return None if inner is None else not inner
    value = row[told.attribute[0]]
    if isinstance(told, IsNull | IsNotNull):
        return (value is None) == isinstance(told, IsNull)
    if isinstance(told, EqualNullSafe):
        return value == told.value
    if value is None:
        return None
    if isinstance(told, In):
        return True if value in told.value else None if None in told.value else False
    if told.value is None:
        return None
    return _COMPARE[type(told)](value, told.value)


_COMPARE: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
    StringContains: lambda a, b: b in a, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b),
}
#: Spark orders strings by their UTF-8 bytes, as Python does by code points.
_KNOWN = (*_COMPARE, In, EqualNullSafe, IsNull, IsNotNull)


class PgnReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names = [f.name for f in schema.fields]
        self.kinds = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, LongType) else pa.string()) for f in schema.fields])
        self.path = options.get("path")
        self.size = max(1, int(options.get("splitBytes", 128 << 20)))
        self.filters: list[Filter] = []

    def _on(self, *columns: str) -> list[Filter]:
        return [f for f in self.filters if (f.child if isinstance(f, Not) else f).attribute[0] in columns]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        if not self.path:
            raise ValueError("a PGN archive has a path")
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith(("file:", "/")) else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        made: list[InputPartition] = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type != fs.FileType.File or f.base_name.startswith(("_", ".")) or not all(matches(told, {"file": f.path}) for told in self._on("file")):
                continue
            if f.base_name.endswith((".zst", ".gz")):
                made.append(Range(f.path, 0, None))
            else:
                made += [Range(f.path, k, min(k + self.size, f.size)) for k in range(0, f.size, self.size)]
        return made or [Range("", 0, 0)]

    def _games(self, part: Range) -> Iterator[tuple[int, bytes]]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        if part.stop is None:
            with store.open_input_stream(part.path, compression=None) as packed:
                unpacked: BinaryIO
                if part.path.endswith(".gz"):
                    unpacked = gzip.GzipFile(fileobj=packed)
                else:
                    import zstandard

                    unpacked = zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True)
                yield from games_of(unpacked.read, 0, 0, None)
            return
        with store.open_input_file(part.path) as plain:
            first = max(0, part.start - _BEFORE)
            plain.seek(first)
            yield from games_of(plain.read, first, part.start, part.stop)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Range)
        if not partition.path:
            return
        wanted, rows = self._on(*self.names), []
        for at, raw in self._games(partition):
            text = raw.decode("utf-8", "replace").replace("\r", "").rstrip("\n")
            tags = headers(text)
            row = {n: tags.get(n) for n in self.names} | {"file": partition.path, "at": at, "text": text}
            if all(matches(f, row) for f in wanted):
                rows.append(row)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, self.kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.kinds)


class PushingReader(PgnReader):
    """Only with Spark's switch on: a reader that takes filters fails without it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes all on whole columns but ``text``, for which Spark is quicker."""
        for told in filters:
            inner = told.child if isinstance(told, Not) else told
            if isinstance(inner, _KNOWN) and len(inner.attribute) == 1 and inner.attribute[0] in self.names and inner.attribute[0] != "text":
                self.filters.append(told)
            else:
                yield told


class PgnSource(DataSource):
    """Options: ``path`` (a file or a folder), ``headers`` (names of tags, each a column of strings; null
    where a game has none), ``splitBytes`` of plain files, ``pushdown`` (true with the session's setting
    ``spark.sql.python.filterPushdown.enabled``: filters reach the reader)."""

    @classmethod
    def name(cls) -> str:
        return "pgn"

    def schema(self) -> StructType:
        asked = [n.strip() for n in self.options.get("headers", "").split(",") if n.strip()]
        return StructType([StructField("file", StringType()), StructField("at", LongType()), StructField("text", StringType()), *(StructField(n, StringType()) for n in asked)])

    def reader(self, schema: StructType) -> DataSourceReader:
        made = PushingReader if self.options.get("pushdown", "false") == "true" else PgnReader
        return made(schema, self.options)


def read_pgn(spark: SparkSession, path: str, headers: Sequence[str] = (), **options: object) -> DataFrame:
    """file, at, text and the headers of each game; filters are pushed if the session lets them."""
    spark.dataSource.register(PgnSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("pgn").options(headers=",".join(headers), pushdown=push, **options).load(path)
