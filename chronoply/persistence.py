"""Saving and loading of models written in Python, by themselves and inside of ML pipelines."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame


class Learnt(Model, MLWritable, MLReadable):
    """A model whose state is ``learnt`` (what JSON holds), ``tables`` (of any size, kept as Parquet) and
    ``parts`` (other models)."""

    def __init__(self, learnt: dict[str, Any] | None = None, tables: dict[str, DataFrame] | None = None, parts: dict[str, Model] | None = None) -> None:
        super().__init__()
        self.learnt, self.tables, self.parts = learnt or {}, tables or {}, parts or {}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: Learnt) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        told = {"learnt": self.model.learnt, "tables": sorted(self.model.tables), "parts": sorted(self.model.parts)}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=told)
        for name, table in self.model.tables.items():
            table.write.parquet(f"{path}/{name}")
        for name, part in self.model.parts.items():
            part.save(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, kind: type[Learnt]) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Learnt:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = {n: self.sparkSession.read.parquet(f"{path}/{n}") for n in told["tables"]}
        made = self.kind(told["learnt"], tables)
        made.parts = {n: DefaultParamsReader.loadParamsInstance(f"{path}/{n}", self.sparkSession) for n in told["parts"]}
        made._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(made, told)
        return made
