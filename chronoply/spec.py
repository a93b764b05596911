"""Names of an event log's columns, and the check that they can serve as such."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, MapType, StringType, StructType, TimestampNTZType, TimestampType
from pyspark.sql.window import WindowSpec

#: Types that give a case an identity by ``groupBy``, and those that order its events.
_NESTED = (ArrayType, MapType, StructType)
_TIMES = (TimestampType, TimestampNTZType, DateType, StringType)


@dataclass(frozen=True)
class LogSpec:
    """One total order serves all operators: time, then the tie-break column."""

    case: str = "case"
    event: str = "event"
    time: str = "time"
    tie: str = "tie"
    features: Sequence[str] = ()

    def problems(self, df: DataFrame) -> list[str]:
        """What keeps ``df`` from being a log of these names, told by role; empty if nothing does."""
        types: dict[str, DataType] = {f.name: f.dataType for f in df.schema.fields}
        roles = {"case": self.case, "event": self.event, "time": self.time} | {f"feature {n}": c for n, c in enumerate(self.features)}
        found = [f"{role}: no column {name!r}" for role, name in roles.items() if name not in types]
        if isinstance(types.get(self.case), _NESTED):
            found.append(f"case: {self.case!r} is of nested type {types[self.case].simpleString()}")
        if self.time in types and not isinstance(types[self.time], _TIMES):
            found.append(f"time: {self.time!r} has type {types[self.time].simpleString()}")
        return found

    def validate(self, df: DataFrame) -> DataFrame:
        if found := self.problems(df):
            raise ValueError("not an event log: " + "; ".join(found))
        return df

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(self.case).orderBy(self.time, self.tie)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(self.case)

    def rank(self) -> Column:
        return F.struct(self.time, self.tie)


def with_overrides(config: object, **overrides: object) -> object:
    """A copy of a config dataclass with the given fields; unknown names are an error."""
    unknown = sorted(set(overrides) - {f.name for f in fields(config)})
    if unknown:
        raise ValueError(f"Unknown config fields: {unknown}")
    return replace(config, **overrides)
