"""A fitted encoder of event logs as a Spark ML estimator and its model.

``LogEncoder.fit`` learns, by aggregates over the log, the labels of events (with the end
mark), the categories, the bounds and medians of numbers, the kinds of transition (with UNK)
and the bounds of time gaps. The model encodes any log with them: an unseen category is a row
of zeros, an unseen transition is UNK, an unseen event is an error. Features of a case are its
first known values, scaled by the bounds over cases. Estimator and model are saved and loaded as
Spark ML does it, alone or in a pipeline.
"""

from __future__ import annotations

from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import encoding, sequences
from .operators.quantiles import quantiles
from .persistence import Learnt
from .spec import LogSpec

END, UNKNOWN = "EOS", "UNK"


class _Columns(Params):
    """Names of columns, as ML params."""

    case = Param(Params._dummy(), "case", "column of the case", TypeConverters.toString)
    event = Param(Params._dummy(), "event", "column of the event", TypeConverters.toString)
    time = Param(Params._dummy(), "time", "column of the time", TypeConverters.toString)
    tie = Param(Params._dummy(), "tie", "column that orders events of one time", TypeConverters.toString)
    status = Param(Params._dummy(), "status", "column whose changes are transitions", TypeConverters.toString)
    categories = Param(Params._dummy(), "categories", "columns of categories", TypeConverters.toListString)
    numbers = Param(Params._dummy(), "numbers", "columns of numbers, -1 where missing", TypeConverters.toListString)
    caseCategories = Param(Params._dummy(), "caseCategories", "columns of categories of a case", TypeConverters.toListString)
    caseNumbers = Param(Params._dummy(), "caseNumbers", "columns of numbers of a case, -1 where missing", TypeConverters.toListString)
    medians = Param(Params._dummy(), "medians", "missing numbers take the median, else they stay -1", TypeConverters.toBoolean)
    most = Param(Params._dummy(), "most", "values that a vocabulary may have", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(case="case", event="event", time="time", tie="tie", status="", categories=[], numbers=[], caseCategories=[], caseNumbers=[], medians=False, most=10_000)

    def spec(self) -> LogSpec:
        get = self.getOrDefault
        return LogSpec(get("case"), get("event"), get("time"), get("tie"), (*get("categories"), *get("numbers"), *get("caseCategories"), *get("caseNumbers")))

    def kinds(self) -> str:
        return self.getOrDefault("status") or self.getOrDefault("event")


class LogEncoder(Estimator, _Columns, DefaultParamsWritable, DefaultParamsReadable):
    @keyword_only
    def __init__(self, *, case: str = "case", event: str = "event", time: str = "time", tie: str = "tie", status: str = "", categories: list[str] | None = None, numbers: list[str] | None = None, caseCategories: list[str] | None = None, caseNumbers: list[str] | None = None, medians: bool = False, most: int = 10_000) -> None:
        super().__init__()
        self._defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _values(self, df: DataFrame, column: Column, *extra: str) -> list[str]:
        return encoding.categories(df, column, self.getOrDefault("most"), extra)

    def _bounds(self, df: DataFrame, names: list[str]) -> dict[str, list[float | None]]:
        """The least, the largest and, where it is asked for, the middle of the known numbers of each column."""
        told = df.agg(F.count("*"), *(f(encoding.known(n)) for n in names for f in (F.min, F.max))).first()[1:] if names else ()
        middle = {n: quantiles(df.select(encoding.known(n).alias("v")), "v", [0.5]).first().quantiles[0] for n in names} if self.getOrDefault("medians") else {}
        return {n: [told[2 * k], told[2 * k + 1], middle.get(n)] for k, n in enumerate(names)}

    def _fit(self, dataset: DataFrame) -> LogEncoderModel:
        spec = self.spec()
        log = spec.validate(dataset)
        kinds = sequences.transitions(log, spec, self.kinds())
        gap = S.seconds_between(F.lead(spec.time).over(spec.ordered()), F.col(spec.time))
        gaps = log.select(gap.alias("g")).agg(F.min("g"), F.max("g")).first()
        own = [*self.getOrDefault("caseCategories"), *self.getOrDefault("caseNumbers")]
        cases = sequences.sequence_table(log, spec, own) if own else log
        learnt = {
            "events": self._values(log, F.col(spec.event), END),
            "categories": {c: self._values(log, F.col(c)) for c in self.getOrDefault("categories")},
            "numbers": self._bounds(log, self.getOrDefault("numbers")),
            "caseCategories": {c: self._values(cases, F.col(c)) for c in self.getOrDefault("caseCategories")},
            "caseNumbers": self._bounds(cases, self.getOrDefault("caseNumbers")),
            "kinds": self._values(kinds, F.col("transition"), UNKNOWN),
            "gaps": list(gaps),
        }
        return self._copyValues(LogEncoderModel(learnt))


class LogEncoderModel(Learnt, _Columns):
    def __init__(self, learnt: dict[str, Any] | None = None, tables: dict[str, DataFrame] | None = None) -> None:
        super().__init__(learnt, tables)
        self._defaults()

    def _index(self, names: list[str], value: Column) -> Column:
        """Place of the value, null for an unseen one."""
        return F.nullif(F.array_position(F.array(*map(F.lit, names)), value.cast("string")) - 1, F.lit(-1).cast("bigint")).cast("int")

    def features(self, of: str = "") -> Column:
        """Of events, or ``of`` the case (its values in columns with that beginning): one-hot blocks of the categories, then the scaled numbers. A category that is marked
        as missing makes its block -1; an unseen or null one makes it 0."""
        made = [c.cast("double") for name, values in self.learnt["caseCategories" if of else "categories"].items() for c in encoding.one_hot(F.col(of + name), values)]
        for name, (low, high, middle) in self.learnt["caseNumbers" if of else "numbers"].items():
            name = of + name
            value = F.coalesce(encoding.known(name), F.lit(middle)) if self.getOrDefault("medians") else encoding.known(name)
            made.append(S.min_max(value, F.lit(low), F.lit(high)))
        return F.array(*made) if made else F.array().cast("array<double>")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds label, next_label, kind (of the transition to the next event), gap (to it, on
        the fitted scale), features and case_features. An event that the fit hasn't seen fails the job."""
        spec, learnt = self.spec(), self.learnt
        log, w = spec.validate(dataset), spec.ordered()
        label = self._index(learnt["events"], F.col(spec.event))
        checked = F.coalesce(label, F.raise_error(F.concat(F.lit("unseen event: "), F.coalesce(F.col(spec.event).cast("string"), F.lit("null")))).cast("int"))
        pair = F.concat(F.col(self.kinds()).cast("string"), F.lit("→"), F.lead(self.kinds()).over(w).cast("string"))
        kind = F.coalesce(self._index(learnt["kinds"], pair), F.lit(learnt["kinds"].index(UNKNOWN)))
        gap = S.seconds_between(F.lead(spec.time).over(w), F.col(spec.time))
        low, high = (F.lit(x).cast("double") for x in learnt["gaps"])
        last = F.lead(F.lit(1)).over(w).isNull()
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        own = [*learnt["caseCategories"], *learnt["caseNumbers"]]
        rows = log.withColumns({"label": checked, **{f"__case_{c}": F.first(c, ignorenulls=True).over(whole) for c in own}})
        made = rows.withColumns({
            "next_label": F.coalesce(F.lead("label").over(w), F.lit(learnt["events"].index(END))),
            "kind": F.when(~last, kind), "gap": F.when(~last, S.min_max(gap, low, high)), "features": self.features(), "case_features": self.features("__case_"),
        })
        return made.drop(*(f"__case_{c}" for c in own))

    def cases(self, dataset: DataFrame) -> DataFrame:
        """The case and its case_features, a row for each."""
        spec = self.spec()
        own = [*self.learnt["caseCategories"], *self.learnt["caseNumbers"]]
        if not own:
            return dataset.select(spec.case).distinct().withColumn("case_features", self.features("__case_"))
        table = sequences.sequence_table(spec.validate(dataset), spec, own).withColumnsRenamed({c: f"__case_{c}" for c in own})
        return table.select(spec.case, self.features("__case_").alias("case_features"))

    def windows(self, dataset: DataFrame, size: int) -> DataFrame:
        """Every run of ``size`` encoded events of a case: labels, features and gaps of each, the
        case's features, and the label after it."""
        spec = self.spec()
        w = spec.ordered()
        run = w.rowsBetween(1 - size, 0)
        rows = self.transform(dataset).withColumn("__n", F.row_number().over(w))
        rows = rows.withColumn("window", F.collect_list(F.struct("label", F.coalesce("gap", F.lit(-1.0)).alias("gap"), "features")).over(run))
        return rows.where(F.col("__n") >= size).select(spec.case, (F.col("__n") - size).alias("window_no"), "window", "case_features", F.col("next_label").alias("target"))
