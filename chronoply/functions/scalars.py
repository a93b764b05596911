"""Scalar and array expressions: clocks, buckets, padding, activations."""

from __future__ import annotations

from math import log1p, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds at which the clock scale saturates.
CLOCK_CAP = 600


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def parse_clock(comment: Column) -> Column:
    """Seconds of ``[%clk H:M:S]`` or ``[%clk M:S]``; null where there is none."""

    def part(k: int) -> Column:
        return F.regexp_extract(comment, r"\[%clk (?:(\d+):)?(\d+):(\d+)\]", k).try_cast("int")

    return F.coalesce(part(1), F.lit(0)) * 3600 + part(2) * 60 + part(3)


def parse_eval(comment: Column) -> tuple[Column, Column]:
    """(pawns as double, mate distance as int) of ``[%eval x]``."""
    raw = F.regexp_extract(comment, r"\[%eval ([^\]\s]+)\]", 1)
    return raw.try_cast("double"), F.regexp_extract(raw, r"^#(-?\d+)$", 1).try_cast("int")


def parse_increment(control: Column) -> Column:
    """Increment seconds of ``300+2``; 0 for anything else."""
    return F.coalesce(F.regexp_extract(control, r"^\d+\+(\d+)", 1).try_cast("double"), F.lit(0.0))


def clock_norm(seconds: Column) -> Column:
    return F.least(F.log1p(F.greatest(seconds, F.lit(0.0))) / F.lit(log1p(CLOCK_CAP)), F.lit(1.0))


def clock_denorm(norm: Column) -> Column:
    return F.expm1(norm * F.lit(log1p(CLOCK_CAP)))


def half_even_bucket(x: Column, size: int) -> Column:
    return (F.bround(x / size) * size).cast("long")


def simulated_seconds(rating: Column) -> Column:
    return F.lit(5.0) + rating / F.lit(3000.0) * F.lit(55.0)


def simulated_clock(base: Column, ply: Column) -> Column:
    """Seconds on the clock at a ply, a tenth of the base more with each; rounded to two places."""
    return F.round(base * (F.lit(1.0) + F.lit(0.1) * ply), 2)


def chain_delta(norm: Column, before: Column) -> Column:
    """Seconds between two normalised clocks, never below 0."""
    return F.greatest(clock_denorm(norm) - clock_denorm(before), F.lit(0.0))


#: Forms of a time that are tried in turn after the engine's own.
TIME_FORMS = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "yyyyMMdd")


def parse_time(text: Column) -> Column:
    """A UTC timestamp of a text in ISO form (with or without offset) or one of TIME_FORMS; else
    null. Texts without an offset are in the session's zone, which should be UTC."""
    forms = [F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMS]
    return F.coalesce(F.when(text.rlike(r"^\s*\d{4}-"), text.try_cast("timestamp")), *forms)

def pad(values: Column, length: int | Column, fill: int = -1, post: bool = True) -> Column:
    """Cut to ``length`` and fill up to it, behind (or before) the values."""
    length = F.lit(length) if isinstance(length, int) else length
    cut = F.slice(values, F.lit(1), length)
    more = F.array_repeat(F.lit(fill), length - F.size(cut))
    return F.concat(cut, more) if post else F.concat(more, cut)


def unpad(values: Column, fill: int = -1) -> Column:
    return F.filter(values, lambda x: x != fill)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """0 for a constant column, -1 for a missing value."""
    return F.when(x.isNull(), F.lit(-1.0)).when(high == low, F.lit(0.0)).otherwise((x - low) / (high - low))


def erf(x: Column) -> Column:
    """The error function: a series of positive terms, each the one before times 2 x^2 / (2 n + 3);
    beyond 6 it is 1 in doubles."""
    first = F.struct(F.abs(x).alias("last"), F.abs(x).alias("sum"))

    def add(a: Column, n: Column) -> Column:
        term = a["last"] * (2 * x * x) / (2 * n + 3)
        return F.struct(term.alias("last"), (a["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(0), F.lit(120)), first, add, lambda a: a["sum"])
    near = F.least(F.lit(2.0 / sqrt(pi)) * F.exp(-x * x) * series, F.lit(1.0))
    return F.signum(x) * F.when(F.abs(x) > 6, F.lit(1.0)).otherwise(near)


def activation(name: str, x: Column) -> Column:
    made = {
        "relu": lambda: F.greatest(x, F.lit(0.0)),
        "elu": lambda: F.when(x > 0, x).otherwise(F.expm1(x)),
        "gelu": lambda: F.lit(0.5) * x * (F.lit(1.0) + erf(x / F.lit(sqrt(2)))),
        "leaky_relu": lambda: F.when(x > 0, x).otherwise(x * F.lit(0.01)),
    }
    if name not in made:
        raise ValueError(f"Unknown activation: {name}")
    return made[name]()


def square_name(square: Column) -> Column:
    return F.concat(F.char(F.lit(97) + square % 8), (F.floor(square / 8) + 1).cast("string"))


def first_theme_mate(themes: Column) -> Column:
    """n of the first ``mateInN`` of a space-separated list; null where there is none."""
    return F.regexp_extract(themes, r"(?:^| )mateIn(\d+)", 1).try_cast("int")
