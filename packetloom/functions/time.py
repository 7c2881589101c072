"""Capture time: seconds and a fraction in ticks of a resolution, never rounded."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000


def instant(seconds: Column, fraction: Column) -> Column:
    """Comparable within one resolution; null if either part is."""
    return F.when(seconds.isNotNull() & fraction.isNotNull(), F.struct(seconds.alias("seconds"), fraction.alias("fraction")))


def ticks_per_second(kind: Column, exponent: Column) -> Column:
    """10 or 2 to the exponent; null where that is no bigint, or the resolution is not known."""
    ten = F.when(exponent.between(0, 18), F.concat(F.lit("1"), F.repeat(F.lit("0"), exponent)).cast("bigint"))
    two = F.when(exponent.between(0, 62), F.expr("1L") * F.pow(F.lit(2.0), exponent).cast("bigint"))
    return F.when(kind == "decimal", ten).when(kind == "binary", two)


def duration(start: Column, end: Column, ticks_per_second: Column | int = MICRO, exact: bool = False) -> Column:
    """Ticks from start to end; null if either is, or end comes first, or a second's ticks are null.

    Unless exact, a duration that would borrow a second (a smaller fraction at the end) is null too:
    the behaviour that this engine's users have relied on. Overflow gives null.
    """
    later = (end["seconds"] > start["seconds"]) | ((end["seconds"] == start["seconds"]) & (end["fraction"] >= start["fraction"]))
    fine = later if exact else later & (end["fraction"] >= start["fraction"])
    ticks = F.try_add(F.try_multiply(F.try_subtract(end["seconds"], start["seconds"]), ticks_per_second if isinstance(ticks_per_second, Column) else F.lit(ticks_per_second)), end["fraction"] - start["fraction"])
    return F.when(fine, ticks)


def extrema(packets: DataFrame) -> list[tuple[int, int, str, int]]:
    """(seconds, fraction, res_kind, res_exp) of the earliest and latest packet over mixed resolutions; [] without time.

    Spark reduces to one candidate for each resolution, at most 256 rows; those compare as exact fractions.
    """
    t = instant(F.col("seconds"), F.col("fraction"))
    rows = packets.groupBy("res_kind", "res_exp").agg(F.min(t).alias("a"), F.max(t).alias("b")).where("a is not null").collect()
    if not rows:
        return []
    exact = lambda p, r: p.seconds + Fraction(p.fraction, (10 if r.res_kind == "decimal" else 2) ** r.res_exp)
    first = min(rows, key=lambda r: exact(r.a, r))
    last = max(rows, key=lambda r: exact(r.b, r))
    return [(first.a.seconds, first.a.fraction, first.res_kind, first.res_exp), (last.b.seconds, last.b.fraction, last.res_kind, last.res_exp)]
