"""Slices of an ordered column: pieces of nearly equal numbers of rows, so that a key with many rows is several tasks.

The edges are approximate quantiles over all rows. A slice of a key then has no more than about
one in ``slices`` of all rows, whatever the key's share, unless more rows than that have one value.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slices at most, and the share of rows by which an edge may be off.
MOST, ACCURACY = 1024, 20_000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def fresh(names: Iterable[str], *wanted: str) -> list[str]:
    """Column names made from ``wanted`` that none of ``names`` is equal to, in whatever case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def default_slices(spark: SparkSession) -> int:
    """Twice the shuffle partitions, so that slices even out over the tasks."""
    return max(2, min(MOST, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def ticks(df: DataFrame, name: str) -> Column:
    """The column as a number in the same order: microseconds of times, days of dates."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        # by difference and not through a time zone, in which clock times may come twice or not at all
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {quoted(name)})")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column(name))
    if isinstance(kind, T.DateType):
        return F.unix_date(column(name)).cast("long")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column(name).cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return column(name).cast("double") if isinstance(kind, T.FloatType) else column(name)
    raise TypeError(f"column {name} of type {kind.simpleString()} has no order in numbers")


def edges(df: DataFrame, name: str, slices: int, apart: float = 0) -> list:
    """Ascending edges that cut the rows by the numeric column into at most ``slices`` slices, each at least ``apart`` from the one before."""
    found = df.agg(F.percentile_approx(column(name), [k / slices for k in range(1, slices)], ACCURACY).alias("e")).first()["e"] if slices > 1 else []
    out: list = []
    for x in found or []:
        if x == x and abs(x) != math.inf and (not out or (x > out[-1] and x - out[-1] >= apart)):
            out.append(x)
    return out


def slice_of(name: str, found: list) -> Column:
    """The number of edges below the value, by a binary search; null for null."""

    def literal(x: object) -> str:
        return f"CAST('{x}' AS DOUBLE)" if isinstance(x, float) else f"{x}BD" if not isinstance(x, int) else f"{x}L" if x >= 0 else f"(-{-x}L)"

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"CASE WHEN {quoted(name)} <= {literal(found[mid])} THEN {tree(low, mid)} ELSE {tree(mid + 1, high)} END"

    return F.expr(f"CASE WHEN {quoted(name)} IS NOT NULL THEN {tree(0, len(found))} END")
