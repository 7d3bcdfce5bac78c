"""Table functions that take a table: their output's columns follow from the table's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.slices import column
from tidemill.sources.tables import table

#: Partitions of the table, each with the keys of one hash: a function's call for each key costs more than a short key's rows.
BUCKETS = 1 << 14


def changes(values: pa.Array) -> np.ndarray:
    """Which values after the first differ from the one before. Null equals null, and NaN equals NaN."""
    now, before = values.slice(1), values.slice(0, max(0, len(values) - 1))
    try:
        differ = pc.not_equal(now, before)
    except pa.ArrowNotImplementedError:  # nested kinds
        listed = values.to_pylist()
        return np.fromiter((x != y for x, y in zip(listed[1:], listed, strict=False)), bool, max(0, len(listed) - 1))
    if pa.types.is_floating(values.type):
        differ = pc.and_(differ, pc.invert(pc.and_(pc.is_nan(now), pc.is_nan(before))))
    return pc.coalesce(differ, pc.not_equal(pc.is_null(now), pc.is_null(before))).to_numpy(zero_copy_only=False)


class Runs:
    """Runs of equal values, one row each, in a table of ``key`` and ``value`` whose rows come by key and in order.

    The output has both, ``run`` (from 1 in each key) and ``n`` (rows). A partition of the table is read as a stream of
    Arrow batches; the last run of a batch, which may go on in the next one, is all that is held.
    """

    def __init__(self) -> None:
        self.last, self.run, self.n = None, 1, 1

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        key, value = rows.column("key"), rows.column("value")
        if self.last:
            key, value = (pa.concat_arrays(pair) for pair in zip(self.last, (key, value), strict=True))
        if not len(key):
            return
        new_key = np.concatenate(([False], changes(key)))
        begins = np.concatenate(([0], np.flatnonzero(new_key[1:] | changes(value)) + 1))
        sizes = np.diff(begins, append=len(key))
        sizes[0] += self.n - 1  # the first row is that of the last run
        at = np.arange(len(begins))
        first = np.maximum.accumulate(np.where(new_key[begins], at, 0))
        run = at - first + np.where(first == 0, self.run, 1)
        self.last, self.run, self.n = (key.slice(begins[-1], 1), value.slice(begins[-1], 1)), int(run[-1]), int(sizes[-1])
        if len(begins) > 1:
            yield self.table(key.take(pa.array(begins[:-1])), run[:-1], value.take(pa.array(begins[:-1])), sizes[:-1])

    def terminate(self) -> Iterator[pa.Table]:
        if self.last:
            yield self.table(self.last[0], [self.run], self.last[1], [self.n])

    @staticmethod
    def table(key: pa.Array, run: np.ndarray | list, value: pa.Array, n: np.ndarray | list) -> pa.Table:
        return pa.table([key, pa.array(run, pa.int32()), value, pa.array(n, pa.int64())], ["key", "run", "value", "n"])


def runs(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The runs of ``value`` in each ``key``, in the order of the columns ``order``.

    The output has both under their own names and kinds, ``run`` (from 1 in each key) and ``n`` (rows). Null equals null, NaN
    equals NaN, and a table may have any other columns. The keys of one hash are one partition, sorted by key, so a key is in one task.
    """
    for name in (key, value):
        if name not in df.columns:
            raise ValueError(f"{name} is no column of the table, which has {', '.join(df.columns)}")
    kinds = [T.StructField("key", df.schema[key].dataType), T.StructField("run", T.IntegerType()), T.StructField("value", df.schema[value].dataType), T.StructField("n", T.LongType())]
    ranks = [f"order{i}" for i in range(len(order))]
    rows = df.select(column(key).alias("key"), column(value).alias("value"), *(column(c).alias(o) for c, o in zip(order, ranks, strict=True)), F.pmod(F.xxhash64(column(key)), F.lit(BUCKETS)).alias("bucket"))
    found = F.arrow_udtf(Runs, returnType=T.StructType(kinds))(rows.asTable().partitionBy("bucket").orderBy("key", *ranks))
    return found.toDF(key, "run", value, "n")


def udtf_runs_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of one type of each user."""
    return runs(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", "event_type", "ts", "event_id")


def udtf_runs_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same function over another table: runs of one flag along the lines of a supplier."""
    return runs(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"), "l_suppkey", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")


QUERIES = {f.__name__: f for f in (udtf_runs_of_events, udtf_runs_of_lines)}


def _sql(rows: str, key: str, value: str, order: str) -> str:
    marked = f"SELECT *, CASE WHEN {value} IS NOT DISTINCT FROM lag({value}) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM {rows} WINDOW w AS (PARTITION BY {key} ORDER BY {order})"
    numbered = f"SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM ({marked})"
    return f"SELECT {key}, CAST(run AS INTEGER) AS run, any_value({value}) AS {value}, count(*) AS n FROM ({numbered}) GROUP BY {key}, run"


ORACLE_SQL = {
    "udtf_runs_of_events": _sql("events", "user_id", "event_type", "ts, event_id"),
    "udtf_runs_of_lines": _sql("lineitem", "l_suppkey", "l_returnflag", "l_shipdate, l_orderkey, l_linenumber, l_partkey"),
}
