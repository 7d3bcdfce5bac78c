"""Intermediate tables in the folder that all executors share.

An operator that needs a result twice, or needs a row layout to stay fixed,
writes a table here and reads it back: that cuts the lineage, and a lost executor
costs only the tasks that ran on it. ``clear`` deletes them once results are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import application_folder, shared_folder

#: A side of a join with at most so many bytes, as counted in all its rows, may be broadcast.
BROADCAST_BYTES = 16 << 20
_FIXED = (T.LongType, T.IntegerType, T.DoubleType, T.BooleanType, T.TimestampType, T.DateType)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it as read from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(column, kind: T.DataType):
    """Bytes of a value in memory, about."""
    if isinstance(kind, _FIXED):
        return F.lit(8)
    if isinstance(kind, T.StructType):
        return sum((_bytes(column[f.name], f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, _FIXED):
        return F.lit(16) + 8 * F.coalesce(F.size(column), F.lit(0))
    return F.lit(16) + F.coalesce(F.octet_length(column.cast("string") if not isinstance(kind, (T.StringType, T.BinaryType)) else column), F.lit(0))


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``limit`` bytes in memory; beyond that the join shuffles.

    All rows are measured, so ``df`` should be a scratch table.
    """
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(24))
    n = df.agg(F.sum(row.cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if n <= limit else df
