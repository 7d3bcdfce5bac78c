"""The Parquet tables of a data folder, and tables that are kept for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written to the shared folder and read again: computed once, and a lost executor costs only its tasks."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
