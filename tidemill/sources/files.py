"""File sources and sinks: each query writes a table in a format and reads it back by its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import shared_folder
from tidemill.sources.tables import table


def through(df: DataFrame, kind: str, partition: str | None = None, **options: str) -> DataFrame:
    """``df`` as written in format ``kind`` and read again with its own schema."""
    path = shared_folder(df.sparkSession, kind)
    writer = df.write.format(kind).options(**options)
    (writer.partitionBy(partition) if partition else writer).save(path)
    return df.sparkSession.read.format(kind).options(**options).schema(df.schema).load(path)


def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(table(spark, sf_dir, "customer"), "csv", header="true")


def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(table(spark, sf_dir, "supplier"), "json")


def source_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(table(spark, sf_dir, "part"), "orc")


def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(table(spark, sf_dir, "part").select(F.col("p_name").alias("value")), "text")


def source_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned Parquet table; the filter on the partition column prunes folders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return through(lines, "parquet", "l_returnflag").where("l_returnflag = 'R'").select(lines.columns)


def source_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(table(spark, sf_dir, "supplier"), "xml", rowTag="supplier")


def source_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as bytes: the size of the text files of the customers of each nation."""
    path = shared_folder(spark, "binary")
    table(spark, sf_dir, "customer").select(F.col("c_name").alias("value"), "c_nationkey").repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    files = spark.read.format("binaryFile").load(path).select("c_nationkey", F.length("content").cast("long").alias("bytes"))
    return files.groupBy("c_nationkey").agg(F.sum("bytes").alias("bytes"))


QUERIES = {f.__name__: f for f in (source_csv, source_json, source_orc, source_text, source_partitioned, source_xml, source_binary)}

ORACLE_SQL = {
    "source_csv": "SELECT * FROM customer",
    "source_json": "SELECT * FROM supplier",
    "source_orc": "SELECT * FROM part",
    "source_text": "SELECT p_name AS value FROM part",
    "source_xml": "SELECT * FROM supplier",
    "source_binary": "SELECT c_nationkey, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes FROM customer GROUP BY 1",
    "source_partitioned": "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R'",
}
