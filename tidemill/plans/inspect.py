"""What the optimizer made of a DataFrame, for tests that hold a plan to its promise."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scans(df: DataFrame) -> list[dict[str, str]]:
    """For each Parquet scan of the plan the columns read and the filters pushed to it."""
    found = []
    for block in re.split(r"\n(?=\(\d+\) )", plan_text(df)):
        if re.match(r"\(\d+\) Scan parquet", block):
            columns = re.search(r"ReadSchema: struct<(.*)>", block)
            pushed = re.search(r"PushedFilters: \[(.*)\]", block)
            found.append({"columns": columns[1] if columns else "", "pushed": pushed[1] if pushed else ""})
    return found


def shuffles(df: DataFrame) -> int:
    """Exchanges in the initial plan, broadcasts not counted."""
    return len(re.findall(r"^\(\d+\) Exchange", plan_text(df), re.M))
