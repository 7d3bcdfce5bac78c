"""Intermediate tables: what may be broadcast, and that they can be deleted."""

import os

from pyspark.sql import functions as F

from tidemill import session
from tidemill.llm import scratch
from tidemill.plans.inspect import plan_text


def test_only_measured_tables_are_broadcast(spark):
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array("id", "id").alias("a"), F.struct("id").alias("t"), F.lit(None).cast("string").alias("n"))
    left = spark.range(100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_text(left.join(scratch.sized(rows, 200_000), "id"))
        assert "SortMergeJoin" in plan_text(left.join(scratch.sized(rows, 100_000), "id"))
        assert "BroadcastHashJoin" in plan_text(left.join(scratch.sized(rows.where("id % 1000 = 999"), 1), "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_clear(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    (tmp_path / "tidemill" / "other").mkdir(parents=True)  # another application's
    table = scratch.table(spark.range(3), "numbers")
    assert table.count() == 3 and len(os.listdir(tmp_path / "tidemill")) == 2
    scratch.clear(spark)
    assert os.listdir(tmp_path / "tidemill") == ["other"]
