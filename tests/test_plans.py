"""Plans: what reaches the scan, and how many shuffles a query takes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.functions import scalar
from tidemill.operators import analytic, ranges, relational
from tidemill.plans.inspect import plan_text, scans, shuffles
from tidemill.sources.tables import table
from tidemill.streaming import events


def test_filters_and_columns_reach_the_scan(spark, small):
    (scan,) = scans(relational.filter_project(spark, small))
    assert "l_discount" in scan["pushed"] and "l_quantity" in scan["pushed"]
    assert "l_comment" not in scan["columns"] and scan["columns"].count(":") == 5


def test_partition_filter_prunes(spark, small):
    from tidemill.sources.files import source_partitioned

    df = source_partitioned(spark, small)
    assert {r.l_returnflag for r in df.select("l_returnflag").distinct().collect()} == {"R"}


def test_one_shuffle_each(spark, small):
    assert shuffles(relational.scalar_subquery(spark, small)) == 1
    assert shuffles(analytic.agg_cube(spark, small)) == 1


def test_asof_join_edges(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 3, "z"), (None, 1, "n"), (None, 5, "m"), (1, None, "o")], "k long, t long, name string")
    right = spark.createDataFrame([(1, 5, 50), (1, 2, 20), (2, 4, 40), (None, 1, 77), (1, None, 99), (2, None, 98)], "k long, t long, v long")
    got = {r.name: r.v for r in ranges.asof_join(left, right, "k", "t", ["v"]).collect()}
    assert got == {"x": 50, "y": None, "z": None, "n": None, "m": None, "o": None}


def test_user_functions_take_nulls(spark):
    given = spark.createDataFrame([("AEx",), (None,), ("",)], "s string")
    assert [r[0] for r in given.select(scalar.vowels("s")).collect()] == [2, None, 0]
    assert given.lateralJoin(scalar.Pieces(F.col("s").outer())).where("s IS NULL").count() == 0


def test_range_join_names_its_times(spark):
    left = spark.createDataFrame([(1, datetime(2024, 1, 1, 10))], "k long, began timestamp")
    right = spark.createDataFrame([(1, datetime(2024, 1, 1, 10, 59)), (1, datetime(2024, 1, 1, 11, 1)), (1, datetime(2024, 1, 1, 9, 59)), (1, None), (None, datetime(2024, 1, 1, 10))], "k long, ended timestamp")
    got = relational.range_join(left, right, "k", "began", "ended", 3600).collect()
    assert [(r.began, r.ended) for r in got] == [(datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 10, 59))]


@pytest.mark.parametrize(("hint", "node"), [("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin")])
def test_join_strategies(spark, small, hint, node):
    """The three ways of an equi-join: the hint decides the plan and not the rows."""
    orders, lines = table(spark, small, "orders"), table(spark, small, "lineitem").select("l_orderkey", "l_quantity")
    joined = orders.join(lines.hint(hint), orders["o_orderkey"] == lines["l_orderkey"])
    assert node in plan_text(joined)
    assert joined.count() == lines.count()


def test_join_choice_by_size(spark, small):
    """Without a hint the size decides: a small side is broadcast, and with broadcasts off both sides are sorted."""
    assert "BroadcastHashJoin" in plan_text(relational.join_right(spark, small))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_text(relational.join_right(spark, small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sketches_are_near_the_truth(spark, small):
    """Estimates within their documented errors of the exact counts."""
    users = table(spark, small, "events")
    exact = {r.event_type: r.n for r in users.groupBy("event_type").agg(F.count_distinct("user_id").alias("n")).collect()}
    assert all(abs(r.users - exact[r.event_type]) <= 0.05 * exact[r.event_type] + 1 for r in analytic.agg_approximate(spark, small).collect())
    whole = users.select(F.count_distinct("user_id")).first()[0]
    assert abs(analytic.agg_sketch_union(spark, small).first().users - whole) <= 0.05 * whole + 1
    lines = table(spark, small, "lineitem")
    parts = {r.l_returnflag: (r.n, r.low, r.high) for r in lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"), F.percentile("l_extendedprice", 0.47).alias("low"), F.percentile("l_extendedprice", 0.53).alias("high")).collect()}
    for r in analytic.agg_sketches(spark, small).collect():
        n, low, high = parts[r.l_returnflag]
        assert abs(r.parts - n) <= 0.05 * n and low <= r.median <= high
    counts = {r.o_orderpriority: r.n for r in table(spark, small, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).collect()}
    top = analytic.agg_frequent(spark, small).collect()
    assert [r.n for r in top] == sorted(counts.values(), reverse=True)[:3] and all(counts[r.priority] == r.n for r in top)
    assert all(len(r.sketch) > 1000 for r in analytic.agg_count_min(spark, small).collect())


def test_normalisation_takes_marks_away(spark):
    given = spark.createDataFrame([("éàü ñ",), ("ﬁ ½",), ("plain",), (None,)], "s string")
    assert [r[0] for r in given.select(scalar.normalized("s")).collect()] == ["eau n", "fi 1⁄2", "plain", None]


def test_a_batch_that_runs_again_replaces_itself(spark, small):
    """The sink's folder of a batch is overwritten, so a retried batch isn't there twice."""
    df = events.stream(spark, small).select("event_id")
    seen = []
    original = df.writeStream.__class__.foreachBatch

    def twice(self, write):
        return original(self, lambda batch, number: (write(batch, number), write(batch, number), seen.append(number))[0])

    df.writeStream.__class__.foreachBatch = twice
    try:
        got = events.finished(df, "append")
    finally:
        df.writeStream.__class__.foreachBatch = original
    assert seen and got.count() == table(spark, small, "events").count()
