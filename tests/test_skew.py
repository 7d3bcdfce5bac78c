"""The join for hot keys: equal to the plain one, few rows shuffled, no key lost by the filter."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill.operators import skew
from tidemill.plans.inspect import plan_text


def sides(spark):
    rng = random.Random(3)
    large = [(None if rng.random() < 0.03 else 7 if rng.random() < 0.35 else rng.randint(0, 3000), i) for i in range(4000)] + [(8, -1)] * 500
    small = [(k, f"s{k}") for k in range(0, 200)] + [(7, "twice"), (None, "none"), (8, "x")]
    clash = {c: F.lit("clash") for c in ("salt", "a", "b", "words", "w", "p")}
    return large, small, spark.createDataFrame(large, "k long, i long").withColumns(clash).repartition(4), spark.createDataFrame(small, "other long, v string").withColumns(clash)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skewed_join_equals_the_plain_one(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "SAMPLE", 1000)
    large, small, a, b = sides(spark)
    out = skew.skewed_join(a, b, "k", "other", how, 8).select(F.col("a.i"), F.col("a.k"), F.col("b.v"))
    met = {}
    for k, v in small:
        met.setdefault(k, []).append(v)
    want = Counter((i, k, v) for k, i in large for v in (met.get(k) if k is not None and k in met else [None] if how == "left" else []))
    assert Counter(map(tuple, out.collect())) == want
    assert skew.skewed_join(a, b.limit(0), "k", "other", how).count() == (len(large) if how == "left" else 0)
    assert skew.skewed_join(a.limit(0), b, "k", "other", how).count() == 0


def test_hot_keys_are_found_and_salted(spark, monkeypatch):
    monkeypatch.setattr(skew, "SAMPLE", 2000)
    _, _, a, b = sides(spark)
    assert set(skew.hot_keys(a, "k", 16)) == {7, 8}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = skew.skewed_join(a, b, "k", "other", slices=16)
        spread = out.where("a.k = 7").select(F.spark_partition_id().alias("p"), F.col("a.i")).groupBy("p").count().collect()
        assert "salt" in plan_text(out) and len(spread) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_filter_loses_no_key_and_lets_few_others_through(spark):
    keys = spark.range(0, 30_000, 3).withColumnRenamed("id", "k")
    words, bits = skew.bloom_words(keys, "k")
    assert words.select(F.size("words")).first()[0] == bits // 64
    tested = spark.range(60_000).select("id", skew.may_contain(words.scalar(), bits, F.col("id")).alias("there"))
    found = {r.id: r.there for r in tested.collect()}
    assert all(found[i] for i in range(0, 30_000, 3))
    others = [found[i] for i in range(60_000) if i % 3 or i >= 30_000]
    assert sum(others) < 0.03 * len(others)
    assert not spark.sql("SELECT CAST(NULL AS BIGINT) AS k").select(skew.may_contain(F.lit([0]).cast("array<long>"), 64, F.col("k"))).first()[0]


def test_few_rows_are_shuffled(spark, small):
    """The rows that reach the join's shuffle are those that meet something and few others; the filter stands below it."""
    lines, parts = skew._sides(spark, small)
    words, bits = skew.bloom_words(parts, "k")
    let = lines.where(skew.may_contain(words.scalar(), bits, F.col("k"))).count()
    meet = lines.join(parts, "k", "left_semi").count()
    assert meet <= let <= meet + 0.05 * lines.count() < lines.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(skew.skewed_join(lines, parts, "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tree = text.split("\n\n")[0]
    assert "Subquery" in text and tree.index("Exchange") < tree.index("Filter")  # a plan is printed from the top
