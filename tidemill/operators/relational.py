"""Projection, subqueries, joins, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators.slices import fresh
from tidemill.sources.tables import table


def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_discount") >= 0.05) & (F.col("l_quantity") < 24))
    return lines.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


def exists_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


def scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders above their customer's average, by a window instead of a self-join."""
    orders = table(spark, sf_dir, "orders").withColumn("mean", F.avg("o_totalprice").over(Window.partitionBy("o_custkey")))
    return orders.where("o_totalprice > mean").select("o_orderkey", "o_custkey")


#: The types of events.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def pivot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by type; the values are given, so no job looks for them."""
    events = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", EVENT_TYPES).agg(F.count(F.lit(1)))
    return events.select("user_id", *(F.coalesce(F.col(k), F.lit(0)).cast("long").alias(f"n_{k}") for k in EVENT_TYPES))


def unpivot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], "measure", "amount")


def explode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")


def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer")
    return customers.join(late, customers["c_custkey"] == late["o_custkey"], "left").select("c_custkey", "n")


def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("a")).agg(F.count("*").alias("customers"))
    right = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("b")).agg(F.count("*").alias("suppliers"))
    return left.join(right, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("nation"), "customers", "suppliers")


def join_full_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full outer join with a further predicate: it decides who meets, and all others stay alone."""
    left = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_custkey", "c_nationkey", "c_acctbal")
    right = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return left.join(right, (left["c_nationkey"] == right["s_nationkey"]) & (right["s_acctbal"] > left["c_acctbal"]), "full").select("c_custkey", "s_suppkey")


def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 8000")
    nations = table(spark, sf_dir, "nation")
    return suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"], "right").select("n_name", "s_suppkey")


def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of regions: a table of fixed size with itself."""
    region = table(spark, sf_dir, "region")
    return region.select(F.col("r_name").alias("a")).crossJoin(region.select(F.col("r_name").alias("b")))


def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


def join_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer a subquery of their orders, which Spark turns into an aggregate and a join."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_custkey") == F.col("c_custkey").outer())
    found = orders.select(F.count("*").alias("n"), F.max("o_totalprice").alias("top"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"))
    return table(spark, sf_dir, "customer").lateralJoin(found).select("c_custkey", "n", "top", "dearest")


def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions by inequality; both sides have a fixed number of rows, and Spark sees to it that a small one is broadcast."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] < region["r_regionkey"]).select("n_name", "r_name")


def range_join(left: DataFrame, right: DataFrame, key: str, time: str, other: str, seconds: int) -> DataFrame:
    """Pairs with one key whose times are at most ``seconds`` apart (``other`` of right at or after ``time`` of left).

    Times fall into buckets of that width, so each row meets those of two buckets
    and no others; ``left`` and ``right`` must have different columns but for the key.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    (name,) = fresh([*left.columns, *right.columns], "bucket")
    a = left.withColumn(name, bucket(time))
    b = right.withColumn(name, F.explode(F.array(bucket(other), bucket(other) - 1)))
    gap = F.col(other) - F.col(time)
    return a.join(b, [key, name]).where((F.col(other) >= F.col(time)) & (gap <= F.make_dt_interval(secs=F.lit(seconds)))).drop(name)


def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "ts")
    right = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("other_time"))
    return range_join(left, right, "user_id", "ts", "other_time", 6 * 3600).select("user_id", "click_id", "purchase_id")


def sort_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def sort_top_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(order)).where("place <= 2").select("o_custkey", "o_orderkey", "place")


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("k"))


def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.unionByName(b)


def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_union_all(spark, sf_dir).distinct()


def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.intersect(b)


def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 9500").select(F.col("s_nationkey").alias("k"))
    return a.union(b).subtract(rich)


def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.exceptAll(b)


QUERIES = {
    f.__name__: f
    for f in (filter_project, exists_correlated, scalar_subquery, pivot_events, unpivot_lines, explode_words, join_inner, join_left, join_full, join_full_bounded, join_right, join_cross, join_anti, join_lateral, join_theta, join_range, sort_top, sort_top_by_group, set_union_all, set_union, set_intersect, set_except, set_except_all)
}

_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 3000"
ORACLE_SQL = {
    "filter_project": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24",
    "exists_correlated": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "scalar_subquery": "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "pivot_events": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in EVENT_TYPES) + " FROM events GROUP BY user_id",
    "unpivot_lines": "SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem",
    "join_full_bounded": "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) FULL JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal > c_acctbal",
    "explode_words": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word",
    "join_inner": "SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'",
    "join_left": "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON c_custkey = o_custkey",
    "join_full": "SELECT coalesce(a, b) AS nation, customers, suppliers FROM (SELECT c_nationkey AS a, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS b, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON a = b",
    "join_right": "SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 8000) RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "join_cross": "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "join_lateral": "SELECT c_custkey, n, top, dearest FROM customer, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS top, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders WHERE o_custkey = c_custkey)",
    "join_theta": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey",
    "join_range": "SELECT a.user_id, a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
    "sort_top": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sort_top_by_group": "SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 2",
    "set_union_all": f"{_A} UNION ALL {_B}",
    "set_union": f"{_A} UNION {_B}",
    "set_intersect": f"{_A} INTERSECT {_B}",
    "set_except": f"({_A} UNION ALL {_B}) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500",
    "set_except_all": f"{_A} EXCEPT ALL {_B}",
}
