"""Aggregation, grouping sets and window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.sources.tables import table


def agg_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 1).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")


def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("l_returnflag"), F.col("l_linestatus")]
    return _sets(spark, sf_dir).groupingSets([[keys[0]], [keys[1]], []], *keys).agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("over_flags"))


def agg_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.round(F.sum(F.when(F.col("value") > 50, F.col("value"))), 4).alias("high"))


def agg_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.9), 6).alias("p90"))


def agg_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.covar_samp("l_quantity", "l_tax"), 6).alias("cov"))


def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


def agg_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted names in one string; a nation has few suppliers."""
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("names"))


def agg_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mergeable sketch of distinct users; its estimate depends on the engine, so there is no SQL to compare with."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("users"), F.percentile_approx("value", 0.5).alias("p50"))


def agg_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("dearest"))


def agg_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of a column with few of them, in order."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"), F.bool_and(F.col("o_totalprice") > 0).alias("paid"))


def agg_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of fixed size, whose estimates depend on the engine, so there is no SQL to compare with."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.theta_sketch_estimate(F.theta_sketch_agg("l_partkey")).alias("parts"), F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("l_extendedprice"), F.lit(0.5)).alias("median"))


def agg_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value (of equal ones the smallest) and the skewness of a column."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.expr("mode() WITHIN GROUP (ORDER BY l_linenumber)").alias("common"), F.round(F.skewness("l_extendedprice"), 6).alias("skew"))


def agg_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in order in one string, by the aggregate function for it; a region has few nations."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name)").alias("names"))


def agg_sketch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of all events from the sketches of each type, which merge without the rows."""
    parts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.hll_sketch_agg("user_id").alias("s"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("users"))


def agg_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent priorities from a sketch of fixed size, with their estimated counts."""
    top = table(spark, sf_dir, "orders").agg(F.expr("approx_top_k(o_orderpriority, 3)").alias("top"))
    return top.select(F.inline("top")).toDF("priority", "n")


def agg_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count-min sketch of the parts in each kind of line, as bytes."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_min_sketch("l_partkey", F.lit(0.001), F.lit(0.99), F.lit(7)).alias("sketch"))


def _by_user() -> object:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.rank().over(order).alias("r"), F.dense_rank().over(order).alias("d"))


def window_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _by_user()
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after"))


def window_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.ntile(4).over(order).alias("quarter"), F.round(F.percent_rank().over(order), 6).alias("pr"), F.round(F.cume_dist().over(order), 6).alias("cd"))


def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(_by_user().rowsBetween(-3, 0)), 4).alias("last_four"))


def window_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _by_user().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select("event_id", F.first("event_id").over(w).alias("first_id"), F.last("event_id").over(w).alias("last_id"), F.nth_value("event_id", 2).over(w).alias("second_id"))


QUERIES = {
    f.__name__: f
    for f in (agg_pricing_summary, agg_distinct, agg_rollup, agg_cube, agg_grouping_sets, agg_filtered, agg_percentile, agg_statistics, agg_having, agg_collect, agg_regression, agg_list, agg_sketches, agg_approximate, agg_shape, agg_listagg, agg_sketch_union, agg_frequent, agg_count_min, window_rank, window_lag_lead, window_ntile, window_rows, window_first_last)
}

_U = "PARTITION BY user_id ORDER BY ts, event_id"
ORACLE_SQL = {
    "agg_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS over_flags FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "agg_filtered": "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(sum(value) FILTER (WHERE value > 50), 4) AS high FROM events GROUP BY 1",
    "agg_percentile": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1",
    "agg_statistics": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(stddev_samp(l_quantity), 6) AS sd, round(covar_samp(l_quantity, l_tax), 6) AS cov FROM lineitem GROUP BY 1",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15",
    "agg_collect": "SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS names FROM supplier GROUP BY 1",
    "agg_regression": "SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS dearest FROM lineitem GROUP BY 1",
    "agg_list": "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities, bool_and(o_totalprice > 0) AS paid FROM orders GROUP BY 1",
    "agg_shape": "WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_returnflag, arg_min(l_linenumber, (-n, l_linenumber)) AS common FROM c GROUP BY 1), p AS (SELECT l_returnflag, avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY 1) SELECT l_returnflag, any_value(common) AS common, round(avg(((l_extendedprice - mu) / sd) ** 3), 6) AS skew FROM lineitem JOIN m USING (l_returnflag) JOIN p USING (l_returnflag) GROUP BY 1",
    "agg_listagg": "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY 1",
    "window_rank": "SELECT l_orderkey, l_linenumber, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity DESC)",
    "window_lag_lead": f"SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after FROM events WINDOW w AS ({_U})",
    "window_ntile": "SELECT c_custkey, CAST(ntile(4) OVER w AS INTEGER) AS quarter, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)",
    "window_rows": f"SELECT event_id, round(sum(value) OVER ({_U} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS last_four FROM events",
    "window_first_last": f"SELECT event_id, first_value(event_id) OVER w AS first_id, last_value(event_id) OVER w AS last_id, nth_value(event_id, 2) OVER w AS second_id FROM events WINDOW w AS ({_U} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
}
