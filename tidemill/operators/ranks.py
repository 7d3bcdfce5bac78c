"""Ranks, running sums and quantiles of whole tables, without a task that has all rows or a buffer that has all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators.slices import column, default_slices, edges, fresh, slice_of, ticks
from tidemill.sources.tables import kept, table


def _alike(a: Row, b: Row) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def global_ranks(df: DataFrame, order: list[str], peers: int | None = None, buckets: int | None = None, running: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``row_number``, ``rank``, ``dense_rank``, ``percent_rank``, ``ntile`` (if ``buckets`` is given) and running sums over the whole table.

    ``order`` names the columns that sort, descending after a minus sign; rows that agree in the first
    ``peers`` of them (all by default) have one rank. ``running`` names sums up to and including the row.

    Rows are range-partitioned by the whole order, so that ties of its first columns are split as well, and ranked
    within their partition. A row for each partition (its number of rows, its sums, its first and last peers) goes
    to the driver and says what is added to the ranks of each; peers may end in any later partition.

    Defined results: nulls come first, after a minus sign last; nulls in sums count as 0; of rows that don't
    differ in ``order``, which stay together, any comes first; an empty table gives no rows; the new columns' names
    may not be there before, all other names may.
    """
    running = running or {}
    made = ["row_number", "rank", "dense_rank", "percent_rank", *(["ntile"] if buckets else []), *running]
    if clash := {c.lower() for c in df.columns} & {c.lower() for c in made}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    names = [c.removeprefix("-") for c in order]
    by = [column(n).desc() if c.startswith("-") else column(n).asc() for c, n in zip(order, names, strict=True)]
    n_peers = peers or len(order)
    row, rank, dense, part, before, first_rank, groups, *rest = fresh([*df.columns, *made], "row", "rank_", "dense", "part", "before", "first_rank", "groups", *(f"{k}{i}" for k in ("sum", "less") for i in range(len(running))))
    sums, less = rest[: len(running)], rest[len(running) :]

    placed = df.repartitionByRange(*by).withColumn(part, F.spark_partition_id())
    within, alike = (Window.partitionBy(column(part)).orderBy(*x) for x in (by, by[:n_peers]))
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    added = [F.sum(F.coalesce(x, F.lit(0))).over(so_far).alias(s) for s, x in zip(sums, running.values(), strict=True)]
    ranked = kept(placed.select("*", F.row_number().over(within).cast("long").alias(row), F.rank().over(alike).cast("long").alias(rank), F.dense_rank().over(alike).cast("long").alias(dense), *added), "ranked")

    key = F.struct(*(column(c).alias(f"k{i}") for i, c in enumerate(names[:n_peers])))
    parts = ranked.groupBy(part).agg(F.count("*").alias("n"), F.min_by(key, row).alias("first"), F.max_by(key, row).alias("last"), F.max(rank).alias("last_rank"), F.max(dense).alias("groups"), *(F.max_by(s, row).alias(f"s{i}") for i, s in enumerate(sums)))
    total, distinct, last, last_start, sums_before, plan = 0, 0, None, 0, [None] * len(sums), []
    for r in sorted(parts.collect(), key=lambda r: r[part]):
        goes_on = last is not None and _alike(last, r["first"])
        start = last_start if goes_on else total + 1
        distinct -= goes_on
        plan.append((r[part], total, start, distinct, *sums_before))
        last, last_start = r["last"], start if r["last_rank"] == 1 else total + r["last_rank"]
        total, distinct = total + r["n"], distinct + r["groups"]
        sums_before = [r[f"s{i}"] if x is None else x + r[f"s{i}"] for i, x in enumerate(sums_before)]
    kinds = "".join(f", {name} {ranked.schema[s].dataType.simpleString()}" for name, s in zip(less, sums, strict=True))
    offsets = df.sparkSession.createDataFrame(plan, f"{part} int, {before} long, {first_rank} long, {groups} long{kinds}")

    out = ranked.join(F.broadcast(offsets), part)
    number, place = column(row) + column(before), F.when(column(rank) == 1, column(first_rank)).otherwise(column(rank) + column(before))
    found = {"row_number": number, "rank": place, "dense_rank": column(dense) + column(groups), "percent_rank": (place - 1) / F.lit(float(max(total - 1, 1)))}
    if buckets:
        each, more = divmod(total, buckets)
        wide = (each + 1) * more  # so many rows are in the first buckets, which have one row more
        at = f"`{row}` + `{before}`"
        found["ntile"] = F.expr(f"CASE WHEN {at} <= {wide} THEN 1 + ({at} - 1) div {each + 1} ELSE 1 + {more} + ({at} - 1 - {wide}) div {max(each, 1)} END").cast("int")
    found |= {name: column(s) + F.coalesce(column(x), F.lit(0)) for name, s, x in zip(running, sums, less, strict=True)}
    return out.select(*map(column, df.columns), *(c.alias(name) for name, c in found.items()))


def exact_quantiles(df: DataFrame, groups: list[str], value: str, shares: list[float], slices: int | None = None) -> DataFrame:
    """The exact quantiles of ``value`` in each group at each of ``shares``, interpolated between two values: ``groups..., share, quantile``.

    Equal values are counted first. Values are cut into slices of about equal numbers of rows, and the numbers of rows of
    each (group, slice) say in which slices the ranks wanted lie; only those are sorted, a (group, slice) a task at
    most. Nothing holds the values of a group.

    Defined results: null values don't count, and a group without others gives null; NaN counts as the largest; null is a
    group; an empty table gives no rows, also without ``groups``.
    """
    k = F.struct(*(column(c).alias(f"k{i}") for i, c in enumerate(groups)), F.lit(0).alias("one"))
    given = df.select(k.alias("k"), ticks(df, value).alias("v"))
    counted = kept(given.groupBy("k", "v").agg(F.count("*").alias("n")), "counted")
    valued = counted.where("v IS NOT NULL")
    cut = valued.withColumn("slice", slice_of("v", edges(valued, "v", slices or default_slices(df.sparkSession))))
    sizes = cut.groupBy("k", "slice").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("k").orderBy("slice")
    sizes = sizes.select("k", "slice", "n", (F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("k")).alias("total"))
    place = F.explode(F.array(*map(F.lit, map(float, shares)))).alias("share")
    wanted = sizes.select("*", place).withColumn("at", F.col("share") * (F.col("total") - 1)).select("*", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    wanted = wanted.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select("k", "slice", "share", "at", "rank", "before")
    needed = cut.join(wanted.select("k", "slice").distinct(), ["k", "slice"], "left_semi")
    upto = Window.partitionBy("k", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    sums = needed.select("k", "slice", "v", F.sum("n").over(upto).alias("upto"), "n")
    met = wanted.join(sums, ["k", "slice"]).where((F.col("rank") - F.col("before") < F.col("upto")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("n")))
    ends = met.groupBy("k", "share").agg(F.min_by("v", "rank").alias("low"), F.max_by("v", "rank").alias("high"), (F.max("at") - F.min("rank")).alias("part"))
    found = ends.select("k", "share", F.when(F.col("low") == F.col("high"), F.col("low").cast("double")).otherwise(F.col("low") + (F.col("high") - F.col("low")).cast("double") * F.col("part")).alias("quantile"))
    every = counted.select("k").distinct().select("k", place)
    out = every.join(found, ["k", "share"], "left")
    return out.select(*(F.col(f"k.k{i}").alias(c) for i, c in enumerate(groups)), "share", "quantile")


def agg_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five quantiles of the prices of each kind of line."""
    out = exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.0, 0.25, 0.5, 0.95, 1.0])
    return out.select("l_returnflag", "l_linestatus", "share", F.round("quantile", 6).alias("quantile"))


def window_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of all lines by quantity (few values, so ties run over partitions), and the running sum of quantities."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    out = global_ranks(lines, ["-l_quantity", "l_orderkey", "l_linenumber", "l_partkey"], peers=1, buckets=100, running={"total": F.col("l_quantity")})
    return out.select("l_orderkey", "l_linenumber", "row_number", "rank", "dense_rank", F.round("percent_rank", 8).alias("percent_rank"), "ntile", "total")


QUERIES = {f.__name__: f for f in (agg_quantiles, window_global)}

ORACLE_SQL = {
    "agg_quantiles": "SELECT l_returnflag, l_linestatus, CAST(s AS DOUBLE) AS share, round(CASE s WHEN 0.0 THEN quantile_cont(l_extendedprice, 0.0) WHEN 0.25 THEN quantile_cont(l_extendedprice, 0.25) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) WHEN 0.95 THEN quantile_cont(l_extendedprice, 0.95) ELSE quantile_cont(l_extendedprice, 1.0) END, 6) AS quantile FROM lineitem, (SELECT unnest([0.0, 0.25, 0.5, 0.95, 1.0]) AS s) GROUP BY l_returnflag, l_linestatus, s",
    "window_global": "SELECT l_orderkey, l_linenumber, row_number() OVER w AS row_number, rank() OVER p AS rank, dense_rank() OVER p AS dense_rank, round(percent_rank() OVER p, 8) AS percent_rank, CAST(ntile(100) OVER w AS INTEGER) AS ntile, sum(l_quantity) OVER w AS total FROM lineitem WINDOW w AS (ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (ORDER BY l_quantity DESC)",
}
