"""Structured Streaming over the events: each query runs what is there to its end and returns the result table.

The source is a stream of files in the order of time, the sink a Parquet table in the
shared folder with a folder for each batch, so that a batch that is run again replaces
what it wrote. A result is that of the batch query in its SQL. Watermarks bound the state
wherever rows are grouped or remembered.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.session import shared_folder
from tidemill.sources.tables import table

#: Files that a table is dealt to, in the order of time, to be streamed one by one.
FILES = 3


def stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream; its time as a timestamp, which watermarks need."""
    schema = table(spark, sf_dir, name).schema
    # as a pattern the path may be a folder or a single file
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def timed_stream(spark: SparkSession, sf_dir: str, files: int = FILES, newest_first: bool = False) -> DataFrame:
    """The events as a stream of files by time, one a batch, so that watermarks move and windows close on the way.

    With ``newest_first`` the files come in the wrong order, and all but the first one are late.
    """
    events = table(spark, sf_dir, "events")
    edges = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [k / files for k in range(1, files)]).alias("e")).first()["e"] or []
    path, at = shared_folder(spark, "stream"), F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = list(zip([None, *edges], [*edges, None], strict=True))
    for low, high in reversed(bounds) if newest_first else bounds:
        part = events.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def finished(df: DataFrame, mode: str, keys: list[str] | None = None, late: list[int] | None = None) -> DataFrame:
    """The sink's table after all input is processed. To ``late`` the number of rows is added that came after the watermark and were dropped.

    Mode ``append`` adds each batch, ``complete`` takes the last batch, ``update`` the last row of each ``keys``.
    """
    spark = df.sparkSession
    path, place = shared_folder(spark, "sink"), shared_folder(spark, "progress")
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", place).foreachBatch(write).start()
    query.awaitTermination()
    if late is not None:
        late.append(sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators))
    out = spark.read.option("basePath", path).parquet(path)
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    elif mode == "update":
        rest = [c for c in df.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
    return out.select(df.columns)


def _begin(column: str) -> Column:
    return F.col(f"{column}.start").cast("timestamp_ntz").alias("begin")


def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", "value")
    return finished(out, "append")


def _hourly(events: DataFrame) -> DataFrame:
    counts = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(_begin("window"), "event_type", "n")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(_hourly(stream(spark, sf_dir)), "complete")


def stream_tumbling_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed, each once; the state holds the open ones alone."""
    return finished(_hourly(timed_stream(spark, sf_dir)), "append")


def stream_tumbling_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as they change; the last word on each is the result."""
    return finished(_hourly(timed_stream(spark, sf_dir)), "update", ["begin", "event_type"])


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = timed_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return finished(counts.select(_begin("window"), "n"), "append")


def _sessions(events: DataFrame) -> DataFrame:
    counts = events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "1 hour"), "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", _begin("session_window"), "n")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(_sessions(stream(spark, sf_dir)), "complete")


def stream_session_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    return finished(_sessions(timed_stream(spark, sf_dir)), "append")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type; the state is as large as the keys."""
    return finished(stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")


def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive twice, once; an id is remembered for as long as a copy may come."""
    events = timed_stream(spark, sf_dir).select("event_id", "ts")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withWatermark("ts", "1 hour")
    return finished(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "append")


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within an hour after a click of the same user; watermarks bound the state."""
    events = stream(spark, sf_dir)
    clicks = events.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("click_id"), F.col("ts").alias("clicked")).withWatermark("clicked", "2 hours")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), "ts").withWatermark("ts", "2 hours")
    out = bought.join(clicks, F.expr("user_id = u AND ts >= clicked AND ts <= clicked + INTERVAL 1 HOUR"))
    return finished(out.select("user_id", "click_id", "purchase_id"), "append")


def clicks_with_purchases(events: DataFrame, other: DataFrame) -> DataFrame:
    """Clicks with the purchases of their user within an hour after; those without any once the watermark says that none can come."""
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked")).withWatermark("clicked", "2 hours")
    bought = other.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("event_id").alias("purchase_id"), "ts").withWatermark("ts", "2 hours")
    return clicks.join(bought, F.expr("user_id = u AND ts >= clicked AND ts <= clicked + INTERVAL 1 HOUR"), "left_outer").select("user_id", "click_id", "purchase_id")


def stream_join_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left outer join of two streams; clicks that the final watermark leaves open are not there yet."""
    return finished(clicks_with_purchases(timed_stream(spark, sf_dir), timed_stream(spark, sf_dir)), "append")


def stream_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running count of each user's events, kept in custom state; the last one of each user is its total."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total = (state.get[0] if state.exists else 0) + sum(map(len, frames))
        state.update((total,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [total]})

    counts = stream(spark, sf_dir).select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(step, "user_id long, n long", "n long", "append", "NoTimeout")
    return finished(counts, "append").groupBy("user_id").agg(F.max("n").alias("n"))


#: Users share their state by so many buckets: a call, a state and a timer cost about the same for one user as for hundreds.
BUCKETS = 256


def bucketed(events: DataFrame, buckets: int) -> DataFrame:
    """The rows with the ``bucket`` of their user, by a hash of it; those without a user have one of their own, as pandas turns whole numbers beside nulls into floats."""
    return events.withColumn("bucket", F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(buckets))).cast("int"))


def _listed(column: pd.Series) -> list:
    """The values as Python ones, null as None."""
    return [None if x is pd.NA else x for x in column.astype("Int64").tolist()]


class Totals(StatefulProcessor):
    """Count and highest value of each user of a bucket so far, in a named state variable."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "user_id array<bigint>, n array<bigint>, top array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        users, ns, tops = self.total.get() if self.total.exists() else ([], [], [])
        totals = {user: (n, top) for user, n, top in zip(users, ns, tops, strict=True)}
        changed: dict[int | None, None] = {}
        for frame in rows:
            found = frame.groupby(frame["user_id"].astype("Int64"), dropna=False)["value"].agg(["size", "max"])
            for user, m, high in zip(_listed(found.index.to_series()), found["size"].tolist(), found["max"].tolist(), strict=True):
                n, top = totals.get(user, (0, None))
                totals[user] = n + m, high if top is None and high == high else top if high != high else max(top, high)
                changed[user] = None
        self.total.update((list(totals), [n for n, _ in totals.values()], [top for _, top in totals.values()]))
        yield pd.DataFrame({"user_id": pd.array(list(changed), "Int64"), "n": [totals[u][0] for u in changed], "top": pd.array([totals[u][1] for u in changed], "Float64")})

    def close(self) -> None:
        pass


def totals(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The last word on each user's number of events and highest value (null if none has one)."""
    with settings(events.sparkSession, **ROCKSDB):
        rows = bucketed(events.select("user_id", "value"), buckets)
        found = rows.groupBy("bucket").transformWithStateInPandas(Totals(), "user_id long, n long, top double", "Update", "None")
        return finished(found, "update", ["user_id"])


def stream_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each user by a stateful processor, whose state lies in RocksDB."""
    return totals(timed_stream(spark, sf_dir))


class Sessions(StatefulProcessor):
    """Sessions of the users of a bucket, kept as a list until an event-time timer says that no row can join them any more.

    Rows may come in any order within the watermark: what they bring together is merged. A bucket's
    state are its open sessions, and it has one timer, for the one that ends first.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "user_id array<bigint>, begin array<bigint>, finish array<bigint>, n array<bigint>")

    def _found(self) -> list[tuple]:
        return list(zip(*self.open.get(), strict=True)) if self.open.exists() else []

    def _wait(self, found: list[tuple]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if found:
            self.open.update(tuple(map(list, zip(*found, strict=True))))
            self.handle.registerTimer((min(f for _, _, f, _ in found) + self.gap) // 1000 + 1)
        elif self.open.exists():
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self._found()
        for frame in rows:
            found += [(user, at, at, 1) for user, at in zip(_listed(frame["user_id"]), frame["at"].tolist(), strict=True)]
        merged: list[tuple] = []
        for user, begin, finish, n in sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x[1:])):
            if merged and user == merged[-1][0] and begin - merged[-1][2] <= self.gap:
                _, a, b, m = merged[-1]
                merged[-1] = user, a, max(b, finish), m + n
            else:
                merged.append((user, begin, finish, n))
        self._wait(merged)
        yield pd.DataFrame({"user_id": [], "begin": [], "finish": [], "n": []}, dtype="Int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, found = timerValues.getCurrentWatermarkInMs() * 1000, self._found()
        closed = [x for x in found if x[2] + self.gap < now]
        self._wait([x for x in found if x[2] + self.gap >= now])
        yield pd.DataFrame({name: pd.array([x[k] for x in closed], "Int64") for k, name in enumerate(("user_id", "begin", "finish", "n"))})

    def close(self) -> None:
        pass


class Recent(StatefulProcessor):
    """Events of each user of a bucket and type so far, in a map by type, whose users are forgotten ``ttl_ms`` after their last change.

    A type's entry of the map is forgotten as a whole once none of its users has changed for so long.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "event_type string", "user_id array<bigint>, n array<bigint>, changed_ms array<bigint>", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        found: dict[str | None, dict[int | None, int]] = {}
        for frame in rows:
            times = frame.groupby([frame["event_type"], frame["user_id"].astype("Int64")], dropna=False).size()
            names, users = (times.index.get_level_values(k) for k in (0, 1))
            for name, user, n in zip(names, _listed(users.to_series()), times.tolist(), strict=True):
                own = found.setdefault(name, {})
                own[user] = own.get(user, 0) + n
        out: list[tuple] = []
        for name, own in found.items():
            kept = {u: (n, at) for u, n, at in zip(*self.counts.getValue((name,)), strict=True) if at + self.ttl > now} if self.counts.containsKey((name,)) else {}
            kept |= {user: (n + kept.get(user, (0, 0))[0], now) for user, n in own.items()}
            self.counts.updateValue((name,), (list(kept), [n for n, _ in kept.values()], [at for _, at in kept.values()]))
            out += [(user, name, kept[user][0]) for user in own]
        yield pd.DataFrame({"user_id": pd.array([x[0] for x in out], "Int64"), "event_type": [x[1] for x in out], "n": [x[2] for x in out]})

    def close(self) -> None:
        pass


@contextmanager
def settings(spark: SparkSession, **given: str) -> Iterator[None]:
    """Settings of ``spark.sql.streaming`` that hold while a query is planned and run."""
    names = {f"spark.sql.streaming.{k.replace('_', '.')}": v for k, v in given.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


#: Named state variables and timers need state in RocksDB.
ROCKSDB = {"stateStore_providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def timed_sessions(events: DataFrame, gap_ms: int, late: list[int] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Sessions of each user that a timer has closed."""
    with settings(events.sparkSession, **ROCKSDB):
        rows = bucketed(events.withWatermark("ts", "1 hour").select("user_id", "ts", F.unix_micros("ts").alias("at")), buckets)
        closed = rows.groupBy("bucket").transformWithStateInPandas(Sessions(gap_ms), "user_id long, begin long, finish long, n long", "Append", "EventTime")
        return finished(closed, "append", late=late)


def stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with gaps of an hour, each given out by its timer."""
    out = timed_sessions(timed_stream(spark, sf_dir), 3_600_000)
    return out.select("user_id", *(F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("begin", "finish")), "n")


def recent_counts(events: DataFrame, ttl_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """The last word on how many events of each type a user had, without those forgotten.

    With processing time there is always another batch, so one without data would never let the stream end.
    """
    with settings(events.sparkSession, noDataMicroBatches_enabled="false", **ROCKSDB):
        counts = bucketed(events.select("user_id", "event_type"), buckets).groupBy("bucket").transformWithStateInPandas(Recent(ttl_ms), "user_id long, event_type string, n long", "Update", "ProcessingTime")
        return finished(counts, "update", ["user_id", "event_type"])


def stream_map_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by user and type in a map state whose entries live for a day without a change, longer than the stream runs."""
    return recent_counts(timed_stream(spark, sf_dir), 86_400_000)


def stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory sink, for small results: counts by type."""
    name = f"counts_{uuid.uuid4().hex}"
    counts = stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


QUERIES = {
    f.__name__: f
    for f in (stream_filter, stream_tumbling, stream_tumbling_append, stream_tumbling_update, stream_sliding, stream_session, stream_session_append, stream_dedup, stream_dedup_watermark, stream_join, stream_join_outer, stream_stateful, stream_processor, stream_timers, stream_map_state, stream_memory)
}

_SESSIONS = "WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m) SELECT user_id, min(ts) AS begin, count(*) AS n FROM s GROUP BY user_id, s"
_HOURS = "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS begin, event_type, count(*) AS n FROM events GROUP BY 1, 2"
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
ORACLE_SQL = {
    "stream_filter": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
    "stream_tumbling": _HOURS,
    "stream_tumbling_append": f"SELECT * FROM ({_HOURS}) WHERE begin + INTERVAL 1 HOUR <= {_CLOSED}",
    "stream_tumbling_update": _HOURS,
    "stream_sliding": f"SELECT * FROM (SELECT CAST(date_trunc('hour', ts) - to_hours(h) AS TIMESTAMP) AS begin, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS h) GROUP BY 1) WHERE begin + INTERVAL 2 HOUR <= {_CLOSED}",
    "stream_session": _SESSIONS,
    "stream_session_append": _SESSIONS + f" HAVING max(ts) + INTERVAL 1 HOUR <= {_CLOSED}",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_dedup_watermark": "SELECT event_id FROM events",
    "stream_join": "SELECT a.user_id, a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
    "stream_join_outer": "WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'), w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 2 HOUR AS w), j AS (SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id, c.ts FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR) SELECT user_id, click_id, purchase_id FROM j, w WHERE purchase_id IS NOT NULL OR ts + INTERVAL 1 HOUR < w",
    "stream_timers": f"SELECT user_id, begin, finish, n FROM (WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m) SELECT user_id, min(ts) AS begin, max(ts) AS finish, count(*) AS n FROM s GROUP BY user_id, s) WHERE finish + INTERVAL 1 HOUR < {_CLOSED}",
    "stream_map_state": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_stateful": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
    "stream_processor": "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1",
    "stream_memory": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
}
