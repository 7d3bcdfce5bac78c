"""Streams beyond the catalogue's SQL: late rows, timers with rows out of order, state that is forgotten, and a table function."""

import itertools
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.functions import tables
from tidemill.session import shared_folder
from tidemill.streaming import events

BEGIN = datetime(2024, 5, 1)


def files(spark, batches, schema):
    """A stream with a batch for each list of rows."""
    path = shared_folder(spark, "batches")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_are_counted(spark, small):
    """In order no row is late; newest first, all but the first file are, and they are not in the result."""
    in_order, reverse = [], []
    right = events.finished(events.clicks_with_purchases(events.timed_stream(spark, small), events.timed_stream(spark, small)), "append", late=in_order)
    wrong = events.finished(events.clicks_with_purchases(events.timed_stream(spark, small, newest_first=True), events.timed_stream(spark, small, newest_first=True)), "append", late=reverse)
    assert in_order == [0] and reverse[0] > 0
    assert wrong.count() < right.count()
    clicks = spark.read.parquet(f"{small}/events.parquet").where("event_type = 'click'").count()
    assert right.where("purchase_id IS NULL").count() > 0 and right.select("click_id").distinct().count() <= clicks


def test_timers_close_sessions(spark):
    """Rows out of order within the watermark are merged; what comes after it is dropped; open sessions stay open."""
    at = lambda minutes: BEGIN + timedelta(minutes=minutes)
    batches = [
        [(1, at(0)), (1, at(100)), (2, at(10)), (None, at(20))],
        [(1, at(50)), (2, at(80)), (1, at(101))],  # 50 joins 0 and 100
        [(2, at(600)), (3, at(601))],
        [(3, at(610))],
        [(2, at(300)), (1, at(610)), (3, at(620))],  # 300 is late: the watermark of the batch before is 541
        [(9, at(2000))],
        [(9, at(2010))],
    ]
    late = []
    stream = files(spark, batches, "user_id long, ts timestamp")
    got = events.timed_sessions(stream, 3_600_000, late)
    minutes = lambda x: (datetime.fromtimestamp(x / 1e6) - datetime.fromtimestamp(BEGIN.timestamp())).total_seconds() / 60
    found = Counter((r.user_id, minutes(r.begin), minutes(r.finish), r.n) for r in got.collect())
    assert found == Counter([(1, 0, 101, 4), (2, 10, 10, 1), (2, 80, 80, 1), (None, 20, 20, 1), (2, 600, 600, 1), (3, 601, 620, 3), (1, 610, 610, 1)])
    assert late == [1]


@pytest.mark.parametrize(("ttl", "want"), [(86_400_000, {(1, "a"): 3, (1, "b"): 1, (2, "a"): 2}), (1, {(1, "a"): 1, (1, "b"): 1, (2, "a"): 2})])
def test_state_is_forgotten(spark, ttl, want):
    """With a day to live counts add up; with a millisecond each batch begins anew."""
    stream = files(spark, [[(1, "a"), (1, "a"), (1, "b")], [(2, "a"), (2, "a")], [(1, "a")]], "user_id long, event_type string")
    assert {(r.user_id, r.event_type): r.n for r in events.recent_counts(stream, ttl).collect()} == want


def test_users_share_their_state(spark):
    """Three buckets hold the state of a hundred users, in all three processors; ids beyond a float's whole numbers and none at all, values that are null."""
    rng = random.Random(3)
    users = [None, *(2**60 + k for k in range(100))]
    at = lambda k, m: BEGIN + timedelta(hours=5 * k, minutes=m)
    batches = [[(rng.choice(users), rng.choice("ab"), rng.choice((None, rng.random())), at(k, rng.randint(0, 30))) for _ in range(400)] for k in range(3)] + [[(7, "a", None, at(9, 0))], [(7, "b", None, at(9, 1))]]
    rows = [r for batch in batches for r in batch]
    stream = files(spark, batches, "user_id long, event_type string, value double, ts timestamp")
    got = {r.user_id: (r.n, r.top) for r in events.totals(stream, 3).collect()}
    want = {u: (sum(r[0] == u for r in rows), max((r[2] for r in rows if r[0] == u and r[2] is not None), default=None)) for u in {r[0] for r in rows}}
    assert got == want
    got = {(r.user_id, r.event_type): r.n for r in events.recent_counts(stream, 86_400_000, 3).collect()}
    assert got == Counter(r[:2] for r in rows)
    late = []
    got = Counter((r.user_id, r.n) for r in events.timed_sessions(stream, 3_600_000, late, 3).collect())
    assert late == [0] and got == Counter((u, n) for batch in batches[:3] for u, n in Counter(r[0] for r in batch).items())


def test_runs_of_any_table(spark):
    rows = [(None, None, 1), (None, None, 2), (None, 1.5, 3), ("k", 1.5, 2), ("k", 1.5, 1), ("k", None, 3), ("k", 1.5, 4)]
    df = spark.createDataFrame(rows, "who string, what double, i long").withColumns({c: F.lit("clash") for c in ("run", "n", "row")}).repartition(3)
    out = tables.runs(df, "who", "what", "i")
    assert out.dtypes == [("who", "string"), ("run", "int"), ("what", "double"), ("n", "bigint")]
    assert {tuple(r) for r in out.collect()} == {(None, 1, None, 2), (None, 2, 1.5, 1), ("k", 1, 1.5, 2), ("k", 2, None, 1), ("k", 3, 1.5, 1)}
    assert tables.runs(df.limit(0), "who", "what", "i").count() == 0
    with pytest.raises(Exception, match="no column of the table"):
        tables.runs(df, "who", "else", "i").collect()


def test_runs_over_batches(spark):
    """Runs that go on over many Arrow batches, several keys in one partition of the table; NaN equals NaN, also as a key; nested values and times keep their kinds."""
    rng = random.Random(8)
    rows = [(k, i, rng.choice((math.nan, None, 1.5)) if k != 2.0 else 7.0, [1, None] if i < 30 else None, {"a": i // 20}, BEGIN + timedelta(hours=i // 25)) for k in (math.nan, None, 2.0, -1.0, *map(float, range(10, 40))) for i in range(50)]
    df = spark.createDataFrame(rows, "k double, i long, d double, l array<int>, m map<string,int>, t timestamp").repartition(5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        for c, value in (("d", 2), ("l", 3), ("m", 4), ("t", 5)):
            out = tables.runs(df, "k", c, "i")
            assert dict(out.dtypes)[c] == dict(df.dtypes)[c]
            want = Counter()
            for k in {repr(r[0]) for r in rows}:
                for run, (v, of) in enumerate(itertools.groupby(repr(r[value]) for r in rows if repr(r[0]) == k), 1):
                    want[k, run, v, sum(1 for _ in of)] += 1
            assert Counter((repr(r.k), r.run, repr(r[c]), r.n) for r in out.collect()) == want
    finally:
        spark.conf.set(name, before)
