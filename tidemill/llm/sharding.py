"""Sharding with a two-pass external shuffle, in DataFrame functions only.

The first pass scatters the records by seeded hashes into buckets sized for
memory: the shard by rendezvous hashing of the key, so that a further shard takes
rows only into itself, and the bucket within the shard by a hash of the whole record.
Each bucket is a partition of Spark's shuffle, which is the external memory. The second
pass sorts a bucket by its records' hashes, shuffles it in memory (Spark's ``shuffle``
is a Fisher-Yates, seeded by the partition's number, here the bucket's), numbers its
records after those of the shard's earlier buckets, and writes it.

The result depends on the rows and the seed alone, not on how the input is
partitioned or in which order buckets are fetched. Records that are equal in all
columns are counted before they move, and their copies dealt to buckets one by one.

Defined results: a null text has no bytes, a null doc_id is a key of its own;
equal doc_ids share a shard; an empty table gives no rows; further columns are
carried along, but those named ``shard``, ``slot``, ``grown_shard`` or ``bucket`` are
replaced or dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import scratch
from tidemill.operators.slices import fresh

SHARDS = 8
SEED = 20_240_229
#: Text bytes of a bucket, on average.
BUCKET_BYTES = 8 << 20


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of the text, plus 1."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is the highest."""
    return F.greatest(*(F.struct(F.xxhash64(key, F.lit(seed), F.lit(k)).alias("h"), F.lit(k).alias("k")) for k in range(shards)))["k"] if shards > 1 else F.lit(0)


def apart(docs: DataFrame, copy: str) -> DataFrame:
    """``docs`` with a column ``copy``: 0, and for the copies of a record that is there n times 0 to n - 1."""
    names = docs.columns
    r1, r2, n = fresh([*names, copy], "r1", "r2", "times")
    marks = [F.xxhash64(*names).alias(r1), F.xxhash64(F.lit(SEED), *names).alias(r2)]
    times = docs.select(*marks).groupBy(r1, r2).agg(F.count("*").alias(n)).where(F.col(n) > 1)
    times = scratch.table(times, "repeated_records")
    if times.isEmpty():
        return docs.withColumn(copy, F.lit(0).cast("long"))
    marked, known = docs.select("*", *marks), scratch.sized(times)
    single = marked.join(known, [r1, r2], "left_anti").select(*names, F.lit(0).cast("long").alias(copy))
    # collapses before its shuffle
    one = marked.join(known, [r1, r2]).groupBy(r1, r2, n).agg(F.first(F.struct(*names)).alias("r"))
    return single.unionByName(one.select("r.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(copy)))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``shard``, ``slot`` (gapless from 0 in each shard), ``grown_shard`` and ``bucket``, a partition for each bucket."""
    docs = docs.drop("shard", "slot", "grown_shard", "bucket")
    names = docs.columns
    (copy,) = fresh(names, "copy")
    total = docs.agg(F.sum(size_of()).alias("n")).first()["n"] or 0
    buckets = max(1, round(total / shards / bucket_bytes))
    docs = apart(docs, copy)
    own, other = (F.xxhash64(F.lit(seed + k), *names, copy) for k in (0, 1))
    bucket = (rendezvous(F.col("doc_id"), shards, seed) * buckets + F.pmod(own, F.lit(buckets))).cast("int").alias("bucket")
    counts = scratch.table(docs.select(bucket).groupBy("bucket").count(), "bucket_sizes")
    before = Window.partitionBy(F.floor(F.col("bucket") / buckets)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each bucket, so its size follows from bucket_bytes
    offsets = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))

    scattered = docs.select(bucket, other.alias("h"), F.struct(*names).alias("r")).repartitionById(shards * buckets, "bucket")
    sorted_ = scattered.sortWithinPartitions("bucket", "h")
    mixed = sorted_.groupBy("bucket").agg(F.shuffle(F.collect_list("r"), F.lit(seed)).alias("records"))
    placed = mixed.join(scratch.sized(offsets), "bucket").select("bucket", "before", F.posexplode("records").alias("at", "r"))
    return placed.select(
        *(F.col("r")[c].alias(c) for c in names),
        F.floor(F.col("bucket") / buckets).cast("int").alias("shard"),
        (F.col("before") + F.col("at")).alias("slot"),
        rendezvous(F.col("r.doc_id"), shards + 1, seed).cast("int").alias("grown_shard"),
        "bucket",
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard and in it one for each bucket, in the order of slots; each bucket is written by the task that shuffled it."""
    sharded.write.partitionBy("shard", "bucket").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of shards as written, with the columns of ``schema``."""
    return spark.read.schema(schema).parquet(path).select(schema.names)
