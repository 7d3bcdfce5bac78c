"""An equi-join for a large side with hot keys of which few rows meet: a Bloom filter before the shuffle, and salts for the keys that a sample shows to be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.slices import column, default_slices
from tidemill.sources.tables import kept, table

#: Bits for each key of the filter, hashes of a key, and bits at most (16 MB): with more keys the filter lets more rows through, never fewer.
BITS, HASHES, MOST_BITS = 12, 4, 1 << 27
#: Rows of the sample about. A key is hot from half a task's share of the rows; no more than 2 * slices keys can be.
SAMPLE = 200_000


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(HASHES)]


def bloom_words(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A one-row table ``words``: the Bloom filter of a column's values as an array of 64-bit words; and its number of bits.

    The number of keys is measured before. Bits are gathered word by word on the executors; the filter has 16 MB at most.
    """
    keys = df.where(column(key).isNotNull()).select(column(key).alias("k")).distinct()
    n = keys.count()
    bits = min(MOST_BITS, max(64, 1 << (BITS * n - 1).bit_length()))
    place = keys.select(F.explode(F.array(*_places(F.col("k"), bits))).alias("p"))
    # a bit of 64 as a signed number: the last one is the sign
    bit = F.when(F.col("p") % 64 == 63, F.lit(-(2**63))).otherwise(F.expr("shiftleft(1L, CAST(p % 64 AS INT))"))
    words = place.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(bit).alias("word"))
    every = df.sparkSession.range(bits // 64).select(F.col("id").alias("w"))
    whole = every.join(words, "w", "left").select("w", F.coalesce("word", F.lit(0)).alias("word"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "word"))), lambda x: x["word"]).alias("words")), bits


def may_contain(words: Column, bits: int, key: Column) -> Column:
    """False only for keys that the filter has not seen, and for null."""
    out = key.isNotNull()
    for place in _places(key, bits):
        out = out & (F.getbit(F.element_at(words, (F.floor(place / 64) + 1).cast("int")), (place % 64).cast("int")) == 1)
    return out


def hot_keys(df: DataFrame, key: str, slices: int) -> list:
    """Keys that have over half of one in ``slices`` of the rows in a sample of about SAMPLE rows, at most 2 * ``slices`` of them."""
    n = df.count()
    part = df.where(column(key).isNotNull()).select(column(key).alias("k")).sample(min(1.0, SAMPLE / max(n, 1)), seed=1)
    seen = part.groupBy("k").count()
    least = max(10, min(n, SAMPLE) / (2 * slices))
    return [r["k"] for r in seen.where(F.col("count") > least).orderBy(F.desc("count"), "k").limit(2 * slices).collect()]


def skewed_join(large: DataFrame, small: DataFrame, key: str, other: str | None = None, how: str = "inner", slices: int | None = None) -> DataFrame:
    """Pairs ``a, b`` (structs of the row of ``large`` and of ``small``) with equal keys, ``key`` of large and ``other`` (the same name by default) of small.

    A Bloom filter of the small side's keys takes out the rows of the large side that meet nothing, before
    they are shuffled; with ``how="left"`` these go to the result at once. The rows of a hot key are dealt to
    ``slices`` salts by a hash of the row, and the small side's rows of that key are there once for each salt. Adaptive
    execution splits what is still large, like a hot key whose rows are all the same.

    Defined results: a null key meets nothing; repeated rows are so many pairs; any column names are allowed.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    n, other = slices or default_slices(large.sparkSession), other or key
    words, bits = bloom_words(small, other)
    words = kept(words, "bloom")
    a = large.select(column(key).alias("k"), F.struct(*map(column, large.columns)).alias("a"))
    b = small.where(column(other).isNotNull()).select(column(other).alias("k"), F.struct(*map(column, small.columns)).alias("b"))
    passes = may_contain(words.scalar(), bits, F.col("k"))
    met = a.where(passes)
    hot = hot_keys(met, "k", n)
    is_hot = F.col("k").isin(hot) if hot else F.lit(False)
    salted = met.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("a"), F.lit(n))).otherwise(0).cast("int"))
    spread = b.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    out = salted.join(spread, ["k", "salt"], how).select("a", "b")
    if how == "left":
        out = out.union(a.where(~passes | F.col("k").isNull()).select("a", F.lit(None).cast(b.schema["b"].dataType)))
    return out


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines by part, where those of large quantities, a third of all, count as of part 1; and the small parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") > 33, 1).otherwise(F.col("l_partkey")).alias("k"))
    parts = table(spark, sf_dir, "part").where("p_size <= 5 OR p_partkey = 1").select(F.col("p_partkey").alias("k"), "p_brand", "p_size")
    return lines, parts


def join_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = skewed_join(*_sides(spark, sf_dir), "k")
    return met.select("a.l_orderkey", "a.l_linenumber", "a.l_partkey", "b.p_brand", "b.p_size")


def join_skewed_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = skewed_join(*_sides(spark, sf_dir), "k", how="left")
    return met.select("a.l_orderkey", "a.l_linenumber", "a.l_partkey", "b.p_brand")


QUERIES = {f.__name__: f for f in (join_skewed, join_skewed_left)}

_SIDES = "(SELECT *, CASE WHEN l_quantity > 33 THEN 1 ELSE l_partkey END AS k FROM lineitem) {} JOIN (SELECT * FROM part WHERE p_size <= 5 OR p_partkey = 1) ON k = p_partkey"
ORACLE_SQL = {
    "join_skewed": f"SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM {_SIDES.format('')}",
    "join_skewed_left": f"SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM {_SIDES.format('LEFT')}",
}
