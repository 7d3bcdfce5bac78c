"""Scalar functions on strings, dates, numbers, JSON, arrays and maps, and the kinds of user-defined functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.tables import table


def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper("c_name").alias("up"), F.length("c_name").alias("n"), F.substring("c_name", 3, 4).alias("part"), F.replace("c_mktsegment", F.lit("U"), F.lit("_")).alias("swapped"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("padded"))


def fn_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_replace("url", r"\d+", "#").alias("masked"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


def fn_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


def fn_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofweek("o_orderdate").alias("dow"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"), F.date_diff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date")).alias("days"))


def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.sqrt("p_retailprice"), 6).alias("root"), F.round(F.ln("p_retailprice"), 6).alias("log"), F.expr("p_size div 7").cast("int").alias("quotient"), (F.col("p_size") % 7).alias("rest"), F.try_divide(F.col("p_retailprice"), F.lit(0.0)).alias("nothing"))


def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.get_json_object("props", "$.k").alias("k_text"))


def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared length of each vector, its largest item and its size, without leaving the JVM."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 4).alias("squared"), F.round(F.array_max(v), 6).alias("top"), F.size("embedding").alias("n"))


def fn_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of letters in the segment's name, through a map."""
    letters = F.create_map(F.lit("length"), F.length("c_mktsegment"), F.lit("u"), F.regexp_count("c_mktsegment", F.lit("U")))
    return table(spark, sf_dir, "customer").withColumn("m", F.map_filter(letters, lambda k, v: v > 0)).select("c_custkey", F.size("m").alias("n"), F.element_at("m", F.lit("length")).alias("size"))


def fn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, substitutions and distances of names and brands."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.split_part(name, F.lit(" "), F.lit(2)).alias("second"), F.translate("p_brand", "rand", "RAND").alias("swapped"), F.levenshtein("p_brand", F.lit("Brand#11")).alias("apart"), F.size(F.regexp_extract_all("p_type", F.lit("[A-Z]+"), 0)).alias("n_words"), F.initcap(name).alias("title"), F.reverse("p_brand").alias("backward"))


def fn_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"), F.parse_url("url", F.lit("PROTOCOL")).alias("protocol"))


def fn_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON kept as a variant, of which one field is taken."""
    events = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("v"))
    return events.select("event_id", F.variant_get("v", "$.k", "bigint").alias("k"))


def fn_posexplode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "item")).select("vec_id", "place", F.round(F.col("item").cast("double"), 5).alias("item"))


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    """NFKD without marks, which Spark has no function for."""
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def udf_vectorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without accents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalized("text")).alias("plain_md5"), (normalized("text") == F.col("text")).alias("was_plain"))


def fn_hash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own 64-bit hash and a phonetic key, which no SQL of another engine has."""
    return table(spark, sf_dir, "part").select("p_partkey", F.xxhash64("p_name", "p_size").alias("h"), F.soundex("p_name").alias("sound"))


def fn_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns to JSON and fields out of it."""
    made = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct("c_name", "c_nationkey")).alias("j"))
    return made.select("c_custkey", "j", F.json_tuple("j", "c_name", "c_nationkey").alias("name", "nation"))


def fn_array_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two arrays side by side, a slice, and an array of arrays made flat."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    moved = F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: b - a)
    total = F.aggregate(moved, F.lit(0.0), lambda a, x: a + F.abs(x))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 4).alias("path"), F.size(F.flatten(F.array(v, F.slice(v, 1, 3)))).alias("n"), F.round(F.slice(v, 60, 2)[1], 5).alias("late"))


def fn_map_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map from two arrays, and structs made rows."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.map_from_arrays(F.array(F.lit("size"), F.lit("price")), F.array(F.col("p_size").cast("double"), "p_retailprice")).alias("m"))
    return parts.select("p_partkey", F.inline(F.map_entries("m")).alias("name", "amount"))


@F.udf(T.IntegerType())
def vowels(text: str) -> int:
    """A function of one row; the slow kind, for what nothing else expresses. Null for null."""
    return None if text is None else sum(c in "AEIOU" for c in text)


def udf_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", vowels(F.upper("p_name")).alias("n"))


@F.pandas_udf(T.DoubleType())
def spread(values: pd.Series) -> float:
    """A grouped aggregate: the distance of the quartiles."""
    return float(values.quantile(0.75) - values.quantile(0.25))


def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.round(spread("s_acctbal"), 4).alias("spread"))


def udf_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation from the nation's mean balance, by group; pandas sees a nation's customers at once."""

    def centred(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s_suppkey": group["s_suppkey"], "off": (group["s_acctbal"] - group["s_acctbal"].mean()).round(4)})

    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").applyInPandas(centred, "s_suppkey long, off double")


def udf_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"c_custkey": frame["c_custkey"], "n": frame["c_name"].str.len().astype("Int64")})

    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").mapInPandas(work, "c_custkey long, n long")


@F.udtf(returnType=T.StructType([T.StructField("k", T.IntegerType()), T.StructField("piece", T.StringType())]))
class Pieces:
    """The words of a text with their places; nothing for null."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(text.split(" "))


def udf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return parts.lateralJoin(Pieces(F.col("p_name").outer())).select("p_partkey", "k", "piece")


QUERIES = {f.__name__: f for f in (fn_string, fn_regex, fn_hash, fn_date, fn_math, fn_json, fn_array, fn_map, fn_text, fn_url, fn_variant, fn_posexplode, fn_hash64, fn_to_json, fn_array_pairs, fn_map_arrays, udf_row, udf_aggregate, udf_vectorized, udf_grouped, udf_partition, udf_table)}

ORACLE_SQL = {
    "fn_string": "SELECT c_custkey, upper(c_name) AS up, CAST(length(c_name) AS INTEGER) AS n, substring(c_name, 3, 4) AS part, replace(c_mktsegment, 'U', '_') AS swapped, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS padded FROM customer",
    "fn_regex": r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(url, '\d+', '#', 'g') AS masked, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs FROM pages",
    "fn_hash": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "fn_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days FROM orders",
    "fn_math": "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS log, CAST(p_size // 7 AS INTEGER) AS quotient, p_size % 7 AS rest, CAST(NULL AS DOUBLE) AS nothing FROM part",
    "fn_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text FROM events",
    "fn_array": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS squared, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top, CAST(len(embedding) AS INTEGER) AS n FROM embeddings",
    "fn_map": "SELECT c_custkey, CAST(1 + CASE WHEN contains(c_mktsegment, 'U') THEN 1 ELSE 0 END AS INTEGER) AS n, CAST(length(c_mktsegment) AS INTEGER) AS size FROM customer",
    "fn_text": "SELECT p_partkey, split_part(p_name, ' ', 2) AS second, translate(p_brand, 'rand', 'RAND') AS swapped, CAST(levenshtein(p_brand, 'Brand#11') AS INTEGER) AS apart, CAST(len(regexp_extract_all(p_type, '[A-Z]+')) AS INTEGER) AS n_words, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title, reverse(p_brand) AS backward FROM part",
    "fn_url": r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^([a-z]+):', 1) AS protocol FROM pages",
    "fn_variant": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "fn_posexplode": "SELECT vec_id, CAST(i - 1 AS INTEGER) AS place, round(CAST(embedding[i] AS DOUBLE), 5) AS item FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(embedding)",
    "udf_vectorized": "SELECT doc_id, md5(strip_accents(text)) AS plain_md5, strip_accents(text) = text AS was_plain FROM documents",
    "fn_to_json": """SELECT c_custkey, '{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS j, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""",
    "fn_array_pairs": "SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding)), lambda i: abs(CAST(embedding[i + 1] AS DOUBLE) - CAST(embedding[i] AS DOUBLE)))), 4) AS path, CAST(len(embedding) + 3 AS INTEGER) AS n, round(CAST(embedding[61] AS DOUBLE), 5) AS late FROM embeddings",
    "fn_map_arrays": "SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part",
    "udf_row": "SELECT p_partkey, CAST(len(regexp_extract_all(upper(p_name), '[AEIOU]')) AS INTEGER) AS n FROM part",
    "udf_aggregate": "SELECT s_nationkey, round(quantile_cont(s_acctbal, 0.75) - quantile_cont(s_acctbal, 0.25), 4) AS spread FROM supplier GROUP BY 1",
    "udf_grouped": "SELECT s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS off FROM supplier",
    "udf_partition": "SELECT c_custkey, length(c_name) AS n FROM customer",
    "udf_table": "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS k, p[i] AS piece FROM (SELECT p_partkey, string_split(p_name, ' ') AS p, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)",
}
