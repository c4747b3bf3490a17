"""Workload inputs derived from the given tables, in Spark and as SQL text with the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _k(props):
    return F.regexp_extract(props, r'"k": (\d+)', 1).cast("int")


def taps(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").filter(F.col("event_type").isin("click", "purchase"))
    fare = F.when(F.col("event_type") == "click", F.lit("0.00")).otherwise(F.lit("3.00")).cast("decimal(10,2)")
    return events.select(F.col("user_id").alias("uid"), "ts", "event_id",
                         _k(F.col("props")).alias("location"), fare.alias("amount"))


def pings(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    status = (F.when(F.col("event_type").isin("click", "view", "signup"), "0")
              .when(F.col("event_type") == "purchase", "1").otherwise("x"))
    return events.select(
        F.col("user_id").alias("tid"), "ts", "event_id", status.alias("status"),
        (F.lit(121.3) + F.lit(0.0031) * _k(F.col("props"))).alias("lng"),
        (F.lit(31.14) + F.lit(0.0017) * ((F.col("event_id") * 37) % 100)).alias("lat"))


def locations(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        key.alias("name"), (F.lit(121.3) + F.lit(0.0125) * key).alias("lng"),
        (F.lit(31.14) + F.lit(0.007) * ((key * 7) % 25)).alias("lat"))


def trip_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shipped line: day, hour, and the keys and nations of both ends."""
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_partkey", "l_quantity",
        F.dayofmonth("l_shipdate").alias("day"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 24).cast("int").alias("hour"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                       F.col("c_nationkey").alias("dst"))
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                                       F.col("s_nationkey").alias("src"))
    # Customers meet the orders first, so that the lines, the longest table, are shuffled once and not by customer again.
    return line.join(supplier, "l_suppkey").join(orders.join(customer, "o_custkey"), "l_orderkey")


def od_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = trip_lines(spark, folder)
    return rows.groupBy("day", "hour", "src", "dst").agg(F.count(F.lit(1)).alias("cnt"))


def od_fine(spark: SparkSession, folder: str) -> DataFrame:
    """Large sparse tensor: supplier x customer x hour."""
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 24).alias("k"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return (line.join(orders, "l_orderkey")
            .groupBy(F.col("l_suppkey").alias("i"), F.col("o_custkey").alias("j"), "k")
            .agg(F.count(F.lit(1)).cast("double").alias("v")))


def pois(spark: SparkSession, folder: str) -> DataFrame:
    def side(name, prefix, key, nation, balance, tag):
        k = F.col(key)
        return table(spark, folder, name).select(
            F.concat(F.lit(prefix), k.cast("string")).alias("uid"),
            (F.lit(121.2) + F.lit(0.5) * ((k * 7919) % 1000) / F.lit(1000.0)).alias("lng"),
            (F.lit(31.0) + F.lit(0.4) * ((k * 104729) % 1000) / F.lit(1000.0)).alias("lat"),
            F.concat(tag, F.lit(";NATION_"), F.col(nation).cast("string")).alias("tags"),
            F.col(balance).alias("price"))
    return side("customer", "C", "c_custkey", "c_nationkey", "c_acctbal", F.col("c_mktsegment")).unionByName(
        side("supplier", "S", "s_suppkey", "s_nationkey", "s_acctbal", F.lit("SUPPLIER")))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (relation, origin, destination) with value 1 and a dense relation number."""
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("k"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                       F.col("c_nationkey").alias("o"))
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                                       F.col("s_nationkey").alias("s"))
    rows = line.join(supplier, "l_suppkey").join(orders.join(customer, "o_custkey"), "l_orderkey")
    return rows.select("k", "s", "o").distinct().withColumn("v", F.lit(1.0))


# ---- the same views as SQL text -------------------------------------------------------------------

K_SQL = "CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS INTEGER)"
TAPS = f"""taps AS (SELECT user_id AS uid, ts, event_id, {K_SQL} AS location, event_type = 'click' AS enters
  FROM events WHERE event_type IN ('click', 'purchase'))"""
PINGS = f"""pings AS (SELECT user_id AS tid, ts, event_id,
  CASE WHEN event_type IN ('click','view','signup') THEN '0' WHEN event_type = 'purchase' THEN '1' ELSE 'x' END AS status,
  121.3::DOUBLE + 0.0031::DOUBLE * {K_SQL} AS lng, 31.14::DOUBLE + 0.0017::DOUBLE * ((event_id * 37) % 100) AS lat FROM events)"""
LOCATIONS = """locations AS (SELECT n_nationkey AS name, 121.3::DOUBLE + 0.0125::DOUBLE * n_nationkey AS lng,
  31.14::DOUBLE + 0.007::DOUBLE * ((n_nationkey * 7) % 25) AS lat FROM nation)"""
LINES = """lines AS (SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, o_custkey, dayofmonth(l_shipdate)::INT AS day,
  ((l_orderkey * 7 + l_linenumber) % 24)::INT AS hour, s_nationkey AS src, c_nationkey AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey)"""
OD = LINES + """, od_counts AS (SELECT day, hour, src, dst, count(*)::BIGINT AS cnt FROM lines GROUP BY ALL)"""
OD_FINE = """od_fine AS (SELECT l_suppkey AS i, o_custkey AS j, (l_orderkey * 7 + l_linenumber) % 24 AS k, count(*)::DOUBLE AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
POIS = """pois AS (SELECT 'C' || c_custkey AS uid, 121.2::DOUBLE + 0.5::DOUBLE * ((c_custkey * 7919) % 1000) / 1000.0::DOUBLE AS lng,
  31.0::DOUBLE + 0.4::DOUBLE * ((c_custkey * 104729) % 1000) / 1000.0::DOUBLE AS lat,
  c_mktsegment || ';NATION_' || c_nationkey AS tags, c_acctbal AS price FROM customer UNION ALL
  SELECT 'S' || s_suppkey, 121.2::DOUBLE + 0.5::DOUBLE * ((s_suppkey * 7919) % 1000) / 1000.0::DOUBLE,
  31.0::DOUBLE + 0.4::DOUBLE * ((s_suppkey * 104729) % 1000) / 1000.0::DOUBLE,
  'SUPPLIER;NATION_' || s_nationkey, s_acctbal FROM supplier)"""
EDGES = """edges AS (SELECT DISTINCT l_returnflag || l_linestatus AS k, s_nationkey AS s, c_nationkey AS o
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey)"""


def in_box_sql(lng: str, lat: str) -> str:
    return f"({lng} > 121.308::DOUBLE AND {lng} < 121.598::DOUBLE AND {lat} > 31.146::DOUBLE AND {lat} < 31.306::DOUBLE)"


def compat_sql(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    return (f"round(6400.0::DOUBLE * acos(least(sin(radians({lng1})) * sin(radians({lng2})) * cos(radians({lat1}) - radians({lat2}))"
            f" + cos(radians({lng1})) * cos(radians({lng2})), 1.0::DOUBLE)), 2)")


def haversine_sql(lng1: str, lat1: str, lng2: str, lat2: str, radius: str) -> str:
    return (f"(2.0 * {radius}) * asin(least(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin((radians({lng2}) - radians({lng1})) / 2), 2)), 1.0))")
