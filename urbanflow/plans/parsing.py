"""Registered queries: text lines composed from the given tables, parsed by the readers' functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanflow.functions.text import METRO_MODE
from urbanflow.plans import views as V
from urbanflow.sources import readers, writers


def _stamped(spark, folder):
    events = V.table(spark, folder, "events")
    return events.withColumn("k", V._k(F.col("props"))).withColumn("stamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def parse_metro_taps(spark, folder):
    e = _stamped(spark, folder)
    mode = F.when(F.col("event_type") == "error", "other").otherwise(METRO_MODE)
    amount = F.when(F.col("event_type") == "click", "0.00").when(F.col("event_type") == "view", "n/a").otherwise("3.00")
    lines = e.select(F.concat_ws(",", "user_id", F.substring("stamp", 1, 10), F.substring("stamp", 12, 8),
                                 F.concat(F.lit("9号线S"), F.col("k")), mode, amount).alias("value"))
    return readers.parse_metro_taps(lines).drop("event_id")


def parse_taxi_pings(spark, folder):
    e = _stamped(spark, folder)
    lng = F.when(F.col("event_type") == "error", "?").otherwise((F.col("k") / 100.0).cast("string"))
    lines = e.select(F.concat_ws(",", "user_id", F.lit("a"), F.col("k") % 2, *[F.lit("x")] * 4, "stamp", lng,
                                 F.col("event_id") / 8.0).alias("value"))
    return readers.parse_taxi_pings(lines).drop("event_id")


def parse_metro_trips(spark, folder):
    e = _stamped(spark, folder)
    lines = e.select(F.concat_ws(",", "user_id", "stamp", F.concat(F.lit("1号线A"), F.col("k")), "stamp",
                                 F.concat(F.lit("B"), F.col("k"))).alias("value"))
    return readers.parse_metro_trips(lines)


def parse_taxi_trips(spark, folder):
    e = _stamped(spark, folder)
    place = F.concat_ws(" ", F.col("k") / 4.0, F.col("event_id") / 8.0)
    lines = e.select(F.concat_ws(",", "user_id", "stamp", place, F.lit("never"), F.lit("12.5"), F.col("k"), F.col("k") / 2.0).alias("value"))
    return readers.parse_taxi_trips(lines)


def parse_od_counts(spark, folder):
    counts = V.od_counts(spark, folder)
    count = F.when(F.col("cnt") % 5 == 0, "none").otherwise(F.col("cnt").cast("string"))
    lines = counts.select(F.concat_ws(",", "day", F.concat(F.lit(" "), F.col("hour"), F.lit(" ")), "src", "dst", count).alias("value"))
    return readers.parse_od_counts(lines)


def parse_variability(spark, folder):
    orders = V.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    devs = F.concat_ws(",", F.col("o_custkey") / 2.0, F.lit("x"), F.col("o_orderkey"))
    lines = orders.select(F.concat_ws("\t", F.col("o_orderkey") % 24, "o_custkey", F.lit("d"), "o_orderkey",
                                      F.col("o_orderkey") / 4.0, F.lit("0.5"), F.lit("1e-2"), devs).alias("value"))
    return readers.parse_variability(lines)


def parse_locations(spark, folder):
    nation = V.table(spark, folder, "nation")
    lines = nation.select(F.col("n_nationkey").cast("long").alias("idx"), F.concat_ws(
        ",", F.concat(F.lit(" "), F.col("n_name")), F.col("n_nationkey") / 8.0 + 121, F.lit("31.5")).alias("value"))
    return readers.parse_locations(lines)


def parse_weather(spark, folder):
    e = _stamped(spark, folder)
    rain = F.when(F.col("event_type") == "error", "////").otherwise((F.col("k") / 2.0).cast("string"))
    lines = e.select(F.concat_ws(",", F.date_format("ts", "yyyyMMddHHmm"), F.lit("-"), F.lit("-"), F.col("k") / 4.0, F.lit("NE"),
                                 F.lit("2.5"), rain).alias("value"))
    return readers.parse_weather(lines)


def parse_pois(spark, folder):
    c = V.table(spark, folder, "customer")
    place = F.struct((F.col("c_custkey") / 8.0).alias("lng"), F.lit(31.25).alias("lat"))
    detail = F.struct(F.col("c_mktsegment").alias("tag"), F.col("c_custkey").cast("string").alias("price"))
    uid = F.concat(F.lit("C"), F.col("c_custkey"))
    lines = c.select(F.to_json(F.struct(uid.alias("uid"), place.alias("location"), detail.alias("detail_info"))).alias("value"))
    rows = readers.parse_pois(lines)
    return rows.select("uid", "lng", "lat", "tags", "price", F.col("position.type").alias("type"),
                       F.get("position.coordinates", F.lit(0)).alias("x"))


def format_lines(spark, folder):
    return writers.text_lines(V.od_counts(spark, folder).select("day", "hour", "src", "dst", "cnt"))


QUERIES = {f.__name__: f for f in (
    parse_metro_taps, parse_taxi_pings, parse_metro_trips, parse_taxi_trips, parse_od_counts, parse_variability,
    parse_locations, parse_weather, parse_pois, format_lines)}

E = f"e AS (SELECT *, {V.K_SQL} AS k, date_trunc('second', ts)::TIMESTAMP AS stamp FROM events)"
SQL = {
    "parse_metro_taps": f"""WITH {E} SELECT user_id::VARCHAR AS uid, stamp AS ts, '9号线S' || k AS location, '{METRO_MODE}' AS mode,
      CASE event_type WHEN 'click' THEN 0.00 WHEN 'view' THEN NULL ELSE 3.00 END::DECIMAL(10,2) AS amount FROM e WHERE event_type <> 'error'""",
    "parse_taxi_pings": f"""WITH {E} SELECT user_id::VARCHAR AS tid, stamp AS ts, (k % 2)::VARCHAR AS status,
      CASE WHEN event_type <> 'error' THEN k / 100.0::DOUBLE END AS lng, event_id / 8.0::DOUBLE AS lat FROM e""",
    "parse_metro_trips": f"WITH {E} SELECT user_id::VARCHAR AS uid, stamp AS ts0, 'A' || k AS location0, stamp AS ts1, NULL::VARCHAR AS location1 FROM e",
    "parse_taxi_trips": f"""WITH {E} SELECT user_id::VARCHAR AS tid, stamp AS ts0, k / 4.0::DOUBLE AS lng0, event_id / 8.0::DOUBLE AS lat0,
      NULL::TIMESTAMP AS ts1, 12.5::DOUBLE AS lng1, NULL::DOUBLE AS lat1, k::DOUBLE AS secs, k / 2.0::DOUBLE AS km FROM e""",
    "parse_od_counts": f"WITH {V.OD} SELECT day, hour, src::VARCHAR AS src, dst::VARCHAR AS dst, cnt FROM od_counts WHERE cnt % 5 <> 0",
    "parse_variability": """SELECT (o_orderkey % 24)::INT AS hour, o_custkey::VARCHAR AS src, 'd' AS dst, o_orderkey::BIGINT AS n,
      o_orderkey / 4.0::DOUBLE AS mean, 0.5::DOUBLE AS mae, 0.01::DOUBLE AS err, [o_custkey / 2.0::DOUBLE, NULL, o_orderkey::DOUBLE] AS devs FROM orders""",
    "parse_locations": """SELECT n_name AS name, n_nationkey::BIGINT AS idx, n_nationkey / 8.0::DOUBLE + 121 AS lng, 31.5::DOUBLE AS lat,
      (n_nationkey / 8.0::DOUBLE + 121)::VARCHAR || ',31.5' AS lnglat FROM nation""",
    "parse_weather": f"""WITH {E} SELECT date_trunc('minute', ts)::TIMESTAMP AS ts, k / 4.0::DOUBLE AS temperature, 'NE' AS wind_dir,
      2.5::DOUBLE AS wind_speed, CASE WHEN event_type <> 'error' THEN k / 2.0::DOUBLE END AS rain FROM e""",
    "parse_pois": "SELECT 'C' || c_custkey AS uid, c_custkey / 8.0::DOUBLE AS lng, 31.25::DOUBLE AS lat, c_mktsegment AS tags, c_custkey::VARCHAR AS price, 'Point' AS type, c_custkey / 8.0::DOUBLE AS x FROM customer",
    "format_lines": f"WITH {V.OD} SELECT concat_ws(',', day, hour, src, dst, cnt) AS value FROM od_counts",
}
