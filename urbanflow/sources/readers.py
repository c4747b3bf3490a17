"""Readers.  Every schema is declared, bad lines become NULL columns or are filtered, none stops the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanflow.functions.text import METRO_MODE, station_name
from urbanflow.operators.tensor.table import numbered

STAMP = "yyyy-MM-dd HH:mm:ss"


def _fields(lines: DataFrame, schema: str, text: str = "value", **options) -> DataFrame:
    """The fields of separated text lines; blank lines are skipped, unreadable fields become NULL."""
    filled = lines.where(F.length(F.trim(F.col(text))) > 0)
    return filled.select(F.from_csv(F.col(text), schema, {"mode": "PERMISSIVE", **options}).alias("fields")).select("fields.*")


def _stamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(STAMP)).cast("timestamp_ntz")


def metro_taps(spark: SparkSession, path, mode: str = METRO_MODE) -> DataFrame:
    return parse_metro_taps(spark.read.text(path), mode=mode)


def parse_metro_taps(lines: DataFrame, text: str = "value", mode: str = METRO_MODE) -> DataFrame:
    """Card taps of one transport mode.  ``event_id`` breaks ties between equal times."""
    raw = _fields(lines, "uid string, date string, time string, location string, mode string, amount string", text)
    raw = raw.filter(F.col("mode") == mode)
    ts = _stamp(F.concat_ws(" ", "date", "time"))
    return raw.select("uid", ts.alias("ts"), _tie_break(raw.columns).alias("event_id"), "location", "mode",
                      F.col("amount").try_cast("decimal(10,2)").alias("amount"))


def _tie_break(columns: list[str]) -> Column:
    """A row identity that does not depend on how the input was split."""
    return F.xxhash64(*columns)


def taxi_pings(spark: SparkSession, path) -> DataFrame:
    return parse_taxi_pings(spark.read.text(path))


def parse_taxi_pings(lines: DataFrame, text: str = "value") -> DataFrame:
    """Vehicle pings: columns 0 id, 2 status, 7 time, 8 longitude, 9 latitude of the line."""
    raw = _fields(lines, ", ".join(f"c{i} string" for i in range(10)), text)
    picked = raw.select("c0", "c2", "c7", "c8", "c9")
    return picked.select(F.col("c0").alias("tid"), _stamp(F.col("c7")).alias("ts"),
                         _tie_break(picked.columns).alias("event_id"), F.col("c2").alias("status"),
                         F.col("c8").try_cast("double").alias("lng"), F.col("c9").try_cast("double").alias("lat"))


def metro_trip_lines(spark: SparkSession, path) -> DataFrame:
    return parse_metro_trips(spark.read.text(path))


def parse_metro_trips(lines: DataFrame, text: str = "value") -> DataFrame:
    """Metro trips; station names are the text after the line mark."""
    raw = _fields(lines, "uid string, t0 string, l0 string, t1 string, l1 string", text)
    return raw.select("uid", _stamp(F.col("t0")).alias("ts0"), station_name(F.col("l0")).alias("location0"),
                      _stamp(F.col("t1")).alias("ts1"), station_name(F.col("l1")).alias("location1"))


def taxi_trip_lines(spark: SparkSession, path) -> DataFrame:
    return parse_taxi_trips(spark.read.text(path))


def parse_taxi_trips(lines: DataFrame, text: str = "value") -> DataFrame:
    """Taxi trips; a place is "lng lat" in one field."""
    raw = _fields(lines, "tid string, t0 string, p0 string, t1 string, p1 string, secs string, km string", text)

    def part(name, index):
        return F.get(F.split(name, " "), F.lit(index)).try_cast("double")
    return raw.select("tid", _stamp(F.col("t0")).alias("ts0"), part("p0", 0).alias("lng0"), part("p0", 1).alias("lat0"),
                      _stamp(F.col("t1")).alias("ts1"), part("p1", 0).alias("lng1"), part("p1", 1).alias("lat1"),
                      F.col("secs").try_cast("double").alias("secs"), F.col("km").try_cast("double").alias("km"))


def od_counts(spark: SparkSession, path) -> DataFrame:
    return parse_od_counts(spark.read.text(path))


def parse_od_counts(lines: DataFrame, text: str = "value") -> DataFrame:
    """Counts per day, hour, origin and destination; lines without a count are left out."""
    raw = _fields(lines, "day int, hour int, src string, dst string, cnt bigint", text,
                  ignoreLeadingWhiteSpace="true", ignoreTrailingWhiteSpace="true")
    return raw.filter(F.col("cnt").isNotNull())


def variability(spark: SparkSession, path, partitions: int | None = None) -> DataFrame:
    """Variability TSV.  A gzip file is one split, so it is spread again right after the read if asked."""
    lines = spark.read.text(path)
    return parse_variability(lines.repartition(partitions) if partitions else lines)


def parse_variability(lines: DataFrame, text: str = "value") -> DataFrame:
    raw = _fields(lines, "hour int, src string, dst string, n bigint, mean double, mae double, err double, list string", text,
                  sep="\t", ignoreLeadingWhiteSpace="true", ignoreTrailingWhiteSpace="true")
    devs = F.transform(F.split("list", ","), lambda x: x.try_cast("double"))
    return raw.select("hour", "src", "dst", "n", "mean", "mae", "err", devs.alias("devs"))


def locations(spark: SparkSession, path) -> DataFrame:
    """Location lookup with the "lng,lat" text form and a row number in file order."""
    return parse_locations(numbered(spark.read.text(path).where(F.length(F.trim("value")) > 0)))


def parse_locations(lines: DataFrame, text: str = "value") -> DataFrame:
    """Locations of numbered lines (``idx``)."""
    fields = F.from_csv(F.col(text), "name string, lng_text string, lat_text string")
    rows = lines.select("idx", fields.alias("fields")).select("idx", "fields.*")
    return rows.select(F.trim("name").alias("name"), "idx", F.col("lng_text").try_cast("double").alias("lng"),
                       F.col("lat_text").try_cast("double").alias("lat"),
                       F.concat_ws(",", "lng_text", "lat_text").alias("lnglat"))


def weather(spark: SparkSession, path) -> DataFrame:
    """Weather readings; ``////`` marks a missing rain value."""
    return parse_weather(spark.read.text(path))


def parse_weather(lines: DataFrame, text: str = "value") -> DataFrame:
    raw = _fields(lines, "stamp string, a string, b string, temperature double, wind_dir string, wind_speed double, "
                         "rain double", text, nullValue="////")
    ts = F.try_to_timestamp(F.col("stamp"), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")
    return raw.select(ts.alias("ts"), "temperature", "wind_dir", "wind_speed", "rain")


BUS_FIELDS = ["fullname", "name", "starttime", "endtime", "company", "stationnum", "stations"]


def bus_stops(lines: DataFrame, text: str = "value") -> DataFrame:
    """One row per (line, station) from tab-separated text lines; lines without seven fields are skipped."""
    fields = lines.select(F.split(F.trim(F.col(text)), "\t").alias("f")).filter(F.size("f") == len(BUS_FIELDS))
    rows = fields.select(*[F.col("f")[i].alias(n) for i, n in enumerate(BUS_FIELDS)])
    rows = rows.filter(F.col("stationnum").try_cast("int").isNotNull())
    stops = rows.select("fullname", "name", "starttime", "endtime", "company",
                        F.col("stationnum").try_cast("int").alias("stationnum"),
                        F.explode(F.split("stations", " ")).alias("stop"))
    parts = F.split("stop", ":")
    place = F.split(F.get(parts, F.lit(1)), ",")
    return stops.select(*stops.columns[:-1], F.get(parts, F.lit(0)).alias("station_name"),
                        F.get(place, F.lit(0)).try_cast("double").alias("lng"),
                        F.get(place, F.lit(1)).try_cast("double").alias("lat"))


def read_bus_stops(spark: SparkSession, path) -> DataFrame:
    """Bus stops of a file; the header goes because its station count is no number."""
    return bus_stops(spark.read.text(path))


POI_SCHEMA = ("uid string, location struct<lng: double, lat: double>, "
              "detail_info struct<tag: string, price: string>")


def poi_documents(spark: SparkSession, path) -> DataFrame:
    """POI documents with their GeoJSON point."""
    return parse_pois(spark.read.text(path))


def parse_pois(lines: DataFrame, text: str = "value") -> DataFrame:
    filled = lines.where(F.length(F.trim(F.col(text))) > 0)
    raw = filled.select(F.from_json(F.col(text), POI_SCHEMA).alias("poi")).select("poi.*")
    lng, lat = F.col("location.lng"), F.col("location.lat")
    position = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    return raw.select("uid", lng.alias("lng"), lat.alias("lat"), F.col("detail_info.tag").alias("tags"),
                      F.col("detail_info.price").alias("price"), position.alias("position"))


def nested_tensor(lines: DataFrame, text: str = "value") -> DataFrame:
    """Long table (i, j, k, v) of a nested JSON tensor, zeros left out."""
    cube = F.from_json(F.col(text), "array<array<array<double>>>")
    rows = lines.select(F.posexplode(cube).alias("i", "plane"))
    rows = rows.select("i", F.posexplode("plane").alias("j", "line"))
    return rows.select("i", "j", F.posexplode("line").alias("k", "v")).filter(F.col("v") != 0)
