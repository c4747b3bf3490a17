"""Origin-destination counts, day-to-day variability, totals and hourly profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanflow.functions.geo import cell_name, distance_compat, grid_x, grid_y, in_box
from urbanflow.functions.text import day_type, int_div, ratio_cents

OD_KEYS = ["day", "hour", "src", "dst"]


def metro_od_counts(trips: DataFrame) -> DataFrame:
    """Trips per (day, hour, origin, destination), sorted; partial counts before the shuffle."""
    keyed = trips.select(F.dayofmonth("ts0").alias("day"), F.hour("ts0").alias("hour"),
                         F.col("location0").alias("src"), F.col("location1").alias("dst"))
    return keyed.groupBy(*OD_KEYS).agg(F.count(F.lit(1)).alias("cnt")).orderBy(*OD_KEYS)


def _cell(lng: str, lat: str) -> Column:
    return cell_name(grid_x(F.col(lng)), grid_y(F.col(lat)))


def taxi_od_counts(trips: DataFrame) -> DataFrame:
    """As :func:`metro_od_counts` by grid cell, for trips whose both ends lie inside the box."""
    inside = trips.filter(in_box(F.col("lng0"), F.col("lat0")) & in_box(F.col("lng1"), F.col("lat1")))
    keyed = inside.select(F.dayofmonth("ts0").alias("day"), F.hour("ts0").alias("hour"),
                          _cell("lng0", "lat0").alias("src"), _cell("lng1", "lat1").alias("dst"))
    return keyed.groupBy(*OD_KEYS).agg(F.count(F.lit(1)).alias("cnt")).orderBy(*OD_KEYS)


def _ends(trips: DataFrame, origin: Column, destination: Column) -> DataFrame:
    ends = F.explode(F.array(
        F.struct(F.lit("O").alias("role"), F.hour("ts0").alias("hour"), origin.alias("place")),
        F.struct(F.lit("D").alias("role"), F.hour("ts1").alias("hour"), destination.alias("place"))))
    rows = trips.select(ends.alias("e")).select("e.*").filter(F.col("place").isNotNull())
    return rows.groupBy("place", "hour", "role").agg(F.count(F.lit(1)).alias("cnt"))


def metro_production_attraction(trips: DataFrame) -> DataFrame:
    """Departures (by start hour) and arrivals (by end hour) per station."""
    return _ends(trips, F.col("location0"), F.col("location1"))


def taxi_production_attraction(trips: DataFrame) -> DataFrame:
    """The same per grid cell; each end is tested against the box on its own."""
    def place(lng, lat):
        return F.when(in_box(F.col(lng), F.col(lat)), _cell(lng, lat))
    return _ends(trips, place("lng0", "lat0"), place("lng1", "lat1"))


def variability(counts: DataFrame) -> DataFrame:
    """Mean, mean absolute deviation and relative error over the days that have trips.

    A group holds one count per day of the month, so the day list never exceeds 31 entries.  All
    rounding is done on whole numbers, which makes it independent of the engine.
    """
    typed = counts.withColumn("day_type", day_type(F.col("day")))
    grouped = typed.groupBy("day_type", "hour", "src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("total"),
        F.sort_array(F.collect_list("cnt")).alias("daily"))
    n = F.col("n")
    grouped = grouped.withColumn("mean100", ratio_cents(F.col("total"), n))
    grouped = grouped.withColumn("dev100", F.transform("daily", lambda x: F.abs(x * 100 - F.col("mean100"))))
    spread = F.aggregate("dev100", F.lit(0).cast("long"), lambda acc, x: acc + x)
    grouped = grouped.withColumn("mae100", int_div(spread * 2 + n, n * 2))
    err = int_div(F.col("mae100") * 20000 + F.col("mean100"), F.col("mean100") * 2)
    return grouped.select(
        "day_type", "hour", "src", "dst", "n", (F.col("mean100") / 100).alias("mean"),
        (F.col("mae100") / 100).alias("mae"), (err / 10000).alias("err"),
        F.transform("dev100", lambda x: x / 100).alias("devs"))


def node_day_totals(counts: DataFrame, locations: DataFrame) -> DataFrame:
    """Departures and arrivals per location and day, with the position (one shuffle for both roles)."""
    ends = F.explode(F.array(F.struct(F.lit("src").alias("role"), F.col("src").alias("name")),
                             F.struct(F.lit("dst").alias("role"), F.col("dst").alias("name"))))
    rows = counts.select("day", "cnt", ends.alias("e")).select("day", "cnt", "e.*")
    totals = rows.groupBy("role", "name", "day").agg(F.sum("cnt").alias("count"))
    return totals.join(locations, "name").select("role", "name", "day", "lng", "lat", "count")


def with_positions(pairs: DataFrame, locations: DataFrame) -> DataFrame:
    """Look up the coordinates of both ends of a pair."""
    source = locations.select(F.col("name").alias("src"), F.col("lng").alias("src_lng"), F.col("lat").alias("src_lat"))
    target = locations.select(F.col("name").alias("dst"), F.col("lng").alias("dst_lng"), F.col("lat").alias("dst_lat"))
    return pairs.join(source, "src").join(target, "dst")


def missing_locations(counts: DataFrame, locations: DataFrame) -> DataFrame:
    """Names that occur in the counts but not in the lookup."""
    names = location_names(counts)
    return names.join(locations.select("name"), "name", "left_anti")


def location_names(counts: DataFrame) -> DataFrame:
    """Union of origin and destination names."""
    both = F.explode(F.array("src", "dst")).alias("name")
    return counts.select(both).distinct()


def od_day_distance(counts: DataFrame, locations: DataFrame) -> DataFrame:
    totals = counts.groupBy("src", "dst", "day").agg(F.sum("cnt").alias("count"))
    placed = with_positions(totals, locations)
    dist = distance_compat(F.col("src_lng"), F.col("src_lat"), F.col("dst_lng"), F.col("dst_lat"))
    return placed.select("src", "dst", "day", dist.alias("dist"), "count")


def od_positions(counts: DataFrame, locations: DataFrame, last_day: int = 15) -> DataFrame:
    """Counts of the first days with both positions, ready to be stored by day."""
    return with_positions(counts.filter(F.col("day") <= last_day), locations)


def location_profile(counts: DataFrame, day: int, name=None) -> DataFrame:
    """Hourly trips out of and into locations on one day; all locations unless one is named."""
    ends = F.explode(F.array(F.struct(F.lit("out").alias("direction"), F.col("src").alias("name")),
                             F.struct(F.lit("in").alias("direction"), F.col("dst").alias("name"))))
    rows = counts.filter(F.col("day") == day)
    if name is not None:
        rows = rows.filter((F.col("src") == name) | (F.col("dst") == name))
    rows = rows.select("hour", "cnt", ends.alias("e")).select("hour", "cnt", "e.*")
    if name is not None:
        rows = rows.filter(F.col("name") == name)
    return rows.groupBy("name", "direction", "hour").agg(F.sum("cnt").alias("cnt"))


def pair_profile(counts: DataFrame, day: int, src=None, dst=None) -> DataFrame:
    """Hourly trips between two locations in both directions; all pairs unless one is named.

    Pairs are stored once, smaller name first, with the direction as a column.
    """
    rows = counts.filter(F.col("day") == day)
    if src is not None:
        there = (F.col("src") == src) & (F.col("dst") == dst)
        back = (F.col("src") == dst) & (F.col("dst") == src)
        rows = rows.filter(there | back)
    forward = F.col("src") <= F.col("dst")
    rows = rows.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"),
                       F.when(forward, "forward").otherwise("backward").alias("direction"), "hour", "cnt")
    return rows.groupBy("a", "b", "direction", "hour").agg(F.sum("cnt").alias("cnt"))


def hourly_rel_error(var: DataFrame) -> DataFrame:
    """Volume-weighted relative error per hour; weights are exact hundredths."""
    def cents(name):
        return F.round(F.col(name) * 100).cast("long")
    sums = var.groupBy("day_type", "hour").agg(F.sum(F.col("n") * cents("mean")).alias("volume100"),
                                               F.sum(F.col("n") * cents("mae")).alias("error100"))
    ratio = int_div(F.col("error100") * 20000 + F.col("volume100"), F.col("volume100") * 2) / 10000
    return sums.select("day_type", "hour", (F.col("volume100") / 100).alias("total_volume"),
                       (F.col("error100") / 100).alias("total_error"), ratio.alias("rel_error"))


def daily_mean(readings: DataFrame) -> DataFrame:
    """Mean rain per day over the readings that are not missing; NULL when none is left."""
    exact = F.sum(F.col("rain").cast("decimal(18,4)")).cast("double")
    return readings.groupBy(F.to_date("ts").alias("date")).agg(
        F.try_divide(exact, F.count("rain").cast("double")).alias("mean_rain"),
        F.count("rain").alias("n"), F.count(F.lit(1)).alias("readings"))


def key_sample(df: DataFrame, key: str, per_thousand: int) -> DataFrame:
    """Repeatable row sample by a multiplicative key hash."""
    return df.filter((F.col(key) * 2654435761) % 1000 < per_thousand)


def row_sample(df: DataFrame, fraction: float = 0.1, seed: int = 50) -> DataFrame:
    """Bernoulli row sample without replacement."""
    return df.sample(False, fraction, seed)
