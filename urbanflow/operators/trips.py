"""Trip reconstruction from ordered events.

Both operators mark trip starts and trip ends.  Within a key the marks strictly alternate, so a trip is
a start together with the mark that follows it.  Ordinary keys need one shuffle and one sort.  Hot keys
(see ``skew``) are cut into time chunks: every chunk is solved in its own task with a small carried-in
state, and only the marks left open at chunk borders are paired across chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.functions.geo import distance_compat
from urbanflow.functions.text import epoch_seconds, is_tap_in
from urbanflow.operators.skew import CHUNK_SECONDS, HOT_ROWS, join_chunks, split_hot, with_time_chunk


def _pair(marks: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Attach to every mark the next one of the same key group."""
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    return marks.withColumns({f"next_{c}": F.lead(c).over(order) for c in ["is_start", *payload]})


def _finish(paired: DataFrame, key: str, payload: list[str]) -> DataFrame:
    trips = paired.filter(F.col("is_start") & ~F.col("next_is_start"))
    return trips.select(key, *[F.col(c).alias(f"{c}0") for c in payload],
                        *[F.col(f"next_{c}").alias(f"{c}1") for c in payload])


def _pair_across_chunks(marks: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Pair marks inside each chunk, then the open ones at chunk borders across chunks."""
    chunk_order = Window.partitionBy(key, "chunk").orderBy("ts", "event_id")
    paired = _pair(marks, [key, "chunk"], payload).withColumn(
        "leads_chunk", F.row_number().over(chunk_order) == 1)
    inner = _finish(paired.filter(F.col("next_is_start").isNotNull()), key, payload)
    open_start = F.col("is_start") & F.col("next_is_start").isNull()
    borders = paired.filter(open_start | (~F.col("is_start") & F.col("leads_chunk")))
    borders = borders.select(key, "is_start", "event_id", *payload)
    return inner.unionByName(_finish(_pair(borders, [key], payload), key, payload))


def metro_trips(taps: DataFrame, hot_rows: int = HOT_ROWS, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Pair the first tap-in of a run with the tap-out that ends it.

    ``taps``: uid, ts, event_id, location, amount.  Result: uid, ts0, location0, ts1, location1.
    """
    payload = ["ts", "location"]
    taps = taps.select("uid", "event_id", *payload, is_tap_in(F.col("amount")).alias("enters"))
    ordinary, hot = split_hot(taps, "uid", hot_rows)
    pairs = _pair(_metro_marks(ordinary, ["uid"], F.lit(None)), ["uid"], payload)
    cold_trips = _finish(pairs, "uid", payload)
    if hot is None:
        return cold_trips

    chunked = with_time_chunk(hot, "ts", chunk_seconds)
    last = chunked.groupBy("uid", "chunk").agg(
        F.max_by("enters", F.struct("ts", "event_id")).alias("last_enters"))
    by_chunk = Window.partitionBy("uid").orderBy("chunk")
    carried = last.select("uid", "chunk", F.lag("last_enters").over(by_chunk).alias("carried_enters"))
    chunked = join_chunks(chunked, carried, "uid")
    marks = _metro_marks(chunked, ["uid", "chunk"], F.col("carried_enters"))
    return cold_trips.unionByName(_pair_across_chunks(marks, "uid", payload))


def _metro_marks(taps: DataFrame, keys: list[str], carried: Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    before = F.coalesce(F.lag("enters").over(order), carried, F.lit(False))
    return taps.withColumn("before", before).filter(F.col("enters") != F.col("before")).withColumnRenamed(
        "enters", "is_start")


def taxi_trips(pings: DataFrame, hot_rows: int = HOT_ROWS, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Runs of occupied pings closed by a vacant one; a lone occupied ping is carried to the next run.

    ``pings``: tid, ts, event_id, status, lng, lat.  Result: tid, ts0, lng0, lat0, ts1, lng1, lat1, secs, km.
    Trips whose time or place cannot be read are left out after the state has been reset.
    """
    payload = ["ts", "lng", "lat"]
    pings = pings.filter(F.col("status").isin("0", "1")).select(
        "tid", "event_id", *payload, (F.col("status") == "0").alias("occupied"))
    ordinary, hot = split_hot(pings, "tid", hot_rows)
    none = F.lit(None)
    marks = _taxi_marks(_taxi_edges(ordinary, ["tid"], none, none), ["tid"], F.lit(0))
    trips = _finish(_pair(marks, ["tid"], payload), "tid", payload)
    if hot is not None:
        trips = trips.unionByName(_hot_taxi_trips(hot, payload, chunk_seconds))
    secs = (epoch_seconds(F.col("ts1")) - epoch_seconds(F.col("ts0"))).cast("double")
    km = distance_compat(F.col("lng0"), F.col("lat0"), F.col("lng1"), F.col("lat1"))
    trips = trips.withColumns({"secs": secs, "km": km})
    return trips.filter(F.col("secs").isNotNull() & F.col("km").isNotNull())


def _hot_taxi_trips(hot: DataFrame, payload: list[str], chunk_seconds: int) -> DataFrame:
    """Trips of hot keys: neighbours and parity at chunk borders come from one small row per chunk."""
    chunked = with_time_chunk(hot, "ts", chunk_seconds)
    at = F.struct("ts", "event_id")
    ends = chunked.groupBy("tid", "chunk").agg(F.min_by("occupied", at).alias("first_occupied"),
                                               F.max_by("occupied", at).alias("last_occupied"))
    by_chunk = Window.partitionBy("tid").orderBy("chunk")
    ends = ends.select("tid", "chunk", F.lag("last_occupied").over(by_chunk).alias("carried_before"),
                       F.lead("first_occupied").over(by_chunk).alias("carried_after"))
    edges = _taxi_edges(join_chunks(chunked, ends, "tid"), ["tid", "chunk"],
                        F.col("carried_before"), F.col("carried_after"))
    edges = join_chunks(edges, _carried_openings(edges), "tid")
    marks = _taxi_marks(edges, ["tid", "chunk"], F.col("carried_openings"))
    return _pair_across_chunks(marks, "tid", payload)


def _taxi_edges(pings: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """Keep the occupied pings that open a run, close a run, or are a run alone."""
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    follows = F.coalesce(F.lag("occupied").over(order), before, F.lit(False))
    goes_on = F.coalesce(F.lead("occupied").over(order), after, F.lit(False))
    flagged = pings.withColumns({"opens": ~follows, "closes": ~goes_on})
    return flagged.filter(F.col("occupied") & (F.col("opens") | F.col("closes")))


def _taxi_marks(edges: DataFrame, keys: list[str], carried: Column) -> DataFrame:
    """Decide by parity which run edges start and end trips.

    A run of two or more pings always ends a trip.  Lone pings since then alternate between opening a
    trip and ending it, so the number of openings since the last long run tells which one applies.
    """
    order = Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    openings = F.sum(F.col("opens").cast("long")).over(order)
    long_end = F.col("closes") & ~F.col("opens")
    counted = edges.withColumn("openings", openings)
    settled = F.max(F.when(long_end, F.col("openings"))).over(order)
    since = F.when(settled.isNull(), F.col("openings") + carried).otherwise(F.col("openings") - settled)
    counted = counted.withColumn("odd", since % 2 == 1)
    counted = counted.withColumn("is_start", F.col("opens") & F.col("odd"))
    lone_end = F.col("opens") & F.col("closes") & ~F.col("odd")
    return counted.filter(F.col("is_start") | long_end | lone_end)


def _carried_openings(edges: DataFrame) -> DataFrame:
    """Per key and chunk: openings since the last long run before the chunk (one small row per chunk)."""
    long_at = F.max(F.when(F.col("closes") & ~F.col("opens"), F.struct("ts", "event_id")))
    lasts = edges.groupBy("tid", "chunk").agg(long_at.alias("long_at"))
    tail = join_chunks(edges, lasts, "tid").groupBy("tid", "chunk").agg(
        F.sum(F.when(F.col("opens") & (F.col("long_at").isNull() | (F.struct("ts", "event_id") > F.col("long_at"))),
                     1).otherwise(0)).alias("tail"),
        F.max(F.col("long_at").isNotNull()).alias("settles"))
    by_chunk = Window.partitionBy("tid").orderBy("chunk")
    running = by_chunk.rowsBetween(Window.unboundedPreceding, 0)
    tail = tail.withColumn("running", F.sum("tail").over(running))
    base = F.max(F.when(F.col("settles"), F.col("running") - F.col("tail"))).over(running)
    tail = tail.withColumn("out", F.col("running") - F.coalesce(base, F.lit(0)))
    return tail.select("tid", "chunk", F.coalesce(F.lag("out").over(by_chunk), F.lit(0)).alias("carried_openings"))
