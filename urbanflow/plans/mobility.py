"""Registered queries: trips, origin-destination statistics, gravity models."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanflow.functions import geo
from urbanflow.functions.text import as_text
from urbanflow.operators import gravity, od, trips
from urbanflow.plans import views as V

DAY = 1


def metro_trips(spark, folder):
    rows = trips.metro_trips(V.taps(spark, folder))
    return rows.select("uid", as_text(F.col("ts0")).alias("t0"), F.col("location0").alias("loc0"),
                       as_text(F.col("ts1")).alias("t1"), F.col("location1").alias("loc1"))


def metro_od_counts(spark, folder):
    return od.metro_od_counts(trips.metro_trips(V.taps(spark, folder)))


def production_attraction(spark, folder):
    return od.metro_production_attraction(trips.metro_trips(V.taps(spark, folder)))


def taxi_trips(spark, folder):
    rows = trips.taxi_trips(V.pings(spark, folder))
    return rows.select("tid", as_text(F.col("ts0")).alias("t0"), "lng0", "lat0",
                       as_text(F.col("ts1")).alias("t1"), "lng1", "lat1", "secs", "km")


def taxi_od_counts(spark, folder):
    return od.taxi_od_counts(trips.taxi_trips(V.pings(spark, folder)))


def taxi_production_attraction(spark, folder):
    return od.taxi_production_attraction(trips.taxi_trips(V.pings(spark, folder)))


def grid_cells(spark, folder):
    lng, lat = F.col("lng"), F.col("lat")
    rows = V.pings(spark, folder).filter(geo.in_box(lng, lat))
    rows = rows.withColumns({"gx": geo.grid_x(lng), "gy": geo.grid_y(lat)})
    gx, gy = F.col("gx"), F.col("gy")
    return rows.select("event_id", "gx", "gy", geo.cell_name(gx, gy).alias("cell"), geo.pixel_x(lng).alias("px"),
                       geo.pixel_y(lat).alias("py"), geo.cell_pixel_x(gx).alias("cpx"), geo.cell_pixel_y(gy).alias("cpy"))


def grid_roundtrip(spark, folder):
    """Cell centres fall back into their cell, and pixels map back to within one pixel."""
    lng, lat = F.col("lng"), F.col("lat")
    rows = V.pings(spark, folder).filter(geo.in_box(lng, lat))
    rows = rows.withColumns({"gx": geo.grid_x(lng), "gy": geo.grid_y(lat), "px": geo.pixel_x(lng), "py": geo.pixel_y(lat)})
    rows = rows.withColumns({
        "back_x": geo.grid_x(geo.cell_center_lng(F.col("gx"))), "back_y": geo.grid_y(geo.cell_center_lat(F.col("gy"))),
        "back_lng": geo.pixel_lng(F.col("px")), "back_lat": geo.pixel_lat(F.col("py"))})
    same = (F.col("gx") == F.col("back_x")) & (F.col("gy") == F.col("back_y"))
    near = ((F.abs(F.col("back_lng") - lng) <= (geo.LNG_HIGH - geo.LNG_LOW) / geo.MAP_WIDTH + 1e-9)
            & (F.abs(F.col("back_lat") - lat) <= (geo.LAT_HIGH - geo.LAT_LOW) / geo.MAP_HEIGHT + 1e-9))
    return rows.groupBy("gx", "gy").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same_cell"), F.count_if(near).alias("near_pixel"),
        F.round(F.first(geo.cell_center_lng(F.col("gx"))), 8).alias("center_lng"),
        F.round(F.first(geo.cell_center_lat(F.col("gy"))), 8).alias("center_lat"))


def _pairs(spark, folder):
    return od.with_positions(V.od_counts(spark, folder).select("src", "dst").distinct(), V.locations(spark, folder))


def _ends():
    return [F.col(c) for c in ("src_lng", "src_lat", "dst_lng", "dst_lat")]


def distance_compat(spark, folder):
    return _pairs(spark, folder).select("src", "dst", geo.distance_compat(*_ends()).alias("dist"))


def distance_haversine(spark, folder):
    return _pairs(spark, folder).select("src", "dst", F.round(geo.haversine(*_ends()), 6).alias("dist"))


def od_counts(spark, folder):
    return V.od_counts(spark, folder)


def od_variability(spark, folder):
    rows = od.variability(V.od_counts(spark, folder))
    cents = F.transform("devs", lambda x: F.round(x * 100).cast("long").cast("string"))
    return rows.select("day_type", "hour", "src", "dst", "n", "mean", "mae", "err",
                       F.concat_ws(",", cents).alias("devs"))


def hourly_rel_error(spark, folder):
    return od.hourly_rel_error(od.variability(V.od_counts(spark, folder)))


def node_day_totals(spark, folder):
    return od.node_day_totals(V.od_counts(spark, folder), V.locations(spark, folder))


def od_day_distance(spark, folder):
    return od.od_day_distance(V.od_counts(spark, folder), V.locations(spark, folder))


def od_positions(spark, folder):
    return od.od_positions(V.od_counts(spark, folder), V.locations(spark, folder))


def location_profile(spark, folder):
    return od.location_profile(V.od_counts(spark, folder), DAY)


def pair_profile(spark, folder):
    return od.pair_profile(V.od_counts(spark, folder), DAY)


def location_names(spark, folder):
    counts = V.od_counts(spark, folder)
    lost = od.missing_locations(counts, V.locations(spark, folder)).withColumn("known", F.lit(False))
    names = od.location_names(counts)
    return names.join(lost, "name", "left").select("name", F.coalesce("known", F.lit(True)).alias("known"))


def daily_mean_missing(spark, folder):
    rain = F.when(F.col("event_type") != "error", F.col("value"))
    rows = od.daily_mean(V.table(spark, folder, "events").select("ts", rain.alias("rain")))
    return rows.select(F.col("date").cast("string").alias("date"), "mean_rain", "n", "readings")


def key_sample(spark, folder):
    return od.key_sample(V.table(spark, folder, "events"), "event_id", 100).select("event_id", "user_id", "event_type")


def row_sample(spark, folder):
    return od.row_sample(V.table(spark, folder, "events"), 0.1, 50).select("event_id", "user_id", "event_type")


def _gravity_rows(spark, folder):
    return gravity.gravity_rows(V.od_counts(spark, folder), V.locations(spark, folder), DAY)


def gravity_by_station(spark, folder):
    coefs = gravity.gravity_by_station(_gravity_rows(spark, folder))
    return coefs.select("name", "role", "n", F.round("volume_coef", 6).alias("volume_coef"),
                        F.round("distance_coef", 6).alias("distance_coef"))


def gravity_tradeoff(spark, folder):
    rows = _gravity_rows(spark, folder)
    line = gravity.gravity_tradeoff(gravity.gravity_by_station(rows), gravity.station_weights(rows, 20))
    return line.select("role", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def gravity_global(spark, folder):
    return gravity.gravity_global(_gravity_rows(spark, folder)).select("term", F.round("coef", 6).alias("coef"))


QUERIES = {f.__name__: f for f in (
    metro_trips, metro_od_counts, production_attraction, taxi_trips, taxi_od_counts, taxi_production_attraction,
    grid_cells, grid_roundtrip, distance_compat, distance_haversine, od_counts, od_variability, hourly_rel_error,
    node_day_totals, od_day_distance, od_positions, location_profile, pair_profile, location_names,
    daily_mean_missing, key_sample, row_sample, gravity_by_station, gravity_tradeoff, gravity_global)}

# ---- SQL counterparts -----------------------------------------------------------------------------

STAMP = "'%Y-%m-%d %H:%M:%S'"
METRO = V.TAPS + """, runs AS (SELECT *, coalesce(sum(CASE WHEN enters THEN 0 ELSE 1 END) OVER (PARTITION BY uid ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM taps),
  metro AS (SELECT uid, min(ts) FILTER (enters) AS ts0, arg_min(location, event_id) FILTER (enters) AS location0,
    min(ts) FILTER (NOT enters) AS ts1, arg_min(location, event_id) FILTER (NOT enters) AS location1
    FROM runs GROUP BY uid, g HAVING count(*) FILTER (enters) > 0 AND count(*) FILTER (NOT enters) > 0)"""
TAXI = V.PINGS + f""", p1 AS (SELECT *, sum(CASE WHEN status = '1' THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY ts, event_id) AS run
    FROM pings WHERE status IN ('0', '1')),
  p2 AS (SELECT tid, run, count(*) AS n, min({{'ts': ts, 'e': event_id, 'lng': lng, 'lat': lat}}) AS f,
    max({{'ts': ts, 'e': event_id, 'lng': lng, 'lat': lat}}) AS l FROM p1 WHERE status = '0' GROUP BY tid, run),
  p3 AS (SELECT *, coalesce(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY run
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak FROM p2),
  p4 AS (SELECT *, row_number() OVER (PARTITION BY tid, streak ORDER BY run) AS pos FROM p3),
  p5 AS (SELECT tid, min(f) AS f, max(l) AS l FROM p4 GROUP BY tid, streak, (pos + 1) // 2 HAVING sum(n) >= 2),
  taxi AS (SELECT tid, f.ts AS ts0, f.lng AS lng0, f.lat AS lat0, l.ts AS ts1, l.lng AS lng1, l.lat AS lat1,
    (epoch(date_trunc('second', l.ts)) - epoch(date_trunc('second', f.ts)))::DOUBLE AS secs,
    {V.compat_sql('f.lng', 'f.lat', 'l.lng', 'l.lat')} AS km FROM p5)"""


def _gx(lng):
    return f"trunc(({lng} - 121.308::DOUBLE) / (121.598::DOUBLE - 121.308::DOUBLE) * 28.0::DOUBLE)::INT"


def _gy(lat):
    return f"trunc(({lat} - 31.146::DOUBLE) / (31.306::DOUBLE - 31.146::DOUBLE) * 24.0::DOUBLE)::INT"


def _cell(lng, lat):
    return f"({_gx(lng)} || '_' || {_gy(lat)})"


PLACED = V.OD + ", " + V.LOCATIONS + """, placed AS (SELECT c.*, a.lng AS src_lng, a.lat AS src_lat, b.lng AS dst_lng, b.lat AS dst_lat
  FROM od_counts c JOIN locations a ON c.src = a.name JOIN locations b ON c.dst = b.name)"""
VAR = V.OD + """, typed AS (SELECT *, CASE WHEN day IN (4,5,6,11,12,18,19,25,26) THEN 'holidays' ELSE 'workdays' END AS day_type FROM od_counts),
  g1 AS (SELECT day_type, hour, src, dst, count(*)::BIGINT AS n, sum(cnt)::BIGINT AS s FROM typed GROUP BY ALL),
  g2 AS (SELECT *, (200 * s + n) // (2 * n) AS mean100 FROM g1),
  g3 AS (SELECT day_type, hour, src, dst, n, mean100, sum(abs(100 * cnt - mean100))::BIGINT AS dev,
    string_agg(abs(100 * cnt - mean100)::VARCHAR, ',' ORDER BY cnt) AS devs FROM typed JOIN g2 USING (day_type, hour, src, dst) GROUP BY ALL),
  g4 AS (SELECT *, (2 * dev + n) // (2 * n) AS mae100 FROM g3),
  var AS (SELECT *, (mae100 * 20000 + mean100) // (mean100 * 2) AS err4 FROM g4)"""
GRAV = PLACED + f""", od_day AS (SELECT src, dst, sum(cnt)::BIGINT AS count, {V.compat_sql('min(src_lng)', 'min(src_lat)', 'min(dst_lng)', 'min(dst_lat)')} AS dist
    FROM placed WHERE day = {DAY} GROUP BY src, dst),
  st AS (SELECT src, sum(cnt)::BIGINT AS src_total FROM od_counts WHERE day = {DAY} GROUP BY src),
  dt AS (SELECT dst, sum(cnt)::BIGINT AS dst_total FROM od_counts WHERE day = {DAY} GROUP BY dst),
  gr AS (SELECT * FROM od_day JOIN st USING (src) JOIN dt USING (dst) WHERE dist <> 0),
  flat AS (SELECT src AS name, 'src' AS role, ln(dst_total) AS x1, ln(dist) AS x2, ln(count) AS y FROM gr UNION ALL
    SELECT dst, 'dst', ln(src_total), ln(dist), ln(count) FROM gr),
  mo AS (SELECT name, role, count(*)::BIGINT AS n, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
    covar_pop(x1, y) AS t1, covar_pop(x2, y) AS t2 FROM flat GROUP BY ALL),
  md AS (SELECT *, s11 + s22 AS tr, s11 * s22 - s12 * s12 AS det FROM mo),
  co AS (SELECT name, role, n,
    CASE WHEN tr <= 1e-18 THEN 0 WHEN det <= 1e-12 * tr * tr THEN (s11 * t1 + s12 * t2) / (tr * tr) ELSE (s22 * t1 - s12 * t2) / det END AS a,
    CASE WHEN tr <= 1e-18 THEN 0 WHEN det <= 1e-12 * tr * tr THEN (s12 * t1 + s22 * t2) / (tr * tr) ELSE (s11 * t2 - s12 * t1) / det END AS b FROM md)"""

_same = (f"({_gx('(gx + 0.5::DOUBLE) / 28.0::DOUBLE * (121.598::DOUBLE - 121.308::DOUBLE) + 121.308::DOUBLE')} = gx AND "
         f"{_gy('(gy + 0.5::DOUBLE) / 24.0::DOUBLE * (31.306::DOUBLE - 31.146::DOUBLE) + 31.146::DOUBLE')} = gy)")
_px = "trunc((lng - 121.308::DOUBLE) / (121.598::DOUBLE - 121.308::DOUBLE) * 850.0::DOUBLE)::INT"
_py = "trunc((31.306::DOUBLE - lat) / (31.306::DOUBLE - 31.146::DOUBLE) * 550.0::DOUBLE)::INT"

SQL = {
    "metro_trips": f"WITH {METRO} SELECT uid, strftime(ts0, {STAMP}) AS t0, location0 AS loc0, strftime(ts1, {STAMP}) AS t1, location1 AS loc1 FROM metro",
    "metro_od_counts": f"WITH {METRO} SELECT dayofmonth(ts0)::INT AS day, hour(ts0)::INT AS hour, location0 AS src, location1 AS dst, count(*)::BIGINT AS cnt FROM metro GROUP BY ALL ORDER BY ALL",
    "production_attraction": f"WITH {METRO} SELECT place, hour, role, count(*)::BIGINT AS cnt FROM (SELECT location0 AS place, hour(ts0)::INT AS hour, 'O' AS role FROM metro UNION ALL SELECT location1, hour(ts1)::INT, 'D' FROM metro) GROUP BY ALL",
    "taxi_trips": f"WITH {TAXI} SELECT tid, strftime(ts0, {STAMP}) AS t0, lng0, lat0, strftime(ts1, {STAMP}) AS t1, lng1, lat1, secs, km FROM taxi",
    "taxi_od_counts": f"WITH {TAXI} SELECT dayofmonth(ts0)::INT AS day, hour(ts0)::INT AS hour, {_cell('lng0', 'lat0')} AS src, {_cell('lng1', 'lat1')} AS dst, count(*)::BIGINT AS cnt FROM taxi WHERE {V.in_box_sql('lng0', 'lat0')} AND {V.in_box_sql('lng1', 'lat1')} GROUP BY ALL ORDER BY ALL",
    "taxi_production_attraction": f"WITH {TAXI} SELECT place, hour, role, count(*)::BIGINT AS cnt FROM (SELECT {_cell('lng0', 'lat0')} AS place, hour(ts0)::INT AS hour, 'O' AS role FROM taxi WHERE {V.in_box_sql('lng0', 'lat0')} UNION ALL SELECT {_cell('lng1', 'lat1')}, hour(ts1)::INT, 'D' FROM taxi WHERE {V.in_box_sql('lng1', 'lat1')}) GROUP BY ALL",
    "grid_cells": f"WITH {V.PINGS}, c AS (SELECT event_id, lng, lat, {_gx('lng')} AS gx, {_gy('lat')} AS gy FROM pings WHERE {V.in_box_sql('lng', 'lat')}) SELECT event_id, gx, gy, gx || '_' || gy AS cell, {_px} AS px, {_py} AS py, gx * 30 + 10 AS cpx, (23 - gy) * 23 AS cpy FROM c",
    "grid_roundtrip": f"""WITH {V.PINGS}, c AS (SELECT event_id, lng, lat, {_gx('lng')} AS gx, {_gy('lat')} AS gy, {_px} AS px, {_py} AS py FROM pings WHERE {V.in_box_sql('lng', 'lat')})
      SELECT gx, gy, count(*)::BIGINT AS n, count(*) FILTER ({_same})::BIGINT AS same_cell,
      count(*) FILTER (abs(px / 850.0::DOUBLE * (121.598::DOUBLE - 121.308::DOUBLE) + 121.308::DOUBLE - lng) <= 0.29::DOUBLE / 850 + 1e-9
        AND abs(31.306::DOUBLE - py / 550.0::DOUBLE * (31.306::DOUBLE - 31.146::DOUBLE) - lat) <= 0.16::DOUBLE / 550 + 1e-9)::BIGINT AS near_pixel,
      round((gx + 0.5::DOUBLE) / 28.0::DOUBLE * (121.598::DOUBLE - 121.308::DOUBLE) + 121.308::DOUBLE, 8) AS center_lng,
      round((gy + 0.5::DOUBLE) / 24.0::DOUBLE * (31.306::DOUBLE - 31.146::DOUBLE) + 31.146::DOUBLE, 8) AS center_lat FROM c GROUP BY gx, gy""",
    "distance_compat": f"WITH {PLACED} SELECT DISTINCT src, dst, {V.compat_sql('src_lng', 'src_lat', 'dst_lng', 'dst_lat')} AS dist FROM placed",
    "distance_haversine": f"WITH {PLACED} SELECT DISTINCT src, dst, round({V.haversine_sql('src_lng', 'src_lat', 'dst_lng', 'dst_lat', '6400.0')}, 6) AS dist FROM placed",
    "od_counts": f"WITH {V.OD} SELECT * FROM od_counts",
    "od_variability": f"WITH {VAR} SELECT day_type, hour, src, dst, n, mean100 / 100 AS mean, mae100 / 100 AS mae, err4 / 10000 AS err, devs FROM var",
    "hourly_rel_error": f"WITH {VAR} SELECT day_type, hour, sum(n * mean100)::BIGINT / 100 AS total_volume, sum(n * mae100)::BIGINT / 100 AS total_error, ((sum(n * mae100) * 20000 + sum(n * mean100))::BIGINT // (sum(n * mean100) * 2)::BIGINT) / 10000 AS rel_error FROM var GROUP BY ALL",
    "node_day_totals": f"WITH {PLACED} SELECT 'src' AS role, src AS name, day, min(src_lng) AS lng, min(src_lat) AS lat, sum(cnt)::BIGINT AS count FROM placed GROUP BY ALL UNION ALL SELECT 'dst', dst, day, min(dst_lng), min(dst_lat), sum(cnt)::BIGINT FROM placed GROUP BY ALL",
    "od_day_distance": f"WITH {PLACED} SELECT src, dst, day, {V.compat_sql('min(src_lng)', 'min(src_lat)', 'min(dst_lng)', 'min(dst_lat)')} AS dist, sum(cnt)::BIGINT AS count FROM placed GROUP BY src, dst, day",
    "od_positions": f"WITH {PLACED} SELECT * FROM placed WHERE day <= 15",
    "location_profile": f"WITH {V.OD} SELECT name, direction, hour, sum(cnt)::BIGINT AS cnt FROM (SELECT src AS name, 'out' AS direction, hour, cnt FROM od_counts WHERE day = {DAY} UNION ALL SELECT dst, 'in', hour, cnt FROM od_counts WHERE day = {DAY}) GROUP BY ALL",
    "pair_profile": f"WITH {V.OD} SELECT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN src <= dst THEN 'forward' ELSE 'backward' END AS direction, hour, sum(cnt)::BIGINT AS cnt FROM od_counts WHERE day = {DAY} GROUP BY ALL",
    "location_names": f"WITH {V.OD}, {V.LOCATIONS} SELECT name, name IN (SELECT name FROM locations) AS known FROM (SELECT src AS name FROM od_counts UNION SELECT dst FROM od_counts)",
    "daily_mean_missing": "SELECT strftime(ts, '%Y-%m-%d') AS date, CASE WHEN count(*) FILTER (event_type <> 'error') > 0 THEN (sum(value::DECIMAL(18,4)) FILTER (event_type <> 'error'))::DOUBLE / count(*) FILTER (event_type <> 'error') END AS mean_rain, count(*) FILTER (event_type <> 'error')::BIGINT AS n, count(*)::BIGINT AS readings FROM events GROUP BY 1",
    "key_sample": "SELECT event_id, user_id, event_type FROM events WHERE (event_id * 2654435761) % 1000 < 100",
    "gravity_by_station": f"WITH {GRAV} SELECT name, role, n, round(a, 6) AS volume_coef, round(b, 6) AS distance_coef FROM co",
    "gravity_tradeoff": f"""WITH {GRAV}, wt AS (SELECT name, coalesce(max(a), max(b)) / 20.0::DOUBLE AS weight FROM (SELECT src AS name, src_total AS a, NULL AS b FROM gr UNION ALL SELECT dst, NULL, dst_total FROM gr) GROUP BY name),
      sm AS (SELECT role, count(*)::BIGINT AS n, sum(weight) AS sw, sum(weight * a) AS sx, sum(weight * b) AS sy, sum(weight * a * a) AS sxx, sum(weight * a * b) AS sxy FROM co JOIN wt USING (name) GROUP BY role),
      sl AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope FROM sm)
      SELECT role, n, round(slope, 6) AS slope, round((sy - slope * sx) / sw, 6) AS intercept FROM sl""",
    "gravity_global": f"""WITH {GRAV}, lg AS (SELECT ln(src_total) AS a, ln(dst_total) AS b, ln(dist) AS c, ln(count) AS y FROM gr),
      m AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc,
        covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my FROM lg),
      d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
      r AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS p,
        (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS q,
        (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS s FROM d)
      SELECT 'log_src' AS term, round(p, 6) AS coef FROM r UNION ALL SELECT 'log_dst', round(q, 6) FROM r
      UNION ALL SELECT 'log_dist', round(s, 6) FROM r UNION ALL SELECT 'intercept', round(my - p * ma - q * mb - s * mc, 6) FROM r""",
}
