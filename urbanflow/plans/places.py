"""Registered queries: points of interest, page extraction, grids and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanflow.functions import geo, text
from urbanflow.operators import gravity, listings, od, places
from urbanflow.plans import views as V
from urbanflow.sources import readers

TAGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "SUPPLIER"]
DAY = 1


def _stops(spark, folder):
    return V.pois(spark, folder).filter(F.startswith("uid", F.lit("S"))).select("lng", "lat")


def _radius_counts(spark, folder):
    return places.radius_counts(V.pois(spark, folder), _stops(spark, folder), V.locations(spark, folder), TAGS)


def poi_radius_counts(spark, folder):
    return _radius_counts(spark, folder)


def poi_radius_mixed(spark, folder):
    pois = V.pois(spark, folder)
    wording = F.when(F.col("price") < 0, F.lit("暂无数据")).otherwise(
        F.concat(F.floor("price").cast("string"), F.lit("户")))
    communities = pois.filter(F.startswith("uid", F.lit("C"))).select(
        "lng", "lat", text.household_count(wording).alias("households"))
    buildings = pois.filter(F.startswith("uid", F.lit("S"))).select("lng", "lat", F.abs("price").alias("area"))
    return places.radius_mixed(pois, communities, buildings, _stops(spark, folder), V.locations(spark, folder), TAGS, 1000)


def poi_features(spark, folder):
    names = places.feature_names(TAGS)
    rows = places.normalized_features(_radius_counts(spark, folder), names)
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.round(n, 8).alias("v")) for n in names]))
    return rows.select("name", long.alias("e")).select("name", "e.*")


def poi_density(spark, folder):
    return places.poi_density(V.pois(spark, folder), TAGS)


def poi_price(spark, folder):
    return places.poi_price(V.pois(spark, folder), TAGS)


def poi_quotient(spark, folder):
    return places.location_quotient(places.poi_density(V.pois(spark, folder), TAGS))


def tag_frequency(spark, folder):
    return places.tag_frequency(V.pois(spark, folder), "BUILDING")


def tag_values(spark, folder):
    """Last tag segment, parsed price and household number of every point."""
    rows = V.pois(spark, folder)
    wording = F.when(F.col("price") < 0, F.lit("暂无数据")).otherwise(
        F.concat(F.floor("price").cast("string"), F.lit("户")))
    station = F.concat(F.lit("2号线 "), "tags")
    return rows.select("uid", text.last_segment(F.col("tags")).alias("label"),
                       text.price_value(F.col("price").cast("string")).alias("price"),
                       text.household_count(wording).alias("households"),
                       text.station_name(station).alias("station"), text.has_tag(F.col("tags"), "_1").alias("tagged"))


def _node_totals(spark, folder):
    totals = od.node_day_totals(V.od_counts(spark, folder), V.locations(spark, folder))
    return totals.filter((F.col("day") == DAY) & (F.col("role") == "src"))


def _all_totals(spark, folder):
    return od.node_day_totals(V.od_counts(spark, folder), V.locations(spark, folder)).select("role", "name", "day", "count")


def bucket20(spark, folder):
    return places.bucket20(_all_totals(spark, folder), "count")


def minmax_size(spark, folder):
    rows = places.minmax_size(_all_totals(spark, folder), "count")
    return rows.withColumn("size", F.round("size", 8))


def poi_regression(spark, folder):
    totals = _node_totals(spark, folder).filter(geo.in_box(F.col("lng"), F.col("lat"))).select("name", "count")
    counts = _radius_counts(spark, folder).select("name", F.expr("r1000_t0 + r1000_t1 + r1000_t2").alias("x1"),
                                                  F.expr("r1000_t3 + r1000_t4 + r1000_t5").alias("x2"))
    rows = gravity.poi_regression(totals, counts, ["x1", "x2"])
    return rows.select("name", "count", F.round("fitted", 5).alias("fitted"),
                       F.round("rel_residual", 6).alias("rel_residual"), F.round("r2", 6).alias("r2"))


def upsert_latest(spark, folder):
    events = V.table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return places.upsert_latest(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


LINK = r'<a href="(.+?)">(.+?)</a>'
FIELD = r"<(title|h1)>(.+?)</(?:title|h1)>"


def page_links(spark, folder):
    pages = V.table(spark, folder, "pages").select("page_id", "html")
    return listings.listing_rows(pages, "html", {"url": (LINK, 1), "name": (LINK, 2)})


def page_fields(spark, folder):
    pages = V.table(spark, folder, "pages").select("page_id", listings.one_line(F.col("html")).alias("html"))
    rows = pages.withColumn("fields", listings.pairs_map(F.col("html"), (FIELD, 1), (FIELD, 2)))
    return rows.select("page_id", F.explode("fields").alias("field", "value"))


def page_clean_text(spark, folder):
    pages = V.table(spark, folder, "pages").select("page_id", "url", listings.one_line(F.col("html")).alias("html"))
    clean = pages.withColumn("content", listings.clean_text(F.col("html")))
    number = listings.first_or(F.col("url"), r"page=(\d+)", "0").try_cast("double")
    return clean.select("page_id", F.md5(F.col("content").cast("binary")).alias("content_md5"),
                        F.char_length("content").alias("chars"), number.alias("number"))


def busline_explode(spark, folder):
    key = F.col("c_custkey")

    def stop(n):
        lng = (key * (7 + n)) % 300 + 300
        lat = (key * (11 + n)) % 160 + 140
        return F.concat(F.lit("S"), ((key + n) % 50).cast("string"), F.lit(":121."), lng.cast("string"),
                        F.lit(",31."), lat.cast("string"))
    stations = F.concat_ws(" ", stop(0), stop(1), stop(2))
    line = F.concat_ws("\t", "c_name", F.concat(F.lit("L"), F.col("c_nationkey").cast("string")), F.lit("05:30"),
                       F.lit("22:00"), "c_mktsegment", F.lit("3"), stations)
    stops = readers.bus_stops(V.table(spark, folder, "customer").select(line.alias("value")))
    return stops.select("fullname", "name", "company", "stationnum", "station_name", "lng", "lat")


def _tags(spark, folder):
    return V.table(spark, folder, "customer").select(F.col("c_mktsegment").alias("tag")).distinct()


def tile_plan(spark, folder):
    return places.tile_plan(_tags(spark, folder))


def page_plan(spark, folder):
    hits = places.matched_tags(places.tile_of(V.pois(spark, folder)), TAGS)
    totals = hits.groupBy("tag", "gx", "gy").agg(F.count(F.lit(1)).alias("total"))
    return places.page_plan(totals)


def grid_dimension(spark, folder):
    """Every grid cell with its centre and its number of pings, empty cells included."""
    lng, lat = F.col("lng"), F.col("lat")
    pings = V.pings(spark, folder).filter(geo.in_box(lng, lat))
    counts = pings.groupBy(geo.cell_name(geo.grid_x(lng), geo.grid_y(lat)).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    cells = places.grid_dimension(spark).join(counts, "name", "left")
    return cells.select("name", "gx", "gy", F.round("lng", 8).alias("lng"), F.round("lat", 8).alias("lat"),
                        F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {f.__name__: f for f in (
    poi_radius_counts, poi_radius_mixed, poi_features, poi_density, poi_price, poi_quotient, tag_frequency, tag_values,
    bucket20, minmax_size, poi_regression, upsert_latest, page_links, page_fields, page_clean_text, busline_explode,
    tile_plan, page_plan, grid_dimension)}

# ---- SQL counterparts -----------------------------------------------------------------------------

R = "6378100.0::DOUBLE"
STOPS = "stops AS (SELECT lng, lat FROM pois WHERE uid LIKE 'S%')"
NEAR = V.POIS + ", " + V.LOCATIONS + f""", {STOPS},
  pp AS (SELECT l.name, p.tags, p.uid, p.price, {V.haversine_sql('l.lng', 'l.lat', 'p.lng', 'p.lat', R)} AS m FROM locations l, pois p),
  sp AS (SELECT l.name, {V.haversine_sql('l.lng', 'l.lat', 'p.lng', 'p.lat', R)} AS m FROM locations l, stops p),
  pc AS (SELECT name, {', '.join(f"count(*) FILTER (m <= {r} AND contains(tags, '{t}'))::BIGINT AS r{r}_t{i}" for r in places.RADII for i, t in enumerate(TAGS))} FROM pp GROUP BY name),
  sc AS (SELECT name, {', '.join(f"count(*) FILTER (m <= {r})::BIGINT AS r{r}_stops" for r in places.RADII)} FROM sp GROUP BY name),
  rc AS (SELECT * FROM pc JOIN sc USING (name))"""
_x = "trunc(100.0::DOUBLE * (lng - 121.2::DOUBLE) / (121.7::DOUBLE - 121.2::DOUBLE))::INT"
_y = "trunc(80.0::DOUBLE * (lat - 31.0::DOUBLE) / (31.4::DOUBLE - 31.0::DOUBLE))::INT"
_tag_list = "(VALUES " + ", ".join(f"('{t}')" for t in TAGS) + ") AS t(tag)"
BINNED = V.POIS + f""", binned AS (SELECT *, {_x} AS x, {_y} AS y FROM pois),
  tagged AS (SELECT b.*, t.tag FROM binned b JOIN {_tag_list} ON contains(b.tags, t.tag) WHERE x >= 0 AND x < 100 AND y >= 0 AND y < 80),
  density AS (SELECT tag, x, y, count(*)::BIGINT AS cnt FROM tagged GROUP BY ALL)"""
TOT = V.OD + ", " + V.LOCATIONS + f", tot AS (SELECT src AS name, sum(cnt)::BIGINT AS count FROM od_counts WHERE day = {DAY} GROUP BY src), ends AS (SELECT min(count) AS lo, max(count) AS hi FROM tot)"
ALL_TOT = V.OD + """, tot AS (SELECT 'src' AS role, src AS name, day, sum(cnt)::BIGINT AS count FROM od_counts GROUP BY ALL UNION ALL
  SELECT 'dst', dst, day, sum(cnt)::BIGINT FROM od_counts GROUP BY ALL), ends AS (SELECT min(count) AS lo, max(count) AS hi FROM tot)"""
FEATURES = places.feature_names(TAGS)
_grand = " + ".join(f"sum({f}) OVER ()" for f in FEATURES)
_rowsum = " + ".join(FEATURES)


def _bus(n):
    return f"'S' || ((c_custkey + {n}) % 50), ('121.' || ((c_custkey * {7 + n}) % 300 + 300))::DOUBLE, ('31.' || ((c_custkey * {11 + n}) % 160 + 140))::DOUBLE"


_line = r"regexp_replace(html, '\r\n|\n', '', 'g')"
SQL = {
    "poi_radius_counts": f"WITH {NEAR} SELECT * FROM rc",
    "poi_radius_mixed": f"""WITH {NEAR}, mx AS (SELECT name, {', '.join(f"count(*) FILTER (contains(tags, '{t}'))::BIGINT AS t{i}" for i, t in enumerate(TAGS))},
      coalesce(sum(CASE WHEN uid LIKE 'C%' THEN CASE WHEN price < 0 THEN 0 ELSE floor(price)::BIGINT END END), 0)::BIGINT AS households,
      coalesce(floor(sum(CASE WHEN uid LIKE 'S%' THEN abs(price)::DECIMAL(18,2) END)), 0)::BIGINT AS area,
      count(*) FILTER (uid LIKE 'S%')::BIGINT AS stops FROM pp WHERE m <= 1000 GROUP BY name)
      SELECT l.name, {', '.join(f'coalesce(t{i}, 0) AS t{i}' for i in range(len(TAGS)))}, coalesce(households, 0) AS households, coalesce(area, 0) AS area, coalesce(stops, 0) AS stops FROM locations l LEFT JOIN mx USING (name)""",
    "poi_features": f"WITH {NEAR}, nf AS (SELECT name, " + ", ".join(
        f"round(coalesce({f} / nullif(sum({f}) OVER (), 0), 0) - coalesce(({_rowsum}) / nullif({_grand}, 0), 0), 8) AS {f}" for f in FEATURES)
        + f" FROM rc) SELECT name, feature, v FROM (UNPIVOT nf ON {', '.join(FEATURES)} INTO NAME feature VALUE v)",
    "poi_density": f"WITH {BINNED} SELECT * FROM density",
    "poi_price": f"WITH {BINNED} SELECT tag, x, y, count(*) FILTER (abs(price) >= 1)::BIGINT AS n, coalesce((sum(price::DECIMAL(18,2)) FILTER (abs(price) >= 1))::DOUBLE / nullif(count(*) FILTER (abs(price) >= 1), 0), 0.0) AS mean_price FROM tagged GROUP BY ALL",
    "poi_quotient": f"""WITH {BINNED}, bt AS (SELECT tag, sum(cnt)::BIGINT AS tt FROM density GROUP BY tag), bc AS (SELECT x, y, sum(cnt)::BIGINT AS ct FROM density GROUP BY x, y),
      al AS (SELECT sum(cnt)::BIGINT AS total FROM density)
      SELECT bt.tag, bc.x, bc.y, coalesce(d.cnt, 0) AS cnt, coalesce(d.cnt, 0) / tt - ct / total AS diff FROM bc CROSS JOIN bt CROSS JOIN al LEFT JOIN density d ON d.tag = bt.tag AND d.x = bc.x AND d.y = bc.y""",
    "tag_frequency": f"WITH {V.POIS} SELECT tag, count(*)::BIGINT AS cnt FROM (SELECT unnest(string_split(tags, ';')) AS tag FROM pois WHERE contains(tags, 'BUILDING')) WHERE tag <> 'BUILDING' GROUP BY tag",
    "tag_values": f"WITH {V.POIS} SELECT uid, string_split(tags, ';')[-1] AS label, CASE WHEN abs(price) >= 1 THEN price END AS price, CASE WHEN price < 0 THEN 0 ELSE floor(price)::INT END AS households, tags AS station, contains(tags, '_1') AS tagged FROM pois",
    "bucket20": f"WITH {ALL_TOT} SELECT role, name, day, count, trunc(0.99::DOUBLE * (count - lo) / (hi - lo) * 20)::INT AS bucket FROM tot, ends",
    "minmax_size": f"WITH {ALL_TOT} SELECT role, name, day, count, round((count - lo) / (hi - lo) * 15 + 2, 8) AS size FROM tot, ends",
    "poi_regression": f"""WITH {NEAR}, {V.OD}, tot AS (SELECT src AS name, sum(cnt)::BIGINT AS count FROM od_counts WHERE day = {DAY} GROUP BY src),
      dd AS (SELECT t.name, t.count, r1000_t0 + r1000_t1 + r1000_t2 AS a, r1000_t3 + r1000_t4 + r1000_t5 AS b FROM tot t JOIN locations l USING (name) JOIN rc USING (name) WHERE {V.in_box_sql('l.lng', 'l.lat')}),
      mm AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, count) AS ay, covar_pop(b, count) AS by_, avg(a) AS ma, avg(b) AS mb, avg(count) AS my, var_pop(count) AS yy FROM dd),
      cc AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS p, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS q FROM mm),
      ff AS (SELECT name, count, my + p * (a - ma) + q * (b - mb) AS fitted, (p * ay + q * by_) / yy AS r2 FROM dd, cc)
      SELECT name, count, round(fitted, 5) AS fitted, round(abs(fitted - count) / count, 6) AS rel_residual, round(r2, 6) AS r2 FROM ff""",
    "upsert_latest": "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "page_links": rf"""WITH p AS (SELECT page_id, {_line} AS html FROM pages), h AS (SELECT page_id, regexp_extract_all(html, '<a href="(.+?)">(.+?)</a>', 1) AS u, regexp_extract_all(html, '<a href="(.+?)">(.+?)</a>', 2) AS n FROM p)
      SELECT page_id, (unnest(range(len(u))))::INT AS pos, unnest(u) AS url, unnest(n) AS name FROM h""",
    "page_fields": rf"""WITH p AS (SELECT page_id, {_line} AS html FROM pages), h AS (SELECT page_id, regexp_extract_all(html, '<(title|h1)>(.+?)</(?:title|h1)>', 1) AS k, regexp_extract_all(html, '<(title|h1)>(.+?)</(?:title|h1)>', 2) AS v FROM p),
      e AS (SELECT page_id, unnest(range(len(k))) AS pos, unnest(k) AS field, unnest(v) AS value FROM h) SELECT page_id, field, arg_max(value, pos) AS value FROM e GROUP BY page_id, field""",
    "page_clean_text": rf"""WITH p AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace({_line}, '<.*?>', '', 'g'), ' +', ' ', 'g'), '&nbsp;', '', 'g')) AS content FROM pages)
      SELECT page_id, md5(content) AS content_md5, length(content)::INT AS chars, coalesce(try_cast(nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS DOUBLE), 0.0::DOUBLE) AS number FROM p""",
    "busline_explode": "SELECT c_name AS fullname, 'L' || c_nationkey AS name, c_mktsegment AS company, 3::INT AS stationnum, station_name, lng, lat FROM (" + " UNION ALL ".join(
        f"SELECT c_name, c_nationkey, c_mktsegment, {_bus(n)} FROM customer" for n in range(3)) + ") AS b(c_name, c_nationkey, c_mktsegment, station_name, lng, lat)",
    "tile_plan": "SELECT tag, gx::INT AS gx, gy::INT AS gy, (gx * 5 + 121000) / 1000 AS lng0, (gy * 5 + 30700) / 1000 AS lat0, (gx * 5 + 121005) / 1000 AS lng1, (gy * 5 + 30705) / 1000 AS lat1 FROM (SELECT DISTINCT c_mktsegment AS tag FROM customer), range(200) AS a(gx), range(160) AS b(gy)",
    "page_plan": f"""WITH {V.POIS}, tt AS (SELECT t.tag, floor((lng - 121.0::DOUBLE) / 0.005::DOUBLE)::INT AS gx, floor((lat - 30.7::DOUBLE) / 0.005::DOUBLE)::INT AS gy, count(*)::BIGINT AS total FROM pois JOIN {_tag_list} ON contains(tags, t.tag) GROUP BY ALL)
      SELECT tag, gx, gy, total, unnest(range((total - 1) // 20 + 1))::BIGINT AS page FROM tt""",
    "grid_dimension": f"""WITH {V.PINGS}, pc AS (SELECT trunc((lng - 121.308::DOUBLE) / (121.598::DOUBLE - 121.308::DOUBLE) * 28.0::DOUBLE)::INT AS gx, trunc((lat - 31.146::DOUBLE) / (31.306::DOUBLE - 31.146::DOUBLE) * 24.0::DOUBLE)::INT AS gy, count(*)::BIGINT AS n FROM pings WHERE {V.in_box_sql('lng', 'lat')} GROUP BY ALL)
      SELECT gx || '_' || gy AS name, gx::INT AS gx, gy::INT AS gy, round((gx + 0.5::DOUBLE) / 28.0::DOUBLE * (121.598::DOUBLE - 121.308::DOUBLE) + 121.308::DOUBLE, 8) AS lng,
      round((gy + 0.5::DOUBLE) / 24.0::DOUBLE * (31.306::DOUBLE - 31.146::DOUBLE) + 31.146::DOUBLE, 8) AS lat, coalesce(n, 0) AS n FROM range(28) AS a(gx) CROSS JOIN range(24) AS b(gy) LEFT JOIN pc USING (gx, gy)""",
}
