"""Points of interest: radius joins, density, prices, shares, tag tables, grids and tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanflow.functions import geo
from urbanflow.functions.text import int_div

# Tag key words, radii in metres and the density grid.
POI_TAGS = ["房地产;住宅区", "房地产;写字楼", "公司企业", "美食", "购物", "金融", "生活服务", "休闲娱乐", "旅游景点", "自然地物", "政府机构"]
RADII = (200, 500, 1000)
POI_GRID = (100, 80)
POI_LNG = (121.2, 121.7)
POI_LAT = (31.0, 31.4)


def _band(lat: Column, height: float) -> Column:
    return F.floor((lat + 90.0) / F.lit(height)).cast("int")


def _cells_around(band: Column, height: float) -> Column:
    """How many cells a band has around the globe, each as wide as the radius anywhere in the band and its neighbours.

    A band from whose neighbourhood the radius reaches a pole is one cell.
    """
    south = F.abs((band - 1).cast("double") * height - 90.0)
    north = F.abs((band + 2).cast("double") * height - 90.0)
    steepest = F.greatest(south, north)
    reach = F.lit(math.sin(math.radians(height))) / F.cos(F.radians(steepest))
    width = F.degrees(F.asin(reach)) * 1.001
    return F.when((steepest >= 90.0) | (reach >= 1.0), 1).otherwise(F.greatest(F.lit(1), F.floor(360.0 / width))).cast("long")


def _cell(lng: Column, cells: Column) -> Column:
    """The cell of a longitude; 180 degrees east and west are the same place."""
    return F.pmod(F.floor(F.pmod(lng + 180.0, F.lit(360.0)) / 360.0 * cells), cells).cast("long")


def radius_pairs(points: DataFrame, centers: DataFrame, radius_m: float) -> DataFrame:
    """Points within ``radius_m`` of centers, by an equi-join on cells at least one radius wide.

    Cells go around the globe and over the poles.  Each center (the small side) is repeated for its nine neighbouring
    cells at most; points keep one cell.  Nothing is broadcast by hand: a small center table is broadcast by its
    measured size, a large one is shuffled, and adaptive execution splits a crowded cell.  ``points``: lng, lat, ...;
    ``centers``: name, clng, clat.
    """
    height = math.degrees(radius_m / geo.QUERY_RADIUS_M) * 1.000001
    cells = points.withColumn("cy", _band(F.col("lat"), height))
    cells = cells.withColumn("cx", _cell(F.col("lng"), _cells_around(F.col("cy"), height)))
    near = centers.withColumn("cy", F.explode(F.array(*[_band(F.col("clat"), height) + d for d in (-1, 0, 1)])))
    around = _cells_around(F.col("cy"), height)
    middle = _cell(F.col("clng"), around)
    near = near.withColumn("cx", F.explode(F.array_distinct(F.array(*[F.pmod(middle + d, around) for d in (-1, 0, 1)]))))
    meters = geo.haversine(F.col("clng"), F.col("clat"), F.col("lng"), F.col("lat"), geo.QUERY_RADIUS_M)
    joined = cells.join(near, ["cy", "cx"]).withColumn("meters", meters)
    return joined.filter(F.col("meters") <= radius_m).drop("cy", "cx")


def _centers(locations: DataFrame) -> DataFrame:
    return locations.select("name", F.col("lng").alias("clng"), F.col("lat").alias("clat"))


def radius_counts(pois: DataFrame, stops: DataFrame, locations: DataFrame, tags: list[str] = POI_TAGS,
                  radii: tuple = RADII) -> DataFrame:
    """One row per location with a count per (radius, tag) and per radius for stops; zeros are kept.

    Both kinds of points go through one radius join at the largest radius.  Columns: ``r{radius}_t{i}`` for
    tag number ``i`` and ``r{radius}_stops``.
    """
    points = pois.select("lng", "lat", "tags", F.lit(False).alias("is_stop")).unionByName(
        stops.select("lng", "lat", F.lit("").alias("tags"), F.lit(True).alias("is_stop")))
    pairs = radius_pairs(points, _centers(locations), max(radii))
    sums = []
    for radius in radii:
        close = F.col("meters") <= radius
        sums += [F.count_if(close & ~F.col("is_stop") & F.contains("tags", F.lit(tag))).alias(f"r{radius}_t{i}")
                 for i, tag in enumerate(tags)]
        sums.append(F.count_if(close & F.col("is_stop")).alias(f"r{radius}_stops"))
    counts = pairs.groupBy("name").agg(*sums)
    return locations.select("name").join(counts, "name", "left").na.fill(0)


def feature_names(tags: list[str] = POI_TAGS, radii: tuple = RADII) -> list[str]:
    return [f"r{r}_{suffix}" for r in radii for suffix in [*[f"t{i}" for i in range(len(tags))], "stops"]]


def radius_mixed(pois: DataFrame, communities: DataFrame, buildings: DataFrame, stops: DataFrame,
                 locations: DataFrame, tags: list[str], radius: float) -> DataFrame:
    """POI counts per tag, households, building area and stops within one radius of each location.

    ``communities``: lng, lat, households (int, NULL if unreadable); ``buildings``: lng, lat, area.
    """
    def kind(df, name, tags_col=F.lit(""), amount=F.lit(None)):
        return df.select("lng", "lat", F.lit(name).alias("kind"), tags_col.alias("tags"),
                         amount.cast("decimal(18,2)").alias("amount"))
    points = (kind(pois, "poi", F.col("tags")).unionByName(kind(communities, "community", amount=F.col("households")))
              .unionByName(kind(buildings, "building", amount=F.col("area"))).unionByName(kind(stops, "stop")))
    pairs = radius_pairs(points, _centers(locations), radius)
    is_kind = {k: F.col("kind") == k for k in ("poi", "community", "building", "stop")}
    sums = [F.count_if(is_kind["poi"] & F.contains("tags", F.lit(tag))).alias(f"t{i}") for i, tag in enumerate(tags)]
    sums += [F.sum(F.when(is_kind["community"], F.col("amount"))).cast("long").alias("households"),
             F.floor(F.sum(F.when(is_kind["building"], F.col("amount")))).cast("long").alias("area"),
             F.count_if(is_kind["stop"]).alias("stops")]
    return locations.select("name").join(pairs.groupBy("name").agg(*sums), "name", "left").na.fill(0)


def poi_cell(pois: DataFrame) -> DataFrame:
    """Bin points into the density grid; truncation is toward zero, so the low edge reaches one cell further out."""
    (nx, ny), (w, e), (s, n) = POI_GRID, POI_LNG, POI_LAT
    x = (F.lit(float(nx)) * (F.col("lng") - F.lit(w)) / F.lit(e - w)).cast("int")
    y = (F.lit(float(ny)) * (F.col("lat") - F.lit(s)) / F.lit(n - s)).cast("int")
    cells = pois.withColumns({"x": x, "y": y})
    return cells.filter((F.col("x") >= 0) & (F.col("x") < nx) & (F.col("y") >= 0) & (F.col("y") < ny))


def matched_tags(pois: DataFrame, tags: list[str]) -> DataFrame:
    """One row per point and key word that its tag text contains."""
    hits = F.array_compact(F.array(*[F.when(F.contains("tags", F.lit(t)), F.lit(t)) for t in tags]))
    return pois.withColumn("tag", F.explode(hits))


def poi_density(pois: DataFrame, tags: list[str]) -> DataFrame:
    return matched_tags(poi_cell(pois), tags).groupBy("tag", "x", "y").agg(F.count(F.lit(1)).alias("cnt"))


def poi_price(pois: DataFrame, tags: list[str]) -> DataFrame:
    """Mean price per tag and cell over usable prices, 0 where there is none."""
    usable = F.when(F.abs(F.col("price")) >= 1, F.col("price").cast("decimal(18,2)"))
    rows = matched_tags(poi_cell(pois), tags).withColumn("usable", usable)
    sums = rows.groupBy("tag", "x", "y").agg(F.sum("usable").cast("double").alias("total"), F.count("usable").alias("n"))
    return sums.select("tag", "x", "y", "n",
                       F.coalesce(F.try_divide("total", F.col("n").cast("double")), F.lit(0.0)).alias("mean_price"))


def location_quotient(density: DataFrame) -> DataFrame:
    """Share of a tag that lies in a cell, minus the share of all points there.

    Cells empty of a tag but not of all count as 0.  Totals are folded from the small per-cell table.
    """
    by_tag = density.groupBy("tag").agg(F.sum("cnt").alias("tag_total"))
    by_cell = density.groupBy("x", "y").agg(F.sum("cnt").alias("cell_total"), F.map_from_entries(
        F.collect_list(F.struct("tag", "cnt"))).alias("cell_counts"))
    # One row holding the totals of the key words, whose number is fixed by the caller.
    all_tags = by_tag.agg(F.sort_array(F.collect_list(F.struct("tag", "tag_total"))).alias("tags"),
                          F.sum("tag_total").alias("total"))
    wide = with_totals(by_cell, all_tags).withColumn("t", F.explode("tags"))
    cnt = F.coalesce(F.try_element_at("cell_counts", F.col("t.tag")), F.lit(0))
    diff = cnt / F.col("t.tag_total") - F.col("cell_total") / F.col("total")
    return wide.select(F.col("t.tag").alias("tag"), "x", "y", cnt.alias("cnt"), diff.alias("diff"))


def normalized_features(counts: DataFrame, features: list[str]) -> DataFrame:
    """Share of a location in each feature, minus the location's share of everything.

    The column sums form a single row whose width is the number of features.
    """
    totals = counts.agg(*[F.sum(f).alias(f"{f}_sum") for f in features])
    row_sum = sum((F.col(f) for f in features), F.lit(0))
    grand = sum((F.col(f"{f}_sum") for f in features), F.lit(0))
    rows = with_totals(counts, totals).withColumns({"row_sum": row_sum, "grand": grand})
    return rows.select("name", *[
        (F.coalesce(F.try_divide(F.col(f), F.col(f"{f}_sum")), F.lit(0.0))
         - F.coalesce(F.try_divide(F.col("row_sum"), F.col("grand")), F.lit(0.0))).alias(f) for f in features])


def tag_frequency(pois: DataFrame, tag: str | None = None) -> DataFrame:
    """Frequency of the single tags of points matching a key word, other tags only, most frequent first."""
    rows = pois if tag is None else pois.filter(F.contains("tags", F.lit(tag)))
    single = rows.select(F.explode(F.split("tags", ";")).alias("tag"))
    if tag is not None:
        single = single.filter(F.col("tag") != tag)
    return single.groupBy("tag").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "tag")


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as one scalar subquery."""
    row = totals.select(F.struct(*totals.columns).alias("totals")).scalar()
    return df.withColumn("totals", row).select(*df.columns, "totals.*")


def with_range(df: DataFrame, value: str) -> DataFrame:
    """Add the minimum and maximum of a column to every row."""
    return with_totals(df, df.agg(F.min(value).alias("lowest"), F.max(value).alias("highest")))


def bucket20(df: DataFrame, value: str) -> DataFrame:
    """Quantize a column to 20 buckets over its range."""
    share = F.try_divide(F.lit(0.99) * (F.col(value) - F.col("lowest")), F.col("highest") - F.col("lowest"))
    bucket = F.coalesce((share * 20).cast("int"), F.lit(0))
    return with_range(df, value).withColumn("bucket", bucket).drop("lowest", "highest")


def minmax_size(df: DataFrame, value: str) -> DataFrame:
    """Scale a column to marker sizes from 2 to 17."""
    share = F.try_divide(F.col(value) - F.col("lowest"), F.col("highest") - F.col("lowest"))
    return with_range(df, value).withColumn("size", F.coalesce(share, F.lit(0.0)) * 15 + 2).drop("lowest", "highest")


def upsert_latest(rows: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """Last write per key wins.  A maximum combines map-side, so a key with very many writes is no hot spot."""
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*sequence)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def grid_dimension(spark) -> DataFrame:
    """Name and centre of every grid cell."""
    ids = spark.range(geo.GRID_WIDTH * geo.GRID_HEIGHT)
    cells = ids.select(int_div(F.col("id"), F.lit(geo.GRID_HEIGHT)).cast("int").alias("gx"),
                       (F.col("id") % geo.GRID_HEIGHT).cast("int").alias("gy"))
    gx, gy = F.col("gx"), F.col("gy")
    return cells.select("gx", "gy", geo.cell_name(gx, gy).alias("name"), geo.cell_center_lng(gx).alias("lng"),
                        geo.cell_center_lat(gy).alias("lat"))


def tile_plan(tags: DataFrame, nx: int = 200, ny: int = 160) -> DataFrame:
    """Bounding boxes of 0.005 degrees for every tag; corners are computed in whole thousandths.

    ``tags`` has one column ``tag`` with distinct values; the tiles are generated per tag, not joined.
    """
    tiles = tags.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    tiles = tiles.withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    gx, gy = F.col("gx"), F.col("gy")
    return tiles.select("tag", "gx", "gy", ((gx * 5 + 121000) / 1000).alias("lng0"), ((gy * 5 + 30700) / 1000).alias("lat0"),
                        ((gx * 5 + 121005) / 1000).alias("lng1"), ((gy * 5 + 30705) / 1000).alias("lat1"))


def tile_of(pois: DataFrame) -> DataFrame:
    """Tile numbers of a point in the plan's grid."""
    return pois.withColumns({"gx": F.floor((F.col("lng") - 121.0) / 0.005).cast("int"),
                             "gy": F.floor((F.col("lat") - 30.7) / 0.005).cast("int")})


def page_plan(totals: DataFrame, page_size: int = 20) -> DataFrame:
    """Result pages needed per row: (total - 1) div size + 1; at least the first page is asked for."""
    pages = int_div(F.col("total") - 1, F.lit(page_size)) + 1
    pages = F.greatest(F.when(F.col("total") <= 0, 1).otherwise(pages), F.lit(1))
    return totals.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), pages - 1)))
