"""Places, pages, files, patterns and reconstruction on small inputs."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tensor_golden import dense, factor_array

from urbanflow.functions import geo, text
from urbanflow.operators import learn, listings, patterns, places
from urbanflow.operators.tensor import algebra as A
from urbanflow.sources import readers, writers


def meters(lng1, lat1, lng2, lat2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * geo.QUERY_RADIUS_M * math.asin(math.sqrt(h))


@pytest.mark.parametrize("base_lat", [31.2, -55.0, 0.0])
def test_radius_join_equals_brute_force(spark, base_lat):
    rng = np.random.default_rng(2)
    points = [(n, 121.3 + float(a), base_lat + float(b)) for n, (a, b) in enumerate(rng.uniform(-0.05, 0.05, (400, 2)))]
    centers = [(n, 121.3 + float(a), base_lat + float(b)) for n, (a, b) in enumerate(rng.uniform(-0.05, 0.05, (15, 2)))]
    got = places.radius_pairs(spark.createDataFrame(points, "p int, lng double, lat double"),
                              spark.createDataFrame(centers, "name int, clng double, clat double"), 1500)
    want = {(p[0], c[0]) for p in points for c in centers if meters(*p[1:], *c[1:]) <= 1500}
    rows = got.select("p", "name").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) > 0


def test_grid_and_text_functions(spark):
    row = spark.range(1).select(
        geo.distance_compat(F.lit(121.4), F.lit(31.2), F.lit(121.5), F.lit(31.2)).alias("east"),
        geo.distance_compat(F.lit(121.4), F.lit(31.2), F.lit(121.4), F.lit(31.3)).alias("north"),
        text.station_name(F.lit("2号线 人民广场 ")).alias("station"), text.station_name(F.lit("none")).alias("no_station"),
        text.household_count(F.lit("1200户")).alias("h"), text.household_count(F.lit("暂无数据")).alias("h0"),
        text.household_count(F.lit("x")).alias("bad"), text.price_value(F.lit("0.4")).alias("p0"),
        text.price_value(F.lit("12.5")).alias("p"), text.price_value(F.lit("?")).alias("pbad"),
        geo.in_box(F.lit(geo.LNG_LOW), F.lit(31.2)).alias("edge"), geo.cell_pixel_x(F.lit(2)).alias("cx"),
        geo.cell_pixel_y(F.lit(0)).alias("cy")).first()
    assert (row.east, row.north) == (11.17, 9.53)
    assert (row.station, row.no_station, row.h, row.h0, row.bad) == ("人民广场", None, 1200, 0, None)
    assert (row.p0, row.p, row.pbad, row.edge, row.cx, row.cy) == (None, 12.5, None, False, 70, 529)


def test_density_edges(spark):
    pois = spark.createDataFrame([("a", 121.1999, 31.001, "美食;x", 1.0), ("b", 121.194, 31.1, "美食", 2.0), ("c", 121.7, 31.1, "美食", 2.0)],
                                 "uid string, lng double, lat double, tags string, price double")
    assert [(r.x, r.y, r.cnt) for r in places.poi_density(pois, ["美食"]).collect()] == [(0, 0, 1)]


def test_page_plan_counts(spark):
    rows = spark.createDataFrame([(0,), (1,), (20,), (21,), (400,)], "total bigint")
    got = {r.total: r.n for r in places.page_plan(rows).groupBy("total").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 1, 1: 1, 20: 1, 21: 2, 400: 20}


def test_upsert_keeps_last_write(spark):
    rows = spark.createDataFrame([("u", 1, "old"), ("u", 3, "new"), ("u", 2, "mid"), ("v", 1, "only")], "uid string, seq int, doc string")
    assert {(r.uid, r.doc) for r in places.upsert_latest(rows, ["uid"], ["seq"]).collect()} == {("u", "new"), ("v", "only")}


PAGE = ('<li class="list_item">\r\n<a href="http://a/1" title="Green">x</a> y <a href="http://shanghai.anjuke.com/map/sale/#l1=31.2&l2=121.4&z=1">m</a></li>'
        '<li class="list_item"><a href="http://a/2" title="Blue">x</a> y <a href="http://shanghai.anjuke.com/map/sale/#l1=31.3&l2=121.5">m</a></li>')
DETAIL = ('<dl class="comm-r-detail float-r"><dt>总户数</dt><dd class="a">120户</dd><dt>年代</dt><dd>1999</dd><dt>年代</dt><dd>2001</dd></dl>')
BUILDING = ('<img src="http://api.map.baidu.com/staticimage?center=121.41,31.21&zoom=1"><table class="config"><tr><td>总建筑面积：</td>'
            '<td>5200.5平米</td></tr>\n<tr><td>a   b&nbsp;c</td></tr></table>')


def test_page_extraction(spark):
    pages = spark.createDataFrame([(1, PAGE, DETAIL, BUILDING), (2, "", "", "<p>none</p>")], "id int, list string, detail string, building string")
    found = listings.community_listings(pages.select("id", "list"), "list").collect()
    assert [(r.pos, r.url, r.name, r.location) for r in found] == [(0, "http://a/1", "Green", "31.2,121.4"), (1, "http://a/2", "Blue", "31.3,121.5")]
    fields = {r.id: r.fields for r in listings.community_fields(pages.select("id", "detail"), "detail").collect()}
    assert fields == {1: {"总户数": "120户", "年代": "2001"}, 2: {}}
    detail = listings.building_details(pages.select("id", "building"), "building").collect()
    assert [(r.id, r.content, r.area, r.lng, r.lat) for r in detail] == [(1, "总建筑面积：5200.5平米a bc", 5200.5, 121.41, 31.21)]


def test_text_files(spark, tmp_path):
    (tmp_path / "taps.csv").write_text("u1,2015-04-01,08:00:00,2号线A,地铁,0.00\nu1,2015-04-01,08:30:00,2号线B,地铁,3.00\n"
                                       "u1,2015-04-01,09:00:00,71路,公交,2.00\nu2,bad\n", "utf-8")
    taps = readers.metro_taps(spark, str(tmp_path / "taps.csv")).collect()
    assert len(taps) == 2 and str(taps[0].ts) == "2015-04-01 08:00:00"
    (tmp_path / "pings.csv").write_text("t1,a,0,b,c,d,e,2015-04-01 08:00:00,121.4,31.2,z\nt1,a,1,b,c,d,e,nonsense,x,31.2,z\n")
    pings = sorted(readers.taxi_pings(spark, str(tmp_path / "pings.csv")).collect(), key=lambda r: r.status)
    assert (pings[0].lng, pings[0].status) == (121.4, "0") and (pings[1].ts, pings[1].lng) == (None, None)
    (tmp_path / "trips.csv").write_text('t1,2015-04-01 08:00:00,121.4 31.2,2015-04-01 08:10:00,121.5 31.3,600.0,9.1\n')
    trip = readers.taxi_trip_lines(spark, str(tmp_path / "trips.csv")).first()
    assert (trip.lng0, trip.lat1, trip.secs) == (121.4, 31.3, 600.0)
    (tmp_path / "metro.csv").write_text("u1,2015-04-01 08:00:00,2号线A,2015-04-01 08:30:00,2号线 B\n", "utf-8")
    assert readers.metro_trip_lines(spark, str(tmp_path / "metro.csv")).first().location1 == "B"
    with gzip.open(tmp_path / "var.txt.gz", "wt") as f:
        f.write("8\ta\tb\t2\t3.5\t0.5\t0.1429\t0.5,0.5\n")
    var = readers.variability(spark, str(tmp_path / "var.txt.gz"), 2).first()
    assert (var.hour, var["mean"], var.devs) == (8, 3.5, [0.5, 0.5])
    (tmp_path / "loc.csv").write_text("a,121.40,31.20\nb,121.50,31.30\n")
    loc = readers.locations(spark, str(tmp_path / "loc.csv")).collect()
    assert [(r.name, r.idx, r.lnglat) for r in loc] == [("a", 0, "121.40,31.20"), ("b", 1, "121.50,31.30")]
    (tmp_path / "rain.csv").write_text("201504010000,1,2,20,N,3,0.5\n201504010100,1,2,20,N,3,////\n")
    assert [r.rain for r in readers.weather(spark, str(tmp_path / "rain.csv")).orderBy("ts").collect()] == [0.5, None]
    (tmp_path / "poi.json").write_text(json.dumps({"uid": "p", "location": {"lng": 121.4, "lat": 31.2}, "detail_info": {"tag": "美食;x"}}) + "\n")
    poi = readers.poi_documents(spark, str(tmp_path / "poi.json")).first()
    assert poi.position.coordinates == [121.4, 31.2] and poi.tags == "美食;x" and poi.price is None
    (tmp_path / "bus.tsv").write_text("fullname\tname\tstarttime\tendtime\tcompany\tstationnum\tstations\nL1 up\tL1\t5:30\t22:00\tC\t2\tA:121.1,31.1 B:121.2,31.2\nshort\tline\n")
    bus = readers.read_bus_stops(spark, str(tmp_path / "bus.tsv")).collect()
    assert [(r.station_name, r.lng) for r in bus] == [("A", 121.1), ("B", 121.2)]
    (tmp_path / "tensor.txt").write_text("[[[1, 0], [0, 2]], [[0, 0], [3, 0]]]")
    cells = readers.nested_tensor(spark.read.text(str(tmp_path / "tensor.txt"), wholetext=True)).collect()
    assert {(r.i, r.j, r.k): r.v for r in cells} == {(0, 0, 0): 1, (0, 1, 1): 2, (1, 1, 0): 3}


def test_writers(spark, tmp_path):
    counts = spark.createDataFrame([(1, 8, "a", "b", 3), (2, 9, "a", "b", 4)], "day int, hour int, src string, dst string, cnt bigint")
    writers.write_lines(counts, str(tmp_path / "counts"))
    assert readers.od_counts(spark, str(tmp_path / "counts")).exceptAll(counts).isEmpty()
    writers.write_table(counts, str(tmp_path / "table"), ["day"])
    assert (tmp_path / "table" / "day=1").is_dir()
    writers.write_single_csv(counts, str(tmp_path / "single"))
    assert len(list((tmp_path / "single").glob("*.csv"))) == 1
    var = spark.createDataFrame([(8, "a", "b", 2, 3.5, 0.5, 0.1429, [0.5, 0.5])],
                                "hour int, src string, dst string, n bigint, mean double, mae double, err double, devs array<double>")
    writers.write_variability(var, str(tmp_path / "var"))
    assert readers.variability(spark, str(tmp_path / "var")).exceptAll(var).isEmpty()
    index = spark.createDataFrame([("a", 0), ("b", 1)], "name string, idx int")
    writers.write_index(index, str(tmp_path / "index"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "index")).count() == 2


def test_spline_is_exact_for_cubics():
    xs = patterns.spline_xs(24)
    w = patterns.spline_basis(24, xs)
    assert len(xs) == 230
    for curve in (lambda x: x ** 3 - 20 * x ** 2 + x, lambda x: 0 * x + 4.0):
        assert np.allclose(w @ curve(np.arange(24.0)), curve(xs))
    assert np.allclose(w[::10], np.eye(24)[:23], atol=1e-9)


def test_spatial_class(spark):
    f = A.factor_from_array(spark, np.array([[9.0, 1, 0], [1, 9, 0], [1, 1, 1], [0, 0, 0]]))
    assert {r.idx: r["class"] for r in patterns.spatial_class(f).collect()} == {0: 0, 1: 1, 2: 2, 3: None}
    strength = {r.component: r.strength for r in patterns.component_strength([f, f]).collect()}
    assert strength == {0: 121, 1: 121, 2: 1}


def test_error_sweep(spark):
    rng = np.random.default_rng(4)
    x = np.einsum("ir,jr,kr->ijk", *[rng.random((n, 2)) for n in (5, 5, 4)])
    rows = patterns.error_sweep({("metro", "workdays"): dense(spark, x)}, (1, 2), (1.0,), ("ANLS_BPP",), min_iter=2, max_iter=2).collect()
    error = {r["rank"]: r.rel_frobenius for r in rows}
    assert error[2] < error[1] < 1


def test_learning(spark):
    rng = np.random.default_rng(5)
    n, hours = 8, 24
    sf, df = rng.random((n, 2)), rng.random((n, 2))
    x = np.zeros((n, n, hours))
    for i in range(n):
        for j in range(n):
            x[i, j] = 10 + 40 * (sf[i] * df[j]) @ rng.random((2, hours))
    t = dense(spark, x)
    places_table = spark.createDataFrame([(i, 121.4 + i / 100, 31.2, float(i), float(i * i)) for i in range(n)],
                                         "idx bigint, lng double, lat double, a double, b double")
    pairs = learn.pair_features(t, A.factor_from_array(spark, sf), A.factor_from_array(spark, df), places_table, ["a", "b"], 30)
    assert pairs.count() == n * (n - 1)
    row = pairs.filter("i = 1 and j = 2").first()
    assert sum(row[f"y{k}"] for k in range(hours)) == pytest.approx(100)
    assert (row.sf0, row.df1, row.sx1, row.dx1) == pytest.approx((sf[1, 0], df[2, 1], 1.0, 4.0))
    folded = learn.with_folds(pairs, 3)
    sizes = {r.fold: (r.n, r.lo, r.hi) for r in folded.groupBy("fold").agg(
        F.count("*").alias("n"), F.min(F.struct("i", "j")).alias("lo"), F.max(F.struct("i", "j")).alias("hi")).collect()}
    assert [sizes[f][0] for f in range(3)] == [19, 19, 18] and sizes[0][2] < sizes[1][1] and sizes[1][2] < sizes[2][1]
    for model in ("model1", "model2", "model3"):
        scored = learn.kfold(pairs, model, 2, "linear")
        total = learn.total_error(scored).first()
        assert total.n == n * (n - 1) * hours and 0 < total.error < 1
    # Fits by subtraction equal fits on the other folds' rows, for every model and case.
    cases = {"workdays": pairs, "holidays": pairs.filter("i < 6")}
    scored = learn.linear_kfold(cases, 10).toPandas()
    assert scored.groupby(["case", "model"]).size().to_dict() == {
        (c, m): 24 * k for c, k in (("workdays", 56), ("holidays", 42)) for m in ("model1", "model2", "model3")}
    rows, _ = learn.model_columns(learn.with_folds(cases["holidays"], 10), "model3")
    rows = rows.toPandas()
    for model in ("model1", "model3"):
        names = learn.model_columns(pairs, model)[1]
        train, test = rows[rows.fold != 4], rows[rows.fold == 4]
        x = lambda part: np.column_stack([np.ones(len(part)), part[names].to_numpy(float)])
        weights = np.linalg.lstsq(x(train), train[[f"y{k}" for k in range(24)]].to_numpy(float), rcond=None)[0]
        got = scored[(scored.case == "holidays") & (scored.model == model) & (scored.fold == 4)].sort_values(["i", "j", "hour"])
        want = (x(test.sort_values(["i", "j"])) @ weights).ravel()
        assert np.allclose(got.prediction, want, atol=1e-4)
    errors = {(r["case"], r["model"]): r.error for r in learn.error_by_model(learn.linear_kfold(cases, 10)).collect()}
    assert len(errors) == 6 and all(0 < e < 1 for e in errors.values())
    gbt = learn.reconstruct(folded.filter("fold < 2"), folded.filter("fold = 2"), "model3", maxIter=2, maxDepth=2)
    assert gbt.count() == 18 * hours


def test_matrix_factorization(spark):
    r = [[5, 3, 0, 1], [4, 0, 0, 1], [1, 1, 0, 5], [1, 0, 0, 4], [0, 1, 5, 4]]
    cells = spark.createDataFrame([(i, j, float(v)) for i, line in enumerate(r) for j, v in enumerate(line)], "row int, col int, v double")
    model, observed = learn.matrix_factorization(cells, 2, 15)
    got = learn.mf_error(model, observed).first()
    assert got.n == 13 and got.rmse < 0.5
    assert factor_array(A.factor_from_array(spark, np.eye(2))).shape == (2, 2)
