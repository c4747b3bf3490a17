"""Hard inputs: places near the poles and the date line, nearly equal columns, tensors of low rank, long modes."""

import math
import random

import numpy as np
import pytest

from urbanflow.functions import geo
from urbanflow.operators import listings, places
from urbanflow.operators.tensor import cp, nnls, tucker
from urbanflow.operators.tensor import table as TB
from urbanflow.operators.tensor.algebra import factor_matrix, gram


def meters(lng1, lat1, lng2, lat2):
    a, b = math.radians(lat1), math.radians(lat2)
    chord = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * geo.QUERY_RADIUS_M * math.asin(min(1.0, math.sqrt(chord)))


@pytest.mark.parametrize("radius", [200.0, 1000.0, 500_000.0])
@pytest.mark.parametrize("lat,lng", [(89.995, 0.0), (-89.995, 90.0), (89.97, -179.9), (0.0, 180.0), (60.0, -180.0), (31.2, 121.4),
                                     (-45.0, 179.999), (90.0, 10.0), (89.98, 30.0)])
def test_radius_join_equals_brute_force(spark, lat, lng, radius):
    rng = random.Random(f"{lat}{lng}{radius}")
    spread = math.degrees(radius / geo.QUERY_RADIUS_M) * 1.5

    def near():
        y = lat + rng.uniform(-spread, spread)
        x = lng + rng.uniform(-spread, spread) / max(0.0005, math.cos(math.radians(min(abs(y), 89.9999))))
        if abs(y) > 90:
            y, x = math.copysign(180 - abs(y), y), x + 180
        return (x + 180) % 360 - 180, y

    points = [(n, *near()) for n in range(150)]
    centers = [(f"c{n}", *near()) for n in range(15)] + [("west", -180.0, lat), ("east", 180.0, lat)]
    got = places.radius_pairs(spark.createDataFrame(points, "id int, lng double, lat double"),
                              spark.createDataFrame(centers, "name string, clng double, clat double"), radius)
    want = sorted((i, c) for i, x, y in points for c, u, v in centers if meters(u, v, x, y) <= radius)
    assert sorted((r["id"], r["name"]) for r in got.collect()) == want and want


@pytest.mark.parametrize("solver", [nnls.block_pivoting, nnls.active_set])
@pytest.mark.parametrize("rank", [1, 2, 3, 8, 12])
@pytest.mark.parametrize("gap", [None, 1e-3, 1e-6, 1e-8, 0.0])
def test_nnls_is_optimal_for_nearly_equal_columns(solver, rank, gap):
    rng = np.random.default_rng(rank)
    basis = rng.random((40, rank))
    if gap is not None and rank > 1:
        basis[:, 1] = basis[:, 0] + gap * rng.random(40)
    if gap is not None and rank > 3:
        basis[:, 3] = basis[:, 2] + gap * rng.random(40)
    g, right = basis.T @ basis, (rng.random((400, 40)) * 2 - 0.6) @ basis
    x = solver(g, right)
    dual, size = x @ g - right, np.abs(right).max(axis=1, keepdims=True)
    assert (x >= 0).all() and (dual >= -1e-7 * size).all() and (np.abs(dual)[x > 1e-9 * np.broadcast_to(size, x.shape)]
                                                                  <= 1e-7 * np.broadcast_to(size, x.shape)[x > 1e-9 * np.broadcast_to(size, x.shape)]).all()


def rank_one(spark, shape):
    rows = [(i, j, k, float((i + 1) * (j + 2) * (k + 1))) for i in range(shape[0]) for j in range(shape[1]) for k in range(shape[2])]
    return TB.tensor(spark.createDataFrame(rows, "i bigint, j bigint, k bigint, v double"), ("i", "j", "k"))


def test_leading_vectors_of_a_rank_one_tensor(spark):
    t = rank_one(spark, (5, 4, 3))
    f = tucker.nvecs(t, 0, 3)
    assert f.rank == 3 and np.allclose(gram(f), np.eye(3), atol=1e-8)
    found = cp.cp_als(t, 3, init="nvecs", max_iter=4)
    assert found.fit > 0.999 and all(g.rank == 3 for g in found.model.factors)


def test_leading_vectors_of_a_long_mode(spark):
    rng = np.random.default_rng(4)
    dense = rng.random((400, 6)) @ np.diag([50, 20, 9, 4, 2, 1]) @ rng.random((6, 30))
    rows = [(int(i), int(c % 10), int(c // 10), float(dense[i, c])) for i in range(400) for c in range(30)]
    t = TB.tensor(spark.createDataFrame(rows, "i bigint, j bigint, k bigint, v double"), ("i", "j", "k"))
    f = tucker.nvecs(t, 0, 2)
    got = np.zeros((400, 2))
    for r in factor_matrix(f).collect():
        got[r["r"], r["c"]] = r["m"]
    want = np.linalg.svd(dense)[0][:, :2]
    assert np.allclose(np.abs(got.T @ want), np.eye(2), atol=1e-6)


def test_building_listings(spark):
    # The form of a list page.
    page = ('<div class="bdl_mic_nrjj">\n<b>x</b><a target="_blank" href=" /loupan/1.html ">Tower A </a></div>'
            '<div class="bdl_mic_nrjj"><a target="_blank" href="/loupan/2.html"> </a></div>'
            '<div class="bdl_mic_nrjj"><a target="_blank" href="/loupan/3.html">Tower C</a></div>')
    rows = listings.building_listings(spark.createDataFrame([(1, page), (2, "<p>none</p>")], "id int, html string"), "html")
    assert sorted((r["id"], r["url"], r["name"]) for r in rows.collect()) == [
        (1, "/loupan/1.html", "Tower A"), (1, "/loupan/3.html", "Tower C")]
