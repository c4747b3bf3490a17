"""Small golden numbers for tensor tables and algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanflow.operators.tensor import algebra as A
from urbanflow.operators.tensor import table as TB
from urbanflow.sources import writers


def dense(spark, array):
    rows = [(*map(int, at), float(array[at])) for at in np.ndindex(*array.shape)]
    names = "ijklm"[:array.ndim]
    schema = ", ".join([f"{c} bigint" for c in names]) + ", v double"
    return TB.tensor(spark.createDataFrame(rows, schema), names, array.shape)


def sparse(spark, subs, values, shape=None, **options):
    names = "ijklm"[:len(subs)]
    rows = [(*map(int, at), float(v)) for *at, v in zip(*subs, values)]
    schema = ", ".join([f"{c} bigint" for c in names]) + ", v double"
    return TB.tensor(spark.createDataFrame(rows, schema), names, shape, **options)


def array_of(t):
    out = np.zeros(t.shape)
    for r in t.df.collect():
        out[tuple(int(r[m]) for m in t.modes)] += r["v"]
    return out


def matrix_of(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"], r["col"]] = r["v"]
    return out


def factor_array(f):
    out = np.zeros((f.rows, f.rank))
    for r in f.df.collect():
        out[r["idx"]] = [r[c] for c in f.columns]
    return out


T = np.fromfunction(lambda i, j, k: 1 + i + 3 * j + 12 * k, (3, 4, 2))
U = np.array([[1.0, 3, 5], [2, 4, 6]])


@pytest.fixture(scope="module")
def t(spark):
    return dense(spark, T)


def matrix(spark, array):
    rows = [(r, c, float(array[r, c])) for r in range(array.shape[0]) for c in range(array.shape[1])]
    return spark.createDataFrame(rows, "r bigint, c bigint, m double")


def test_ttm(spark, t):
    y = array_of(A.ttm(t, matrix(spark, U), 2, 0))
    assert y[:, :, 0].tolist() == [[22, 49, 76, 103], [28, 64, 100, 136]]
    assert y[:, :, 1].tolist() == [[130, 157, 184, 211], [172, 208, 244, 280]]
    again = array_of(A.ttm(t, matrix(spark, U.T), 2, 0, transp=True))
    assert np.array_equal(y, again)


def test_ttv(spark, t):
    v = spark.createDataFrame([(n, n + 1.0) for n in range(4)], "idx bigint, w double")
    rows = {(r.i, r.k): r.v for r in A.ttv(t, {1: v}).collect()}
    assert rows == {(0, 0): 70, (0, 1): 190, (1, 0): 80, (1, 1): 200, (2, 0): 90, (2, 1): 210}
    zero = spark.createDataFrame([(n, 0.0) for n in range(4)], "idx bigint, w double")
    assert A.ttv(t, {0: zero, 1: zero}).isEmpty()


def test_unfold_layout_and_fold(t):
    for mode in range(3):
        rest = sorted([m for m in range(3) if m != mode], reverse=True)
        want = T.transpose([mode, *rest]).reshape(T.shape[mode], -1)
        u = TB.unfold(t, mode)
        assert np.array_equal(matrix_of(u.df, want.shape), want)
        assert np.array_equal(array_of(TB.fold(u)), T)
    assert matrix_of(TB.unfold(t, 1).df, (4, 6))[0].tolist() == [1, 2, 3, 13, 14, 15]
    turned = TB.unfold(t, [1], transp=True)
    assert np.array_equal(matrix_of(turned.df, (6, 4)), matrix_of(TB.unfold(t, 1).df, (4, 6)).T)
    with pytest.raises(ValueError):
        TB.unfold(t, [0, 1], [1])


def test_fold_round_trip_four_modes(spark):
    rng = np.random.default_rng(3)
    x = rng.random((4, 5, 3, 2))
    t4 = dense(spark, x)
    for mode in range(4):
        assert np.allclose(array_of(TB.fold(TB.unfold(t4, mode))), x)
    assert np.allclose(array_of(TB.fold(TB.unfold(t4, [2, 0], [3, 1]))), x)


def test_sparse_five_modes_equal_dense_unfolding(spark):
    shape, n = (25, 11, 18, 7, 2), 100
    subs = [[(n * 7 + s * (m + 3) * 13) % size for s in range(n)] for m, size in enumerate(shape)]
    values = [(s * 37) % 100 for s in range(n)]
    rows = [(*[int(subs[m][s]) for m in range(5)], s, float(values[s])) for s in range(n)]
    df = spark.createDataFrame(rows, "i bigint, j bigint, k bigint, l bigint, m bigint, seq int, v double")
    t5 = TB.tensor(df, "ijklm", shape, accumulate="last", order_by="seq")
    x = np.zeros(shape)
    for *at, _, v in rows:
        x[tuple(at)] = v
    for mode in range(5):
        rest = sorted([d for d in range(5) if d != mode], reverse=True)
        want = x.transpose([mode, *rest]).reshape(shape[mode], -1)
        assert np.array_equal(matrix_of(TB.unfold(t5, mode).df, want.shape), want)


def test_sparse_construction(spark):
    s = sparse(spark, [[0, 1, 0, 5, 7, 8], [2, 0, 4, 5, 3, 9], [0, 1, 2, 2, 1, 0]], [1, 2, 3, 4, 5, 6.1])
    assert s.shape == (9, 10, 3)
    d = TB.identity(spark, 20, 3)
    assert TB.tensor(d.df, "ijk").shape == d.shape == (20, 20, 20)
    with pytest.raises(ValueError):
        TB.tensor(spark.createDataFrame([(0.5, 1, 1.0)], "i double, j int, v double"), "ij")
    with pytest.raises(ValueError):
        TB.tensor(spark.createDataFrame([(1, 1, 1.0)], "i int, j int, v double"), "ij", (2,))


def test_point_reads(spark):
    s = sparse(spark, [[0, 1, 0, 5, 7, 8], [2, 0, 4, 5, 3, 9], [0, 1, 2, 2, 1, 0]], [1, 2, 3, 4, 5, 6], (10, 10, 3))
    points = {(1, 1, 1): 0, (0, 2, 0): 1, (1, 0, 1): 2, (0, 4, 2): 3, (5, 5, 2): 4, (7, 3, 1): 5, (8, 9, 0): 6}
    assert TB.read_point(s, (1, 1, 1)) == 0 and TB.read_point(s, (5, 5, 2)) == 4
    asked = spark.createDataFrame(list(points), "i bigint, j bigint, k bigint")
    assert {(r.i, r.j, r.k): r.v for r in TB.read_points(s, asked).collect()} == points


def test_sparse_minus_dense(spark):
    a = sparse(spark, [[0, 1, 0], [2, 1, 0], [0, 1, 2]], [1, 2, 3], (3, 3, 3))
    b = np.arange(27.0).reshape(3, 3, 3)
    want = -b
    want[0, 2, 0] += 1
    want[1, 1, 1] += 2
    want[0, 0, 2] += 3
    assert np.array_equal(array_of(A.subtract(a, dense(spark, b))), want)


def test_khatri_rao(spark):
    a = np.arange(1.0, 10).reshape(3, 3)
    got = A.khatri_rao([A.factor_from_array(spark, a), A.factor_from_array(spark, a.T)])
    assert factor_array(got).tolist() == [[1, 8, 21], [2, 10, 24], [3, 12, 27], [4, 20, 42], [8, 25, 48], [12, 30, 54],
                                          [7, 32, 63], [14, 40, 72], [21, 48, 81]]
    turned = A.khatri_rao([A.factor_from_array(spark, a.T), A.factor_from_array(spark, a)], reverse=True)
    assert np.array_equal(factor_array(turned), factor_array(got))
    with pytest.raises(ValueError):
        A.khatri_rao([A.factor_from_array(spark, a), A.factor_from_array(spark, a[:, :2])])


def test_accumulate(spark):
    rows = spark.createDataFrame([(0, 0, 1), (1, 1, 2), (1, 1, 3), (2, 1, 4), (2, 2, 5), (2, 2, 6)], "i int, j int, v int")
    got = {(r.i, r.j): r.v for r in TB.accum(rows, ("i", "j")).collect()}
    assert got == {(0, 0): 1, (1, 1): 5, (2, 1): 4, (2, 2): 11}
    assert {(r.i, r.j): r.v for r in TB.accum(rows, ("i", "j"), "max").collect()}[(2, 2)] == 6


def test_norm_inner_transpose_concat_equal(spark, t):
    assert A.norm(t) == pytest.approx(np.linalg.norm(T))
    assert A.innerprod(t, t).first().v == (T * T).sum()
    assert np.array_equal(array_of(TB.transpose(t, (2, 0, 1))), T.transpose(2, 0, 1))
    assert np.array_equal(array_of(TB.concatenate([t, t], 1)), np.concatenate([T, T], 1))
    with pytest.raises(ValueError):
        TB.concatenate([t, TB.transpose(t, (1, 0, 2))], 2)
    assert TB.equal(t, t) and not TB.equal(t, t.with_df(t.df.filter("v > 1")))


def test_center_scale(spark):
    x = np.array([[[1.0, 0], [2, 0]], [[3, 0], [0, 4]], [[0, 0], [0, 0]]])
    s = TB.nonzeros(dense(spark, x))
    for mode in range(3):
        assert np.allclose(array_of(A.center(s, mode)), x - x.mean(axis=mode, keepdims=True))
        size = np.sqrt((x ** 2).sum(axis=tuple(m for m in range(3) if m != mode), keepdims=True))
        assert np.allclose(array_of(A.scale(s, mode)), x / np.where(size == 0, 1, size))
    m = np.array([[1.0, 2], [3, 4]])
    got = {(r.r, r.c): r.m for r in A.center_matrix(matrix(spark, m), 2).collect()}
    assert got == {(0, 0): -1, (0, 1): -1, (1, 0): 1, (1, 1): 1}


def test_commutation_and_unravel(spark):
    m, n = 3, 4
    a = np.arange(12).reshape(m, n)
    p = np.zeros((12, 12))
    for r in TB.commutation(spark, m, n).collect():
        p[r.row, r.col] = 1
    assert np.array_equal(p @ a.ravel(), a.T.ravel())
    got = spark.range(24).select("id", *[c.alias(f"s{k}") for k, c in enumerate(TB.unravel(F.col("id"), (3, 4, 2)))]).collect()
    assert all((r.s0, r.s1, r.s2) == tuple(np.unravel_index(r.id, (3, 4, 2), order="F")) for r in got)


def test_mttkrp_and_kruskal(spark, t):
    rng = np.random.default_rng(1)
    arrays = [rng.standard_normal((n, 3)) for n in T.shape]
    factors = [A.factor_from_array(spark, x) for x in arrays]
    subs = ["ijk,jr,kr->ir", "ijk,ir,kr->jr", "ijk,ir,jr->kr"]
    for mode in range(3):
        others = [arrays[m] for m in range(3) if m != mode]
        assert np.allclose(factor_array(A.mttkrp(t, factors, mode)), np.einsum(subs[mode], T, *others))
    weights = np.array([1.0, -2.0, 0.5])
    full = np.einsum("r,ir,jr,kr->ijk", weights, *arrays)
    model = A.Kruskal(factors, weights)
    assert model.norm() == pytest.approx(np.linalg.norm(full))
    assert A.kruskal_innerprod(model, t) == pytest.approx((full * T).sum())
    cells = {(r.i, r.j, r.k): r.model for r in A.kruskal_cells(model, t).collect()}
    assert all(cells[at] == pytest.approx(full[at]) for at in np.ndindex(*T.shape))
    other = [A.factor_from_array(spark, rng.standard_normal((n, 2))) for n in T.shape]
    want = np.einsum("ijk,ir,kr->jr", full, factor_array(other[0]), factor_array(other[2]))
    assert np.allclose(factor_array(A.kruskal_mttkrp(model, other, 1)), want)
    parts = A.component_cells(model, t).groupBy("i", "j", "k").agg(F.sum("part").alias("s")).collect()
    assert all(r.s == pytest.approx(full[r.i, r.j, r.k]) for r in parts)
    core = rng.standard_normal((3, 3, 3))
    tucker = np.einsum("abc,ia,jb,kc->ijk", core, *arrays)
    cells = {(r.i, r.j, r.k): r.model for r in A.tucker_cells(core, factors, t).collect()}
    assert all(cells[at] == pytest.approx(tucker[at]) for at in np.ndindex(*T.shape))


def test_pack_unpack(spark):
    shape, rank = (5, 27, 3, 13), 5
    factors = [A.start_factor(spark, m, n, rank) for m, n in enumerate(shape)]
    vector = A.pack(factors)
    assert vector.count() == 240 and vector.agg(F.max("pos")).first()[0] == 239
    for f, g in zip(factors, A.unpack(vector, shape, rank)):
        assert np.array_equal(factor_array(f), factor_array(g))


def test_zero_factors_and_shapes(spark):
    shape = (25, 11, 18, 7, 2)
    t5 = sparse(spark, [[3, 4], [1, 2], [5, 6], [0, 1], [0, 1]], [1, 2], shape)
    zero = [A.factor_from_array(spark, np.zeros((n, 5))) for n in shape]
    assert factor_array(A.all_rows(A.mttkrp(t5, zero, 0))).shape == (25, 5)


def test_histogram_and_index(spark):
    x = np.zeros((4, 5, 2))
    x[0, 0, 0], x[1, 2, 1], x[3, 4, 1] = 10, 2.5, 9.99
    h = {r.bin: r.cnt for r in TB.histogram(TB.nonzeros(dense(spark, x)), 10).collect()}
    assert h == {b: c for b, c in enumerate(np.histogram(x, bins=10)[0]) if c}
    names = [f"n{n:03d}" for n in range(500)]
    rows = spark.createDataFrame([(n,) for n in names[::-1] * 2], "name string")
    assert {r.name: r.idx for r in TB.dense_index(rows).collect()} == {n: i for i, n in enumerate(names)}


def test_json_lines(spark, t):
    lines = writers.tensor_lines(t.df)
    assert [r.json for r in lines.filter("i = 0").orderBy("j").collect()] == ["[1.0,13.0]", "[4.0,16.0]", "[7.0,19.0]", "[10.0,22.0]"]
    back = writers.read_tensor_lines(lines)
    assert back.count() == 24 and back.filter("i = 2 and j = 3 and k = 1").first().v == 24


def test_flipsign(spark):
    x = np.array([[1.0, -5], [-3, 2]])
    assert factor_array(A.flipsign(A.factor_from_array(spark, x))).tolist() == [[-1, 5], [3, -2]]
