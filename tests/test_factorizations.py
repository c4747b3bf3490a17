"""Factorizations: planted models come back, errors fall, constraints hold, numpy agrees."""

import numpy as np
import pytest
from test_tensor_golden import array_of, dense, factor_array, matrix

from urbanflow.operators.tensor import algebra as A
from urbanflow.operators.tensor import cp, layout, nnls, ntf, qr, relational, tucker
from urbanflow.operators.tensor import table as TB

RNG = np.random.default_rng(7)
SHAPE, RANK = (8, 6, 5), 2
PLANTED = [RNG.random((n, RANK)) + 0.1 for n in SHAPE]
X = np.einsum("ir,jr,kr->ijk", *PLANTED)


@pytest.fixture(scope="module")
def x(spark):
    return dense(spark, X)


def full(model):
    return np.einsum("r,ir,jr,kr->ijk", model.weights, *[factor_array(A.all_rows(f)) for f in model.factors])


def rel(model):
    return np.linalg.norm(full(model) - X) / np.linalg.norm(X)


def start(shape, rank):
    return [np.array([[((r + 1) * (7919 + c * 1009) + (m + 1) * 104729 * (c + 1)) % 1009 + 1 for c in range(rank)]
                      for r in range(n)]) / 1010 for m, n in enumerate(shape)]


def test_cp_follows_numpy_and_recovers(x):
    found = cp.cp_als(x, RANK, max_iter=3)
    u, spec = start(SHAPE, RANK), ["ijk,jr,kr->ir", "ijk,ir,kr->jr", "ijk,ir,jr->kr"]
    for sweep in range(3):
        for m in range(3):
            others = [u[o] for o in range(3) if o != m]
            new = np.einsum(spec[m], X, *others) @ np.linalg.pinv((others[0].T @ others[0]) * (others[1].T @ others[1]))
            size = np.sqrt((new ** 2).sum(0)) if sweep == 0 else np.maximum(new.max(0), 1)
            u[m] = new / size
    for f, want in zip(found.model.factors, u):
        assert np.allclose(factor_array(f), want, atol=1e-8)
    assert found.fit == pytest.approx(1 - rel(found.model) ** 2, abs=1e-8)
    assert found.fit > 0.99


def test_nnls_solvers_meet_the_optimality_conditions():
    for rank in (1, 2, 5, 8):
        a = RNG.standard_normal((20, rank))
        gram, right = a.T @ a, RNG.standard_normal((300, rank)) * 5
        for solver in (nnls.block_pivoting, nnls.active_set):
            for first in (None, np.abs(RNG.standard_normal((300, rank))) * (RNG.random((300, rank)) > 0.5)):
                u = solver(gram, right, first)
                dual = u @ gram - right
                assert (u >= 0).all() and (dual >= -1e-8).all() and np.abs(u * dual).max() < 1e-8


@pytest.mark.parametrize("method", ["anls_bpp", "anls_asgroup"])
def test_ntf(x, method):
    found = ntf.ntf(x, RANK, method=method, min_iter=2, max_iter=4)
    assert found.rel_error == pytest.approx(rel(found.model), abs=1e-6) and found.rel_error < 0.05
    assert all((factor_array(f) >= 0).all() for f in found.model.factors)
    assert found.criterion is not None and found.criterion < 0.2
    with pytest.raises(ValueError):
        ntf.ntf(x, RANK, method="other", max_iter=1)


@pytest.mark.parametrize("beta", [2, 1, 0, 1.5])
def test_beta_ntf_follows_numpy(x, beta):
    fixed = (1,) if beta == 2 else ()
    found = ntf.beta_ntf(x, RANK, beta=beta, n_iter=2, fixed_factors=fixed)
    u, spec = start(SHAPE, RANK), ["ijk,jr,kr->ir", "ijk,ir,kr->jr", "ijk,ir,jr->kr"]
    for _ in range(2):
        for m in range(3):
            if m in fixed:
                continue
            model = np.einsum("ir,jr,kr->ijk", *u)
            others = [u[o] for o in range(3) if o != m]
            u[m] = u[m] * (1e-15 + np.einsum(spec[m], X * model ** (beta - 2.0), *others)) / (
                1e-15 + np.einsum(spec[m], model ** (beta - 1.0), *others))
    for f, want in zip(found.model.factors, u):
        assert np.allclose(factor_array(f), want, atol=1e-9)


def test_beta_ntf_weights_and_score(spark, x):
    w = (RNG.random(SHAPE) > 0.2).astype(float)
    found = ntf.beta_ntf(x, RANK, beta=2, n_iter=1, weights=dense(spark, w))
    u, spec = start(SHAPE, RANK), ["ijk,jr,kr->ir", "ijk,ir,kr->jr", "ijk,ir,jr->kr"]
    for m in range(3):
        model = np.einsum("ir,jr,kr->ijk", *u)
        others = [u[o] for o in range(3) if o != m]
        u[m] = u[m] * np.einsum(spec[m], X * w, *others) / np.einsum(spec[m], model * w, *others)
    for f, want in zip(found.model.factors, u):
        assert np.allclose(factor_array(f), want, atol=1e-9)
    assert ntf.beta_score(x, found.model, 2) == pytest.approx(((X - full(found.model)) ** 2).sum() / 2)


def test_errors_need_no_zero_cells(spark):
    """Sums over all cells from the non-zeros, norms and column sums, against dense arrays; the plan builds no cell."""
    rng = np.random.default_rng(9)
    y = rng.integers(1, 9, SHAPE) * (rng.random(SHAPE) < 0.3)
    u, weights = [rng.random((n, RANK)) for n in SHAPE], np.array([2.0, 0.5])
    t = TB.nonzeros(dense(spark, y.astype(float)))
    model = A.Kruskal([A.factor_from_array(spark, f) for f in u], weights)
    m = np.einsum("r,ir,jr,kr->ijk", weights, *u)
    frame = A.errors(model, t)
    row = frame.first()
    assert row.rel_frobenius == pytest.approx(np.linalg.norm(y - m) / np.linalg.norm(y), rel=1e-10)
    assert row.rel_abs == pytest.approx(np.abs(y - m).sum() / y.sum(), rel=1e-10)
    assert "Range" not in frame._jdf.queryExecution().optimizedPlan().toString()
    kl = np.where(y > 0, y * (np.log(np.where(y > 0, y, 1)) - np.log(m)) + m - y, m).sum()
    assert A.divergence(model, t, 1) == pytest.approx(kl, rel=1e-10)
    assert A.divergence(model, t, 2) == pytest.approx(((y - m) ** 2).sum() / 2, rel=1e-10)
    assert A.divergence(model, t, 0) == float("inf")
    full = y + 1.0
    assert A.divergence(model, dense(spark, full), 0) == pytest.approx((full / m - np.log(full / m) - 1).sum(), rel=1e-10)
    signed = A.Kruskal([A.factor_from_array(spark, f - 0.5) for f in u], weights)
    row = A.errors(signed, t).first()
    gap = y - np.einsum("r,ir,jr,kr->ijk", weights, *[f - 0.5 for f in u])
    assert row.rel_abs is None and row.rel_frobenius == pytest.approx(np.linalg.norm(gap) / np.linalg.norm(y), rel=1e-10)
    with pytest.raises(ValueError):
        A.divergence(model, t, 1.5)
    score = (y ** 1.5 + 0.5 * m ** 1.5 - 1.5 * y * m ** 0.5).sum() / 0.75
    assert ntf.beta_score(t, model, 1.5) == pytest.approx(score, rel=1e-10)


def test_nvecs(x):
    for mode in range(3):
        unfolded = np.moveaxis(X, mode, 0).reshape(SHAPE[mode], -1)
        left = np.linalg.svd(unfolded)[0][:, :2]
        left = left * np.where(left[np.abs(left).argmax(0), range(2)] < 0, -1, 1)
        assert np.allclose(factor_array(tucker.nvecs(x, mode, 2)), left, atol=1e-7)


def test_nvecs_long_mode(spark):
    a = np.linalg.qr(RNG.standard_normal((50, 4)))[0] * [9, 6, 3, 0.1]
    y = np.einsum("ir,jr->ij", a, RNG.standard_normal((7, 4)))[:, :, None] + 0.01 * RNG.standard_normal((50, 7, 2))
    left = np.linalg.svd(y.reshape(50, -1))[0][:, :2]
    got = factor_array(tucker.nvecs(dense(spark, y), 0, 2))
    assert np.allclose(np.abs(left.T @ got), np.eye(2), atol=1e-6)


def test_hosvd_and_hooi_agree_with_numpy_on_a_longer_tensor(spark, monkeypatch):
    """40 x 40 x 30, sparse: vectors, residual and core against dense decompositions."""
    rng = np.random.default_rng(11)
    shape = (40, 40, 30)
    # Six strong components; fewer directions of oversampling leave several rounds to do.
    y = np.einsum("ir,jr,kr->ijk", *[np.linalg.qr(rng.standard_normal((n, 6)))[0] * [9, 7, 5, 4, 3, 2] for n in shape])
    y = (y + 0.01 * rng.standard_normal(shape)) * (np.abs(y) > 0.02)
    monkeypatch.setattr(tucker, "OVERSAMPLE", 8)
    t = TB.nonzeros(dense(spark, y))
    left = []
    for mode in range(3):
        u, s, _ = np.linalg.svd(np.moveaxis(y, mode, 0).reshape(shape[mode], -1), full_matrices=False)
        found = tucker.leading_vectors(t, mode, 2)
        got = factor_array(found.factor)
        assert found.residual <= 1e-11 and np.allclose(found.values, s[:2] ** 2, rtol=1e-10)
        assert np.allclose(np.abs(u[:, :2].T @ got), np.eye(2), atol=1e-8)
        left.append(u[:, :2])
    factors, core = tucker.hosvd(t, 2)
    want = np.einsum("ijk,ia,jb,kc->abc", y, *left)
    assert np.allclose(np.abs(array_of(core)), np.abs(want), atol=1e-7)
    for f, u in zip(factors.values(), left):
        assert np.allclose(np.abs(u.T @ factor_array(f)), np.eye(2), atol=1e-8)

    u, fit = [None, *[np.array(start(shape, 2)[m]) for m in (1, 2)]], 0.0
    for sweep in range(500):
        before = fit
        for mode in range(3):
            others = [u[m] for m in range(3) if m != mode]
            w = np.einsum(["ijk,jb,kc->ibc", "ijk,ib,kc->jbc", "ijk,ib,jc->kbc"][mode], y, *others).reshape(shape[mode], -1)
            u[mode] = np.linalg.svd(w, full_matrices=False)[0][:, :2]
        fit = 1 - np.sqrt(max((y ** 2).sum() - ((u[2].T @ w) ** 2).sum(), 0)) / np.linalg.norm(y)
        if sweep > 1 and abs(fit - before) < 1e-3:
            break
    found = tucker.hooi(t, 2, init="random", conv=1e-3)
    assert found.iterations == sweep + 1 and found.fit == pytest.approx(fit, abs=1e-10)
    for f, want in zip(found.factors, u):
        assert np.allclose(np.abs(want.T @ factor_array(f)), np.eye(2), atol=1e-6)


def test_projections_of_many_columns_are_summed_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    y = rng.standard_normal((9, 8, 7))
    u = [rng.standard_normal((n, 3)) for n in (9, 8, 7)]
    monkeypatch.setattr(tucker, "COLUMNS_AT_ONCE", 4)
    with layout.ModeCopies(dense(spark, y), 3) as copies:
        got = factor_array(tucker.projected(copies, [A.factor_from_array(spark, x) for x in u], 1))
    assert np.allclose(got, np.einsum("ijk,ib,kc->jbc", y, u[0], u[2]).reshape(8, -1))


def test_tree_qr_keeps_small_directions(spark):
    """Columns of sizes 1 to 1e-10: a Gram matrix would lose the smallest."""
    rng = np.random.default_rng(4)
    a = np.linalg.qr(rng.standard_normal((60, 4)))[0] * [1, 1e-3, 1e-7, 1e-10]
    f = A.factor_from_array(spark, a)
    f = A.Factor(f.df.repartition(5), f.rows, f.rank)
    assert np.allclose(np.linalg.svd(qr.tall_r(f))[1], [1, 1e-3, 1e-7, 1e-10], rtol=1e-4)
    assert np.allclose(factor_array(qr.orthonormal(f)).T @ factor_array(qr.orthonormal(f)), np.eye(4), atol=1e-5)
    empty = A.Factor(f.df.where("idx < 0"), 0, 4)
    assert qr.whitener(qr.tall_r(empty)).shape == (4, 0)


def test_tucker_recovers_a_planted_core(spark):
    shape, ranks = (7, 8, 9), (2, 3, 2)
    factors = [np.linalg.qr(RNG.standard_normal((n, r)))[0] for n, r in zip(shape, ranks)]
    y = np.einsum("abc,ia,jb,kc->ijk", RNG.standard_normal(ranks), *factors)
    found = tucker.hooi(dense(spark, y), ranks, max_iter=3)
    got = np.einsum("abc,ia,jb,kc->ijk", found.core, *[factor_array(f) for f in found.factors])
    assert np.linalg.norm(got - y) / np.linalg.norm(y) < 1e-6 and found.fit > 1 - 1e-6
    kept, core = tucker.hosvd(dense(spark, y), ranks)
    got = np.einsum("abc,ia,jb,kc->ijk", array_of(core), *[factor_array(kept[m]) for m in range(3)])
    assert np.linalg.norm(got - y) / np.linalg.norm(y) < 1e-6
    assert set(tucker.hosvd(dense(spark, y), ranks, dims=[1], compute_core=False)) == {1}


def test_tucker_with_many_components(spark, monkeypatch):
    """Projections summed in parts give the same model as those summed at once."""
    y = RNG.random((6, 5, 4))
    wide = tucker.hooi(dense(spark, y), (2, 2, 2), max_iter=2)
    monkeypatch.setattr(tucker, "COLUMNS_AT_ONCE", 1)
    long = tucker.hooi(dense(spark, y), (2, 2, 2), max_iter=2)
    assert long.fit == pytest.approx(wide.fit, abs=1e-8) and np.allclose(long.core, wide.core, atol=1e-6)
    for a, b in zip(wide.factors, long.factors):
        assert np.allclose(factor_array(a), factor_array(b), atol=1e-6)


def test_masked_tucker_loss_falls(spark):
    t = dense(spark, np.fromfunction(lambda i, j, k: 1 + i + 3 * j + 12 * k, (3, 4, 2)))
    found, losses = tucker.masked_tucker(t, 2, steps=6, alpha=1e-3)
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0]
    got = np.einsum("abc,ia,jb,kc->ijk", found.core, *[factor_array(f) for f in found.factors])
    want = array_of(t)
    assert found.fit == pytest.approx(((want - got) ** 2 * (want > 10)).sum(), rel=1e-6)


N, K = 9, 3
A0 = RNG.random((N, RANK)) + 0.1


def edges_of(spark, slices):
    return spark.createDataFrame([(k, s, o, float(slices[k, s, o])) for k in range(len(slices)) for s in range(N) for o in range(N)
                                  if slices[k, s, o] != 0], "k int, s bigint, o bigint, v double")


def test_rescal(spark):
    middle = RNG.standard_normal((K, RANK, RANK))
    y = np.array([A0 @ m @ A0.T for m in middle])
    for options in ({"init": "nvecs"}, {"init": "random"}, {"init": "random", "orthogonalize": True}):
        found = relational.rescal(edges_of(spark, y), N, K, RANK, max_iter=6, conv=1e-12, **options)
        a = factor_array(found.a)
        got = np.array([a @ m.reshape(RANK, RANK) @ a.T for m in factor_array(found.r)])
        assert np.linalg.norm(got - y) / np.linalg.norm(y) < 1e-4
        assert abs(found.fit) < 1e-6


def test_rescal_small_example_and_attributes(spark):
    cells = [(0, 2, 0), (0, 1, 2), (0, 3, 3), (1, 0, 0), (1, 2, 1), (1, 3, 2), (1, 3, 3)]
    edges = spark.createDataFrame([(*c, 1.0) for c in cells], "k int, s bigint, o bigint, v double")
    plain = relational.rescal(edges, 4, 2, 2, init="random", max_iter=8)
    assert plain.history[-1] <= plain.history[0] + 1e-9
    p = RNG.random((4, 3))
    attr = spark.createDataFrame([(0, e, a, float(p[e, a])) for e in range(4) for a in range(3)], "l int, e bigint, a int, w double")
    found = relational.rescal(edges, 4, 2, 2, init="random", max_iter=3, attributes=attr, lambda_a=0.1, lambda_r=0.1, lambda_v=0.1)
    a = factor_array(found.a)
    want = np.linalg.solve(a.T @ a + 0.1 * np.eye(2), a.T @ p)
    got = np.array([[r.z0, r.z1] for r in found.attributes.orderBy("a").collect()]).T
    assert np.allclose(got, want, atol=1e-8)


def test_dedicom(spark):
    d, r = RNG.random((K, RANK)) + 0.3, RNG.random((RANK, RANK))
    y = np.array([A0 @ np.diag(x) @ r @ np.diag(x) @ A0.T for x in d])
    found = relational.dedicom(edges_of(spark, y), N, K, RANK, max_iter=4)
    a = factor_array(found.a)
    got = np.array([a @ np.diag(x) @ found.r @ np.diag(x) @ a.T for x in factor_array(found.d)])
    assert found.fit == pytest.approx(1 - 0.5 * ((got - y) ** 2).sum() / (y ** 2).sum(), abs=1e-8)
    assert found.fit > 0.99
    bounded = relational.dedicom(edges_of(spark, y), N, K, RANK, init="random", max_iter=3, nne=1e-8)
    assert (factor_array(bounded.a) >= 0).all() and (factor_array(bounded.d) >= 0).all() and bounded.history[-1] >= bounded.history[0]


def test_indscal(spark):
    q = np.linalg.qr(RNG.standard_normal((N, RANK)))[0]
    d = RNG.random((K, RANK)) + 0.3
    y = np.array([q @ np.diag(x) @ q.T for x in d])
    found = relational.indscal(edges_of(spark, y), N, K, RANK, max_iter=8)
    a = factor_array(found.a)
    assert np.allclose(a.T @ a, np.eye(RANK), atol=1e-8) and found.fit > 0.9
    got = np.array([a @ np.diag(x) @ a.T for x in factor_array(found.d)])
    assert found.fit == pytest.approx(1 - ((got - y) ** 2).sum() / (y ** 2).sum(), abs=1e-8)


def test_holdout_keeps_whole_cells(x):
    kept = TB.holdout(x, 0.5)
    assert 0 < kept.df.count() < x.df.count()
    assert TB.holdout(x, 1.0).df.count() == x.df.count()


def test_gradient_of_a_perfect_model_is_zero(spark, x):
    factors = [A.factor_from_array(spark, p) for p in PLANTED]
    assert ntf.gradient_norm(x, factors, [A.gram(f) for f in factors], False) < 1e-9
    assert matrix(spark, np.eye(2)).count() == 4


def test_a_hundred_thousand_relations(spark):
    """What is kept for a relation never reaches the driver; one relation holds a third of all edges."""
    relations, n = 100_000, 12
    many = spark.range(3 * relations).selectExpr("id % 100000 as k", "pmod(hash(id), 12) as s", "pmod(hash(id, 1), 12) as o",
                                                 "cast(1 + id % 5 as double) as v")
    hot = spark.range(100_000).selectExpr("cast(7 as bigint) as k", "pmod(hash(id), 12) as s", "pmod(hash(id, 2), 12) as o",
                                          "0.01D as v")
    edges = many.union(hot)
    rows = edges.toPandas()
    x = np.zeros((relations, n, n))
    np.add.at(x, (rows.k, rows.s, rows.o), rows.v)
    a = start((n,), RANK)[0]
    # Repeated cells add up in the model's products; the norm of a slice is that of its rows.
    norms = np.bincount(rows.k, rows.v ** 2, relations)

    def middle(a):
        inverse = np.linalg.inv(a.T @ a)
        products = np.einsum("ia,kij,jb->kab", a, x, a, optimize=True)
        return inverse @ products @ inverse, products

    r, _ = middle(a)
    for _ in range(2):
        g, rt = a.T @ a, r.transpose(0, 2, 1)
        f = np.einsum("kij,jb,kab->ia", x, a, r, optimize=True) + np.einsum("kji,jb,kba->ia", x, a, r, optimize=True)
        a = f @ np.linalg.inv((r @ g @ rt + rt @ g @ r).sum(axis=0))
        r, products = middle(a)
    g = a.T @ a
    fit = ((norms - 2 * (r * products).sum(axis=(1, 2)) + np.einsum("kij,ia,kab,bj->k", r, g, r, g, optimize=True)) / norms).sum()
    found = relational.rescal(edges, n, relations, RANK, init="random", max_iter=2, conv=0.0)
    assert np.allclose(factor_array(found.a), a, rtol=1e-6) and found.fit == pytest.approx(fit, rel=1e-8)
    assert np.allclose(factor_array(found.r).reshape(-1, RANK, RANK), r, atol=1e-6)
    assert found.r.df.count() == relations


def test_dedicom_weights_settle_for_every_slice(spark):
    """Two slices of the same matrix have the same weights, and a fit by the default rule ends by itself."""
    d, r = RNG.random((K, RANK)) + 0.3, RNG.random((RANK, RANK))
    d[1] = d[0]
    y = np.array([A0 @ np.diag(x) @ r @ np.diag(x) @ A0.T for x in d])
    found = relational.dedicom(edges_of(spark, y), N, K, RANK)
    kept = factor_array(found.d)
    assert np.allclose(kept[0], kept[1], atol=1e-6) and found.iterations < 500
    assert abs(found.history[-1] - found.history[-2]) < 1e-5
