"""Copies of the non-zeros by mode: the same sums by both ways, and no exchange of the non-zeros."""

import numpy as np
import pyarrow as pa
import pytest
from test_tensor_golden import array_of, factor_array

from urbanflow.operators.tensor import algebra as A
from urbanflow.operators.tensor import cp, layout, nnls, ntf, packed
from urbanflow.operators.tensor.table import Tensor

SHAPE = (40, 30, 6)


@pytest.fixture(scope="module")
def sparse(spark):
    """A third of the non-zeros share one index of each mode."""
    rng = np.random.default_rng(3)
    cells = {}
    for n in range(900):
        at = [int(rng.integers(s)) for s in SHAPE]
        if n % 3 == 0:
            at[n // 3 % 3] = 1
        cells[tuple(at)] = float(rng.integers(1, 9))
    rows = [(*at, v) for at, v in cells.items()]
    return Tensor(spark.createDataFrame(rows, "i bigint, j bigint, k bigint, v double").repartition(3), ("i", "j", "k"), SHAPE)


def numpy_mttkrp(x, u, mode):
    spec = ["ijk,jr,kr->ir", "ijk,ir,kr->jr", "ijk,ir,jr->kr"][mode]
    return np.einsum(spec, x, *[u[m] for m in range(3) if m != mode])


def starts(spark, rank=2):
    return [A.start_factor(spark, m, n, rank) for m, n in enumerate(SHAPE)]


@pytest.mark.parametrize("routed", [False, True])
def test_sums_follow_numpy_and_nonzeros_stay(spark, sparse, routed, monkeypatch):
    if routed:
        monkeypatch.setattr(A, "BROADCAST_BYTES", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x, factors = array_of(sparse), starts(spark)
        u = [factor_array(f) for f in factors]
        with layout.ModeCopies(sparse, 4) as copies:
            assert [c.count() for c in copies.copies] == [sparse.df.count()] * 3
            for mode in range(3):
                found = copies.mttkrp(factors, mode)
                assert np.allclose(factor_array(A.all_rows(found)), numpy_mttkrp(x, u, mode))
                found.df.collect()
                plan = found.df._jdf.queryExecution().executedPlan().toString()
                final = plan.split("== Initial Plan ==")[0]
                # Exchanges carry sums per index, factor rows to the buckets that need them, or factor rows by index.
                moved = [line for line in final.splitlines() if "Exchange" in line and "Reused" not in line]
                allowed = ("hashpartitioning(idx", "hashpartitioning(bucket", f"hashpartitioning({sparse.modes[mode]}",
                           "BroadcastExchange")
                assert moved and all(any(a in line for a in allowed) for line in moved), moved
                at = final.index("Exchange hashpartitioning(bucket") if routed else None
                assert "SelectedBucketsCount: 4 out of 4" in plan
                for line in moved:
                    assert "v#" not in line
                assert at is None or routed
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_indices_are_spread(spark, sparse):
    with layout.ModeCopies(sparse, 4) as copies:
        for copy in copies.copies:
            sizes = [r["count"] for r in copy.groupBy("bucket").count().collect()]
            assert len(sizes) == 4 and max(sizes) < 0.45 * sum(sizes)


def test_tables_and_setting_go_after_use(spark, sparse):
    before = spark.conf.get(layout.CO_PARTITION, "true")
    tables = spark.catalog.listTables()
    with layout.ModeCopies(sparse, 4):
        assert spark.conf.get(layout.CO_PARTITION) == "false" and len(spark.catalog.listTables()) == len(tables) + 3
    assert spark.conf.get(layout.CO_PARTITION) == before and len(spark.catalog.listTables()) == len(tables)


def test_jobs_of_a_sweep(spark, sparse):
    """A half-sweep is one command: three writes a sweep, whatever the number of sweeps."""
    listener_count = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    counts = []
    for sweeps in (2, 4):
        before = listener_count()
        cp.cp_als(sparse, 2, max_iter=sweeps, conv=0.0)
        counts.append(listener_count() - before)
    assert counts[1] - counts[0] <= 2 * 3


def test_ntf_stops_by_each_rule(spark, sparse):
    for rule, tol in ((1, 5e-2), (2, 1e-3), (3, 0.0)):
        found = ntf.ntf(sparse, 2, tol=tol, stop_criterion=rule, min_iter=3, max_iter=60)
        assert 3 < found.iterations < 60, rule
        x = array_of(sparse)
        full = np.einsum("ir,jr,kr->ijk", *[factor_array(A.all_rows(f)) for f in found.model.factors])
        assert found.rel_error == pytest.approx(np.linalg.norm(x - full) / np.linalg.norm(x), abs=1e-9)


def test_beta_errors(spark, sparse):
    x = array_of(sparse)
    for beta in (2, 1):
        found = ntf.beta_ntf(sparse, 2, beta=beta, n_iter=3)
        full = np.einsum("ir,jr,kr->ijk", *[factor_array(A.all_rows(f)) for f in found.model.factors])
        assert found.rel_error == pytest.approx(np.linalg.norm(x - full) / np.linalg.norm(x), abs=1e-9)


def test_nonzeros_are_computed_once(spark, sparse):
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows.add(len(batch))
            yield batch
    counted = sparse.with_df(sparse.df.mapInPandas(seen, sparse.df.schema))
    with layout.ModeCopies(counted, 4) as copies:
        assert [c.count() for c in copies.copies] == [sparse.df.count()] * 3
    assert rows.value == sparse.df.count()


def test_one_copy_serves_all_modes_beside_a_long_mode(spark, sparse, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(layout, "BROADCAST_BYTES", 0)
    x, factors = array_of(sparse), starts(spark)
    u = [factor_array(f) for f in factors]
    tables = len(spark.catalog.listTables())
    with layout.ModeCopies(sparse, 4) as copies:
        assert copies.home == [0, 0, 0] and len(spark.catalog.listTables()) == tables + 1
        for mode in range(3):
            assert np.allclose(factor_array(A.all_rows(copies.mttkrp(factors, mode))), numpy_mttkrp(x, u, mode))
            rows = copies.joined(mode, factors, range(3))
            assert rows.count() == sparse.df.count()


def test_buckets_follow_the_cells():
    assert [layout.bucket_count(n, 200) for n in (0, 11_000, 600_000, 36_000_000, 216_000_000)] == [1, 1, 3, 48, 54]
    assert layout.bucket_count(10 ** 12, 200) == 200


def test_results_of_a_long_mode_are_not_broadcast(spark, sparse, monkeypatch):
    """Only factors of the other modes pass the driver, not a factor's own rows, sums or start values."""
    monkeypatch.setattr(A, "SIDE_ROWS", 8)
    factors = starts(spark)
    grams = [A.gram(f) for f in factors]
    right = A.Factor(spark.createDataFrame([(1, 2.0, 3.0)], "idx bigint, f0 double, f1 double"), SHAPE[0], 2)
    for df in (ntf._gradient(right, factors, grams, 0, True).df, A.all_rows(right).df,
               nnls.nnls_rows(right, grams[0], "anls_bpp", factors[0]).df):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in A.all_rows(A.Factor(right.df, SHAPE[2], 2)).df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("long", [False, True])
def test_packed_cells_follow_numpy(spark, sparse, long, monkeypatch):
    """Blocks of few cells, indices spread over blocks, and the longest mode's factor sent to every worker or to blocks."""
    if long:
        monkeypatch.setattr(A, "BROADCAST_BYTES", 800)
    x, factors = array_of(sparse), starts(spark)
    assert packed.can_pack(sparse, 2) and [f.is_small() for f in factors] == [not long, True, True]
    u = [factor_array(f) for f in factors]
    ratios = np.divide(x, np.einsum("ir,jr,kr->ijk", *u))
    tables = len(spark.catalog.listTables())
    with packed.PackedCells(sparse, 4, 50) as cells:
        assert cells.blocks > 4 and cells._large and len(spark.catalog.listTables()) == tables + 1
        assert cells.norm() == pytest.approx(np.linalg.norm(x))
        for mode in range(3):
            assert np.allclose(factor_array(A.all_rows(cells.mttkrp(factors, mode))), numpy_mttkrp(x, u, mode))
            sums = cells.sums(factors, mode, True, "f")
            assert np.allclose(factor_array(A.all_rows(A.Factor(sums, SHAPE[mode], 2))), numpy_mttkrp(ratios, u, mode))
            sums.collect()
            plan = sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert not any("Exchange" in line and ("at0" in line or " v#" in line) for line in plan.splitlines())
    assert len(spark.catalog.listTables()) == tables


def test_beta_1_reads_packed_cells(spark, sparse, monkeypatch):
    monkeypatch.setattr(ntf, "ModeCopies", None)
    found = ntf.beta_ntf(sparse, 2, beta=1, n_iter=2)
    monkeypatch.undo()
    monkeypatch.setattr(ntf, "can_pack", lambda *_: False)
    rows = ntf.beta_ntf(sparse, 2, beta=1, n_iter=2)
    assert found.rel_error == pytest.approx(rows.rel_error, abs=1e-12)
    for a, b in zip(found.model.factors, rows.model.factors):
        assert np.allclose(factor_array(a), factor_array(b), rtol=1e-12)


def test_packed_cells_without_a_factor_row_count_for_nothing(spark, sparse):
    factors = starts(spark)
    factors[1] = A.Factor(factors[1].df.where("idx != 1"), SHAPE[1], 2)
    x = array_of(sparse)
    x[:, 1] = 0
    u = [factor_array(f) for f in starts(spark)]
    with packed.PackedCells(sparse, 4, 50) as cells:
        assert np.allclose(factor_array(A.all_rows(cells.mttkrp(factors, 0))), numpy_mttkrp(x, u, 0))


@pytest.mark.parametrize("values", [[1.0, 255.0, 0.0], [0.5, 256.0, -2.0], [0.1, np.nan, 1e300]])
def test_packing_keeps_every_number(values):
    columns = {"block": [0, 0, 7], "i": [3, 3, 70_000], "j": [300, 0, 1], "v": values}
    rows = [b for b in packed.pack(iter([pa.RecordBatch.from_pydict(columns)]), 0, 2) for b in zip(*b.columns)]
    found = [packed.unpacked(row[1].as_py(), row[2:]) for row in rows]
    assert [row[0].as_py() for row in rows] == [0, 7]
    assert [i for ids, at, _ in found for i in ids[at[0]]] == columns["i"]
    assert [j for _, at, _ in found for j in at[1]] == columns["j"]
    assert np.array_equal(np.concatenate([v.astype(float) for _, _, v in found]), values, equal_nan=True)
