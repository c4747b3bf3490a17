"""Registered queries: tensor tables, tensor algebra and the kernels of the factorizations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from urbanflow.operators import od
from urbanflow.operators.tensor import algebra as A
from urbanflow.operators.tensor import build, ntf
from urbanflow.operators.tensor import table as TB
from urbanflow.plans import mobility
from urbanflow.plans import views as V
from urbanflow.plans.sweeps import LETTERS, _half_sweep
from urbanflow.session import checkpointed
from urbanflow.sources import writers

RANK = 2
#: Sweeps of the nonnegative model whose factors the pattern, feature and Kruskal queries read.
FIT_SWEEPS = 20


def od_tensor_of(spark, folder, day_type="workdays", counts=None):
    """The tensor of a day type and its index; a query that needs several gives the ``counts`` it has written."""
    var = od.variability(V.od_counts(spark, folder) if counts is None else counts)
    return build.od_tensor(var, V.locations(spark, folder), day_type)


def _t(spark, folder) -> TB.Tensor:
    return od_tensor_of(spark, folder)[0]


def _all(spark, folder, day_type) -> TB.Tensor:
    """Tensor over all known locations; the lookup's own number is the index."""
    var = od.variability(V.od_counts(spark, folder))
    index = V.locations(spark, folder).select("name", F.col("name").cast("long").alias("idx"))
    return build.od_tensor_all(var, index, day_type, V.table(spark, folder, "nation").count())


def start(spark, t, rank=RANK):
    return [A.start_factor(spark, m, n, rank) for m, n in enumerate(t.shape)]


def fitted(t):
    """Factors of the nonnegative model of a tensor, every row present and written."""
    found = ntf.ntf(t, RANK, "anls_bpp", stop_criterion=2, min_iter=FIT_SWEEPS, max_iter=FIT_SWEEPS)
    return [A.Factor(checkpointed(A.all_rows(f).df), f.rows, f.rank) for f in found.model.factors]


def _vector(spark, t, mode):
    return A.start_factor(spark, mode, t.shape[mode], 1).df.withColumnRenamed("f0", "w")


def rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def factor_rows(f: A.Factor, digits=6):
    return rounded(f.df, *f.columns, digits=digits)


def od_tensor(spark, folder):
    return _t(spark, folder).df


def od_tensor_all(spark, folder):
    return _all(spark, folder, "holidays").df


def tensor_index(spark, folder):
    return od_tensor_of(spark, folder)[1]


def tensor_percent(spark, folder):
    return rounded(TB.percent(_t(spark, folder)).df, "v")


def tensor_threshold(spark, folder):
    return TB.threshold(_t(spark, folder), 30).df


def tensor_hourly(spark, folder):
    return rounded(TB.hourly(_t(spark, folder)), "total")


def tensor_marginals(spark, folder):
    return rounded(TB.marginals(_t(spark, folder)), "total")


def tensor_histogram(spark, folder):
    return TB.histogram(_t(spark, folder), 1000)


def accum_sum(spark, folder):
    rows = V.trip_lines(spark, folder).select("src", "dst", "hour", F.col("l_quantity").alias("v"))
    return TB.accum(rows, ("src", "dst", "hour"), "sum")


def accum_last(spark, folder):
    rows = V.trip_lines(spark, folder).select(
        "src", "dst", "hour", (F.col("l_orderkey") * 1000 + F.col("l_partkey") % 1000).alias("seq"))
    return TB.accum(rows.withColumn("v", F.col("seq").cast("double")), ("src", "dst", "hour"), "last", "seq")


def ttm_mode0(spark, folder):
    t = _t(spark, folder)
    matrix = A.factor_matrix(A.start_factor(spark, 0, t.shape[0], RANK))
    return rounded(A.ttm(t, matrix, RANK, 0, transp=True).df, "v")


def ttm_all_modes(spark, folder):
    t = _t(spark, folder)
    matrices = {m: (A.factor_matrix(f), RANK) for m, f in enumerate(start(spark, t))}
    return rounded(A.ttm_many(t, matrices, transp=True).df, "v", digits=4)


def ttv_all(spark, folder):
    t = _t(spark, folder)
    return rounded(A.ttv(t, {m: _vector(spark, t, m) for m in range(3)}), "v")


def ttv_vector(spark, folder):
    t = _t(spark, folder)
    return rounded(A.ttv(t, {1: _vector(spark, t, 1), 2: _vector(spark, t, 2)}), "v")


def unfold_mode0(spark, folder):
    return TB.unfold(_t(spark, folder), 0).df


def unfold_mode1(spark, folder):
    return TB.unfold(_t(spark, folder), 1).df


def unfold_mode2(spark, folder):
    return TB.unfold(_t(spark, folder), 2).df


def unfold_transposed(spark, folder):
    return TB.unfold(_t(spark, folder), [1], transp=True).df


def fold_roundtrip(spark, folder):
    return TB.fold(TB.unfold(_t(spark, folder), [2, 0])).df


def tensor_transpose(spark, folder):
    return TB.transpose(_t(spark, folder), (2, 0, 1)).df


def khatri_rao(spark, folder):
    return factor_rows(A.khatri_rao(fitted(_t(spark, folder))[:2]), 4)


def tensor_norm(spark, folder):
    t = _t(spark, folder)
    return spark.createDataFrame([(round(A.norm(t), 6),)], "norm double")


def tensor_innerprod(spark, folder):
    a, b = _all(spark, folder, "workdays"), _all(spark, folder, "holidays")
    return rounded(A.innerprod(a, b), "v", digits=4)


def tensor_diff(spark, folder):
    a, b = _all(spark, folder, "workdays"), _all(spark, folder, "holidays")
    return rounded(A.subtract(a, b).df, "v")


def tensor_center(spark, folder):
    return rounded(A.center(_t(spark, folder), 1).df, "v")


def tensor_scale(spark, folder):
    return rounded(A.scale(_t(spark, folder), 0).df, "v")


def tensor_concat(spark, folder):
    return TB.concatenate([_all(spark, folder, "workdays"), _all(spark, folder, "holidays")], 2).df


def tensor_densify(spark, folder):
    return TB.densify(_t(spark, folder)).df


def tensor_points(spark, folder):
    t = _t(spark, folder)
    points = V.taps(spark, folder).select((F.col("uid") % t.shape[0]).alias("i"), (F.col("location") % t.shape[1]).cast("long").alias("j"),
                                          (F.col("event_id") % t.shape[2]).alias("k")).distinct()
    return TB.read_points(t, points)


def tensor_sorted(spark, folder):
    return TB.sorted_cells(_t(spark, folder))


def holdout_mask(spark, folder):
    return TB.holdout(_t(spark, folder), 0.9).df


def json_roundtrip(spark, folder):
    lines = writers.tensor_lines(TB.densify(_t(spark, folder)).df)
    rows = writers.read_tensor_lines(lines)
    return rows.select("i", F.col("j").cast("long").alias("j"), F.col("k").cast("long").alias("k"), "v")


def tensor_shape(spark, folder):
    """A sparse tensor built from entries with repeated subscripts: its inferred shape and number of cells."""
    lines = V.trip_lines(spark, folder).select("src", "dst", F.col("hour").cast("long").alias("hour"), F.col("l_quantity").alias("v"))
    t = TB.tensor(lines, ("src", "dst", "hour"), accumulate="max")
    sizes = F.array(*[F.lit(int(n)) for n in t.shape])
    return t.df.agg(F.count("*").alias("cells"), F.sum("v").cast("double").alias("total")).select(
        "cells", "total", F.posexplode(sizes).alias("mode", "size"))


def tensor_from_dense(spark, folder):
    """Dense cells to a sparse tensor: zeros are dropped."""
    return TB.nonzeros(TB.densify(_t(spark, folder))).df


def tensor_equal(spark, folder):
    """A tensor against itself written and read, and against its transpose."""
    t = _t(spark, folder)
    lines = writers.read_tensor_lines(writers.tensor_lines(TB.densify(t).df))
    other = TB.transpose(t, (1, 0, 2))
    rows = [(name, TB.equal(t, o)) for name, o in (("json", t.with_df(lines)), ("transposed", other))]
    cells = [(name, TB.differing_cells(t, o).count()) for name, o in (("json", t.with_df(lines)), ("transposed", other))]
    return spark.createDataFrame([(n, e, c) for (n, e), (_, c) in zip(rows, cells)], "other string, equal boolean, cells bigint")


def identity_trace(spark, folder):
    """Inner product with the super-diagonal of ones."""
    t = _t(spark, folder)
    return rounded(A.innerprod(t, TB.identity(spark, min(t.shape), 3)), "v", digits=6)


def _day_matrix(spark, folder):
    t = _t(spark, folder)
    return t, t.df.groupBy("i", "j").agg(F.sum("v").alias("m"))


def commutation(spark, folder):
    """vec of the transposed pair matrix, from vec of the matrix and the commutation entries."""
    t, matrix = _day_matrix(spark, folder)
    n = t.shape[0]
    vec = matrix.select((F.col("j") * n + F.col("i")).alias("col"), "m")
    turned = TB.commutation(spark, n, n).join(vec, "col").select("row", F.round("m", 6).alias("m"))
    return turned


def center_matrix(spark, folder):
    t, matrix = _day_matrix(spark, folder)
    return rounded(A.center_matrix(matrix.withColumnsRenamed({"i": "r", "j": "c"}), t.shape[0]), "m", digits=6)


def edge_slices(spark, folder):
    return TB.slices(_all(spark, folder, "workdays"))


def _mttkrp(spark, folder, mode):
    t = _t(spark, folder)
    return factor_rows(A.mttkrp(t, start(spark, t), mode), 5)


def mttkrp_mode0(spark, folder):
    return _mttkrp(spark, folder, 0)


def mttkrp_mode1(spark, folder):
    return _mttkrp(spark, folder, 1)


def mttkrp_mode2(spark, folder):
    return _mttkrp(spark, folder, 2)


def mttkrp_fine(spark, folder):
    """The hot kernel on the large sparse tensor."""
    df = V.od_fine(spark, folder)
    sizes = (V.table(spark, folder, "supplier").count(), V.table(spark, folder, "customer").count(), 24)
    t = TB.Tensor(df, ("i", "j", "k"), (sizes[0] + 1, sizes[1] + 1, sizes[2]))
    return factor_rows(A.mttkrp(t, start(spark, t), 0), 5)


def factor_gram(spark, folder):
    rows = [(m, a, b, round(float(g[a, b]), 4)) for m, g in enumerate(A.gram(f) for f in fitted(_t(spark, folder)))
            for a in range(RANK) for b in range(RANK)]
    return spark.createDataFrame(rows, "mode int, a int, b int, v double")


def _model(spark, t):
    return A.Kruskal(start(spark, t), np.array([2.0, 3.0]))


def _fitted_model(t):
    return A.Kruskal(fitted(t), np.array([2.0, 3.0]))


def kruskal_norm(spark, folder):
    return spark.createDataFrame([(round(_fitted_model(_t(spark, folder)).norm(), 4),)], "norm double")


def kruskal_innerprod(spark, folder):
    t = _t(spark, folder)
    return spark.createDataFrame([(round(A.kruskal_innerprod(_model(spark, t), t), 3),)], "v double")


def kruskal_cells(spark, folder):
    t = _t(spark, folder)
    return rounded(A.kruskal_cells(_model(spark, t), t), "model", digits=8)


def component_cells(spark, folder):
    t = _t(spark, folder)
    return rounded(A.component_cells(_model(spark, t), t), "part", digits=8)


def kruskal_mttkrp(spark, folder):
    t = _t(spark, folder)
    other = [A.start_factor(spark, m + 3, n, RANK) for m, n in enumerate(t.shape)]
    return factor_rows(A.kruskal_mttkrp(_fitted_model(t), other, 1), 3)


def rel_error(spark, folder):
    t = _t(spark, folder)
    return rounded(A.errors(_model(spark, t), t), "rel_frobenius", "rel_abs")


def beta_divergence(spark, folder):
    """Divergences over all cells; that of beta 0 is infinite at every zero cell, so it is given for the others, and their number.

    The zero cells of beta 1.5 have no closed sum, so tasks generate them.
    """
    t = _t(spark, folder)
    t = t.with_df(checkpointed(t.df))
    model = _model(spark, t)
    held = TB.nonzeros(t).df.count()
    only = A.kruskal_cells(model, TB.nonzeros(t)).agg(F.sum(A.beta_divergence(F.col("v"), F.col("model"), 0))).first()[0]
    whole = [round(x, 4) for x in (A.divergence(model, t, 1), A.divergence(model, t, 2), ntf.beta_score(t, model, 1.5))]
    return spark.createDataFrame([(round(only, 4), t.cells() - held, *whole)],
                                 "beta0 double, beta0_infinite bigint, beta1 double, beta2 double, beta15 double")


def beta_divergence_dense(spark, folder):
    """A divergence whose zero cells have no closed sum, so tasks generate them."""
    t = _t(spark, folder)
    return spark.createDataFrame([(round(ntf.beta_score(t, _model(spark, t), 1.5), 4),)], "beta15 double")


CORE = np.arange(1.0, 9.0).reshape(2, 2, 2)


def tucker_cells(spark, folder):
    t = _t(spark, folder)
    return rounded(A.tucker_cells(CORE, start(spark, t), t), "model")


def factor_pack(spark, folder):
    return rounded(A.pack(fitted(_t(spark, folder))), "value", digits=4)


def factor_unpack(spark, folder):
    t = _t(spark, folder)
    return factor_rows(A.unpack(A.pack(fitted(t)), t.shape, RANK)[1], 4)


def flipsign(spark, folder):
    f = fitted(_t(spark, folder))[0]
    shifted = f.df.select("idx", *[(F.col(c) - 2.0).alias(c) for c in f.columns])
    return factor_rows(A.flipsign(A.Factor(shifted, f.rows, f.rank)), 4)


QUERIES = {f.__name__: f for f in (
    od_tensor, od_tensor_all, tensor_index, tensor_percent, tensor_threshold, tensor_hourly, tensor_marginals,
    tensor_histogram, accum_sum, accum_last, ttm_mode0, ttm_all_modes, ttv_all, ttv_vector, unfold_mode0, unfold_mode1,
    unfold_mode2, unfold_transposed, fold_roundtrip, tensor_transpose, khatri_rao, tensor_norm, tensor_innerprod,
    tensor_diff, tensor_center, tensor_scale, tensor_concat, tensor_densify, tensor_points, tensor_sorted, holdout_mask, json_roundtrip,
    tensor_shape, tensor_from_dense, tensor_equal, identity_trace, commutation, center_matrix, edge_slices, mttkrp_mode0, mttkrp_mode1, mttkrp_mode2, mttkrp_fine, factor_gram, kruskal_norm, kruskal_innerprod,
    kruskal_cells, component_cells, kruskal_mttkrp, rel_error, beta_divergence, beta_divergence_dense, tucker_cells, factor_pack, factor_unpack,
    flipsign)}

# ---- SQL counterparts -----------------------------------------------------------------------------

HEAD = "WITH " + mobility.VAR + ", " + V.LOCATIONS


def tens_sql(day_type="workdays"):
    return HEAD + f""", inside AS (SELECT v.src, v.dst, v.hour, v.mean100 / 100 AS mean FROM var v JOIN locations a ON v.src = a.name JOIN locations b ON v.dst = b.name
      WHERE day_type = '{day_type}' AND {V.in_box_sql('a.lng', 'a.lat')} AND {V.in_box_sql('b.lng', 'b.lat')}),
    names AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM (SELECT src AS name FROM inside UNION SELECT dst FROM inside)),
    n AS (SELECT count(*) AS size FROM names),
    t AS MATERIALIZED (SELECT a.idx::BIGINT AS i, b.idx::BIGINT AS j, hour::BIGINT AS k, mean AS v FROM inside JOIN names a ON src = a.name JOIN names b ON dst = b.name)"""


def all_sql(day_type, name):
    return f"{name} AS (SELECT src::BIGINT AS i, dst::BIGINT AS j, hour::BIGINT AS k, mean100 / 100 AS v FROM var WHERE day_type = '{day_type}')"


TENS = tens_sql()
SIZES = ("(SELECT size FROM n)", "(SELECT size FROM n)", "24")


def start_sql(mode, c, row="idx", shift=0):
    return f"((({row} + 1) * {7919 + c * 1009} + {(mode + shift + 1) * 104729 * (c + 1)}) % 1009 + 1) / 1010.0::DOUBLE"


def factor_sql(mode, rank=RANK, shift=0, name=None):
    cols = ", ".join(f"{start_sql(mode, c, shift=shift)} AS f{c}" for c in range(rank))
    return f"{name or 'f' + 'abc'[mode]} AS MATERIALIZED (SELECT idx::BIGINT AS idx, {cols} FROM range({SIZES[mode]}) AS r(idx))"


FACS = ", " + ", ".join(factor_sql(m) for m in range(3))


def fitted_sql(sweeps=FIT_SWEEPS):
    """fa, fb, fc: the factors after the sweeps of :func:`fitted`, every row present."""
    names = ["start_a", "start_b", "start_c"]
    ctes = [factor_sql(m, name=names[m]) for m in range(3)]
    for s in range(sweeps):
        for m in range(3):
            new = f"w{LETTERS[m]}{s}"
            ctes += _half_sweep("ntf", m, names, new, s)
            names[m] = new
    ctes += [f"f{LETTERS[m]} AS MATERIALIZED (SELECT r.idx::BIGINT AS idx, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1 "
             f"FROM range({SIZES[m]}) AS r(idx) LEFT JOIN {names[m]} USING (idx))" for m in range(3)]
    return ", " + ", ".join(ctes)


FITTED = fitted_sql()
GRID = f", grid AS (SELECT a.i::BIGINT AS i, b.j::BIGINT AS j, c.k::BIGINT AS k FROM range({SIZES[0]}) AS a(i), range({SIZES[1]}) AS b(j), range(24) AS c(k)), dense AS (SELECT i, j, k, coalesce(v, 0.0) AS v FROM grid LEFT JOIN t USING (i, j, k))"
KEYS = "ijk"
FN = ("fa", "fb", "fc")


def joined(base="t", modes=(0, 1, 2)):
    return f"{base} " + " ".join(f"JOIN {FN[m]} ON {FN[m]}.idx = {base}.{KEYS[m]}" for m in modes)


def mttkrp_sql(mode, base="t", rank=RANK):
    others = [m for m in range(3) if m != mode]
    sums = ", ".join(f"sum({base}.v * " + " * ".join(f"{FN[m]}.f{c}" for m in others) + f") AS f{c}" for c in range(rank))
    return f"SELECT {base}.{KEYS[mode]} AS idx, {sums} FROM {joined(base, others)} GROUP BY 1"


def r(cols, digits):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


MODEL = "(2.0::DOUBLE * fa.f0 * fb.f0 * fc.f0 + 3.0::DOUBLE * fa.f1 * fb.f1 * fc.f1)"
_model_dense = f"md AS (SELECT dense.v AS v, {MODEL} AS m FROM {joined('dense')})"
_tucker = " + ".join(f"{CORE[a, b, c]}::DOUBLE * fa.f{a} * fb.f{b} * fc.f{c}" for a in range(2) for b in range(2) for c in range(2))


def _gram_rows():
    return " UNION ALL ".join(f"SELECT {m} AS mode, {a} AS a, {b} AS b, round(sum(f{a} * f{b}), 4) AS v FROM {FN[m]}"
                              for m in range(3) for a in range(RANK) for b in range(RANK))


def _knorm():
    w = (2.0, 3.0)
    parts = [f"{w[a] * w[b]}::DOUBLE * " + " * ".join(f"(SELECT sum(f{a} * f{b}) FROM {FN[m]})" for m in range(3))
             for a in range(2) for b in range(2)]
    return f"SELECT round(sqrt({' + '.join(parts)}), 4) AS norm"


def _kmttkrp():
    w = (2.0, 3.0)
    cols = []
    for c in range(2):
        terms = [f"{w[s]}::DOUBLE * fb.f{s} * (SELECT sum(fa.f{s} * ga.f{c}) FROM fa JOIN ga USING (idx)) * (SELECT sum(fc.f{s} * gc.f{c}) FROM fc JOIN gc USING (idx))" for s in range(2)]
        cols.append(f"round({' + '.join(terms)}, 3) AS f{c}")
    return f"SELECT idx, {', '.join(cols)} FROM fb"


def _pack():
    out, offset = [], "0"
    for m in range(3):
        out += [f"SELECT (idx * 2 + {c} + {offset})::BIGINT AS pos, round(f{c}, 4) AS value FROM {FN[m]}" for c in range(2)]
        offset += f" + {SIZES[m]} * 2"
    return " UNION ALL ".join(out)


SQL = {
    "od_tensor": f"{TENS} SELECT * FROM t",
    "od_tensor_all": f"{HEAD}, {all_sql('holidays', 't')} SELECT * FROM t",
    "tensor_index": f"{TENS} SELECT name, idx::BIGINT AS idx FROM names",
    "tensor_percent": f"{TENS} SELECT i, j, k, round(v * 100.0 / sum(v) OVER (PARTITION BY i, j), 6) AS v FROM t",
    "tensor_threshold": f"{TENS} SELECT i, j, k, v FROM (SELECT *, sum(v) OVER (PARTITION BY i, j) AS s FROM t) WHERE s >= 30",
    "tensor_hourly": f"{TENS} SELECT k AS idx, round(sum(v), 6) AS total FROM t GROUP BY 1",
    "tensor_marginals": f"{TENS} " + " UNION ALL ".join(f"SELECT {m}::INT AS mode, {KEYS[m]} AS idx, round(sum(v), 6) AS total FROM t GROUP BY 2" for m in range(3)),
    "tensor_histogram": f"{TENS}{GRID}, mm AS (SELECT min(v) AS lo, max(v) AS hi FROM dense) SELECT least(floor((v - lo) / (hi - lo) * 1000), 999)::INT AS bin, count(*)::BIGINT AS cnt FROM dense, mm GROUP BY 1",
    "accum_sum": f"WITH {V.LINES} SELECT src, dst, hour, sum(l_quantity) AS v FROM lines GROUP BY ALL",
    "accum_last": f"WITH {V.LINES} SELECT src, dst, hour, max(l_orderkey * 1000 + l_partkey % 1000)::DOUBLE AS v FROM lines GROUP BY ALL",
    "ttm_mode0": f"{TENS}{FACS} " + " UNION ALL ".join(f"SELECT {c}::BIGINT AS i, j, k, round(sum(v * f{c}), 6) AS v FROM t JOIN fa ON idx = i GROUP BY j, k" for c in range(2)),
    "ttm_all_modes": f"{TENS}{FACS} " + " UNION ALL ".join(f"SELECT {a}::BIGINT AS i, {b}::BIGINT AS j, {c}::BIGINT AS k, round(sum(v * fa.f{a} * fb.f{b} * fc.f{c}), 4) AS v FROM {joined()}" for a in range(2) for b in range(2) for c in range(2)),
    "ttv_all": f"{TENS}{FACS} SELECT round(sum(v * fa.f0 * fb.f0 * fc.f0), 6) AS v FROM {joined()}",
    "ttv_vector": f"{TENS}{FACS} SELECT i, round(sum(v * fb.f0 * fc.f0), 6) AS v FROM {joined('t', (1, 2))} GROUP BY i",
    "unfold_mode0": f"{TENS} SELECT i AS row, k * (SELECT size FROM n) + j AS col, v FROM t",
    "unfold_mode1": f"{TENS} SELECT j AS row, k * (SELECT size FROM n) + i AS col, v FROM t",
    "unfold_mode2": f"{TENS} SELECT k AS row, j * (SELECT size FROM n) + i AS col, v FROM t",
    "unfold_transposed": f"{TENS} SELECT k * (SELECT size FROM n) + i AS row, j AS col, v FROM t",
    "fold_roundtrip": f"{TENS} SELECT * FROM t",
    "tensor_transpose": f"{TENS} SELECT k AS i, i AS j, j AS k, v FROM t",
    "khatri_rao": f"{TENS}{FITTED} SELECT (fa.idx * (SELECT size FROM n) + fb.idx)::BIGINT AS idx, round(fa.f0 * fb.f0, 4) AS f0, round(fa.f1 * fb.f1, 4) AS f1 FROM fa, fb",
    "tensor_norm": f"{TENS} SELECT round(sqrt(sum(v * v)), 6) AS norm FROM t",
    "tensor_innerprod": f"{HEAD}, {all_sql('workdays', 'x')}, {all_sql('holidays', 'y')} SELECT round(sum(x.v * y.v), 4) AS v FROM x JOIN y USING (i, j, k)",
    "tensor_diff": f"{HEAD}, {all_sql('workdays', 'x')}, {all_sql('holidays', 'y')} SELECT i, j, k, round(coalesce(x.v, 0) - coalesce(y.v, 0), 6) AS v FROM x FULL JOIN y USING (i, j, k) WHERE coalesce(x.v, 0) <> coalesce(y.v, 0)",
    "tensor_center": f"{TENS}{GRID}, tk AS (SELECT i, k, sum(v) / (SELECT size FROM n) AS mean FROM t GROUP BY i, k) SELECT i, j, k, round(v - mean, 6) AS v FROM dense JOIN tk USING (i, k)",
    "tensor_scale": f"{TENS}, sl AS (SELECT i, sqrt(sum(v * v)) AS s FROM t GROUP BY i) SELECT i, j, k, round(v / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS v FROM t JOIN sl USING (i)",
    "tensor_concat": f"{HEAD}, {all_sql('workdays', 'x')}, {all_sql('holidays', 'y')} SELECT * FROM x UNION ALL SELECT i, j, k + 24, v FROM y",
    "tensor_densify": f"{TENS}{GRID} SELECT * FROM dense",
    "tensor_points": f"{TENS}, {V.TAPS}, pt AS (SELECT DISTINCT uid % (SELECT size FROM n) AS i, (location % (SELECT size FROM n))::BIGINT AS j, event_id % 24 AS k FROM taps) SELECT i, j, k, coalesce(v, 0.0) AS v FROM pt LEFT JOIN t USING (i, j, k)",
    "tensor_sorted": f"{TENS} SELECT * FROM t ORDER BY k, j, i",
    "holdout_mask": f"{TENS} SELECT * FROM t WHERE v <> 0 AND ((i * 7919 + j * 104729 + k * 1299709) % 1000003 * 7919) % 1000 < 900",
    "json_roundtrip": f"{TENS} SELECT * FROM t WHERE v <> 0",
    "tensor_shape": f"""WITH {V.LINES}, c AS (SELECT src, dst, hour, max(l_quantity) AS v FROM lines GROUP BY ALL),
      a AS (SELECT count(*) AS cells, sum(v)::DOUBLE AS total, max(src) + 1 AS s, max(dst) + 1 AS d, max(hour) + 1 AS h FROM c)
      SELECT cells, total, 0::INT AS mode, s::INT AS size FROM a UNION ALL SELECT cells, total, 1, d FROM a UNION ALL SELECT cells, total, 2, h FROM a""",
    "tensor_from_dense": f"{TENS} SELECT * FROM t WHERE v <> 0",
    "tensor_equal": f"""{TENS}, df AS (SELECT count(*) FILTER (abs(coalesce(x.v, 0) - coalesce(y.v, 0)) > 0) AS n FROM t x FULL JOIN t y ON x.i = y.j AND x.j = y.i AND x.k = y.k)
      SELECT 'json' AS other, true AS equal, 0::BIGINT AS cells UNION ALL SELECT 'transposed', n = 0, n FROM df""",
    "identity_trace": f"{TENS} SELECT round(coalesce(sum(v), 0), 6) AS v FROM t WHERE i = j AND j = k AND k < least((SELECT size FROM n), 24)",
    "commutation": f"{TENS} SELECT (i * (SELECT size FROM n) + j)::BIGINT AS row, round(sum(v), 6) AS m FROM t GROUP BY i, j",
    "center_matrix": f"""{TENS}, m AS (SELECT i, j, sum(v) AS m FROM t GROUP BY i, j), c AS (SELECT j, sum(m) / (SELECT size FROM n) AS mean FROM m GROUP BY j)
      SELECT g.r AS r, g.j AS c, round(coalesce(m.m, 0) - g.mean, 6) AS m FROM (SELECT x.r::BIGINT AS r, c.j, c.mean FROM c, range((SELECT size FROM n)) AS x(r)) g LEFT JOIN m ON m.i = g.r AND m.j = g.j""",
    "edge_slices": f"{HEAD}, {all_sql('workdays', 't')} SELECT k, i AS s, j AS o, v FROM t",
    **{f"mttkrp_mode{m}": f"{TENS}{FACS}, mk AS ({mttkrp_sql(m)}) SELECT idx, {r(('f0', 'f1'), 5)} FROM mk" for m in range(3)},
    "mttkrp_fine": f"""WITH {V.OD_FINE}, fb AS (SELECT idx, {start_sql(1, 0)} AS f0, {start_sql(1, 1)} AS f1 FROM range((SELECT count(*) + 1 FROM customer)) AS r(idx)),
      fc AS (SELECT idx, {start_sql(2, 0)} AS f0, {start_sql(2, 1)} AS f1 FROM range(24) AS r(idx))
      SELECT i AS idx, round(sum(v * fb.f0 * fc.f0), 5) AS f0, round(sum(v * fb.f1 * fc.f1), 5) AS f1 FROM od_fine JOIN fb ON fb.idx = j JOIN fc ON fc.idx = k GROUP BY 1""",
    "factor_gram": f"{TENS}{FITTED} {_gram_rows()}",
    "kruskal_norm": f"{TENS}{FITTED} {_knorm()}",
    "kruskal_innerprod": f"{TENS}{FACS} SELECT round(sum(t.v * {MODEL}), 3) AS v FROM {joined()}",
    "kruskal_cells": f"{TENS}{FACS} SELECT i, j, k, v, round({MODEL}, 8) AS model FROM {joined()}",
    "component_cells": f"{TENS}{FACS} " + " UNION ALL ".join(f"SELECT i, j, k, {c}::INT AS component, round({w}::DOUBLE * fa.f{c} * fb.f{c} * fc.f{c}, 8) AS part FROM {joined()}" for c, w in enumerate((2.0, 3.0))),
    "kruskal_mttkrp": f"{TENS}{FITTED}, {factor_sql(0, shift=3, name='ga')}, {factor_sql(2, shift=3, name='gc')} {_kmttkrp()}",
    "rel_error": f"{TENS}{FACS}{GRID}, {_model_dense} SELECT round(sqrt(sum((v - m) * (v - m)) / sum(v * v)), 6) AS rel_frobenius, round(sum(abs(v - m)) / sum(v), 6) AS rel_abs FROM md",
    "beta_divergence": f"""{TENS}{FACS}{GRID}, {_model_dense} SELECT round(sum(CASE WHEN v > 0 THEN v / m - ln(v / m) - 1 END), 4) AS beta0,
      count(*) FILTER (v = 0) AS beta0_infinite, round(sum(CASE WHEN v = 0 THEN m ELSE v * (ln(v) - ln(m)) + m - v END), 4) AS beta1,
      round(sum((v - m) * (v - m) / 2), 4) AS beta2,
      round(sum((pow(v, 1.5) + 0.5 * pow(m, 1.5) - 1.5 * v * pow(m, 0.5)) / 0.75), 4) AS beta15 FROM md""",
    "beta_divergence_dense": f"""{TENS}{FACS}{GRID}, {_model_dense}
      SELECT round(sum((pow(v, 1.5) + 0.5 * pow(m, 1.5) - 1.5 * v * pow(m, 0.5)) / 0.75), 4) AS beta15 FROM md""",
    "tucker_cells": f"{TENS}{FACS} SELECT i, j, k, v, round({_tucker}, 6) AS model FROM {joined()}",
    "factor_pack": f"{TENS}{FITTED} {_pack()}",
    "factor_unpack": f"{TENS}{FITTED} SELECT idx, {r(('f0', 'f1'), 4)} FROM fb",
    "flipsign": f"{TENS}{FITTED}, sh AS (SELECT idx, f0 - 2.0::DOUBLE AS f0, f1 - 2.0::DOUBLE AS f1 FROM fa), sg AS (SELECT arg_max(f0, abs(f0)) AS s0, arg_max(f1, abs(f1)) AS s1 FROM sh) SELECT idx, round(f0 * CASE WHEN s0 < 0 THEN -1 ELSE 1 END, 4) AS f0, round(f1 * CASE WHEN s1 < 0 THEN -1 ELSE 1 END, 4) AS f1 FROM sh, sg",
}
