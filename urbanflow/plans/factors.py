"""Registered queries: factorizations, patterns, relational models and reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanflow.operators import learn, patterns, places
from urbanflow.operators.tensor import algebra as A
from urbanflow.operators.tensor import cp, ntf, relational, tucker
from urbanflow.operators.tensor import table as TB
from urbanflow.plans import places as PP
from urbanflow.plans.sweeps import LETTERS, _gram_sql, _half_sweep
from urbanflow.plans import tensors as TT
from urbanflow.plans import views as V
from urbanflow.session import checkpointed

RANK = 2


def model_rows(factors: list[A.Factor], digits=5):
    """All factor rows, absent ones as 0, in one table (mode, idx, f0, f1, ...)."""
    out = None
    for m, f in enumerate(factors):
        part = A.all_rows(f).df.withColumn("mode", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return TT.rounded(out, *factors[0].columns, digits=digits)


def cp_als(spark, folder):
    t = TT.od_tensor_of(spark, folder)[0]
    found = cp.cp_als(t, RANK)
    return model_rows(found.model.factors).withColumn("fit", F.lit(round(found.fit, 5))).withColumn(
        "sweeps", F.lit(found.iterations))


def _fine(spark, folder):
    """The large sparse supplier x customer x hour tensor."""
    sizes = (V.table(spark, folder, "supplier").count() + 1, V.table(spark, folder, "customer").count() + 1, 24)
    return TB.Tensor(V.od_fine(spark, folder), ("i", "j", "k"), sizes)


def cp_als_fine(spark, folder):
    found = cp.cp_als(_fine(spark, folder), RANK)
    return model_rows(found.model.factors, 4).withColumn("sweeps", F.lit(found.iterations))


def _ntf(spark, folder, method):
    t = TT.od_tensor_of(spark, folder)[0]
    found = ntf.ntf(t, RANK, method=method, stop_criterion=2)
    return model_rows(found.model.factors).withColumn("sweeps", F.lit(found.iterations))


def ntf_bpp(spark, folder):
    return _ntf(spark, folder, "anls_bpp")


def ntf_as(spark, folder):
    return _ntf(spark, folder, "anls_asgroup")


def ntf_fine(spark, folder):
    """Stops by the projected gradient."""
    found = ntf.ntf(_fine(spark, folder), RANK)
    return model_rows(found.model.factors, 4).withColumn("sweeps", F.lit(found.iterations))


def _beta(spark, folder, beta):
    t = TT.od_tensor_of(spark, folder)[0]
    return model_rows(ntf.beta_ntf(t, RANK, beta=beta).model.factors)


def beta_ntf(spark, folder):
    return _beta(spark, folder, 2)


def beta_ntf_kl(spark, folder):
    return _beta(spark, folder, 1)


def beta_ntf_dense(spark, folder):
    return _beta(spark, folder, 1.5)


def beta_ntf_fine(spark, folder):
    return model_rows(ntf.beta_ntf(_fine(spark, folder), RANK, beta=1).model.factors, 4)


def projected_gradient(spark, folder):
    t = TT.od_tensor_of(spark, folder)[0]
    factors = TT.start(spark, t)
    g = ntf.gradient(t, factors, [A.gram(f) for f in factors], 0, True)
    return TT.rounded(g.df, *g.columns, digits=4)


def nvecs(spark, folder):
    """Leading vector of the hour mode."""
    t = TT.od_tensor_of(spark, folder)[0]
    return TT.factor_rows(tucker.nvecs(t, 2, 1), 5)


def hosvd(spark, folder):
    t = TT.od_tensor_of(spark, folder)[0]
    return TT.rounded(tucker.hosvd(t, RANK)[1].df, "v", digits=3)


def tucker_hooi(spark, folder):
    t = TT.od_tensor_of(spark, folder)[0]
    found = tucker.hooi(t, RANK, init="random")
    return model_rows(found.factors, 3).withColumn("fit", F.lit(round(found.fit, 4))).withColumn("sweeps", F.lit(found.iterations))


def tucker_rank1(spark, folder):
    """With one component each half-sweep is a normalized tensor-vector product, which SQL can follow."""
    t = TT.od_tensor_of(spark, folder)[0]
    found = tucker.hooi(t, 1, init="random", max_iter=2)
    return model_rows(found.factors, 5).withColumn("core", F.lit(round(float(found.core.ravel()[0]), 4)))


def tucker_masked_gradient(spark, folder):
    t = TT.od_tensor_of(spark, folder)[0]
    found, losses = tucker.masked_tucker(t, 2, steps=3, alpha=1e-6, above=1.0)
    rows = [(n, float(x)) for n, x in enumerate(losses)]
    return spark.createDataFrame(rows, "step int, loss double")


def component_strength(spark, folder):
    return TT.rounded(patterns.component_strength(TT.fitted(TT.od_tensor_of(spark, folder)[0])), "strength", digits=3)


def temporal_pattern(spark, folder):
    return TT.rounded(patterns.temporal_pattern(TT.fitted(TT.od_tensor_of(spark, folder)[0])[2]), "value", digits=4)


def spatial_class(spark, folder):
    t, index = TT.od_tensor_of(spark, folder)
    rows = patterns.spatial_pattern(TT.fitted(t)[0], t, 0, index)
    return TT.rounded(rows, "total", digits=4)


def rank_sweep(spark, folder):
    """Held-out error by method and rank on percents of the workday tensor."""
    t = patterns.prepared(TT.od_tensor_of(spark, folder)[0], "metro", "workdays")
    sweep = patterns.error_sweep({("metro", "workdays"): t}, (1, 2), (0.9,), min_iter=1, max_iter=1, beta_iter=1)
    return TT.rounded(sweep, "rel_frobenius", "rel_abs", digits=4)


def _edges(spark, folder):
    """Edge table with relations numbered in name order; written once, because numbers and fits read it again."""
    edges = checkpointed(V.edges(spark, folder))
    index = TB.dense_index(edges.select(F.col("k").alias("name")))
    numbered = edges.join(F.broadcast(index), edges.k == index.name).select(F.col("idx").cast("int").alias("k"), "s", "o", "v")
    return numbered, V.table(spark, folder, "nation").count(), index.count()


def edges(spark, folder):
    return _edges(spark, folder)[0]


def rescal(spark, folder):
    rows, n, relations = _edges(spark, folder)
    found = relational.rescal(rows, n, relations, RANK, init="random")
    return TT.factor_rows(found.a, 4).withColumn("sweeps", F.lit(found.iterations))


def rescal_attributes(spark, folder):
    """Regularized RESCAL with the number of customers per segment as attributes of the nations."""
    rows, n, relations = _edges(spark, folder)
    customer = V.table(spark, folder, "customer")
    attr = customer.groupBy(F.lit(0).alias("l"), F.col("c_nationkey").cast("long").alias("e"),
                            F.col("c_mktsegment").alias("a")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    found = relational.rescal(rows, n, relations, RANK, init="random", attributes=attr, lambda_a=0.1, lambda_r=0.1, lambda_v=0.1)
    return TT.rounded(found.attributes, "z0", "z1", digits=3).withColumn("sweeps", F.lit(found.iterations))


def dedicom(spark, folder):
    rows, n, relations = _edges(spark, folder)
    found = relational.dedicom(rows, n, relations, RANK, init="random")
    return found.a.df.withColumn("fit", F.lit(found.fit)).withColumn("sweeps", F.lit(found.iterations))


def indscal(spark, folder):
    rows, n, relations = _edges(spark, folder)
    found = relational.indscal(rows, n, relations, RANK)
    return TT.factor_rows(found.a, 4).withColumn("sweeps", F.lit(found.iterations))


def matrix_factorization(spark, folder):
    lines = V.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = V.table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    cells = lines.join(orders, "l_orderkey").groupBy(F.col("o_custkey").alias("row"), F.col("l_partkey").alias("col")).agg(
        F.sum("l_quantity").alias("v"))
    return learn.mf_error(*learn.matrix_factorization(cells, RANK, max_iter=3))


FEATURES = places.feature_names(PP.TAGS)
MIN_VOLUME = 15


def _place_features(spark, folder):
    """Features of every place from all points; the counts, a row for each place, are written once, because the sums over
    places read them again."""
    return places.normalized_features(checkpointed(PP._radius_counts(spark, folder)), FEATURES)


def _pairs(spark, folder, day_type="workdays", written=None):
    """Pairs of a day type; a query that needs several gives the counts and place features it has ``written``."""
    counts, known = written or (None, _place_features(spark, folder))
    t, index = TT.od_tensor_of(spark, folder, day_type, counts)
    factors = TT.fitted(t)
    table = index.join(V.locations(spark, folder), "name").join(known, "name")
    return learn.pair_features(t, factors[0], factors[1], table, FEATURES, MIN_VOLUME)


def pair_features(spark, folder):
    rows = _pairs(spark, folder)
    keep = ["i", "j"]
    return rows.select(*keep, *[F.round(c, 5).alias(c) for c in rows.columns if c not in keep])


def _reconstruct(spark, folder, model):
    """Shares of every pair and hour, predicted by trees that have not seen the pair's fold."""
    return learn.kfold(_pairs(spark, folder), model, 2).drop("fold")


def reconstruct_model1(spark, folder):
    return _reconstruct(spark, folder, "model1")


def reconstruct_model2(spark, folder):
    return _reconstruct(spark, folder, "model2")


def reconstruct_model3(spark, folder):
    return _reconstruct(spark, folder, "model3")


FOLDS = 10
DAY_TYPES = ("workdays", "holidays")
#: Feature sets that SQL can follow: the products of both ends' factors, and the distance.
SMALL_MODELS = {"model1": ["p0", "p1"], "distance": ["dist"]}


def _cases(spark, folder):
    """Pairs of both day types; the counts and place features, which both come from, are written once."""
    written = checkpointed(V.od_counts(spark, folder)), _place_features(spark, folder)
    return {d: _pairs(spark, folder, d, written) for d in DAY_TYPES}


def kfold_error(spark, folder):
    """Error of the three models on both day types, every pair predicted by a fit without its fold."""
    return TT.rounded(learn.error_by_model(learn.linear_kfold(_cases(spark, folder), FOLDS)), "error", digits=5)


def kfold_error_small(spark, folder):
    return TT.rounded(learn.error_by_model(learn.linear_kfold(_cases(spark, folder), FOLDS, SMALL_MODELS)), "error", digits=6)


def reconstruct_linear(spark, folder):
    """Shares of every pair and hour from the factor products, by linear fits that have not seen the pair's fold."""
    rows = learn.linear_kfold(_cases(spark, folder), FOLDS, {"model1": SMALL_MODELS["model1"]})
    return TT.rounded(rows, "y", "prediction", digits=4)


QUERIES = {f.__name__: f for f in (
    cp_als, cp_als_fine, ntf_bpp, ntf_as, ntf_fine, beta_ntf, beta_ntf_fine, beta_ntf_kl, beta_ntf_dense, projected_gradient, nvecs, hosvd,
    tucker_hooi, tucker_rank1, tucker_masked_gradient, component_strength, temporal_pattern, spatial_class, rank_sweep, edges, rescal,
    rescal_attributes, dedicom, indscal, matrix_factorization, pair_features, reconstruct_model1, reconstruct_model2,
    reconstruct_model3, kfold_error, kfold_error_small, reconstruct_linear)}

# ---- SQL counterparts -----------------------------------------------------------------------------
# Two components allow closed forms, so whole sweeps can be written as a chain of common table expressions.


def _model(names):
    return " + ".join("*".join(f"{n}.f{c}" for n in names) for c in range(2))


def _dense_update(mode, names, new):
    """Update for divergence 1.5, which needs the model at every cell."""
    others = [m for m in range(3) if m != mode]
    joins = " ".join(f"JOIN {names[m]} ON {names[m]}.idx = dense.{'ijk'[m]}" for m in range(3))
    sums = ", ".join(f"sum(v * pow(m, -0.5) * p{c}) AS n{c}, sum(pow(m, 0.5) * p{c}) AS d{c}" for c in range(2))
    part = ", ".join(f"{' * '.join(f'{names[m]}.f{c}' for m in others)} AS p{c}" for c in range(2))
    return [f"{new}_m AS MATERIALIZED (SELECT idx, {sums} FROM (SELECT dense.{'ijk'[mode]} AS idx, v, {_model(names)} AS m, {part} FROM dense {joins}) GROUP BY 1)",
            f"{new} AS MATERIALIZED (SELECT idx, " + ", ".join(f"f{c} * (1e-15 + n{c}) / (1e-15 + d{c}) AS f{c}" for c in range(2)) + f" FROM {names[mode]} JOIN {new}_m USING (idx))"]


def _chain(kind, sweeps, base="t"):
    """Table expressions of so many sweeps, and the names of the factors after each."""
    names, ctes, after = ["fa", "fb", "fc"], [], []
    for s in range(sweeps):
        for m in range(3):
            new = f"{LETTERS[m]}{s + 1}"
            if kind == "beta15":
                ctes += _dense_update(m, names, new)
            else:
                ratio = f"{base}.v / ({_model(names)})" if kind == "beta1" else None
                ctes += _half_sweep(kind, m, names, new, s, base=base, extra=ratio)
            names[m] = new
        after.append(tuple(names))
    return ctes, after


def _factor_tail(names, sizes, digits):
    return " UNION ALL ".join(
        f"SELECT {m}::INT AS mode, r.idx::BIGINT AS idx, round(coalesce(f0, 0), {digits}) AS f0, round(coalesce(f1, 0), {digits}) AS f1 FROM range({sizes[m]}) AS r(idx) LEFT JOIN {names[m]} USING (idx)"
        for m in range(3))


def sweeps_sql(kind, sweeps, head=None, sizes=TT.SIZES, facs=TT.FACS, digits=5, base="t"):
    """Factors after a fixed number of sweeps."""
    ctes, after = _chain(kind, sweeps, base)
    grid = TT.GRID if kind == "beta15" else ""
    return f"{head or TT.TENS}{facs}{grid}, {', '.join(ctes)} {_factor_tail(after[-1], sizes, digits)}"


def _overlap(names, base, weight):
    """Inner product of the tensor and the model, and the model's squared norm."""
    cells = " + ".join("*".join([weight[c], *[f"{n}.f{c}" for n in names]]) for c in range(2))
    xm = f"(SELECT sum({base}.v * ({cells})) FROM {base} " + " ".join(
        f"JOIN {n} ON {n}.idx = {base}.{'ijk'[m]}" for m, n in enumerate(names)) + "{0})"
    mm = " + ".join(f"{weight[a]} * {weight[b]} * " + " * ".join(_gram_sql(n, a, b) for n in names) for a in range(2) for b in range(2))
    return xm, f"({mm})"


def _squares(names, mode, base, project):
    """Sum of squares of the gradient of one factor; rows that the tensor does not touch have none when projected."""
    others = [m for m in range(3) if m != mode]
    x, y = (names[m] for m in others)
    h = [[f"{_gram_sql(x, a, b)} * {_gram_sql(y, a, b)}" for b in range(2)] for a in range(2)]
    sums = ", ".join(f"sum({base}.v * {x}.f{c} * {y}.f{c}) AS m{c}" for c in range(2))
    joins = " ".join(f"JOIN {names[m]} ON {names[m]}.idx = {base}.{'ijk'[m]}" for m in others)
    inner = f"SELECT {base}.{'ijk'[mode]} AS idx, {sums} FROM {base} {joins} GROUP BY 1"
    g = [f"(f0 * {h[0][c]} + f1 * {h[1][c]} - coalesce(m{c}, 0))" for c in range(2)]
    counted = [f"CASE WHEN {g[c]} < 0 OR f{c} > 0 THEN {g[c]} * {g[c]} ELSE 0 END" if project else f"{g[c]} * {g[c]}" for c in range(2)]
    return f"(SELECT sum({counted[0]} + {counted[1]}) FROM {names[mode]} LEFT JOIN ({inner}) USING (idx))"


def stopped_sql(kind, rule, most, least=0, tol=1e-5, head=None, sizes=TT.SIZES, facs=TT.FACS, digits=5, base="t", fit=False):
    """Factors after the sweep at which a stop rule holds first, out of ``most`` sweeps; ``least`` is the first one to ask.

    The rules: change of the fit (0), projected gradient against the first one (1), change of the relative error (2).
    """
    ctes, after = _chain(kind, most, base)
    size = f"(SELECT sum(v * v) FROM {base})"
    states = []
    for s in range(max(least - 1, 0), most):
        if rule == 1:
            state = "sqrt(" + " + ".join(_squares(after[s], m, base, True) for m in range(3)) + ") / (SELECT value FROM first)"
        else:
            weight = [f"l{c}" if kind == "cp" else "1.0" for c in range(2)]
            xm, mm = _overlap(after[s], base, weight)
            if kind == "cp":
                last = f"{LETTERS[2]}{s + 1}_l"
                mm = f"(SELECT {mm} FROM {last})"
                state = f"1 - ({size} + {mm} - 2 * {xm.format(', ' + last)}) / {size}"
            else:
                state = f"sqrt(greatest({size} + {mm} - 2 * {xm.format('')}, 0)) / sqrt({size})"
        states.append(f"SELECT {s} AS s, {state} AS value")
    if rule == 1:
        first = " + ".join(_squares(("fa", "fb", "fc"), m, base, False) for m in range(3))
        ctes.append(f"first AS MATERIALIZED (SELECT sqrt({first}) AS value)")
    ctes.append(f"states AS MATERIALIZED ({' UNION ALL '.join(states)})")
    met = f"value < {tol}" if rule == 1 else f"abs(value - lag(value) OVER (ORDER BY s)) < {tol}"
    ctes.append(f"asked AS (SELECT s, value, {met} AS met FROM states)")
    ctes.append(f"stop AS MATERIALIZED (SELECT coalesce(min(s), {most - 1}) AS s FROM asked WHERE met AND s >= {least})")
    tail = " UNION ALL ".join(f"SELECT q.* FROM ({_factor_tail(after[s], sizes, digits)}) q, stop WHERE stop.s = {s}"
                              for s in range(max(least, 1), most))
    more = ", round(value, 5) AS fit" if fit else ""
    return (f"{head or TT.TENS}{facs}, {', '.join(ctes)} SELECT q.*{more}, (stop.s + 1)::INT AS sweeps FROM ({tail}) q, stop "
            f"JOIN states USING (s)")


FINE_SIZES = ("(SELECT count(*) + 1 FROM supplier)", "(SELECT count(*) + 1 FROM customer)", "24")
FINE_HEAD = "WITH " + V.OD_FINE
FINE_FACS = ", " + ", ".join(
    f"f{'abc'[m]} AS MATERIALIZED (SELECT idx::BIGINT AS idx, {TT.start_sql(m, 0)} AS f0, {TT.start_sql(m, 1)} AS f1 FROM range({FINE_SIZES[m]}) AS r(idx))" for m in range(3))
EDGE_HEAD = f"""WITH {V.EDGES}, e AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY k) - 1 AS k, s, o FROM edges),
  a0 AS (SELECT idx, {TT.start_sql(0, 0)} AS f0, {TT.start_sql(0, 1)} AS f1 FROM range((SELECT count(*) FROM nation)) AS r(idx))"""


def _products(name, a):
    cols = ", ".join(f"sum(x.f{p} * y.f{q}) AS s{p}{q}" for p in range(2) for q in range(2))
    return f"{name} AS MATERIALIZED (SELECT k, {cols} FROM e JOIN {a} x ON x.idx = e.s JOIN {a} y ON y.idx = e.o GROUP BY k)"


def _g(name, a):
    return f"{name} AS MATERIALIZED (SELECT sum(f0 * f0) AS g00, sum(f0 * f1) AS g01, sum(f1 * f1) AS g11 FROM {a})"


def _matmul(a, b):
    return [[f"({a[x][0]} * {b[0][y]} + {a[x][1]} * {b[1][y]})" for y in range(2)] for x in range(2)]


def _t2(a):
    return [[a[0][0], a[1][0]], [a[0][1], a[1][1]]]


def _stop_ctes(fits, conv, least=1):
    """The first sweep, from the second one on, after which the fit changes by less than ``conv``."""
    states = " UNION ALL ".join(f"SELECT {n} AS s, ({fit}) AS value" for n, fit in enumerate(fits))
    return [f"states AS MATERIALIZED ({states})",
            f"asked AS (SELECT s, abs(value - lag(value) OVER (ORDER BY s)) < {conv} AS met FROM states)",
            f"stop AS MATERIALIZED (SELECT coalesce(min(s), {len(fits) - 1}) AS s FROM asked WHERE met AND s >= {least})"]


def _at_stop(parts):
    """The rows of the sweep that the stop rule picks."""
    return " UNION ALL ".join(f"SELECT q.*, {n + 1}::INT AS sweeps FROM ({sql}) q, stop WHERE stop.s = {n}" for n, sql in enumerate(parts))


ATTRIBUTES = """w AS MATERIALIZED (SELECT c_nationkey AS e, c_mktsegment AS a, count(*)::DOUBLE AS w FROM customer GROUP BY ALL)"""


def rescal_sql(most, attributes=False, penalty=0.0):
    """RESCAL with two components; ridge terms go through the eigenvectors of the 2 x 2 Gram matrix."""
    ctes, fits, ends, a = ["nk AS MATERIALIZED (SELECT k, count(*)::DOUBLE AS n FROM e GROUP BY k)"], [], [], "a0"
    s, g, r = [["s00", "s01"], ["s10", "s11"]], [["g00", "g01"], ["g01", "g11"]], [["r00", "r01"], ["r10", "r11"]]
    v, l = [["c", "-d"], ["d", "c"]], ["l0", "l1"]

    def state(n, a):
        """Gram matrix, slice products, R_k and, with attributes, Z for a factor."""
        found = [_g(f"g{n}", a), _products(f"p{n}", a)]
        found.append(f"v{n} AS MATERIALIZED (SELECT *, c * c * g00 + 2 * c * d * g01 + d * d * g11 AS l0, d * d * g00 - 2 * c * d * g01 + c * c * g11 AS l1 "
                     f"FROM (SELECT *, cos(0.5 * atan2(2 * g01, g00 - g11)) AS c, sin(0.5 * atan2(2 * g01, g00 - g11)) AS d FROM g{n}))")
        turned = _matmul(_matmul(_t2(v), s), v)
        found.append(f"u{n} AS MATERIALIZED (SELECT k, c, d, " + ", ".join(
            f"{turned[x][y]} / ({l[x]} * {l[y]} + {penalty}) AS r{x}{y}" for x in range(2) for y in range(2)) + f" FROM p{n}, v{n})")
        back = _matmul(_matmul(v, r), _t2(v))
        found.append(f"r{n} AS MATERIALIZED (SELECT k, " + ", ".join(f"{back[x][y]} AS r{x}{y}" for x in range(2) for y in range(2)) + f" FROM u{n})")
        if attributes:
            det = f"((g00 + {penalty}) * (g11 + {penalty}) - g01 * g01)"
            found.append(f"y{n} AS MATERIALIZED (SELECT w.a, sum(w * f0) AS f0, sum(w * f1) AS f1 FROM w JOIN {a} x ON x.idx = w.e GROUP BY w.a)")
            found.append(f"z{n} AS MATERIALIZED (SELECT a, (f0 * (g11 + {penalty}) - f1 * g01) / {det} AS z0, (f1 * (g00 + {penalty}) - f0 * g01) / {det} AS z1 FROM y{n}, g{n})")
        return found

    ctes += state(0, a)
    for n in range(most):
        e1, e2 = _matmul(_matmul(r, g), _t2(r)), _matmul(_matmul(_t2(r), g), r)
        more = [[f" + (SELECT sum(z{x} * z{y}) FROM z{n})" if attributes else "" for y in range(2)] for x in range(2)]
        ctes.append(f"e{n} AS MATERIALIZED (SELECT " + ", ".join(
            f"sum({e1[x][y]} + {e2[x][y]}){more[x][y]}{f' + {penalty}' if x == y else ''} AS e{x}{y}" for x in range(2) for y in range(2)) + f" FROM r{n}, g{n})")
        extra = f"UNION ALL SELECT w.e, w * z0, w * z1 FROM w JOIN z{n} USING (a)" if attributes else ""
        ctes.append(f"""f{n} AS MATERIALIZED (SELECT idx, sum(f0) AS f0, sum(f1) AS f1 FROM (
          SELECT e.s AS idx, a.f0 * r00 + a.f1 * r01 AS f0, a.f0 * r10 + a.f1 * r11 AS f1 FROM e JOIN {a} a ON a.idx = e.o JOIN r{n} USING (k) UNION ALL
          SELECT e.o, a.f0 * r00 + a.f1 * r10, a.f0 * r01 + a.f1 * r11 FROM e JOIN {a} a ON a.idx = e.s JOIN r{n} USING (k) {extra}) GROUP BY idx)""")
        a = f"a{n + 1}"
        det = "(e00 * e11 - e01 * e10)"
        ctes.append(f"{a} AS MATERIALIZED (SELECT idx::BIGINT AS idx, (f0 * e11 - f1 * e10) / {det} AS f0, (f1 * e00 - f0 * e01) / {det} AS f1 FROM f{n}, e{n})")
        ctes += state(n + 1, a)
        model = _matmul(_matmul(g, r), g)
        cells = [(x, y) for x in range(2) for y in range(2)]
        gap = f"n - 2 * ({' + '.join(f'{r[x][y]} * {s[x][y]}' for x, y in cells)}) + {' + '.join(f'{r[x][y]} * {model[x][y]}' for x, y in cells)}"
        size = " + ".join(f"{r[x][y]} * {r[x][y]}" for x, y in cells)
        fits.append(f"SELECT max({penalty} * (g00 + g11)) + sum(({gap}) / n + {penalty} * ({size})) FROM r{n + 1} JOIN p{n + 1} USING (k) JOIN nk USING (k), g{n + 1}")
        ends.append(f"SELECT 0::INT AS l, a, round(z0, 3) AS z0, round(z1, 3) AS z1 FROM z{n + 1}" if attributes else
                    f"SELECT idx, round(f0, 4) AS f0, round(f1, 4) AS f1 FROM {a}")
    ctes += _stop_ctes(fits, 1e-4)
    head = EDGE_HEAD + (", " + ATTRIBUTES if attributes else "")
    return f"{head}, {', '.join(ctes)} {_at_stop(ends)}"


def indscal_sql(most):
    def polar(new, old, g):
        det = "(g00 * g11 - g01 * g01)"
        # Inverse root of a 2x2 matrix M: adjugate of (M + sqrt(det) I) over sqrt(det * (trace + 2 sqrt(det))).
        low = f"sqrt({det} * (g00 + g11 + 2 * sqrt({det})))"
        return [_g(g, old), f"{new} AS MATERIALIZED (SELECT idx, (f0 * (g11 + sqrt({det})) - f1 * g01) / {low} AS f0, (f1 * (g00 + sqrt({det})) - f0 * g01) / {low} AS f1 FROM {old}, {g})"]
    ctes, fits, ends, a = polar("b0", "a0", "gg"), [], [], "b0"
    ctes.append(_products("p0", a))
    total = "(SELECT count(*)::DOUBLE FROM e)"
    for n in range(most):
        ctes.append(f"c{n} AS MATERIALIZED (SELECT e.s AS idx, sum(f0 * greatest(s00, 0)) AS f0, sum(f1 * greatest(s11, 0)) AS f1 FROM e JOIN {a} ON idx = e.o JOIN p{n} USING (k) GROUP BY 1)")
        a = f"b{n + 1}"
        ctes += polar(a, f"c{n}", f"q{n}")
        ctes += [_products(f"p{n + 1}", a), _g(f"o{n}", a)]
        d0, d1 = "greatest(x.s00, 0)", "greatest(x.s11, 0)"
        fits.append(f"SELECT 1 - ({total} - 2 * sum({d0} * y.s00 + {d1} * y.s11) + sum({d0} * {d0} * g00 * g00 + 2 * {d0} * {d1} * g01 * g01 + {d1} * {d1} * g11 * g11)) / {total} "
                    f"FROM p{n} x JOIN p{n + 1} y USING (k), o{n}")
        ends.append(f"SELECT idx::BIGINT AS idx, round(f0, 4) AS f0, round(f1, 4) AS f1 FROM {a}")
    ctes += _stop_ctes(fits, 1e-7)
    return f"{EDGE_HEAD}, {', '.join(ctes)} {_at_stop(ends)}"


_share = [f"f{c} / (f0 + f1) - (sum(f{c}) OVER ()) / (sum(f0 + f1) OVER ())" for c in range(2)]


def _weights_sql():
    """The spline weights as a table (step, idx, w), from the same end condition."""
    w = patterns.spline_basis(24, patterns.spline_xs(24))
    rows = ", ".join("[" + ", ".join(f"{x:.15g}" for x in line) + "]" for line in w)
    return f"wl AS (SELECT unnest([{rows}]::DOUBLE[][]) AS w, unnest(range({len(w)})) AS step), ws AS (SELECT step::INT AS step, unnest(range(24)) AS idx, unnest(w) AS w FROM wl)"


def _pair_sql():
    ys = ", ".join(f"round(sum(CASE WHEN k = {k} THEN v ELSE 0 END) * 100.0 / sum(v), 5) AS y{k}" for k in range(24))
    nf = ", ".join(f"coalesce({f} / nullif(sum({f}) OVER (), 0), 0) - coalesce(({PP._rowsum}) / nullif({PP._grand}, 0), 0) AS x{n}" for n, f in enumerate(FEATURES))
    cols = ", ".join(f"round(s.x{n}, 5) AS sx{n}, round(d.x{n}, 5) AS dx{n}" for n in range(len(FEATURES)))
    dist = V.haversine_sql("s.lng", "s.lat", "d.lng", "d.lat", "6400.0")
    near = PP.NEAR.replace(V.LOCATIONS + ", ", "", 1)
    return f"""{TT.TENS}{TT.FITTED}, {near.replace(V.LOCATIONS + ',', '')}, nf AS (SELECT name, {nf} FROM rc),
      pl AS (SELECT idx, lng, lat, nf.* FROM names JOIN locations USING (name) JOIN nf USING (name)),
      pv AS (SELECT i, j, round(sum(v), 5) AS volume, {ys} FROM t WHERE i <> j GROUP BY i, j HAVING sum(v) >= {MIN_VOLUME})
      SELECT pv.*, round({dist} / 1000, 5) AS dist, {', '.join(f'round(fa.f{c}, 5) AS sf{c}, round(fb.f{c}, 5) AS df{c}' for c in range(2))}, {cols}
      FROM pv JOIN pl s ON s.idx = i JOIN pl d ON d.idx = j JOIN fa ON fa.idx = i JOIN fb ON fb.idx = j"""


def _fold_case(day_type):
    """Predictions of the small models on one day type: normal equations by fold and hour, total less own, solved by Cramer's rule."""
    near = PP.NEAR.replace(V.LOCATIONS + ", ", "", 1).replace(V.LOCATIONS + ",", "")
    dist = V.haversine_sql("s.lng", "s.lat", "d.lng", "d.lat", "6400.0")
    shares = ", ".join(f"sum(CASE WHEN k = {k} THEN v ELSE 0 END) * 100.0 / sum(v)" for k in range(24))
    x = {"model1": ["x1", "x2"], "distance": ["x3"]}
    moments = {"n": "count(*)", **{f"s{a}": f"sum(x{a})" for a in (1, 2, 3)}, "s11": "sum(x1 * x1)", "s12": "sum(x1 * x2)",
               "s22": "sum(x2 * x2)", "s33": "sum(x3 * x3)", "y": "sum(y)", **{f"y{a}": f"sum(x{a} * y)" for a in (1, 2, 3)}}
    det = lambda m: (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"  # noqa: E731
                     f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")
    m, right = [["n", "s1", "s2"], ["s1", "s11", "s12"], ["s2", "s12", "s22"]], ["y", "y1", "y2"]
    put = lambda c: [[right[r] if k == c else m[r][k] for k in range(3)] for r in range(3)]
    weights = ", ".join(f"{det(put(c))} / {det(m)} AS b{c}" for c in range(3))
    return f"""({TT.tens_sql(day_type)}{TT.FITTED}, {near},
      pl AS (SELECT idx, lng, lat FROM names JOIN locations USING (name)),
      pv AS (SELECT i, j, [{shares}] AS ys FROM t WHERE i <> j GROUP BY i, j HAVING sum(v) >= {MIN_VOLUME}),
      px AS (SELECT i, j, ys, fa.f0 * fb.f0 AS x1, fa.f1 * fb.f1 AS x2, {dist} / 1000 AS x3, row_number() OVER (ORDER BY i, j) - 1 AS place, count(*) OVER () AS total
        FROM pv JOIN pl s ON s.idx = i JOIN pl d ON d.idx = j JOIN fa ON fa.idx = i JOIN fb ON fb.idx = j),
      pf AS MATERIALIZED (SELECT *, (CASE WHEN place < (total // {FOLDS} + 1) * (total % {FOLDS}) THEN place // (total // {FOLDS} + 1)
        ELSE total % {FOLDS} + (place - (total // {FOLDS} + 1) * (total % {FOLDS})) // greatest(total // {FOLDS}, 1) END)::INT AS fold FROM px),
      ph AS MATERIALIZED (SELECT i, j, fold, x1, x2, x3, unnest(range(24))::INT AS hour, unnest(ys) AS y FROM pf),
      own AS (SELECT fold, hour, {', '.join(f'{e} AS {n}' for n, e in moments.items())} FROM ph GROUP BY ALL),
      rest AS (SELECT fold, hour, {', '.join(f'sum({n}) OVER (PARTITION BY hour) - {n} AS {n}' for n in moments)} FROM own),
      w AS (SELECT fold, hour, {weights}, (y * s33 - s3 * y3) / (n * s33 - s3 * s3) AS d0, (n * y3 - s3 * y) / (n * s33 - s3 * s3) AS d1 FROM rest)
      SELECT '{day_type}' AS "case", i, j, fold, hour, y, b0 + b1 * x1 + b2 * x2 AS model1, d0 + d1 * x3 AS distance FROM ph JOIN w USING (fold, hour))"""


def _fold_rows(models):
    cases = " UNION ALL ".join(f"SELECT * FROM {_fold_case(d)}" for d in DAY_TYPES)
    return " UNION ALL ".join(f"SELECT \"case\", '{m}' AS model, i, j, fold, hour, y, {m} AS prediction FROM scored" for m in models), cases


def reconstruct_linear_sql():
    rows, cases = _fold_rows(["model1"])
    return f"WITH scored AS MATERIALIZED ({cases}) SELECT \"case\", model, i, j, fold, hour, round(y, 4) AS y, round(prediction, 4) AS prediction FROM ({rows})"


def kfold_small_sql():
    rows, cases = _fold_rows(["model1", "distance"])
    return f"WITH scored AS MATERIALIZED ({cases}) SELECT \"case\", model, count(*)::BIGINT AS n, round(sum(abs(prediction - y)) / sum(y), 6) AS error FROM ({rows}) GROUP BY ALL"


def _power_sql(steps=40):
    """Power iteration for the leading vector of the hour mode."""
    ctes, x = ["p0 AS (SELECT idx::BIGINT AS idx, 1.0::DOUBLE AS x FROM range(24) AS r(idx))"], "p0"
    for n in range(steps):
        ctes.append(f"y{n} AS MATERIALIZED (SELECT i, j, sum(v * x) AS y FROM t JOIN {x} ON idx = k GROUP BY i, j)")
        ctes.append(f"z{n} AS MATERIALIZED (SELECT k AS idx, sum(v * y) AS x FROM t JOIN y{n} USING (i, j) GROUP BY k)")
        x = f"p{n + 1}"
        ctes.append(f"{x} AS MATERIALIZED (SELECT idx, x / sqrt(sum(x * x) OVER ()) AS x FROM z{n})")
    return f"{TT.TENS}, {', '.join(ctes)} SELECT idx, round(x, 5) AS f0 FROM {x}"


def _signed_sql(name, source):
    """Columns turned so that the entry of largest magnitude is positive."""
    turns = ", ".join(f"arg_max(sign(f{c}), abs(f{c})) AS s{c}" for c in range(2))
    return f"{name} AS MATERIALIZED (SELECT idx, f0 * s0 AS f0, f1 * s1 AS f1 FROM {source}, (SELECT {turns} FROM {source}))"


def _leading_sql(name, gram, size, squarings=13):
    """Unit eigenvector ``v0, v1, ...`` and value ``l`` of the largest eigenvalue of a small matrix ``g00, g01, ...`` in one row, by
    repeated squaring: the column of the power with the largest diagonal entry."""
    cells = [(x, y) for x in range(size) for y in range(x, size)]
    at = lambda x, y, p: f"{p}{min(x, y)}{max(x, y)}"
    square = {c: " + ".join(f"{at(c[0], z, 'x')} * {at(z, c[1], 'x')}" for z in range(size)) for c in cells}
    trace = " + ".join(at(x, x, "x") for x in range(size))
    rows = ", ".join(f"({square[c]}) / pow({trace}, 2)" for c in cells)
    power = (f"{name}_p(n, {', '.join(at(*c, 'x') for c in cells)}) AS (SELECT 0, {', '.join(at(*c, 'g') for c in cells)} FROM {gram} "
             f"UNION ALL SELECT n + 1, {rows} FROM {name}_p WHERE n < {squarings})")
    largest = f"greatest({', '.join(at(x, x, 'x') for x in range(size))})"
    entry = {y: "CASE " + " ".join(f"WHEN {at(x, x, 'x')} = {largest} THEN {at(x, y, 'x')}" for x in range(size)) + " END" for y in range(size)}
    vector = f"{name}_u AS MATERIALIZED (SELECT " + ", ".join(f"({entry[y]}) / sqrt({largest}) AS u{y}" for y in range(size)) + f" FROM {name}_p WHERE n = {squarings})"
    length = "sqrt(" + " + ".join(f"u{y} * u{y}" for y in range(size)) + ")"
    value = " + ".join(f"u{x} * u{y} * {at(x, y, 'g')}" for x in range(size) for y in range(size))
    return [power, vector, f"{name} AS MATERIALIZED (SELECT " + ", ".join(f"u{y} / {length} AS v{y}" for y in range(size))
            + f", ({value}) / pow({length}, 2) AS l FROM {name}_u, {gram})"]


def hooi_sql(most, conv=1e-7):
    """Orthogonal iteration with two components; singular vectors by repeated squaring and deflation."""
    names, ctes, fits, ends = ["fa", "fb", "fc"], [], [], []
    cells = [(x, y) for x in range(4) for y in range(x, 4)]
    for s in range(most):
        for m in range(3):
            new, others = f"{LETTERS[m]}{s + 1}", [o for o in range(3) if o != m]
            x, y = (names[o] for o in others)
            joins = " ".join(f"JOIN {names[o]} ON {names[o]}.idx = t.{'ijk'[o]}" for o in others)
            wide = ", ".join(f"sum(v * {x}.f{b} * {y}.f{c}) AS w{2 * b + c}" for b in range(2) for c in range(2))
            ctes.append(f"{new}_w AS MATERIALIZED (SELECT t.{'ijk'[m]} AS idx, {wide} FROM t {joins} GROUP BY 1)")
            ctes.append(f"{new}_g AS MATERIALIZED (SELECT {', '.join(f'sum(w{a} * w{b}) AS g{a}{b}' for a, b in cells)} FROM {new}_w)")
            ctes += _leading_sql(f"{new}_1", f"{new}_g", 4)
            ctes.append(f"{new}_h AS MATERIALIZED (SELECT {', '.join(f'g{a}{b} - l * v{a} * v{b} AS g{a}{b}' for a, b in cells)} FROM {new}_g, {new}_1)")
            ctes += _leading_sql(f"{new}_2", f"{new}_h", 4)
            sides = ", ".join("(" + " + ".join(f"w{a} * e{c}.v{a}" for a in range(4)) + f") / sqrt(e{c}.l) AS f{c}" for c in range(2))
            ctes.append(f"{new} AS MATERIALIZED (SELECT idx, {sides} FROM {new}_w, {new}_1 e0, {new}_2 e1)")
            names[m] = new
        fits.append(f"SELECT 1 - sqrt(greatest((SELECT sum(v * v) FROM t) - (SELECT l FROM {new}_1) - (SELECT l FROM {new}_2), 0)) / sqrt((SELECT sum(v * v) FROM t))")
        signed = [f"(WITH {_signed_sql('q', n)} SELECT * FROM q)" for n in names]
        ends.append(" UNION ALL ".join(
            f"SELECT {m}::INT AS mode, r.idx::BIGINT AS idx, round(coalesce(f0, 0), 3) AS f0, round(coalesce(f1, 0), 3) AS f1 FROM range({TT.SIZES[m]}) AS r(idx) LEFT JOIN {signed[m]} USING (idx)"
            for m in range(3)))
    ctes += _stop_ctes(fits, conv, 2)
    head = TT.TENS.replace("WITH ", "WITH RECURSIVE ", 1)
    return (f"{head}{TT.FACS}, {', '.join(ctes)} SELECT z.*, round(value, 4) AS fit FROM ({_at_stop(ends)}) z, stop JOIN states USING (s)")


def hosvd_sql(squarings=13):
    """The core of the tensor in the leading vectors of its unfoldings, found by repeated squaring of their Gram matrices."""
    ctes = []
    for m, letter in enumerate(LETTERS):
        key, rest = "ijk"[m], [k for k in "ijk" if k != "ijk"[m]]
        same = " AND ".join(f"x.{k} = y.{k}" for k in rest)
        gram = f"{letter}_g0"
        ctes.append(f"{gram} AS MATERIALIZED (SELECT x.{key} AS a, y.{key} AS b, sum(x.v * y.v) AS x FROM t x JOIN t y ON {same} GROUP BY 1, 2)")
        for c in range(2):
            now = gram
            for n in range(squarings):
                new = f"{letter}_q{c}_{n}"
                ctes.append(f"{new} AS MATERIALIZED (SELECT p.a, q.b, sum(p.x * q.x) / (SELECT pow(sum(x), 2) FROM {now} WHERE a = b) AS x FROM {now} p JOIN {now} q ON p.b = q.a GROUP BY 1, 2)")
                now = new
            top = f"(SELECT arg_max(a, x) FROM {now} WHERE a = b)"
            ctes.append(f"{letter}_u{c} AS MATERIALIZED (SELECT a, x / sqrt((SELECT sum(x * x) FROM {now} WHERE b = {top})) AS x FROM {now} WHERE b = {top})")
            if c == 0:
                value = f"(SELECT sum(g.x * p.x * q.x) FROM {gram} g JOIN {letter}_u0 p ON p.a = g.a JOIN {letter}_u0 q ON q.a = g.b)"
                ctes.append(f"{letter}_l AS MATERIALIZED (SELECT {value} AS l)")
                ctes.append(f"{letter}_g1 AS MATERIALIZED (SELECT g.a, g.b, g.x - l * p.x * q.x AS x FROM {gram} g JOIN {letter}_u0 p ON p.a = g.a JOIN {letter}_u0 q ON q.a = g.b, {letter}_l)")
                gram = f"{letter}_g1"
        ctes.append(f"{letter}_f AS MATERIALIZED (SELECT p.a AS idx, p.x AS f0, q.x AS f1 FROM {letter}_u0 p JOIN {letter}_u1 q ON p.a = q.a)")
        ctes.append(_signed_sql(f"{letter}_s", f"{letter}_f"))
    joins = " ".join(f"JOIN {x}_s ON {x}_s.idx = t.{k}" for x, k in zip(LETTERS, "ijk"))
    core = " UNION ALL ".join(f"SELECT {a}::BIGINT AS i, {b}::BIGINT AS j, {c}::BIGINT AS k, round(sum(v * a_s.f{a} * b_s.f{b} * c_s.f{c}), 3) AS v FROM t {joins}"
                              for a in range(2) for b in range(2) for c in range(2))
    return f"{TT.TENS}, {', '.join(ctes)} {core}"


def _rank1_sql(sweeps=2):
    names, ctes = ["fa", "fb", "fc"], []
    for s in range(sweeps):
        for m in range(3):
            new, others = f"{LETTERS[m]}{s + 1}", [o for o in range(3) if o != m]
            joins = " ".join(f"JOIN {names[o]} ON {names[o]}.idx = t.{'ijk'[o]}" for o in others)
            ctes.append(f"{new}_m AS MATERIALIZED (SELECT t.{'ijk'[m]} AS idx, sum(v * {' * '.join(names[o] + '.f0' for o in others)}) AS f0 FROM t {joins} GROUP BY 1)")
            ctes.append(f"{new} AS MATERIALIZED (SELECT idx, f0 / sqrt(sum(f0 * f0) OVER ()) AS f0 FROM {new}_m)")
            names[m] = new
    tail = " UNION ALL ".join(f"SELECT {m}::INT AS mode, r.idx::BIGINT AS idx, round(coalesce(f0, 0), 5) AS f0 FROM range({TT.SIZES[m]}) AS r(idx) LEFT JOIN {names[m]} USING (idx)" for m in range(3))
    return f"{TT.TENS}{TT.FACS}, {', '.join(ctes)} SELECT q.*, (SELECT round(sqrt(sum(f0 * f0)), 4) FROM {names[2]}_m) AS core FROM ({tail}) q"


SQL = {
    "nvecs": _power_sql(),
    "reconstruct_linear": reconstruct_linear_sql(),
    "kfold_error_small": kfold_small_sql(),
    "hosvd": hosvd_sql(),
    "tucker_hooi": hooi_sql(24),
    "tucker_rank1": _rank1_sql(),
    "cp_als": stopped_sql("cp", 0, 16, fit=True),
    "cp_als_fine": stopped_sql("cp", 0, 16, head=FINE_HEAD, sizes=FINE_SIZES, facs=FINE_FACS, digits=4, base="od_fine"),
    "ntf_bpp": stopped_sql("ntf", 2, 26, 21, 1e-4),
    "ntf_as": stopped_sql("ntf", 2, 26, 21, 1e-4),
    "ntf_fine": stopped_sql("ntf", 1, 24, 20, 1e-4, FINE_HEAD, FINE_SIZES, FINE_FACS, 4, "od_fine"),
    "beta_ntf": sweeps_sql("beta2", 50),
    "beta_ntf_kl": sweeps_sql("beta1", 50),
    "beta_ntf_dense": sweeps_sql("beta15", 50),
    "beta_ntf_fine": sweeps_sql("beta1", 50, FINE_HEAD, FINE_SIZES, FINE_FACS, 4, "od_fine"),
    "projected_gradient": f"""{TT.TENS}{TT.FACS}, mk AS ({TT.mttkrp_sql(0)}),
      hh AS (SELECT {', '.join(f"(SELECT sum(f{a} * f{b}) FROM fb) * (SELECT sum(f{a} * f{b}) FROM fc) AS h{a}{b}" for a in range(2) for b in range(2))}),
      gd AS (SELECT fa.idx, fa.f0 AS x0, fa.f1 AS x1, fa.f0 * h00 + fa.f1 * h10 - coalesce(mk.f0, 0) AS g0, fa.f0 * h01 + fa.f1 * h11 - coalesce(mk.f1, 0) AS g1 FROM fa LEFT JOIN mk USING (idx), hh)
      SELECT idx, round(CASE WHEN g0 < 0 OR x0 > 0 THEN g0 ELSE 0 END, 4) AS f0, round(CASE WHEN g1 < 0 OR x1 > 0 THEN g1 ELSE 0 END, 4) AS f1 FROM gd""",
    "component_strength": f"{TT.TENS}{TT.FITTED} " + " UNION ALL ".join(f"SELECT {c}::INT AS component, round((SELECT sum(f{c}) FROM fa) * (SELECT sum(f{c}) FROM fb) * (SELECT sum(f{c}) FROM fc), 3) AS strength" for c in range(2)),
    "temporal_pattern": f"""{TT.TENS}{TT.FITTED}, {_weights_sql()},
      cv AS ({' UNION ALL '.join(f"SELECT {c}::INT AS component, idx, f{c} * 100.0 / max(f{c}) OVER () AS value FROM fc" for c in range(2))})
      SELECT component, step, round(sum(value * w), 4) AS value FROM cv JOIN ws USING (idx) GROUP BY ALL""",
    "spatial_class": f"""{TT.TENS}{TT.FITTED}, sh AS (SELECT idx, {', '.join(f'{x} AS s{c}' for c, x in enumerate(_share))} FROM fa),
      cl AS (SELECT idx, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END::INT AS class FROM sh),
      mg AS (SELECT i AS idx, sum(v) AS total FROM t GROUP BY i)
      SELECT name, idx::BIGINT AS idx, class, round(total, 4) AS total, trunc(0.99::DOUBLE * (total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()) * 20)::INT AS bucket FROM cl JOIN mg USING (idx) JOIN names USING (idx)""",
    "edges": f"{EDGE_HEAD} SELECT k::INT AS k, s, o, 1.0::DOUBLE AS v FROM e",
    "rescal": rescal_sql(8),
    "rescal_attributes": rescal_sql(70, True, 0.1),
    "indscal": indscal_sql(50),
    "pair_features": _pair_sql(),
}
