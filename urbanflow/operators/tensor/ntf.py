"""Nonnegative CP by alternating nonnegative least squares, and multiplicative updates for beta divergences."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import mul

import numpy as np
from pyspark.sql import functions as F

from urbanflow.operators.tensor.algebra import (Factor, Kruskal, all_rows, beside, beta_divergence, divergence, gram, inner,
                                                kruskal_cells, model_sql, mttkrp, number, product_sql,
                                                rel_frobenius, start_factor, times_sql)
from urbanflow.operators.tensor.layout import ModeCopies
from urbanflow.operators.tensor.nnls import nnls_rows
from urbanflow.operators.tensor.packed import PackedCells, can_pack
from urbanflow.operators.tensor.sweep import FactorStore
from urbanflow.operators.tensor.table import Tensor, densify


@dataclass
class NTFResult:
    model: Kruskal
    iterations: int
    rel_error: float
    criterion: float | None = None


def gradient(t: Tensor, factors: list[Factor], grams: list[np.ndarray], mode: int, project: bool) -> Factor:
    """Gradient of one factor; projected, entries count only where they point inwards or the factor is positive."""
    return _gradient(mttkrp(t, factors, mode), factors, grams, mode, project)


def _gradient(right: Factor, factors: list[Factor], grams: list[np.ndarray], mode: int, project: bool) -> Factor:
    h = reduce(mul, [g for m, g in enumerate(grams) if m != mode])
    f = factors[mode]
    side = right.df.selectExpr("idx", *[f"{c} as g{s}" for s, c in enumerate(right.columns)])
    both = all_rows(f).df.join(beside(side, right.rows), "idx", "left").na.fill(0.0)
    out = []
    for c, model in enumerate(times_sql(h)):
        g = f"({model} - g{c})"
        out.append((f"case when {g} < 0 or f{c} > 0 then {g} else 0D end" if project else g) + f" as f{c}")
    return Factor(both.selectExpr("idx", *out), f.rows, f.rank)


def gradient_norm(t: Tensor, factors: list[Factor], grams: list[np.ndarray], project: bool) -> float:
    """Norm of the gradient over all factors."""
    return _gradient_norm(lambda mode: mttkrp(t, factors, mode), factors, grams, project)


def _gradient_norm(right: Callable[[int], Factor], factors: list[Factor], grams: list[np.ndarray], project: bool) -> float:
    """Norm of the gradient over all factors, in one job; ``right`` gives the MTTKRP of a mode."""
    parts = None
    for mode in range(len(factors)):
        g = _gradient(right(mode), factors, grams, mode, project)
        part = g.df.agg(F.expr("sum(" + " + ".join(f"{c} * {c}" for c in g.columns) + ")").alias("square"))
        parts = part if parts is None else parts.unionByName(part)
    return float(parts.agg(F.sum("square")).first()[0] or 0.0) ** 0.5


def ntf(t: Tensor, rank: int, method: str = "anls_bpp", tol: float = 1e-4, stop_criterion: int = 1, min_iter: int = 20,
        max_iter: int = 200, max_time: float | None = None, init: list[Factor] | None = None,
        order_ways: list[int] | None = None) -> NTFResult:
    """Alternate over the modes, solving all rows of one factor exactly given the others; one job each.

    Stop rules after ``min_iter`` sweeps: (1) projected gradient relative to the first gradient, which takes one job more,
    (2) change of the relative error, (3) relative error below 1; the error comes with the last half-sweep.
    ``max_time`` (seconds) ends the fit too; without it the result does not depend on the machine.
    """
    spark = t.df.sparkSession
    ways = list(range(t.order)) if order_ways is None else list(order_ways)
    store = FactorStore(init or [start_factor(spark, m, n, rank) for m, n in enumerate(t.shape)])
    store.grams = [gram(f) for f in store.factors]
    began, error, criterion, sweep = time.time(), None, None, 0
    products = tuple(f"sum(f{c} * g{c})" for c in range(rank))
    with ModeCopies(t) as copies:
        norm_x = copies.norm()
        now = lambda mode: copies.mttkrp(store.factors, mode)
        first = _gradient_norm(now, store.factors, store.grams, False) if stop_criterion == 1 else 1.0
        zero = ways[0]
        store.factors[zero] = Factor(store.factors[zero].df.select(
            "idx", *[F.lit(0.0).alias(c) for c in store.factors[zero].columns]), t.shape[zero], rank)
        store.grams[zero] = np.zeros((rank, rank))
        for sweep in range(max_iter):
            before, product_xm = error, 0.0
            for mode in ways:
                right = copies.mttkrp(store.factors, mode)
                warm = None if sweep == 0 else store.factors[mode]
                solved = nnls_rows(right, store.hadamard(mode), method, warm, keep="g")
                product_xm = sum(v or 0.0 for v in store.put(mode, solved, products))
            model_sq = float(reduce(mul, store.grams).sum())
            error = rel_frobenius(norm_x, max(model_sq, 0.0) ** 0.5, product_xm)
            if sweep < min_iter:
                continue
            if max_time is not None and time.time() - began > max_time:
                break
            if stop_criterion == 1:
                criterion = _gradient_norm(now, store.factors, store.grams, True) / first
                if criterion < tol:
                    break
            elif stop_criterion == 2:
                if sweep > min_iter and abs(before - error) < tol:
                    break
            elif error < 1:
                break
    return NTFResult(Kruskal(store.factors, np.ones(rank)), sweep + 1, error, criterion)


def beta_ntf(t: Tensor, rank: int, beta: float = 2, n_iter: int = 50, fixed_factors: tuple[int, ...] = (),
             eps: float = 1e-15, weights: Tensor | None = None, init: list[Factor] | None = None) -> NTFResult:
    """Nonnegative CP by multiplicative updates; one job per half-sweep.

    Divergences with beta 2 and 1 and no weights read the non-zeros only: their denominators come from Gram
    matrices and from column sums.  Beta 1 needs the model in every non-zero: they are packed into blocks of arrays where
    all factors but the longest mode's are small.  Every other case needs all cells; they are generated in tasks and laid
    out like non-zeros.
    """
    spark = t.df.sparkSession
    sparse = weights is None and beta in (1, 2)
    data = t if sparse else _weighted(densify(t), weights)
    store = FactorStore(init or [start_factor(spark, m, n, rank) for m, n in enumerate(t.shape)])
    store.grams = [gram(f) for f in store.factors]
    column_sums = tuple(f"sum(f{c})" for c in range(rank))
    sums = [[v or 0.0 for v in f.df.agg(*map(F.expr, column_sums)).first()] for f in store.factors]
    products = tuple(f"sum(f{c} * x{c})" for c in range(rank))
    packed = sparse and beta == 1 and can_pack(data, rank)
    with (PackedCells if packed else ModeCopies)(data) as copies:
        norm_x, last, product_xm = copies.norm(), t.order - 1, None
        for _ in range(n_iter):
            for mode in range(t.order):
                if mode not in fixed_factors:
                    # With beta 2 the numerator is the MTTKRP, which also gives the error.
                    keep = sparse and beta == 2
                    f = _multiplied(copies, store, sums, mode, beta, eps, sparse, keep)
                    values = [v or 0.0 for v in store.put(mode, f, (*column_sums, *(products if keep else ())))]
                    sums[mode] = values[:rank]
                    product_xm = sum(values[rank:]) if keep and mode == last else None
        if product_xm is None:
            product_xm = float(np.trace(inner(store.factors[0], copies.mttkrp(store.factors, 0))))
    model_sq = float(reduce(mul, store.grams).sum())
    error = rel_frobenius(norm_x, max(model_sq, 0.0) ** 0.5, product_xm)
    return NTFResult(Kruskal(store.factors, np.ones(rank)), n_iter, error)


def _weighted(t: Tensor, weights: Tensor | None) -> Tensor:
    if weights is None:
        return t.with_df(t.df.withColumn("weight", F.lit(1.0)))
    side = weights.df.select(*[F.col(a).alias(b) for a, b in zip(weights.modes, t.modes)], F.col("v").alias("weight"))
    return t.with_df(t.df.join(side, list(t.modes), "left").na.fill(0.0, ["weight"]))


def _multiplied(copies: ModeCopies | PackedCells, store: FactorStore, sums: list[list[float]], mode: int, beta: float, eps: float,
                sparse: bool, keep: bool) -> Factor:
    """One multiplicative update of a factor; ``keep`` also keeps its numerators as columns ``x0, x1, ...``."""
    f, order = store.factors[mode], copies.tensor.order
    rank, others = f.rank, copies.tensor.others(mode)
    model = model_sql(range(order), np.ones(rank))
    if sparse and beta == 2:
        top = _part_sums(copies, store.factors, mode, {"n": "v"}, others)
        bottom = times_sql(store.hadamard(mode))
    elif sparse:
        top = (copies.sums(store.factors, mode, True, "n") if isinstance(copies, PackedCells) else
               _part_sums(copies, store.factors, mode, {"n": f"v / ({model})"}, range(order)))
        bottom = [number(x) for x in np.prod([sums[m] for m in others], axis=0)]
    else:
        values = {"n": f"weight * v * pow({model}, {number(beta - 2)})", "d": f"weight * pow({model}, {number(beta - 1)})"}
        top = _part_sums(copies, store.factors, mode, values, range(order))
        bottom = [f"d{c}" for c in range(rank)]
    rows = f.df.select("idx", *f.columns).join(beside(top, f.rows), "idx", "left").na.fill(0.0)
    small = number(eps)
    out = [f"f{c} * ({small} + n{c}) / ({small} + {bottom[c]}) as f{c}" for c in range(rank)]
    out += [f"n{c} as x{c}" for c in range(rank)] if keep else []
    return Factor(rows.selectExpr("idx", *out), f.rows, rank)


def _part_sums(copies: ModeCopies, factors, mode: int, values: dict[str, str], joined):
    """Per index of ``mode``: cell values times the other modes' factor products, summed per component."""
    others = copies.tensor.others(mode)
    sums = {f"{name}{c}": f"({value}) * {product_sql(others, c)}"
            for name, value in values.items() for c in range(factors[mode].rank)}
    return copies.per_index(mode, copies.joined(mode, factors, joined), sums)


def beta_score(t: Tensor, model: Kruskal, beta: float) -> float:
    """Total divergence between a tensor and a model over all cells; only beta other than 0, 1 and 2 builds the zero cells."""
    if beta in (0, 1, 2):
        return divergence(model, t, beta)
    rows = kruskal_cells(model, densify(t))
    return float(rows.agg(F.sum(beta_divergence(F.col("v"), F.col("model"), beta))).first()[0] or 0.0)
