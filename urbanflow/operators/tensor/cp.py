"""CP decomposition by alternating least squares."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import mul

import numpy as np

from urbanflow.operators.tensor.algebra import Factor, Kruskal, gram, start_factor, times
from urbanflow.operators.tensor.layout import ModeCopies
from urbanflow.operators.tensor.sweep import FactorStore
from urbanflow.operators.tensor.table import Tensor
from urbanflow.operators.tensor.tucker import nvecs


@dataclass
class CPResult:
    model: Kruskal
    fit: float
    iterations: int


def initial_factors(t: Tensor, rank: int, init) -> list[Factor | None]:
    """The first factor is computed by the first half-sweep, so only the others need a start."""
    if isinstance(init, list):
        return [None, *init[1:]]
    if init == "random":
        return [None, *[start_factor(t.df.sparkSession, m, t.shape[m], rank) for m in t.others(0)]]
    if init == "nvecs":
        return [None, *[nvecs(t, m, rank) for m in t.others(0)]]
    raise ValueError(f"unknown init option {init!r}")


def _two_norms(grams: np.ndarray, _: list) -> np.ndarray:
    size = np.sqrt(np.diag(grams))
    return np.where(size == 0, 1.0, size)


def _largest(grams: np.ndarray, values: list) -> np.ndarray:
    return np.maximum([v or 0.0 for v in values[:len(grams)]], 1.0)


def cp_als(t: Tensor, rank: int, init="random", max_iter: int = 500, conv: float = 1e-5,
           fit_method: str = "full") -> CPResult:
    """One job per half-sweep: MTTKRP on the copy of its mode, times a rank-sized inverse, with the statistics it needs.

    Columns are scaled by their 2-norm in the first sweep and by max(largest entry, 1) afterwards.  The fit
    needs no residual tensor: the inner product with the model comes from the last MTTKRP.  Sweeps end when the fit
    changes by less than ``conv``.
    """
    store = FactorStore(initial_factors(t, rank, init))
    for m, f in enumerate(store.factors):
        if f is not None:
            store.grams[m] = gram(f)
    fit, weights, sweep = 0.0, np.ones(rank), 0
    with ModeCopies(t) as copies:
        norm_sq = copies.norm() ** 2
        for sweep in range(max_iter):
            before, product_xm = fit, 0.0
            for mode in range(t.order):
                right = copies.mttkrp(store.factors, mode)
                solved = times(right, np.linalg.pinv(store.hadamard(mode)), keep="g")
                extra = (*[f"max({c})" for c in solved.columns], *[f"sum(f{c} * g{c})" for c in range(rank)])
                values = store.put(mode, solved, extra, _two_norms if sweep == 0 else _largest)
                weights = store.divisor
                product_xm = sum(v or 0.0 for v in values[rank:])
            if fit_method == "full":
                model_sq = float(weights @ reduce(mul, store.grams) @ weights)
                fit = 1 - (norm_sq + model_sq - 2 * product_xm) / norm_sq
            else:
                fit = float(sweep)
            if sweep > 0 and abs(fit - before) < conv:
                break
    return CPResult(Kruskal(store.factors, weights), fit, sweep + 1)
