"""Leading mode vectors, HOSVD, HOOI and the masked Tucker model."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from itertools import batched

import numpy as np
from pyspark.sql import functions as F

from urbanflow.operators.tensor.algebra import (Factor, all_rows, factor_matrix, flipsign, hinted, inner, join_factors, number,
                                                scaled, signs, start_factor, times, ttm_many, tucker_sql, tucker_value)
from urbanflow.operators.tensor.layout import ModeCopies
from urbanflow.operators.tensor.qr import ROUNDING, tall_r, whitener
from urbanflow.operators.tensor.sweep import FactorStore, kept
from urbanflow.operators.tensor.table import Tensor
from urbanflow.session import checkpoint_table, checkpointed, drop_table

#: Directions of the range finder beyond those asked for.
OVERSAMPLE = 32
#: Columns of a projected unfolding that one pass sums; more would make one generated function too long.
COLUMNS_AT_ONCE = 64


def _apply_gram(t: Tensor, mode: int, q: Factor) -> Factor:
    """Unfolding times its transpose times ``q``, as two sparse passes; the Gram matrix itself is never built."""
    names = q.columns
    side = q.df.select(F.col("idx").alias(t.modes[mode]), *names)
    rest = [t.modes[m] for m in t.others(mode)]
    columns = t.df.join(hinted(side, q.is_small()), t.modes[mode]).groupBy(*rest).agg(
        *[F.expr(f"sum(v * {c}) as {c}") for c in names])
    rows = t.df.join(columns, rest).groupBy(F.col(t.modes[mode]).alias("idx")).agg(
        *[F.expr(f"sum(v * {c}) as {c}") for c in names])
    return Factor(rows, q.rows, q.rank)


@dataclass
class LeadingVectors:
    """Leading left vectors of a mode unfolding, the squares of its singular values, and how far they are from exact:
    ``residual`` is the norm of (Gram matrix times vectors - vectors times values) in units of the largest value."""

    factor: Factor
    values: np.ndarray
    residual: float
    rounds: int


def _sketch(t: Tensor, mode: int, width: int) -> Factor:
    """The unfolding times a matrix of random signs, which are bits of a hash of the column: one pass, nothing is joined."""
    others = [t.modes[m] for m in t.others(mode)]
    sums = [f"sum(if((shiftright(xxhash64({c // 64}, {', '.join(others)}), {c % 64}) & 1) = 1, v, -v)) as f{c}" for c in range(width)]
    return Factor(t.df.groupBy(F.expr(f"{t.modes[mode]} as idx")).agg(*map(F.expr, sums)), t.shape[mode], width)


def leading_vectors(t: Tensor, mode: int, rank: int, max_iter: int = 200, tol: float = 1e-11) -> LeadingVectors:
    """Leading left vectors of a mode unfolding by a randomized range finder and subspace iteration.

    The subspace has ``OVERSAMPLE`` directions more than asked for, at most the length of the mode; if it holds the whole
    range, which it does for short modes, the first round is exact.  Tall matrices are made orthonormal by a tree QR.
    Rounds end when the residual is below ``tol``; a warning says if ``max_iter`` came first.  Work is proportional to the
    non-zeros, and only matrices of the subspace's size reach the driver.
    """
    n = t.shape[mode]
    y, path = _written(_sketch(t, mode, min(n, rank + OVERSAMPLE)))
    tables, residual, best, values, rounds = [path], 0.0, None, np.zeros(0), 0
    for rounds in range(1, max_iter + 1):
        turn = whitener(tall_r(y))
        if not turn.shape[1]:
            break
        q = times(y, turn)
        y, path = _written(_apply_gram(t, mode, q))
        tables.append(path)
        ritz = inner(q, y)
        found, vectors = np.linalg.eigh((ritz + ritz.T) / 2)
        found, vectors = found[::-1], vectors[:, ::-1]
        held = int((found[:rank] > max(found[0], 0.0) * ROUNDING).sum())
        values, best = found[:held], times(q, vectors[:, :held])
        residual = _residual_norm(q, y, vectors[:, :held], values) / max(found[0], 1e-300)
        if residual <= tol:
            break
        for old in tables[:-2]:
            drop_table(t.df.sparkSession, old)
        del tables[:-2]
    else:
        warnings.warn(f"leading vectors of mode {mode}: residual {residual:.1e} after {max_iter} rounds", stacklevel=2)
    if best is not None:
        best, _ = _written(best)
    for old in tables:
        drop_table(t.df.sparkSession, old)
    return LeadingVectors(_completed(t.df.sparkSession, best, mode, n, rank), values, residual, rounds)


def _written(f: Factor) -> tuple[Factor, str]:
    df, path = checkpoint_table(f.df)
    return Factor(df, f.rows, f.rank), path


def _residual_norm(q: Factor, y: Factor, vectors: np.ndarray, values: np.ndarray) -> float:
    """Norm of y V - q V diag(values)."""
    right = y.df.selectExpr("idx", *[f"{c} as g{k}" for k, c in enumerate(y.columns)])
    both = q.df.join(hinted(right, y.is_small()), "idx")
    gaps = [" + ".join([f"g{c} * {number(vectors[c, h])} - f{c} * {number(vectors[c, h] * values[h])}" for c in range(q.rank)])
            for h in range(len(values))]
    return float(both.agg(F.expr("sum(" + " + ".join(f"pow({g}, 2)" for g in gaps) + ")")).first()[0] or 0.0) ** 0.5


def nvecs(t: Tensor, mode: int, rank: int, flip: bool = True, max_iter: int = 200, tol: float = 1e-11) -> Factor:
    """The factor of :func:`leading_vectors`.

    Directions that the unfolding does not have are completed, so the factor always has ``rank`` columns.
    """
    best = leading_vectors(t, mode, rank, max_iter, tol).factor
    return flipsign(best) if flip else best


def _completed(spark, best: Factor | None, mode: int, n: int, rank: int) -> Factor:
    """``best`` with further orthonormal columns up to ``rank``; beyond ``n`` columns no more exist and start values serve."""
    if best is not None and best.rank >= rank:
        return best
    have = 0 if best is None else best.rank
    extra = start_factor(spark, mode + 7, n, rank - have)
    if best is None:
        shift = [f"f{c}" for c in range(rank)]
        both = extra.df
    else:
        full = all_rows(best)
        cross = inner(full, extra)
        more = extra.df.selectExpr("idx", *[f"{c} as g{k}" for k, c in enumerate(extra.columns)])
        both = full.df.join(hinted(more, extra.is_small()), "idx")
        shift = [" - ".join([f"g{k}", *[f"f{s} * {number(cross[s, k])}" for s in range(have)]]) for k in range(rank - have)]
    rest = Factor(both.selectExpr("idx", *[f"{e} as f{k}" for k, e in enumerate(shift)]), n, rank - have)
    turn = whitener(tall_r(rest))
    if turn.shape[1] < rank - have:
        turn = np.hstack([turn, np.eye(rank - have)[:, :rank - have - turn.shape[1]]])
    rest = times(rest, turn)
    if best is None:
        return rest
    renamed = rest.df.selectExpr("idx", *[f"{c} as f{have + k}" for k, c in enumerate(rest.columns)])
    return Factor(all_rows(best).df.join(hinted(renamed, rest.is_small()), "idx"), n, rank)


def _ranks(t: Tensor, rank) -> list[int]:
    return [int(rank)] * t.order if np.isscalar(rank) else [int(r) for r in rank]


def hosvd(t: Tensor, rank, dims=None, compute_core: bool = True):
    """Factors of the chosen modes and, if asked for, the core as a small long table."""
    ranks = _ranks(t, rank)
    t = kept(t)
    factors = {m: nvecs(t, m, ranks[m]) for m in (range(t.order) if dims is None else dims)}
    if not compute_core:
        t.df.unpersist()
        return factors
    core = ttm_many(t, {m: (factor_matrix(f), f.rank) for m, f in factors.items()}, transp=True)
    core = core.with_df(checkpointed(core.df))
    t.df.unpersist()
    return factors, core


@dataclass
class TuckerResult:
    core: np.ndarray
    factors: list[Factor]
    fit: float
    iterations: int


def projected(copies: ModeCopies, factors, mode: int) -> Factor:
    """Tensor times the transposed factors of all other modes, as one wide row per index of ``mode``.

    Columns run over the other modes' components, the last one fastest; ``COLUMNS_AT_ONCE`` of them are summed in one pass.
    """
    others = copies.tensor.others(mode)
    values = {f"f{n}": " * ".join(["v", *[f"m{m}_{c}" for m, c in zip(others, at)]])
              for n, at in enumerate(np.ndindex(*[factors[m].rank for m in others]))}
    df = None
    for some in batched(values.items(), COLUMNS_AT_ONCE):
        part = copies.per_index(mode, copies.joined(mode, factors, others), dict(some))
        df = part if df is None else df.join(part, "idx")
    return Factor(df, copies.tensor.shape[mode], len(values))


def hooi(t: Tensor, rank, init="nvecs", max_iter: int = 500, conv: float = 1e-7) -> TuckerResult:
    """Tucker decomposition by orthogonal iteration.

    A half-sweep writes the projected unfolding W on the copy of its mode and reduces it to a triangle by a tree QR; the
    singular vectors of the triangle turn W into the new factor and give the core.  Sweeps end when the fit changes by less
    than ``conv``.
    """
    ranks = _ranks(t, rank)
    spark = t.df.sparkSession
    if isinstance(init, list):
        factors = list(init)
    elif init == "random":
        factors = [None, *[start_factor(spark, m, t.shape[m], ranks[m]) for m in t.others(0)]]
    elif init == "nvecs":
        factors = [None, *[nvecs(t, m, ranks[m]) for m in t.others(0)]]
    else:
        raise ValueError(f"unknown init option {init!r}")
    fit, core, sweep, paths = 0.0, None, 0, [None] * t.order
    with ModeCopies(t) as copies:
        norm_x = copies.norm()
        for sweep in range(max_iter):
            before = fit
            for mode in range(t.order):
                wide, path = _written(projected(copies, factors, mode))
                _, s, vt = np.linalg.svd(tall_r(wide), full_matrices=False)
                s, vt = s[:ranks[mode]], vt[:ranks[mode]]
                held = s > ROUNDING * s.max(initial=0.0)
                factors[mode] = times(wide, vt.T * np.divide(1.0, s, out=np.zeros_like(s), where=held))
                core = np.moveaxis((s[:, None] * vt).reshape([-1, *[factors[m].rank for m in t.others(mode)]]), 0, mode)
                if paths[mode]:
                    drop_table(spark, paths[mode])
                paths[mode] = path
            fit = 1 - max(norm_x ** 2 - float((core ** 2).sum()), 0.0) ** 0.5 / norm_x
            if sweep > 1 and abs(fit - before) < conv:
                break
    found = []
    for mode, f in enumerate(factors):
        turn = signs(f)
        found.append(scaled(f, turn))
        core = core * turn.reshape([-1 if m == mode else 1 for m in range(t.order)])
    return TuckerResult(core, found, fit, sweep + 1)


def masked_tucker(t: Tensor, rank: int, steps: int = 500, alpha: float = 0.0002, beta: float = 0.02,
                  epsilon: float = 1.0, above: float = 10.0) -> tuple[TuckerResult, list[float]]:
    """Tucker model fitted by gradient steps to the cells above a threshold only.

    A step moves the core and all factors at once along the full gradient.  A step that would raise the loss
    is taken back and retried with half the step length; after a success the length grows again.
    Returns the model and the loss after every step.
    """
    t = kept(t.with_df(t.df.filter(F.col("v") > above)))
    spark = t.df.sparkSession
    factors = [start_factor(spark, m, n, rank) for m, n in enumerate(t.shape)]
    core = np.array([(c * 7919 % 101 + 1) / 102 for c in range(rank ** t.order)]).reshape([rank] * t.order)
    loss, step = _masked_loss(t, factors, core), 0
    losses = [loss]
    gradients, current = _masked_gradients(t, factors, core), None
    while step < steps and loss >= epsilon and alpha > 1e-12:
        rows, core_grad = gradients
        trial_core = core - alpha * (core_grad + beta * core)
        trial = FactorStore(factors)
        for m, g in enumerate(rows):
            grad = g.df.selectExpr("idx", *[f"{c} as g{s}" for s, c in enumerate(g.columns)])
            moved = factors[m].df.join(hinted(grad, g.is_small()), "idx", "left").na.fill(0.0)
            df = moved.selectExpr("idx", *[f"f{c} - {number(alpha)} * (g{c} + {number(beta)} * f{c}) as f{c}"
                                           for c in range(rank)])
            trial.put(m, Factor(df, g.rows, rank))
        trial_loss = _masked_loss(t, trial.factors, trial_core)
        if trial_loss <= loss:
            factors, core, loss = trial.factors, trial_core, trial_loss
            losses.append(loss)
            alpha *= 1.2
            gradients = _masked_gradients(t, factors, core)
            current, trial = trial, current
        else:
            alpha /= 2
        if trial is not None:
            trial.discard()
        step += 1
    t.df.unpersist()
    return TuckerResult(core, factors, loss, step), losses


def _residual(t: Tensor, factors, core):
    rows = join_factors(t, factors, range(t.order))
    return rows.withColumn("gap", tucker_value(range(t.order), core) - F.col("v"))


def _masked_loss(t: Tensor, factors, core) -> float:
    return float(_residual(t, factors, core).agg(F.sum(F.col("gap") * F.col("gap"))).first()[0] or 0.0)


def _masked_gradients(t: Tensor, factors, core):
    rows = _residual(t, factors, core)
    rank, grads = core.shape[0], []
    for mode in range(t.order):
        others = t.others(mode)
        sums = [F.expr(f"sum(gap * ({tucker_sql(others, np.take(core, c, axis=mode))})) as f{c}") for c in range(rank)]
        df = rows.groupBy(F.expr(f"{t.modes[mode]} as idx")).agg(*sums)
        grads.append(Factor(df, t.shape[mode], rank))
    cells = [F.expr("sum(" + " * ".join(["gap", *[f"m{m}_{c}" for m, c in enumerate(at)]]) + ")")
             for at in np.ndindex(*core.shape)]
    values = rows.agg(*cells).first()
    return grads, np.array([v or 0.0 for v in values]).reshape(core.shape)
