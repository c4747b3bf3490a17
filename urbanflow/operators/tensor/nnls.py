"""Nonnegative least squares for factor rows.

Rows are independent given the rank-sized Gram matrix, so they are solved in Arrow batches inside the tasks
that hold them.  Within a batch, rows with the same passive set share one small solve.
"""

from __future__ import annotations

from collections.abc import Iterator

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from urbanflow.operators.tensor.algebra import Factor, beside

TINY = 1e-12
#: Condition number from which a block is solved by least squares of smallest norm.
ILL = 1e14

# Ship the small solvers with the task, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def solve_on_sets(gram: np.ndarray, right: np.ndarray, passive: np.ndarray) -> np.ndarray:
    """Least-squares rows restricted to their passive sets, 0 elsewhere."""
    out = np.zeros_like(right)
    patterns, which = np.unique(passive, axis=0, return_inverse=True)
    for p, pattern in enumerate(patterns):
        if pattern.any():
            members = np.flatnonzero(which.reshape(-1) == p)
            block = gram[np.ix_(pattern, pattern)]
            wanted = right[np.ix_(members, pattern)].T
            if np.linalg.cond(block) < ILL:
                solved = np.linalg.solve(block, wanted)
            else:
                solved = np.linalg.lstsq(block, wanted, rcond=1 / ILL)[0]
            out[np.ix_(members, pattern)] = solved.T
    return out


def tolerances(gram: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What counts as 0 for the entries of each row's solution and for its gradient."""
    size = np.abs(right).max(axis=1, keepdims=True)
    return TINY * size / max(gram.diagonal().max(), 1e-300), 100 * TINY * size


def objective(gram: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", 0.5 * (x @ gram) - right, x)


def block_pivoting(gram: np.ndarray, right: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Swap whole infeasible sets while that helps, else only the largest infeasible index.

    Swapping can go round in circles on nearly dependent columns; rows that are open after a number of rounds that
    regular rows never need go to the active-set solver, which cannot.
    """
    count, rank = right.shape
    if not count:
        return np.zeros_like(right)
    zero_x, zero_dual = tolerances(gram, right)
    passive = np.zeros((count, rank), bool) if start is None else start > 0
    best, budget = np.full(count, rank + 1), np.full(count, 3)
    x = solve_on_sets(gram, right, passive)
    todo = np.arange(count)
    for _ in range(5 * rank + 1):
        dual = x[todo] @ gram - right[todo]
        wrong = np.where(passive[todo], x[todo] < -zero_x[todo], dual < -zero_dual[todo])
        open_rows = wrong.any(axis=1)
        todo, wrong = todo[open_rows], wrong[open_rows]
        if not len(todo):
            break
        size = wrong.sum(axis=1)
        improves = size < best[todo]
        best[todo] = np.where(improves, size, best[todo])
        spends = ~improves & (budget[todo] > 0)
        budget[todo] = np.where(improves, 3, budget[todo] - spends)
        last = rank - 1 - wrong[:, ::-1].argmax(axis=1)
        single = np.zeros_like(wrong)
        single[np.arange(len(todo)), last] = True
        passive[todo] ^= np.where((improves | spends)[:, None], wrong, single)
        x[todo] = solve_on_sets(gram, right[todo], passive[todo])
    if len(todo):
        x[todo] = active_set(gram, right[todo])
    return np.where(x < zero_x, 0.0, x)


def active_set(gram: np.ndarray, right: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Add the most promising index when feasible; otherwise step back to the border and drop one.

    Runs until no row is open.  An index whose addition lowers the objective by nothing is left out until another
    one does lower it, so no row comes back to a set it has had.
    """
    count, rank = right.shape
    x = np.zeros_like(right) if start is None else np.where(start > 0, start, 0.0)
    if not count:
        return x
    zero_x, zero_dual = tolerances(gram, right)
    passive, barred = x > 0, np.zeros((count, rank), bool)
    added, reached = np.full(count, -1), np.full(count, np.inf)
    todo = np.arange(count)
    while len(todo):
        z = solve_on_sets(gram, right[todo], passive[todo])
        below = passive[todo] & (z < -zero_x[todo])
        leaves = below.any(axis=1)
        back, ahead = todo[leaves], todo[~leaves]
        if len(back):
            move, zb, negative = x[back], z[leaves], below[leaves]
            ratio = np.where(negative, move / np.where(negative, move - zb, 1.0), np.inf)
            drop = ratio.argmin(axis=1)
            share = ratio.min(axis=1)[:, None]
            x[back] = np.where(passive[back], np.maximum(move + share * (zb - move), 0.0), 0.0)
            x[back, drop] = 0.0
            passive[back, drop] = False
        finished = np.zeros(0, int)
        if len(ahead):
            now = np.maximum(z[~leaves], 0.0)
            value = objective(gram, right[ahead], now)
            best = reached[ahead]
            gains = np.isinf(best) | (value < best - 1e-14 * np.abs(np.where(np.isinf(best), 0.0, best)))
            stuck = ~gains & (added[ahead] >= 0)
            barred[ahead[gains]] = False
            barred[ahead[stuck], added[ahead[stuck]]] = True
            x[ahead[gains]] = now[gains]
            reached[ahead[gains]] = value[gains]
            # Back to the set of the best solution so far, where the last addition did not help.
            passive[ahead[stuck]] = x[ahead[stuck]] > 0
            dual = np.where(passive[ahead] | barred[ahead], np.inf, x[ahead] @ gram - right[ahead])
            worst = dual.argmin(axis=1)
            grows = (dual.min(axis=1) < -zero_dual[ahead, 0])
            passive[ahead[grows], worst[grows]] = True
            added[ahead[grows]] = worst[grows]
            finished = ahead[~grows]
        todo = np.setdiff1d(todo, finished, assume_unique=True)
    return np.where(x < zero_x, 0.0, x)


SOLVERS = {"anls_bpp": block_pivoting, "anls_asgroup": active_set}


def nnls_rows(right: Factor, gram: np.ndarray, method: str, warm: Factor | None = None, keep: str | None = None) -> Factor:
    """Solve every row of a factor, starting from the rows of ``warm``; absent rows have the solution 0.

    ``keep`` also keeps the right-hand sides, as columns with that prefix.
    """
    if method not in SOLVERS:
        raise ValueError(f"unknown method {method!r}")
    rank, names = right.rank, right.columns
    df = right.df.select("idx", *names)
    if warm is not None:
        old = warm.df.selectExpr("idx", *[f"{c} as w{s}" for s, c in enumerate(warm.columns)])
        df = df.join(beside(old, warm.rows), "idx", "left").na.fill(0.0)

    solver, starts = SOLVERS[method], [f"w{c}" for c in range(rank)] if warm is not None else []
    kept = [f"{keep}{c}" for c in range(rank)] if keep else []

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[names].to_numpy(float)
            start = batch[starts].to_numpy(float) if starts else None
            out = pd.DataFrame(solver(gram, rows, start), columns=names)
            out.insert(0, "idx", batch["idx"].to_numpy())
            for c, name in enumerate(kept):
                out[name] = rows[:, c]
            yield out
    schema = ", ".join(["idx bigint", *[f"{n} double" for n in [*names, *kept]]])
    return Factor(df.mapInPandas(solve, schema), right.rows, rank)
