"""QR of tall distributed matrices by a tree: every task reduces its rows to a small triangle, triangles merge."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle

from urbanflow.operators.tensor.algebra import Factor, times

#: Directions with less than this share of the largest one are rounding.
ROUNDING = 1e-13

# Ship the small functions with the task, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def triangle(blocks: Iterator[np.ndarray], width: int) -> np.ndarray:
    """R of the blocks one below the other, holding one block and one triangle at a time."""
    r = np.zeros((0, width))
    for block in blocks:
        r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return r


def tall_r(f: Factor) -> np.ndarray:
    """A matrix R of at most rank rows with R'R = F'F; unlike the Gram matrix it keeps small directions to full precision."""
    names, width = f.columns, f.rank

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = triangle((b[names].to_numpy(float) for b in batches), width)
        out = pd.DataFrame(r, columns=names)
        context = TaskContext.get()
        out.insert(0, "node", context.partitionId() if context else 0)
        yield out

    schema = ", ".join(["node int", *[f"{c} double" for c in names]])
    # Triangles are few and small, so they merge in as many tasks as their size asks for.
    parts = f.df.select(*names).mapInPandas(reduce_rows, schema).repartition("node")
    rows = parts.mapInPandas(reduce_rows, schema).collect()
    if not rows:
        return np.zeros((0, width))
    rows.sort(key=lambda r: tuple(r))  # the order in which tasks end must not change the last digits
    return np.linalg.qr(np.array([list(r)[1:] for r in rows]), mode="r")


def whitener(r: np.ndarray) -> np.ndarray:
    """Matrix that makes the columns behind R orthonormal, largest directions first, without those that are rounding."""
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    good = s > ROUNDING * s.max(initial=0.0)
    good &= s > 0
    return vt[good].T / s[good]


def orthonormal(f: Factor) -> Factor:
    """Orthonormal columns of the same span."""
    return times(f, whitener(tall_r(f)))
