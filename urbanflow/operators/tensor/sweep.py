"""What the iterative factorizations share: keeping factors between sweeps and cutting their lineage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import mul

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Observation
from pyspark.sql import functions as F

from urbanflow.operators.tensor.algebra import Factor, gram_of, gram_sql, number
from urbanflow.operators.tensor.table import Tensor
from urbanflow.session import checkpoint_table, drop_table


def kept(t: Tensor) -> Tensor:
    """Cache the non-zeros, which every half-sweep reads."""
    return t.with_df(t.df.persist(StorageLevel.MEMORY_AND_DISK))


class FactorStore:
    """Current factors of a model with their Gram matrices.

    Every new factor is written to the shared checkpoint folder, and the table it replaces is removed.  A factor
    is far smaller than the non-zeros it was computed from, plans stay as small in the last sweep as in the
    first, and the loss of an executor never replays an earlier half-sweep.
    """

    def __init__(self, factors: list[Factor | None]):
        self.factors = list(factors)
        self.grams: list[np.ndarray | None] = [None] * len(factors)
        self.divisor: np.ndarray | None = None
        self._paths: list[str | None] = [None] * len(factors)

    def put(self, mode: int, factor: Factor, extra: tuple[str, ...] = (),
            scale: Callable[[np.ndarray, list], np.ndarray] | None = None) -> list:
        """Store a factor and return the extra aggregates; ``scale`` turns its statistics into column divisors.

        The Gram matrix and the extra aggregates are observed while the table is written, in the same job.
        """
        rank, seen = factor.rank, Observation()
        wanted = [F.expr(e).alias(f"s{n}") for n, e in enumerate([*gram_sql(rank), *extra])]
        df, path = checkpoint_table(factor.df.observe(seen, *wanted))
        found = [seen.get[f"s{n}"] for n in range(len(wanted))]
        size = rank * (rank + 1) // 2
        grams, values = gram_of(rank, found[:size]), found[size:]
        columns = factor.columns
        if scale is not None:
            divisor = self.divisor = scale(grams, values)
            grams = grams / np.outer(divisor, divisor)
            columns = [f"{c} / {number(d)} as {c}" for c, d in zip(columns, divisor)]
        self.factors[mode] = Factor(df.selectExpr("idx", *columns), factor.rows, rank)
        self.grams[mode] = grams
        if self._paths[mode]:
            drop_table(df.sparkSession, self._paths[mode])
        self._paths[mode] = path
        return values

    def discard(self) -> None:
        """Remove the tables of a store that is no longer needed."""
        for factor, path in zip(self.factors, self._paths):
            if path:
                drop_table(factor.df.sparkSession, path)
        self._paths = [None] * len(self._paths)

    def hadamard(self, without: int) -> np.ndarray:
        """Element-wise product of the Gram matrices of all other modes."""
        return reduce(mul, [g for m, g in enumerate(self.grams) if m != without])
