"""Tensor algebra as joins and aggregates.

A factor matrix is a table ``idx, f0 .. f{r-1}``.  Components are scalar columns, so products and sums
stay in generated code and combine map-side.  A factor is broadcast only when its known size (rows times
rank times 8 bytes) is below ``BROADCAST_BYTES``; beyond that the join is shuffled.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce
from operator import mul

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanflow.functions.text import int_div
from urbanflow.operators.tensor.table import Tensor

BROADCAST_BYTES = 16 * 1024 * 1024
WIDE_RANK = 8
#: Rows up to which a table on the same index is broadcast: it passes the driver again in every step of a fit.
SIDE_ROWS = 20_000

# Ship the small batch functions with the task, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Factor:
    """Rows of a factor matrix; ``rows`` is the length of its mode."""

    df: DataFrame
    rows: int
    rank: int

    @property
    def columns(self) -> list[str]:
        return [f"f{c}" for c in range(self.rank)]

    def is_small(self) -> bool:
        return self.rows * (self.rank + 1) * 8 <= BROADCAST_BYTES


def hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def beside(df: DataFrame, rows: int) -> DataFrame:
    """A table to be joined with another one on the same index; a long one is shuffled, never sent through the driver."""
    return F.broadcast(df) if rows <= SIDE_ROWS else df.hint("shuffle_merge")


def start_value(mode: int, row: Column, component: int) -> Column:
    """Repeatable start value in (0, 1) from mode, row and component."""
    # Multipliers and modulus of the start hash.
    mixed = (row.cast("long") + 1) * (7919 + component * 1009) + (mode + 1) * 104729 * (component + 1)
    return (mixed % 1009 + 1) / F.lit(1010.0)


def start_factor(spark, mode: int, rows: int, rank: int) -> Factor:
    values = [start_value(mode, F.col("id"), c).alias(f"f{c}") for c in range(rank)]
    return Factor(spark.range(rows).select(F.col("id").alias("idx"), *values), rows, rank)


def factor_from_array(spark, array: np.ndarray) -> Factor:
    """Factor from a small driver-side matrix."""
    rows, rank = array.shape
    data = [(int(i), *map(float, r)) for i, r in enumerate(array)]
    schema = ", ".join(["idx bigint", *[f"f{c} double" for c in range(rank)]])
    return Factor(spark.createDataFrame(data, schema), rows, rank)


def number(x: float) -> str:
    """A double literal in an expression string."""
    return f"({float(x)!r}D)" if np.isfinite(x) else f"cast('{float(x)!r}' as double)"


def join_factors(t: Tensor, factors, modes) -> DataFrame:
    """Attach the factor rows of several modes as columns ``m{mode}_{component}``."""
    df = t.df
    for m in modes:
        f = factors[m]
        side = f.df.selectExpr(f"idx as {t.modes[m]}", *[f"{c} as m{m}_{s}" for s, c in enumerate(f.columns)])
        df = df.join(hinted(side, f.is_small()), t.modes[m])
    return df


def product_sql(modes, component: int) -> str:
    return " * ".join(f"m{m}_{component}" for m in modes)


def product(modes, component: int) -> Column:
    return F.expr(product_sql(modes, component))


def mttkrp(t: Tensor, factors, mode: int) -> Factor:
    """Unfolding times the Khatri-Rao product of the other factors, never built: one pass over the non-zeros."""
    others = t.others(mode)
    rank = factors[others[0]].rank
    rows = join_factors(t, factors, others)
    sums = [F.expr(f"sum(v * {product_sql(others, c)}) as f{c}") for c in range(rank)]
    df = rows.groupBy(F.expr(f"{t.modes[mode]} as idx")).agg(*sums)
    return Factor(df, t.shape[mode], rank)


def all_rows(f: Factor) -> Factor:
    """Add the rows that are absent (all 0)."""
    ids = f.df.sparkSession.range(f.rows).select(F.col("id").alias("idx"))
    df = ids.join(beside(f.df, f.rows), "idx", "left").na.fill(0.0, f.columns)
    return Factor(df, f.rows, f.rank)


def times_sql(matrix: np.ndarray, prefix: str = "f") -> list[str]:
    """Expressions for the row ``prefix0, prefix1, ...`` times a small matrix."""
    return [" + ".join(f"{prefix}{s} * {number(matrix[s, c])}" for s in range(matrix.shape[0]))
            for c in range(matrix.shape[1])]


def times(f: Factor, matrix: np.ndarray, keep: str | None = None) -> Factor:
    """Factor times a small matrix, as plain column arithmetic; ``keep`` also keeps the old columns by a prefix."""
    out = [f"{c} as {keep}{s}" for s, c in enumerate(f.columns)] if keep else []
    out += [f"{e} as f{c}" for c, e in enumerate(times_sql(matrix))]
    return Factor(f.df.selectExpr("idx", *out), f.rows, matrix.shape[1])


def gram_sql(rank: int) -> list[str]:
    """Aggregates for the upper triangle of a Gram matrix, row by row."""
    return [f"sum(f{a} * f{b})" for a in range(rank) for b in range(a, rank)]


def gram_of(rank: int, values) -> np.ndarray:
    out = np.zeros((rank, rank))
    out[np.triu_indices(rank)] = [v or 0.0 for v in values]
    return out + np.triu(out, 1).T


def gram(f: Factor) -> np.ndarray:
    """Rank-sized Gram matrix; the only thing that reaches the driver."""
    if f.rank > WIDE_RANK:
        return wide_product(f.df, f.columns, f.columns)
    return gram_of(f.rank, f.df.agg(*[F.expr(e) for e in gram_sql(f.rank)]).first())


def wide_product(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Small product of two sets of columns, summed per task with one matrix product per Arrow batch.

    For many columns this beats one aggregate expression per entry, whose generated code would grow with their
    number squared.
    """
    width, shape = len(right), (len(left), len(right))

    def sums(batches):
        total = np.zeros(shape)
        for batch in batches:
            total += batch[left].to_numpy(float).T @ batch[right].to_numpy(float)
        yield pd.DataFrame({"pos": np.arange(total.size), "value": total.ravel()})
    picked = df.select(*dict.fromkeys([*left, *right]))
    parts = picked.mapInPandas(sums, "pos int, value double").groupBy("pos").agg(F.expr("sum(value) as value"))
    out = np.zeros(shape)
    for row in parts.collect():
        out[row["pos"] // width, row["pos"] % width] = row["value"]
    return out


def inner(a: Factor, b: Factor) -> np.ndarray:
    """Small matrix of column products of two tall factors on the same rows."""
    right = b.df.selectExpr("idx", *[f"{c} as g{s}" for s, c in enumerate(b.columns)])
    both = a.df.join(hinted(right, b.is_small()), "idx")
    if a.rank * b.rank > WIDE_RANK ** 2:
        return wide_product(both, a.columns, [f"g{s}" for s in range(b.rank)])
    row = both.agg(*[F.expr(f"sum(f{x} * g{y})") for x in range(a.rank) for y in range(b.rank)]).first()
    return np.array([v or 0.0 for v in row]).reshape(a.rank, b.rank)


def ttm(t: Tensor, matrix: DataFrame, rows: int, mode: int, transp: bool = False) -> Tensor:
    """Multiply a tensor by a matrix ``(r, c, m)`` along a mode; ``transp`` swaps the matrix sides."""
    inner_col, outer_col = ("r", "c") if transp else ("c", "r")
    name = t.modes[mode]
    side = matrix.select(F.col(inner_col).alias(name), F.col(outer_col).alias("new_index"), "m")
    joined = t.df.join(hinted(side, rows * t.shape[mode] * 24 <= BROADCAST_BYTES), name)
    keys = [F.col("new_index").alias(name) if m == mode else F.col(c) for m, c in enumerate(t.modes)]
    df = joined.groupBy(*keys).agg(F.sum(F.col("v") * F.col("m")).alias("v"))
    return Tensor(df.select(*t.modes, "v"), t.modes, tuple(rows if m == mode else n for m, n in enumerate(t.shape)))


def ttm_many(t: Tensor, matrices: dict[int, tuple[DataFrame, int]], transp: bool = False, without: int | None = None) -> Tensor:
    """Multiply along several modes, largest reduction first."""
    for mode in sorted(matrices, key=lambda m: matrices[m][1] / t.shape[m]):
        if mode != without:
            matrix, rows = matrices[mode]
            t = ttm(t, matrix, rows, mode, transp)
    return t


def factor_matrix(f: Factor) -> DataFrame:
    """A factor as matrix entries (r, c, m)."""
    cells = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("c"), F.col(c).alias("m")) for s, c in enumerate(f.columns)]))
    return f.df.select(F.col("idx").alias("r"), cells.alias("e")).select("r", "e.*")


def ttv(t: Tensor, vectors: dict[int, DataFrame]) -> DataFrame:
    """Multiply by vectors ``(idx, w)`` on some modes; zeros are dropped, all modes give one number."""
    df = t.df
    for mode, vector in vectors.items():
        side = vector.select(F.col("idx").alias(t.modes[mode]), F.col("w").alias(f"w{mode}"))
        df = df.join(hinted(side, t.shape[mode] * 16 <= BROADCAST_BYTES), t.modes[mode])
    value = reduce(mul, [F.col(f"w{m}") for m in vectors], F.col("v"))
    rest = [t.modes[m] for m in t.others(*vectors)]
    if not rest:
        return df.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("v"))
    return df.groupBy(*rest).agg(F.sum(value).alias("v")).filter(F.col("v") != 0)


def norm(t: Tensor) -> float:
    return float(t.df.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0) ** 0.5


def innerprod(a: Tensor, b: Tensor) -> DataFrame:
    """One-row table with the sum of cell products."""
    right = b.df.select(*[F.col(y).alias(x) for x, y in zip(a.modes, b.modes)], F.col("v").alias("w"))
    return a.df.join(right, list(a.modes)).agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("v"))


def subtract(a: Tensor, b: Tensor) -> Tensor:
    """Cell-wise difference, zeros dropped."""
    right = b.df.select(*[F.col(y).alias(x) for x, y in zip(a.modes, b.modes)], F.col("v").alias("w"))
    joined = a.df.join(right, list(a.modes), "full")
    gap = F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))
    return a.with_df(joined.select(*a.modes, gap.alias("v")).filter(F.col("v") != 0))


def khatri_rao(factors: list[Factor], reverse: bool = False) -> Factor:
    """Column-wise Kronecker product; the last factor's rows run fastest.

    The result has as many rows as the product of the inputs, so it is generated from a running number and
    filled by equi-joins.
    """
    parts = list(reversed(factors)) if reverse else list(factors)
    if len({f.rank for f in parts}) != 1:
        raise ValueError("all factors must have the same number of columns")
    done = parts[0]
    for f in parts[1:]:
        rows = done.rows * f.rows
        ids = done.df.sparkSession.range(rows).select(
            "id", int_div(F.col("id"), F.lit(f.rows)).alias("a"), (F.col("id") % f.rows).alias("b"))
        left = done.df.select(F.col("idx").alias("a"), *[F.col(c).alias(f"l{s}") for s, c in enumerate(done.columns)])
        right = f.df.select(F.col("idx").alias("b"), *[F.col(c).alias(f"r{s}") for s, c in enumerate(f.columns)])
        wide = ids.join(hinted(left, done.is_small()), "a").join(hinted(right, f.is_small()), "b")
        df = wide.select(F.col("id").alias("idx"), *[(F.col(f"l{s}") * F.col(f"r{s}")).alias(f"f{s}") for s in range(f.rank)])
        done = Factor(df, rows, f.rank)
    return done


def center(t: Tensor, mode: int) -> Tensor:
    """Subtract from every fibre along a mode its mean; absent cells count as 0, so touched fibres become dense."""
    rest = [t.modes[m] for m in t.others(mode)]
    means = t.df.groupBy(*rest).agg((F.sum("v") / F.lit(float(t.shape[mode]))).alias("mean"))
    dense = means.withColumn(t.modes[mode], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(t.shape[mode] - 1).cast("long"))))
    rows = dense.join(t.df, list(t.modes), "left")
    return t.with_df(rows.select(*t.modes, (F.coalesce("v", F.lit(0.0)) - F.col("mean")).alias("v")))


def center_matrix(matrix: DataFrame, rows: int) -> DataFrame:
    """Subtract the column means of a matrix ``(r, c, m)``."""
    t = center(Tensor(matrix.withColumnRenamed("m", "v"), ("r", "c"), (rows, 0)), 0)
    return t.df.withColumnRenamed("v", "m")


def scale(t: Tensor, mode: int) -> Tensor:
    """Divide each slice of a mode by its norm.  Norms are aggregated and joined, so a big slice is no hot spot."""
    name = t.modes[mode]
    norms = t.df.groupBy(name).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    rows = t.df.join(hinted(norms, t.shape[mode] * 16 <= BROADCAST_BYTES), name)
    size = F.when(F.col("size") == 0, 1.0).otherwise(F.col("size"))
    return t.with_df(rows.select(*t.modes, (F.col("v") / size).alias("v")))


@dataclass
class Kruskal:
    """Factors and component weights."""

    factors: list[Factor]
    weights: np.ndarray

    @property
    def rank(self) -> int:
        return len(self.weights)

    def norm(self, grams: list[np.ndarray] | None = None) -> float:
        """Norm of the full tensor from rank-sized matrices alone."""
        grams = grams or [gram(f) for f in self.factors]
        return float(max(self.weights @ reduce(mul, grams) @ self.weights, 0.0)) ** 0.5


def model_value(modes, weights) -> Column:
    return F.expr(model_sql(modes, weights))


def model_sql(modes, weights) -> str:
    """Sum over components of the product of joined factor columns."""
    return " + ".join(f"{number(w)} * {product_sql(modes, c)}" for c, w in enumerate(weights))


def kruskal_cells(model: Kruskal, t: Tensor) -> DataFrame:
    """Model value (``model``) at the cells of ``t``; densify ``t`` first for the full tensor."""
    modes = range(t.order)
    rows = join_factors(t, model.factors, modes)
    return rows.select(*t.modes, "v", model_value(modes, model.weights).alias("model"))


def component_cells(model: Kruskal, t: Tensor) -> DataFrame:
    """Contribution of every component at the cells of ``t``."""
    modes = range(t.order)
    parts = [F.struct(F.lit(c).alias("component"), (product(modes, c) * float(w)).alias("part"))
             for c, w in enumerate(model.weights)]
    rows = join_factors(t, model.factors, modes).select(*t.modes, F.explode(F.array(*parts)).alias("e"))
    return rows.select(*t.modes, "e.*")


def kruskal_innerprod(model: Kruskal, t: Tensor) -> float:
    rows = kruskal_cells(model, t)
    return float(rows.agg(F.sum(F.col("v") * F.col("model"))).first()[0] or 0.0)


def kruskal_mttkrp(model: Kruskal, others: list[Factor], mode: int) -> Factor:
    """MTTKRP of a Kruskal tensor: its factor times the element-wise product of small cross matrices."""
    cross = [inner(model.factors[m], f) for m, f in enumerate(others) if m != mode]
    return times(model.factors[mode], np.diag(model.weights) @ reduce(mul, cross))


def rel_frobenius(norm_x: float, norm_m: float, product_xm: float) -> float:
    return max(norm_x ** 2 + norm_m ** 2 - 2 * product_xm, 0.0) ** 0.5 / norm_x


def model_total(model: Kruskal) -> tuple[float, bool]:
    """Sum of the model over all cells, from column sums alone, and whether no factor or weight is negative."""
    total, positive = np.array(model.weights, float), bool((model.weights >= 0).all())
    for f in model.factors:
        row = f.df.agg(*[F.expr(f"sum({c})") for c in f.columns], *[F.expr(f"min({c})") for c in f.columns]).first()
        total = total * [v or 0.0 for v in row[:f.rank]]
        positive = positive and all((v or 0.0) >= 0 for v in row[f.rank:])
    return float(total.sum()), positive


def errors(model: Kruskal, t: Tensor) -> DataFrame:
    """Relative Frobenius and relative absolute error over all cells, from one pass over the cells that ``t`` holds.

    Absent cells are 0 and differ by the model alone, so their squares are the model's squared norm less that of the cells
    held, and their absolute values, of a nonnegative model, its sum less theirs.  The absolute error of a model with
    negative entries has no such form and is NULL; densify the tensor for it.
    """
    total, positive = model_total(model)
    gap = F.col("v") - F.col("model")
    seen = kruskal_cells(model, t).agg(
        F.sum(gap * gap).alias("gap_sq"), F.sum(F.abs(gap)).alias("gap_abs"), F.sum(F.col("model") * F.col("model")).alias("model_sq"),
        F.sum("model").alias("model_sum"), F.sum(F.col("v") * F.col("v")).alias("v_sq"), F.sum("v").alias("v_sum"))
    rest_sq = F.greatest(F.lit(model.norm() ** 2) - F.col("model_sq"), F.lit(0.0))
    rest_abs = F.greatest(F.lit(total) - F.col("model_sum"), F.lit(0.0)) if positive else F.lit(None).cast("double")
    return seen.select(F.sqrt((F.col("gap_sq") + rest_sq) / F.col("v_sq")).alias("rel_frobenius"),
                       ((F.col("gap_abs") + rest_abs) / F.col("v_sum")).alias("rel_abs"))


def divergence(model: Kruskal, t: Tensor, beta: float) -> float:
    """Total divergence over all cells without building them, for beta 2, 1 (Kullback-Leibler) and 0 (Itakura-Saito).

    The zero cells of beta 2 come from the model's norm, those of beta 1 from its sum; with beta 0 a zero cell is infinitely
    far from a positive model, so the sum is infinite unless ``t`` holds every cell with a positive value.
    """
    if beta not in (0, 1, 2):
        raise ValueError("only beta 0, 1 and 2 have a form without the zero cells; densify the tensor for others")
    v, m = F.col("v"), F.col("model")
    seen = kruskal_cells(model, t).agg(F.sum(beta_divergence(v, m, beta)), F.sum(m * m), F.sum(m), F.count_if(v > 0)).first()
    here, squares, sums, positive = (x or 0.0 for x in seen)
    if beta == 2:
        return here + max(model.norm() ** 2 - squares, 0.0) / 2
    if beta == 1:
        return here + model_total(model)[0] - sums
    return here if positive == t.cells() else float("inf")


def beta_divergence(a: Column, b: Column, beta: float) -> Column:
    """Divergence of one cell: Itakura-Saito (0), Kullback-Leibler (1), otherwise the general form."""
    if beta == 0:
        return a / b - F.log(a / b) - 1
    if beta == 1:
        return F.when(a == 0, b).otherwise(a * (F.log(a) - F.log(b)) + b - a)
    general = F.pow(a, F.lit(float(beta))) + (beta - 1.0) * F.pow(b, F.lit(float(beta)))
    return (general - beta * a * F.pow(b, F.lit(beta - 1.0))) / (beta * (beta - 1.0))


def tucker_sql(modes, core: np.ndarray) -> str:
    terms = [f"{number(core[at])} * " + " * ".join(f"m{m}_{c}" for m, c in zip(modes, at))
             for at in np.ndindex(*core.shape) if core[at] != 0]
    return " + ".join(terms) or "0D"


def tucker_value(modes, core: np.ndarray) -> Column:
    """Value of a Tucker model from joined factor columns and a small core."""
    return F.expr(tucker_sql(modes, core))


def tucker_cells(core: np.ndarray, factors: list[Factor], t: Tensor) -> DataFrame:
    """Tucker model value at the cells of ``t``."""
    modes = range(t.order)
    return join_factors(t, factors, modes).select(*t.modes, "v", tucker_value(modes, core).alias("model"))


def pack(factors: list[Factor]) -> DataFrame:
    """All factor entries as one vector (pos, value): mode by mode, row by row."""
    out, offset = None, 0
    for f in factors:
        cells = F.posexplode(F.array(*f.columns)).alias("c", "value")
        rows = f.df.select("idx", cells).select((F.col("idx") * f.rank + F.col("c") + offset).alias("pos"), "value")
        out = rows if out is None else out.unionByName(rows)
        offset += f.rows * f.rank
    return out


def unpack(vector: DataFrame, shape, rank: int) -> list[Factor]:
    """Inverse of :func:`pack`."""
    factors, offset = [], 0
    for n in shape:
        at = F.col("pos") - offset
        part = vector.filter((F.col("pos") >= offset) & (F.col("pos") < offset + n * rank))
        cells = part.select(int_div(at, F.lit(rank)).alias("idx"), (at % rank).alias("c"), "value")
        sums = [F.max(F.when(F.col("c") == c, F.col("value"))).alias(f"f{c}") for c in range(rank)]
        factors.append(Factor(cells.groupBy("idx").agg(*sums), n, rank))
        offset += n * rank
    return factors


def signs(f: Factor) -> np.ndarray:
    """-1 for every component whose entry of largest magnitude is negative (first row wins a tie)."""
    tops = f.df.agg(*[F.expr(f"max_by({c}, struct(abs({c}), -idx))") for c in f.columns]).first()
    return np.array([-1.0 if (top or 0.0) < 0 else 1.0 for top in tops])


def flipsign(f: Factor) -> Factor:
    """Make the entry of largest magnitude in every component positive."""
    return scaled(f, signs(f))


def scaled(f: Factor, by: np.ndarray) -> Factor:
    return Factor(f.df.selectExpr("idx", *[f"{c} * {number(x)} as {c}" for c, x in zip(f.columns, by)]), f.rows, f.rank)
