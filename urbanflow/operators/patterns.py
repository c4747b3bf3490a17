"""Patterns read from factors: component strength, temporal curves, spatial classes, error sweeps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.operators.places import bucket20
from urbanflow.operators.tensor import table as TB
from urbanflow.operators.tensor.algebra import Factor, Kruskal, errors
from urbanflow.operators.tensor.ntf import NTFResult, beta_ntf, ntf
from urbanflow.operators.tensor.table import Tensor

# Pair volume needed in a taxi tensor.
TAXI_VOLUME = {"workdays": 90, "holidays": 60}
METHODS = {"ANLS_BPP": "anls_bpp", "ANLS_AS": "anls_asgroup", "Beta_NTF": None}


def long_factor(f: Factor) -> DataFrame:
    """Factor entries as rows (idx, component, value)."""
    cells = F.posexplode(F.array(*f.columns)).alias("component", "value")
    return f.df.select("idx", cells)


def component_strength(factors: list[Factor]) -> DataFrame:
    """Product over the modes of the column sums, per component."""
    sums = None
    for m, f in enumerate(factors):
        part = long_factor(f).groupBy("component").agg(F.sum("value").alias(f"s{m}"))
        sums = part if sums is None else sums.join(part, "component")
    strength = F.expr(" * ".join(f"s{m}" for m in range(len(factors))))
    return sums.select("component", strength.alias("strength"))


def to_hundred(f: Factor) -> DataFrame:
    """Scale every component to a maximum of 100."""
    cells = long_factor(f)
    tops = cells.groupBy("component").agg(F.max("value").alias("top"))
    rows = cells.join(F.broadcast(tops), "component")  # one row per component
    return rows.select("idx", "component", F.try_divide(F.col("value") * 100.0, F.col("top")).alias("value"))


def spline_basis(points: int, xs: np.ndarray) -> np.ndarray:
    """Weights that turn values at 0 .. points-1 into values of the interpolating cubic spline at ``xs``.

    End condition: the third derivative is continuous at the second and the last but one knot.  The map is
    linear, so it is computed once from unit vectors and applied by a join.
    """
    n = points
    left = np.zeros((n, n))
    right = np.zeros((n, n))
    for i in range(1, n - 1):
        left[i, i - 1:i + 2] = 1.0, 4.0, 1.0
        right[i, i - 1:i + 2] = 6.0, -12.0, 6.0
    left[0, :3] = 1.0, -2.0, 1.0
    left[-1, -3:] = 1.0, -2.0, 1.0
    bend = np.linalg.solve(left, right)
    at = np.clip(np.floor(xs).astype(int), 0, n - 2)
    b = xs - at
    a = 1.0 - b
    eye = np.eye(n)
    return (a[:, None] * eye[at] + b[:, None] * eye[at + 1]
            + ((a ** 3 - a)[:, None] * bend[at] + (b ** 3 - b)[:, None] * bend[at + 1]) / 6.0)


def spline_xs(points: int = 24, step: float = 0.1) -> np.ndarray:
    return np.arange(0, points - 1, step)


def spline_profile(curves: DataFrame, points: int = 24, step: float = 0.1) -> DataFrame:
    """Resample curves (component, idx, value) every ``step``; the weights table is fixed by ``points``."""
    xs = spline_xs(points, step)
    weights = spline_basis(points, xs)
    rows = [(x, k, float(weights[x, k])) for x in range(len(xs)) for k in range(points)]
    basis = curves.sparkSession.createDataFrame(rows, "step int, idx bigint, w double")
    joined = curves.join(F.broadcast(basis), "idx")
    return joined.groupBy("component", "step").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def temporal_pattern(time_factor: Factor) -> DataFrame:
    return spline_profile(to_hundred(time_factor), time_factor.rows)


def spatial_class(f: Factor) -> DataFrame:
    """Component whose share in a row exceeds its average share most; NULL for an empty row, first wins a tie."""
    names = f.columns
    totals = f.df.agg(F.struct(*[F.sum(c).alias(c) for c in names]).alias("t"))
    whole = " + ".join(f"t.{c}" for c in names)
    rows = f.df.withColumn("t", totals.scalar()).withColumn("row_sum", F.expr(" + ".join(names)))
    shares = F.array(*[F.expr(f"try_divide({c}, row_sum) - try_divide(t.{c}, {whole})") for c in names])
    rows = rows.withColumn("shares", shares)
    best = F.array_position("shares", F.array_max("shares")) - 1
    return rows.select("idx", F.when(F.col("row_sum") != 0, best).cast("int").alias("class"))


def spatial_pattern(f: Factor, t: Tensor, mode: int, index: DataFrame) -> DataFrame:
    """Class and volume bucket of every location of a mode, by name."""
    volume = bucket20(TB.marginal(t, mode), "total")
    rows = spatial_class(f).join(volume, "idx").join(index, "idx")
    return rows.select("name", "idx", "class", "total", "bucket")


def prepared(t: Tensor, source: str, day_type: str) -> Tensor:
    """Metro tensors become percents per pair, taxi tensors keep pairs of enough volume."""
    if source == "metro":
        return TB.percent(t)
    return TB.threshold(t, TAXI_VOLUME[day_type])


def decompose(t: Tensor, method: str, rank: int, sample_rate: float = 1.0, min_iter: int = 50, max_iter: int = 500,
              beta_iter: int = 100) -> NTFResult:
    """Factorize the sampled cells by one of the three methods."""
    sampled = TB.holdout(t, sample_rate) if sample_rate < 1 else t
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if METHODS[method] is None:
        return beta_ntf(sampled, rank, beta=2, n_iter=beta_iter)
    return ntf(sampled, rank, method=METHODS[method], min_iter=min_iter, max_iter=max_iter)


def sampled_error(t: Tensor, model: Kruskal) -> DataFrame:
    """Errors of a model against the full tensor, all cells included; the cells without trips are never built."""
    return errors(model, t)


def error_sweep(tensors: dict, ranks, rates, methods=tuple(METHODS), **iterations) -> DataFrame:
    """Error of every (tensor, method, rank, sample rate); ``tensors`` maps (source, day type) to a tensor."""
    out = None
    for (source, day_type), t in tensors.items():
        for method in methods:
            for rank in ranks:
                for rate in rates:
                    model = decompose(t, method, rank, rate, **iterations).model
                    row = sampled_error(t, model).select(
                        F.lit(source).alias("source"), F.lit(day_type).alias("day_type"), F.lit(method).alias("method"),
                        F.lit(rank).alias("rank"), F.lit(rate).alias("sample_rate"), "rel_frobenius", "rel_abs")
                    out = row if out is None else out.unionByName(row)
    return out
