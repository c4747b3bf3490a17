"""Reconstruction of hourly flow shares from factors, places and distance with Spark ML."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.functions.geo import haversine
from urbanflow.functions.text import int_div
from urbanflow.operators.tensor.algebra import Factor, hinted
from urbanflow.operators.tensor.table import Tensor, dense_index
from urbanflow.session import checkpointed

HOURS = 24

# Ship the small batch functions with the task, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pair_features(t: Tensor, src: Factor, dst: Factor, places: DataFrame, features: list[str],
                  min_volume: float) -> DataFrame:
    """One row per pair of different locations with enough volume.

    ``places``: idx, lng, lat and one column per feature.  Result: i, j, volume, dist (thousands of km), factor
    rows ``sf*`` and ``df*``, place features ``sx*`` and ``dx*``, and the hourly percents ``y0`` .. ``y23``.
    Pairs without trips have volume 0, so no pair is generated that the tensor does not hold.
    """
    cells = t.df.filter(F.col("i") != F.col("j"))
    volume = cells.groupBy("i", "j").agg(
        F.sum("v").alias("volume"),
        *[F.sum(F.when(F.col("k") == k, F.col("v")).otherwise(0.0)).alias(f"v{k}") for k in range(HOURS)])
    kept = volume.filter(F.col("volume") >= min_volume)
    share = [F.coalesce(F.try_divide(F.col(f"v{k}") * 100.0, F.col("volume")), F.lit(0.0)).alias(f"y{k}") for k in range(HOURS)]
    rows = kept.select("i", "j", "volume", *share)
    for key, side, factor in (("i", "s", src), ("j", "d", dst)):
        f = factor.df.selectExpr(f"idx as {key}", *[f"{c} as {side}{c}" for c in factor.columns])
        p = places.selectExpr(f"idx as {key}", f"lng as {side}lng", f"lat as {side}lat",
                              *[f"{c} as {side}x{n}" for n, c in enumerate(features)])
        rows = rows.join(hinted(f, factor.is_small()), key).join(p, key)
    dist = haversine(F.col("slng"), F.col("slat"), F.col("dlng"), F.col("dlat")) / 1000.0
    return rows.withColumn("dist", dist).drop("slng", "slat", "dlng", "dlat")


def hourly_rows(pairs: DataFrame) -> DataFrame:
    """One row per pair and hour with the target share ``y``."""
    targets = F.posexplode(F.array(*[f"y{k}" for k in range(HOURS)])).alias("hour", "y")
    return pairs.select(*[c for c in pairs.columns if not (c[0] == "y" and c[1:].isdigit())], targets)


def model_columns(pairs: DataFrame, model: str) -> tuple[DataFrame, list[str]]:
    """Features of the three models: factor products, places with distance, or both."""
    rank = sum(c.startswith("sf") for c in pairs.columns)
    places = [c for c in pairs.columns if c[:2] in ("sx", "dx")]
    products = [f"p{c}" for c in range(rank)]
    rows = pairs.withColumns({f"p{c}": F.expr(f"sf{c} * df{c}") for c in range(rank)})
    choice = {"model1": products, "model2": [*places, "dist"], "model3": [*products, *places, "dist"]}
    return rows, choice[model]


def learner(name: str, **options):
    if name == "gbt":
        return GBTRegressor(labelCol="y", featuresCol="features", lossType="absolute", seed=50, **options)
    if name == "linear":
        return LinearRegression(labelCol="y", featuresCol="features", solver="normal", regParam=1e-6, **options)
    raise ValueError(f"unknown learner {name!r}")


def _assembled(rows: DataFrame, names: list[str], name: str) -> DataFrame:
    """Feature vectors; a linear model gets one column per hour (and per hour and factor), trees the number."""
    if name == "linear":
        hours = [f"h{k}" for k in range(1, HOURS)]
        rows = rows.withColumns({f"h{k}": (F.col("hour") == k).cast("double") for k in range(1, HOURS)})
        names = [*names, *hours]
    else:
        names = [*names, "hour"]
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows)


def with_folds(pairs: DataFrame, n_folds: int) -> DataFrame:
    """Contiguous folds over the pairs in (i, j) order; the first folds take one pair more if needed.

    The pairs are written once, and the result too, because every fold reads them for training and for prediction.
    """
    pairs = checkpointed(pairs)
    order = F.struct("i", "j")
    index = dense_index(pairs.select(order.alias("name"))).select("name.i", "name.j", "idx")
    total = index.count()
    size, extra = divmod(total, n_folds)
    border = (size + 1) * extra
    fold = F.when(F.col("idx") < border, int_div(F.col("idx"), F.lit(size + 1))).otherwise(
        extra + int_div(F.col("idx") - border, F.lit(max(size, 1))))
    return checkpointed(pairs.join(index, ["i", "j"]).withColumn("fold", fold.cast("int")).drop("idx"))


def reconstruct(train: DataFrame, test: DataFrame, model: str, learner_name: str = "gbt", **options) -> DataFrame:
    """Fit on the pairs of one table and predict the hourly shares of the other."""
    train_rows, names = model_columns(train, model)
    test_rows, _ = model_columns(test, model)
    fitted = learner(learner_name, **options).fit(_assembled(hourly_rows(train_rows), names, learner_name))
    scored = fitted.transform(_assembled(hourly_rows(test_rows), names, learner_name))
    return scored.select("i", "j", "hour", "y", "prediction")


def kfold(pairs: DataFrame, model: str, n_folds: int = 10, learner_name: str = "gbt", **options) -> DataFrame:
    """Predictions for every pair by models that have not seen its fold."""
    folded = with_folds(pairs, n_folds)
    out = None
    for fold in range(n_folds):
        part = reconstruct(folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold), model,
                           learner_name, **options)
        part = part.withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    return out


#: Directions of the normal equations below this share of the largest are left out of a fold's fit.
DEPENDENT = 1e-10


def fold_sums(folded: DataFrame, names: list[str]) -> dict[tuple[str, int], np.ndarray]:
    """Z'Z of every (case, fold), where a pair's row of Z is 1, its features ``names`` and its 24 shares.

    One pass over the pairs: tasks add up their rows, and what they send is merged by case and fold.  The driver gets one
    matrix of features times features for each case and fold.
    """
    columns = [*names, *[f"y{k}" for k in range(HOURS)]]
    width = len(columns) + 1
    schema = "case string, fold int, part int, sums array<double>"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby(["case", "fold"], sort=False):
                z = np.column_stack([np.ones(len(rows)), rows[columns].to_numpy(float)])
                found[key] = found.get(key, 0.0) + z.T @ z
        context = TaskContext.get()
        for (case, fold), total in found.items():
            yield pd.DataFrame({"case": [case], "fold": [fold], "part": [context.partitionId() if context else 0],
                                "sums": [total.ravel()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for case, fold, part in zip(batch["case"], batch["fold"], batch["sums"]):
                found[case, fold] = found.get((case, fold), 0.0) + np.asarray(part)
        for (case, fold), total in found.items():
            yield pd.DataFrame({"case": [case], "fold": [fold], "part": [0], "sums": [total]})

    parts = folded.select("case", "fold", *columns).mapInPandas(add, schema)
    merged = parts.repartition("case", "fold").sortWithinPartitions("case", "fold", "part").mapInPandas(merge, schema)
    return {(r["case"], r["fold"]): np.array(r["sums"]).reshape(width, width) for r in merged.collect()}


def fold_weights(sums: dict[tuple[str, int], np.ndarray], names: list[str], models: dict[str, list[str]]
                 ) -> dict[tuple[str, str, int], np.ndarray]:
    """(case, model, fold) -> least-squares weights (constant and features x hours) of all pairs of the case but the fold's.

    The statistics of a fold's training pairs are those of the case less its own, and a model's are rows and columns of
    the statistics of all features, so nothing is read again.
    """
    found = {}
    for case in {c for c, _ in sums}:
        total = sum(s for (c, _), s in sums.items() if c == case)
        for fold in (f for c, f in sums if c == case):
            rest = total - sums[case, fold]
            for model, chosen in models.items():
                at = [0, *[1 + names.index(n) for n in chosen]]
                size = np.sqrt(np.maximum(rest[at, at], 1e-300))
                values, vectors = np.linalg.eigh(rest[np.ix_(at, at)] / np.outer(size, size))
                held = values > DEPENDENT * max(values.max(), 0.0)
                turned = vectors[:, held] / values[held] @ vectors[:, held].T
                found[case, model, fold] = turned @ (rest[at, 1 + len(names):] / size[:, None]) / size[:, None]
    return found


def fold_predictions(folded: DataFrame, names: list[str], models: dict[str, list[str]],
                     weights: dict[tuple[str, str, int], np.ndarray]) -> DataFrame:
    """(case, model, i, j, fold, hour, y, prediction): every pair by the fit that has not seen its fold."""
    targets = [f"y{k}" for k in range(HOURS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (case, fold), rows in batch.groupby(["case", "fold"], sort=False):
                y = rows[targets].to_numpy(float)
                for model, chosen in models.items():
                    x = np.column_stack([np.ones(len(rows)), rows[chosen].to_numpy(float)])
                    yield pd.DataFrame({
                        "case": case, "model": model, "i": np.repeat(rows["i"].to_numpy(), HOURS),
                        "j": np.repeat(rows["j"].to_numpy(), HOURS), "fold": fold,
                        "hour": np.tile(np.arange(HOURS), len(rows)), "y": y.ravel(),
                        "prediction": (x @ weights[case, model, fold]).ravel()})

    return folded.select("case", "i", "j", "fold", *names, *targets).mapInPandas(
        run, "case string, model string, i bigint, j bigint, fold int, hour int, y double, prediction double")


def linear_kfold(cases: dict[str, DataFrame], n_folds: int = 10, models: dict[str, list[str]] | None = None) -> DataFrame:
    """Predictions of linear models by hour for every pair of every case, from one pass for the fits and one for the result.

    ``cases`` maps a name (source and day type) to its pairs; ``models`` maps a name to feature columns, by default the
    three models of :func:`model_columns`.
    """
    folded, known = None, None
    for case, pairs in cases.items():
        rows, largest = model_columns(with_folds(pairs, n_folds), "model3")
        known = models or {m: model_columns(pairs, m)[1] for m in ("model1", "model2", "model3")}
        names = largest if models is None else sorted({c for chosen in models.values() for c in chosen})
        part = rows.select(F.lit(case).alias("case"), "i", "j", "fold", *names, *[f"y{k}" for k in range(HOURS)])
        folded = part if folded is None else folded.unionByName(part)
    return fold_predictions(folded, names, known, fold_weights(fold_sums(folded, names), names, known))


def error_by_model(scored: DataFrame) -> DataFrame:
    """Sum of absolute errors over the sum of targets, for every case and model."""
    gap = F.sum(F.abs(F.col("prediction") - F.col("y")))
    return scored.groupBy("case", "model").agg(F.count(F.lit(1)).alias("n"), F.try_divide(gap, F.sum("y")).alias("error"))


def total_error(scored: DataFrame) -> DataFrame:
    """Sum of absolute errors over the sum of targets."""
    gap = F.sum(F.abs(F.col("prediction") - F.col("y")))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.try_divide(gap, F.sum("y")).alias("error"))


def matrix_factorization(cells: DataFrame, rank: int, max_iter: int = 10, beta: float = 0.02, seed: int = 50):
    """L2-regularized factors of the observed (positive) cells (row, col, v) of a matrix."""
    observed = cells.filter(F.col("v") > 0).select(F.col("row").cast("int"), F.col("col").cast("int"), F.col("v").cast("float"))
    als = ALS(rank=rank, maxIter=max_iter, regParam=beta, userCol="row", itemCol="col", ratingCol="v", seed=seed)
    return als.fit(observed), observed


def mf_error(model, observed: DataFrame) -> DataFrame:
    gap = F.col("v") - F.col("prediction")
    return model.transform(observed).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
