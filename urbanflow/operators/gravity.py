"""Gravity-model fits and traffic regressions."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.functions.geo import distance_compat
from urbanflow.operators.od import with_positions

SINGULAR = 1e-12


def gravity_rows(counts: DataFrame, locations: DataFrame, day: int) -> DataFrame:
    """Pairs of one day with distance and both node totals; pairs at distance zero are left out.

    The day's pairs are aggregated once; pairs and both totals read the same shuffle, so the counts are not
    scanned again for the totals.
    """
    pairs = counts.filter(F.col("day") == day).groupBy("src", "dst").agg(F.sum("cnt").alias("count"))
    source = pairs.groupBy("src").agg(F.sum("count").alias("src_total"))
    target = pairs.groupBy("dst").agg(F.sum("count").alias("dst_total"))
    placed = with_positions(pairs, locations)
    dist = distance_compat(F.col("src_lng"), F.col("src_lat"), F.col("dst_lng"), F.col("dst_lat"))
    rows = placed.select("src", "dst", dist.alias("dist"), "count").filter(F.col("dist") != 0)
    return rows.join(source, "src").join(target, "dst")


def gravity_by_station(rows: DataFrame) -> DataFrame:
    """Per station and role: log count on (log total of the other end, log distance), with intercept.

    The two slopes solve the 2x2 system of centred moments; where that is singular the least-norm
    solution is taken.  Only moments are shuffled, so a station with very many pairs is no hot spot.
    """
    view = F.explode(F.array(
        F.struct(F.lit("src").alias("role"), F.col("src").alias("name"), F.log("dst_total").alias("x1")),
        F.struct(F.lit("dst").alias("role"), F.col("dst").alias("name"), F.log("src_total").alias("x1"))))
    flat = rows.select(view.alias("e"), F.log("dist").alias("x2"), F.log("count").alias("y")).select("e.*", "x2", "y")
    moments = flat.groupBy("name", "role").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("x1").alias("s11"), F.var_pop("x2").alias("s22"),
        F.covar_pop("x1", "x2").alias("s12"), F.covar_pop("x1", "y").alias("t1"), F.covar_pop("x2", "y").alias("t2"))
    trace = F.col("s11") + F.col("s22")
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    moments = moments.withColumns({"trace": trace, "det": det})

    def slope(full, flatdir):
        least = flatdir / (F.col("trace") * F.col("trace"))
        return (F.when(F.col("trace") <= 1e-18, 0.0)
                .when(F.col("det") <= SINGULAR * F.col("trace") * F.col("trace"), least)
                .otherwise(F.try_divide(full, F.col("det"))))

    s11, s12, s22, t1, t2 = (F.col(c) for c in ("s11", "s12", "s22", "t1", "t2"))
    return moments.select("name", "role", "n", slope(s22 * t1 - s12 * t2, s11 * t1 + s12 * t2).alias("volume_coef"),
                          slope(s11 * t2 - s12 * t1, s12 * t1 + s22 * t2).alias("distance_coef"))


def gravity_tradeoff(coefs: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted line of the distance coefficient on the volume coefficient, per role.

    ``weights``: name, weight (volume over a normalizer).
    """
    joined = coefs.join(weights, "name")
    x, y, w = F.col("volume_coef"), F.col("distance_coef"), F.col("weight")
    sums = joined.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * x).alias("sx"),
                                      F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"),
                                      F.sum(w * x * y).alias("sxy"))
    slope = F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"),
                         F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    sums = sums.withColumn("slope", slope)
    return sums.select("role", "n", "slope",
                       F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), F.col("sw")).alias("intercept"))


def station_weights(rows: DataFrame, normalizer: float) -> DataFrame:
    """Weight of a station: its origin total if it appears as an origin, else its destination total."""
    view = F.explode(F.array(
        F.struct(F.col("src").alias("name"), F.col("src_total").alias("as_src"), F.lit(None).cast("long").alias("as_dst")),
        F.struct(F.col("dst").alias("name"), F.lit(None).cast("long").alias("as_src"), F.col("dst_total").alias("as_dst"))))
    flat = rows.select(view.alias("e")).select("e.*")
    return flat.groupBy("name").agg(
        (F.coalesce(F.max("as_src"), F.max("as_dst")) / F.lit(float(normalizer))).alias("weight"))


def linear_fit(rows: DataFrame, features: list[str], label: str):
    """Ordinary least squares by the normal equations; only the small moment matrix leaves the executors."""
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    model = LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0).fit(assembled)
    return model, assembled


def gravity_global(rows: DataFrame) -> DataFrame:
    """Log pair volume on the logs of origin total, destination total and distance."""
    logs = rows.select(F.log("src_total").alias("log_src"), F.log("dst_total").alias("log_dst"),
                       F.log("dist").alias("log_dist"), F.log("count").alias("log_count"))
    names = ["log_src", "log_dst", "log_dist"]
    model, _ = linear_fit(logs, names, "log_count")
    rows_out = [(n, float(c)) for n, c in zip(names, model.coefficients)] + [("intercept", float(model.intercept))]
    return rows.sparkSession.createDataFrame(rows_out, "term string, coef double")


def poi_regression(node_totals: DataFrame, poi_counts: DataFrame, features: list[str]) -> DataFrame:
    """Traffic of a station on nearby POI counts: fitted value and relative residual, plus overall R2.

    ``node_totals``: name, count.  ``poi_counts``: name and one column per feature.
    """
    rows = node_totals.join(poi_counts, "name").withColumn("traffic", F.col("count").cast("double"))
    model, assembled = linear_fit(rows, features, "traffic")
    fitted = model.transform(assembled)
    return fitted.select("name", "count", F.col("prediction").alias("fitted"),
                         F.try_divide(F.abs(F.col("prediction") - F.col("traffic")), F.col("traffic")).alias("rel_residual"),
                         F.lit(float(model.summary.r2)).alias("r2"))
