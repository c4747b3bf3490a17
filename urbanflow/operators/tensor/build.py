"""Origin x destination x hour tensors from the variability table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.functions.geo import in_box
from urbanflow.operators.od import location_names, with_positions
from urbanflow.operators.tensor.table import Tensor, dense_index
from urbanflow.session import checkpointed

HOURS = 24


def od_tensor(var: DataFrame, locations: DataFrame, day_type: str) -> tuple[Tensor, DataFrame]:
    """Mean trips per (origin, destination, hour) for pairs inside the box, and the index of names.

    Both modes share one index, sorted by name.  The filtered pairs are checkpointed because the index and
    the tensor both read them.
    """
    rows = with_positions(var.filter(F.col("day_type") == day_type), locations)
    rows = rows.filter(in_box(F.col("src_lng"), F.col("src_lat")) & in_box(F.col("dst_lng"), F.col("dst_lat")))
    rows = checkpointed(rows.select("src", "dst", "hour", "mean"))
    index = dense_index(location_names(rows))
    return _indexed(rows, index, index.count()), index


def od_tensor_all(var: DataFrame, index: DataFrame, day_type: str, size: int) -> Tensor:
    """The same without the box, over all ``size`` known locations of a lookup table (name, idx)."""
    rows = var.filter(F.col("day_type") == day_type).select("src", "dst", "hour", "mean")
    return _indexed(rows, index, size)


def _indexed(rows: DataFrame, index: DataFrame, size: int) -> Tensor:
    source = index.select(F.col("name").alias("src"), F.col("idx").alias("i"))
    target = index.select(F.col("name").alias("dst"), F.col("idx").alias("j"))
    cells = rows.join(source, "src").join(target, "dst")
    df = cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"),
                      F.col("hour").cast("long").alias("k"), F.col("mean").alias("v"))
    return Tensor(df, ("i", "j", "k"), (size, size, HOURS))
