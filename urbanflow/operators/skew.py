"""Hot-key handling shared by the per-key ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.functions.text import epoch_seconds
from urbanflow.session import checkpointed

HOT_ROWS = 5_000_000
CHUNK_SECONDS = 60


def hot_keys(df: DataFrame, key: str, threshold: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``threshold`` rows.

    The counts combine map-side and read only the key column.  There can be no more than
    ``rows / threshold`` such keys, which bounds the broadcast made from them.
    """
    counts = df.groupBy(F.col(key).alias("hot_key")).agg(F.count(F.lit(1)).alias("hot_rows"))
    return counts.filter(F.col("hot_rows") >= threshold).select("hot_key")


def split_hot(df: DataFrame, key: str, threshold: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Split into rows of ordinary keys and rows of hot keys (None without any); no row is lost.

    The check is one narrow pass made when the operator is called.  Found keys are written to the checkpoint
    folder, so that both sides read the same list.
    """
    hot = hot_keys(df, key, threshold)
    if hot.isEmpty():
        return df, None
    hot = F.broadcast(checkpointed(hot))
    same = F.col(key).eqNullSafe(F.col("hot_key"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def with_time_chunk(df: DataFrame, ts: str, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Number the time slice of each row, so that a hot key spreads over many tasks."""
    return df.withColumn("chunk", F.floor(epoch_seconds(F.col(ts)) / seconds))


def join_chunks(rows: DataFrame, per_chunk: DataFrame, key: str) -> DataFrame:
    """Attach one row per (key, chunk) to the rows of that chunk; a NULL key matches itself."""
    side = per_chunk.withColumnsRenamed({key: "side_key", "chunk": "side_chunk"})
    same = F.col(key).eqNullSafe(F.col("side_key")) & F.col("chunk").eqNullSafe(F.col("side_chunk"))
    return rows.join(side, same).drop("side_key", "side_chunk")
