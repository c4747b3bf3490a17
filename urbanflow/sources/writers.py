"""Writers.  Parquet tables are the default form; text forms exist for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet table of tensors, factors, features or counts, optionally one folder per partition value."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def text_lines(df: DataFrame, sep: str = ",") -> DataFrame:
    """One text line (value) per row; timestamps to the second, NULL as an empty field."""
    return df.select(F.to_csv(F.struct("*"), {"sep": sep, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}).alias("value"))


def write_lines(df: DataFrame, path: str, sep: str = ",") -> None:
    """Headerless text lines, as many files as there are partitions."""
    df.write.mode("overwrite").option("sep", sep).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for small final reports only."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_variability(df: DataFrame, path: str) -> None:
    """Gzip TSV lines: hour, src, dst, n, mean, mae, err, deviation list."""
    devs = F.concat_ws(",", F.transform("devs", lambda x: x.cast("string")))
    rows = df.select("hour", "src", "dst", "n", "mean", "mae", "err", devs.alias("devs"))
    rows.write.mode("overwrite").option("sep", "\t").option("compression", "gzip").csv(path)


def write_index(index: DataFrame, path: str) -> None:
    """Index lines: number, name."""
    index.select("idx", "name").coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


def tensor_lines(dense: DataFrame, modes: tuple[str, str, str] = ("i", "j", "k")) -> DataFrame:
    """One JSON list for the last index per pair of the others (i, j, json), from a densified long table.

    Neither the tensor nor a plane of it is ever one value: readers take the lines in order of (i, j).
    """
    i, j, k = modes
    rows = dense.groupBy(i, j).agg(F.sort_array(F.collect_list(F.struct(k, "v"))).alias("cells"))
    return rows.select(i, j, F.to_json(F.transform("cells", lambda c: c["v"])).alias("json"))


def read_tensor_lines(lines: DataFrame) -> DataFrame:
    """Inverse of :func:`tensor_lines`, zeros left out."""
    cells = F.posexplode(F.from_json("json", "array<double>")).alias("k", "v")
    return lines.select("i", "j", cells).filter(F.col("v") != 0)
