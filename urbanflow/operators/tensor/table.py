"""Sparse tensors as long tables: one index column per mode and a value column ``v``."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanflow.functions.text import int_div
from urbanflow.session import checkpointed

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
ACCUMULATORS = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Tensor:
    """A long table, the names of its index columns and the length of each mode.  Absent cells are 0."""

    df: DataFrame
    modes: tuple[str, ...]
    shape: tuple[int, ...]

    @property
    def order(self) -> int:
        return len(self.modes)

    def others(self, *drop: int) -> list[int]:
        return [m for m in range(self.order) if m not in drop]

    def with_df(self, df: DataFrame) -> "Tensor":
        return replace(self, df=df)

    def cells(self) -> int:
        return math.prod(self.shape)


def tensor(df: DataFrame, modes, shape=None, accumulate: str | None = None, order_by: str | None = None) -> Tensor:
    """Check subscripts and build a tensor; the shape defaults to the largest subscript plus one."""
    modes = tuple(modes)
    for m in modes:
        if not isinstance(df.schema[m].dataType, INTEGER_TYPES):
            raise ValueError(f"subscripts of mode {m} must be integers")
    if not isinstance(df.schema["v"].dataType, T.NumericType):
        raise ValueError("values must be numbers")
    if shape is not None and len(shape) != len(modes):
        raise ValueError("the shape must have one length per mode")
    df = df.select(*modes, *([order_by] if order_by else []), F.col("v").cast("double").alias("v"))
    if accumulate:
        df = accum(df, modes, accumulate, order_by)
    if shape is None:
        top = df.agg(*[F.max(m).alias(m) for m in modes]).first()
        shape = tuple(0 if top[m] is None else int(top[m]) + 1 for m in modes)
    return Tensor(df, modes, tuple(int(n) for n in shape))


def accum(df: DataFrame, modes, how: str = "sum", order_by: str | None = None) -> DataFrame:
    """Fold duplicate subscripts; ``last`` takes the value with the largest ``order_by``."""
    if how == "last":
        value = F.max_by("v", order_by)
    else:
        value = ACCUMULATORS[how]("v")
    return df.groupBy(*modes).agg(value.alias("v"))


def nonzeros(t: Tensor) -> Tensor:
    return t.with_df(t.df.filter(F.col("v") != 0))


def read_point(t: Tensor, point) -> float:
    """Value at one point, 0 if absent; duplicates are added."""
    here = t.df
    for name, at in zip(t.modes, point):
        here = here.filter(F.col(name) == at)
    return float(here.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v")).first()["v"])


def read_points(t: Tensor, points: DataFrame) -> DataFrame:
    """Values at many points (a table of subscripts), 0 where absent."""
    summed = accum(t.df, t.modes)
    return points.join(summed, list(t.modes), "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def numbered(df: DataFrame) -> DataFrame:
    """Add a running number ``idx`` from 0 in partition order, without bringing the rows into one task.

    Rows are numbered inside their partition; the partition offsets come from one row per partition.  The
    numbering is written to the checkpoint folder so that it is computed exactly once.
    """
    part = F.spark_partition_id()
    local = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    rows = checkpointed(df.select("*", part.alias("part"), local.alias("pos")))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").select(*df.columns, (F.col("pos") + F.col("offset")).alias("idx"))


def dense_index(names: DataFrame) -> DataFrame:
    """Number distinct names 0, 1, ... in sort order; names are sorted by range partitions."""
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered(names.select("name").distinct().repartitionByRange(parts, "name").sortWithinPartitions("name"))


def percent(t: Tensor) -> Tensor:
    """Each hour as percent of its pair's total; a pair holds at most one row per hour."""
    pair = Window.partitionBy(*t.modes[:-1])
    share = F.try_divide(F.col("v") * 100.0, F.sum("v").over(pair))
    return t.with_df(t.df.select(*t.modes, F.coalesce(share, F.lit(0.0)).alias("v")))


def threshold(t: Tensor, least: float) -> Tensor:
    """Keep the hours of pairs whose total reaches ``least``."""
    pair = Window.partitionBy(*t.modes[:-1])
    rows = t.df.withColumn("pair_total", F.sum("v").over(pair)).filter(F.col("pair_total") >= least)
    return t.with_df(rows.drop("pair_total"))


def densify(t: Tensor) -> Tensor:
    """All cells of the box, 0 where absent.  Cells are generated from one running number."""
    ids = t.df.sparkSession.range(t.cells())
    subs = unravel(F.col("id"), [t.shape[m] for m in reversed(range(t.order))])
    grid = ids.select(*[subs[t.order - 1 - m].alias(name) for m, name in enumerate(t.modes)])
    rows = grid.join(t.df, list(t.modes), "left")
    return t.with_df(rows.select(*t.modes, F.coalesce("v", F.lit(0.0)).alias("v")))


def unravel(index: Column, shape) -> list[Column]:
    """Subscripts of a linear index with the first mode running fastest."""
    subs, stride = [], 1
    for n in shape:
        subs.append(int_div(index, F.lit(stride)) % F.lit(n).cast("long"))
        stride *= n
    return subs


def ravel(columns, shape) -> Column:
    """Linear index with the last column running fastest."""
    index = F.lit(0).cast("long")
    for column, n in zip(columns, shape):
        index = index * n + column
    return index


@dataclass(frozen=True)
class Unfolded:
    """A matrix ``(row, col, v)`` that remembers the tensor it came from."""

    df: DataFrame
    rows: tuple[int, ...]
    cols: tuple[int, ...]
    modes: tuple[str, ...]
    shape: tuple[int, ...]


def unfold(t: Tensor, rdims, cdims=None, transp: bool = False) -> Unfolded:
    """Matricize; remaining modes form the columns in descending order, the last of them running fastest."""
    rdims = [rdims] if isinstance(rdims, int) else list(rdims)
    if transp:
        cdims = rdims
        rdims = sorted(t.others(*cdims), reverse=True)
    elif cdims is None:
        cdims = sorted(t.others(*rdims), reverse=True)
    if sorted([*rdims, *cdims]) != list(range(t.order)):
        raise ValueError("rows and columns must name every mode once")

    def index(dims):
        return ravel([F.col(t.modes[d]) for d in dims], [t.shape[d] for d in dims])
    df = t.df.select(index(rdims).alias("row"), index(cdims).alias("col"), "v")
    return Unfolded(df, tuple(rdims), tuple(cdims), t.modes, t.shape)


def fold(u: Unfolded) -> Tensor:
    picked: dict[int, Column] = {}
    for name, dims in (("row", u.rows), ("col", u.cols)):
        backwards = list(reversed(dims))
        for d, sub in zip(backwards, unravel(F.col(name), [u.shape[d] for d in backwards])):
            picked[d] = sub
    df = u.df.select(*[picked[m].alias(name) for m, name in enumerate(u.modes)], "v")
    return Tensor(df, u.modes, u.shape)


def transpose(t: Tensor, axes) -> Tensor:
    """Permute the modes; new mode ``n`` is the old mode ``axes[n]``."""
    if sorted(axes) != list(range(t.order)):
        raise ValueError("axes must name every mode once")
    df = t.df.select(*[F.col(t.modes[a]).alias(t.modes[n]) for n, a in enumerate(axes)], "v")
    return Tensor(df, t.modes, tuple(t.shape[a] for a in axes))


def concatenate(parts: list[Tensor], axis: int) -> Tensor:
    """Append tensors along a mode; all other lengths must agree."""
    first = parts[0]
    df, offset = None, 0
    for p in parts:
        if any(p.shape[m] != first.shape[m] for m in first.others(axis)):
            raise ValueError("lengths of the other modes must agree")
        shift = [(F.col(a) + offset if m == axis else F.col(a)).cast("long").alias(b)
                 for m, (a, b) in enumerate(zip(p.modes, first.modes))]
        moved = p.df.select(*shift, "v")
        df = moved if df is None else df.unionByName(moved)
        offset += p.shape[axis]
    shape = tuple(offset if m == axis else n for m, n in enumerate(first.shape))
    return Tensor(df, first.modes, shape)


def differing_cells(a: Tensor, b: Tensor, tolerance: float = 0.0) -> DataFrame:
    """Cells where two tensors differ by more than the tolerance."""
    left = a.df.select(*a.modes, F.col("v").alias("va"))
    right = b.df.select(*[F.col(y).alias(x) for x, y in zip(a.modes, b.modes)], F.col("v").alias("vb"))
    both = left.join(right, list(a.modes), "full")
    gap = F.abs(F.coalesce("va", F.lit(0.0)) - F.coalesce("vb", F.lit(0.0)))
    return both.filter(gap > tolerance)


def equal(a: Tensor, b: Tensor, tolerance: float = 0.0) -> bool:
    return a.shape == b.shape and differing_cells(a, b, tolerance).isEmpty()


def holdout_key(t: Tensor) -> Column:
    """Repeatable number 0..999 per cell."""
    # Multipliers of the mask hash.
    primes = (7919, 104729, 1299709, 15485863, 32452843)
    mixed = sum((F.col(m).cast("long") * p for m, p in zip(t.modes, primes)), F.lit(0))
    return (mixed % 1000003 * 7919) % 1000


def holdout(t: Tensor, sample_rate: float) -> Tensor:
    """Drop (set to 0) the non-zero cells whose key falls outside the sample rate."""
    return t.with_df(t.df.filter((F.col("v") != 0) & (holdout_key(t) < int(round(sample_rate * 1000)))))


def sorted_cells(t: Tensor) -> DataFrame:
    """Non-zeros in order, the last mode most significant; for output only."""
    return t.df.orderBy(*reversed(t.modes))


def identity(spark, dim: int, order: int) -> Tensor:
    """Super-diagonal ones."""
    modes = tuple("ijklmnop"[:order])
    df = spark.range(dim).select(*[F.col("id").alias(m) for m in modes], F.lit(1.0).alias("v"))
    return Tensor(df, modes, (dim,) * order)


def commutation(spark, m: int, n: int) -> DataFrame:
    """Entries (row, col) of the matrix that turns vec(A) into vec(transposed A), for an m x n matrix."""
    row = F.col("id")
    return spark.range(m * n).select(row.alias("row"), ((row % m) * n + int_div(row, F.lit(m))).alias("col"))


def slices(t: Tensor) -> DataFrame:
    """A third-order tensor with square slices as relation edges (k, s, o, v)."""
    if t.order != 3 or t.shape[0] != t.shape[1]:
        raise ValueError("a third-order tensor with square slices is needed")
    s, o, k = t.modes
    return t.df.select(F.col(k).alias("k"), F.col(s).alias("s"), F.col(o).alias("o"), "v")


def hourly(t: Tensor) -> DataFrame:
    return marginal(t, t.order - 1)


def marginal(t: Tensor, mode: int) -> DataFrame:
    return t.df.groupBy(F.col(t.modes[mode]).alias("idx")).agg(F.sum("v").alias("total"))


def marginals(t: Tensor, modes=None) -> DataFrame:
    """Totals per index of several modes in one pass."""
    picked = range(t.order) if modes is None else modes
    e = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(t.modes[m]).cast("long").alias("idx")) for m in picked]))
    return t.df.select(e.alias("e"), "v").select("e.*", "v").groupBy("mode", "idx").agg(F.sum("v").alias("total"))


def histogram(t: Tensor, bins: int = 1000) -> DataFrame:
    """Equal-width histogram over all cells, absent ones counted as 0; the last bin is closed."""
    stats = t.df.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("present"))
    absent = F.lit(t.cells()) - F.col("present")
    stats = stats.select(absent.alias("absent"),
                         F.when(absent > 0, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("low"),
                         F.when(absent > 0, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("high"))
    row = stats.select(F.struct("absent", "low", "high")).scalar()
    values = t.df.select("v", F.lit(1).cast("long").alias("weight")).unionByName(
        stats.select(F.lit(0.0).alias("v"), F.col("absent").alias("weight")))
    placed = values.withColumn("s", row)
    share = F.try_divide(F.col("v") - F.col("s.low"), F.col("s.high") - F.col("s.low"))
    at = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return placed.groupBy(at.alias("bin")).agg(F.sum("weight").alias("cnt")).filter(F.col("cnt") > 0)
