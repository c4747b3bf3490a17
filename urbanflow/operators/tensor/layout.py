"""Non-zeros laid out once for each mode, so that sweeps move factor rows only.

The copy of a mode is a bucketed table in the shared checkpoint folder: rows whose index of that mode hashes to the same
bucket lie together, sorted by it, and stay where they are in every half-sweep.  An index that holds more than its share
of the non-zeros is spread over all buckets by its other indices.  Losing an executor costs the tasks it ran, because
copies are files.

A half-sweep joins the copy with the factors of the other modes and sums per index.  A factor below the broadcast size goes
to every executor; a larger one is *routed*: a small table, also made once, says which buckets need a factor row, and only
rows that are needed travel there.  Sums leave a bucket as one row per index.

Where the longest mode is too long to be broadcast, its copy serves all modes: each of its rows is then needed in one bucket
only, and what the buckets send for a shorter mode is one row per index that they hold.
"""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanflow.operators.tensor.algebra import BROADCAST_BYTES, Factor, hinted, product_sql
from urbanflow.operators.tensor.table import Tensor
from urbanflow.session import checkpoint_table, drop_table, ensure_checkpoint_dir

#: Without this a join on (bucket, index) would shuffle the copy, although its buckets already hold the rows together.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
#: An index with more than this share of a bucket's mean is spread over all buckets.
SPREAD = 0.25
#: Cells of a bucket up to so many buckets, and beyond them: fewer buckets send fewer sums and need fewer factor rows.
CELLS, FEW, MANY_CELLS = 250_000, 48, 4_000_000
#: Bytes of a factor row, at the rank that most fits have.
ROW_BYTES = 24


def bucket_count(cells: int, most: int) -> int:
    return max(1, min(most, max(min(ceil(cells / CELLS), FEW), ceil(cells / MANY_CELLS))))


def bucket_labels(spark, buckets: int) -> list[int]:
    """For each bucket a number that Spark's hash puts there, so that a column of these numbers deals rows exactly."""
    if buckets == 1:
        return [0]
    tries = spark.range(max(64 * buckets, 1024)).selectExpr("cast(id as int) as label", f"pmod(hash(cast(id as int)), {buckets}) as b")
    found = {r["b"]: r["label"] for r in tries.groupBy("b").agg(F.min("label").alias("label")).collect()}
    return [found.get(b, b) for b in range(buckets)]


class ModeCopies:
    """The non-zeros of a tensor as one bucketed table for each mode; use it as a context manager."""

    def __init__(self, t: Tensor, buckets: int | None = None):
        self.tensor, self.spark = t, t.df.sparkSession
        self._tables: list[tuple[str, str]] = []
        self._before = self.spark.conf.get(CO_PARTITION, "true")
        self._routes: dict[tuple[int, int], DataFrame] = {}
        # The non-zeros are computed once; counts and copies read them from there.
        cells, path = checkpoint_table(t.df)
        total = cells.count()
        self.buckets = buckets or bucket_count(total, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self._labels = bucket_labels(self.spark, self.buckets)
        longest = max(range(t.order), key=lambda m: t.shape[m])
        shared = t.shape[longest] * ROW_BYTES > BROADCAST_BYTES
        #: The mode whose copy serves each mode, and the spread indices of each copy.
        self.home = [longest if shared else mode for mode in range(t.order)]
        self._large: dict[int, list] = {}
        made = {mode: self._copy(cells, total, mode) for mode in sorted(set(self.home))}
        self.copies = [made[mode] for mode in self.home]
        drop_table(self.spark, path)
        self.spark.conf.set(CO_PARTITION, "false")

    def __enter__(self) -> ModeCopies:
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(CO_PARTITION, self._before)
        for name, path in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_table(self.spark, path)
        self._tables = []

    def _stored(self, df: DataFrame, key: str, order: list[str]) -> DataFrame:
        name = f"urbanflow_{uuid.uuid4().hex}"
        path = f"{ensure_checkpoint_dir(self.spark)}/{name}"
        dealt = df.repartition(self.buckets, key).sortWithinPartitions(*order)
        dealt.write.bucketBy(self.buckets, key).sortBy(*order).option("path", path).saveAsTable(name)
        self._tables.append((name, path))
        return self.spark.table(name)

    def _copy(self, cells: DataFrame, total: int, mode: int) -> DataFrame:
        t, index = self.tensor, self.tensor.modes[mode]
        counts = cells.groupBy(index).agg(F.count("*").alias("n"))
        # At most buckets / SPREAD indices have more than that share, so the list is short whatever the data.
        share = max(1.0, SPREAD * total / self.buckets)
        large = [r[0] for r in counts.where(F.col("n") > share).collect()] if self.buckets > 1 else []
        self._large[mode] = large
        others = F.xxhash64(*[t.modes[m] for m in t.others(mode)])
        salt = F.when(F.col(index).isin(large), F.pmod(others, F.lit(self.buckets))).otherwise(F.lit(0).cast("long"))
        label = self._label(F.col(index), salt)
        return self._stored(cells.withColumn("bucket", label), "bucket", ["bucket", index])

    def _label(self, index: Column, salt: Column) -> Column:
        slot = F.pmod(F.xxhash64(index.cast("long"), salt), F.lit(self.buckets)).cast("int")
        return F.element_at(F.array(*[F.lit(x) for x in self._labels]), slot + 1)

    def _own(self, mode: int, f: Factor) -> DataFrame:
        """Rows of the factor that a copy is laid out by, with their bucket; a spread index goes to all of them."""
        own, large = self._label(F.col("idx"), F.lit(0).cast("long")), self._large[mode]
        everywhere = F.array(*[F.lit(x) for x in self._labels])
        at = F.explode(F.when(F.col("idx").isin(large), everywhere).otherwise(F.array(own))) if large else own
        return f.df.select("idx", *f.columns, at.alias("bucket"))

    def _route(self, mode: int, other: int) -> DataFrame:
        """(idx, bucket): the buckets of the copy of ``mode`` that need rows of the factor ``other``."""
        if (mode, other) not in self._routes:
            needed = self.copies[mode].select(F.col(self.tensor.modes[other]).alias("idx"), "bucket").distinct()
            self._routes[mode, other] = self._stored(needed, "idx", ["idx"])
        return self._routes[mode, other]

    def joined(self, mode: int, factors: list[Factor], modes) -> DataFrame:
        """The copy of ``mode`` with the factor rows of several modes as columns ``m{mode}_{component}``."""
        df = self.copies[mode]
        for m in modes:
            f, index = factors[m], self.tensor.modes[m]
            columns = [f"{c} as m{m}_{s}" for s, c in enumerate(f.columns)]
            if f.is_small():
                df = df.join(hinted(f.df.selectExpr(f"idx as {index}", *columns), True), index)
            else:
                home = self.home[mode]
                rows = self._own(m, f) if m == home else self._route(home, m).hint("shuffle_merge").join(f.df, "idx")
                rows = rows.selectExpr(f"idx as {index}", "bucket", *columns).repartition(self.buckets, "bucket")
                df = df.join(rows.hint("shuffle_hash"), ["bucket", index])
        return df

    def per_index(self, mode: int, rows: DataFrame, sums: dict[str, str]) -> DataFrame:
        """Sums per index of ``mode``: first within a bucket, where the rows are, then one row per bucket and index."""
        index = self.tensor.modes[mode]
        inside = rows.groupBy("bucket", index).agg(*[F.expr(f"sum({e}) as {n}") for n, e in sums.items()])
        if self.home[mode] == mode and not self._large[mode]:
            # Every index lies in one bucket.
            return inside.select(F.col(index).alias("idx"), *sums)
        return inside.groupBy(F.col(index).alias("idx")).agg(*[F.sum(n).alias(n) for n in sums])

    def mttkrp(self, factors: list[Factor], mode: int) -> Factor:
        """Unfolding times the Khatri-Rao product of the other factors."""
        others = self.tensor.others(mode)
        rank = factors[others[0]].rank
        sums = {f"f{c}": f"v * {product_sql(others, c)}" for c in range(rank)}
        rows = self.joined(mode, factors, others)
        return Factor(self.per_index(mode, rows, sums), self.tensor.shape[mode], rank)

    def norm(self) -> float:
        return float(self.copies[0].agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0) ** 0.5
