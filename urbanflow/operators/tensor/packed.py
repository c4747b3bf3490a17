"""Non-zeros packed into blocks of arrays, for sums that need the model in every non-zero.

All non-zeros of an index of the longest mode lie in one block (an index that holds more than its share is spread over
several), sorted by it.  A block is one row of a bucketed table in the shared checkpoint folder: its indices and values as
binary columns, so that a task reads arrays and not rows, and sums them with numpy a few thousand cells at a time.

The factors of the other modes are small and go to every worker; a long factor of the longest mode travels to the blocks
that need its rows, a list for each block.  Sums leave a task as one row per index.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from functools import reduce
from math import ceil
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanflow.operators.tensor.algebra import Factor
from urbanflow.operators.tensor.layout import SPREAD, bucket_count
from urbanflow.operators.tensor.table import Tensor
from urbanflow.session import checkpoint_table, drop_table, ensure_checkpoint_dir

#: Cells of a block, and cells that are worked on at once, so that what is computed stays in the processor's cache.
BLOCK_CELLS, STEP = 1 << 17, 1 << 14

# Ship the batch functions with the task, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def longest_mode(t: Tensor) -> int:
    return max(range(t.order), key=lambda m: t.shape[m])


def can_pack(t: Tensor, rank: int) -> bool:
    """Whether the factors of all modes but the longest are small enough to be sent to every worker."""
    return all(n < 1 << 31 and Factor(t.df, n, rank).is_small() for m, n in enumerate(t.shape) if m != longest_mode(t))


def narrow(numbers: np.ndarray) -> np.ndarray:
    """Indices in the fewest bytes that hold them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max())))


def narrow_values(v: np.ndarray) -> np.ndarray:
    """Values in the fewest bytes that hold them exactly."""
    for kind in (np.uint8, np.float32):
        with np.errstate(invalid="ignore", over="ignore"):
            short = v.astype(kind)
        if np.array_equal(short, v):
            return short
    return v


def unpacked(n: int, row: list[pa.BinaryScalar]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The ids, indices and values of a block of ``n`` cells; the bytes of a cell tell how they were narrowed."""
    ids, *at, v = [x.as_buffer() for x in row]
    value = {1: np.uint8, 4: np.float32, 8: np.float64}[v.size // n]
    return np.frombuffer(ids, np.int64), [np.frombuffer(a, f"u{a.size // n}") for a in at], np.frombuffer(v, value)


def pack(batches: Iterator[pa.RecordBatch], home: int, order: int) -> Iterator[pa.RecordBatch]:
    """Cells (block, indices, v) sorted by block and the index of ``home`` -> one row per block."""
    now, pieces = None, []

    def packed():
        columns = [np.concatenate(c) for c in zip(*pieces)]
        ids, at = np.unique(columns[home], return_inverse=True)
        columns[home] = at
        arrays = [ids.astype(np.int64), *map(narrow, columns[:order]), narrow_values(columns[order].astype(np.float64))]
        numbers = [pa.array([x], pa.int32()) for x in (now, len(at))]
        return pa.RecordBatch.from_arrays([*numbers, *[pa.array([a.tobytes()], pa.binary()) for a in arrays]],
                                          names=["block", "n", "ids", *[f"at{m}" for m in range(order)], "v"])

    for batch in batches:
        block, *columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if block[a] != now:
                if pieces:
                    yield packed()
                now, pieces = int(block[a]), []
            pieces.append([c[a:b] for c in columns])
    if pieces:
        yield packed()


def block_sums(at: list[np.ndarray], v: np.ndarray, tables: list[np.ndarray], mode: int, ratio: bool) -> list[np.ndarray]:
    """Per component and index of ``mode``: values (over the model, for ``ratio``) times the other modes' factor products.

    A cell with an index that a factor has no row for, which is NaN here, counts for nothing.
    """
    rank = tables[mode].shape[0]
    out = np.empty((rank, len(v)))
    for a in range(0, len(v), STEP):
        part = slice(a, a + STEP)
        others = [reduce(mul, [t[c].take(at[m][part]) for m, t in enumerate(tables) if m != mode]) for c in range(rank)]
        weight = v[part]
        model = reduce(np.add, [o * tables[mode][c].take(at[mode][part]) for c, o in enumerate(others)])
        absent = np.isnan(model)
        if absent.any():
            model = np.where(absent, 1.0, model)
            others = [np.where(absent, 0.0, o) for o in others]
        if ratio:
            with np.errstate(divide="raise", invalid="raise"):
                weight = weight / model
        for c, o in enumerate(others):
            np.multiply(weight, o, out=out[c, part])
    return [np.bincount(at[mode], n, tables[mode].shape[1]) for n in out]


class PackedCells:
    """The non-zeros of a tensor as blocks, for factors of one rank; use it as a context manager."""

    def __init__(self, t: Tensor, buckets: int | None = None, block_cells: int = BLOCK_CELLS):
        self.tensor, self.spark, self.home = t, t.df.sparkSession, longest_mode(t)
        self._held: dict[int, tuple] = {}
        index, modes = t.modes[self.home], list(t.modes)
        # The non-zeros are computed once; counts and blocks read them from there.
        cells, path = checkpoint_table(t.df.select(*modes, F.col("v").cast("double").alias("v")))
        total, square = cells.agg(F.count("*"), F.sum(F.col("v") * F.col("v"))).first()
        self._norm = float(square or 0.0) ** 0.5
        self.buckets = buckets or bucket_count(total, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.blocks = max(self.buckets, ceil(total / block_cells))
        # At most buckets / SPREAD indices have more than that share, so the list is short whatever the data.
        share = max(1.0, SPREAD * total / self.buckets)
        counts = cells.groupBy(index).agg(F.count("*").alias("n"))
        self._large = [r[0] for r in counts.where(F.col("n") > share).collect()] if self.buckets > 1 else []
        others = F.xxhash64(*[t.modes[m] for m in t.others(self.home)])
        salt = F.when(F.col(index).isin(self._large), F.pmod(others, F.lit(self.buckets))).otherwise(F.lit(0).cast("long"))
        inside = reduce(lambda a, b: a & b, [F.col(c).between(0, n - 1) for c, n in zip(modes, t.shape)])
        cells = cells.where(inside & F.col("v").isNotNull()).select(self._block(F.col(index), salt).alias("block"), *modes, "v")
        home, order = self.home, t.order
        dealt = cells.repartition(self.buckets, "block").sortWithinPartitions("block", index)
        made = dealt.mapInArrow(lambda batches: pack(batches, home, order), "block int, n int, ids binary, " + ", ".join(
            f"at{m} binary" for m in range(order)) + ", v binary")
        self._name = f"urbanflow_{uuid.uuid4().hex}"
        self._path = f"{ensure_checkpoint_dir(self.spark)}/{self._name}"
        made.write.bucketBy(self.buckets, "block").option("path", self._path).saveAsTable(self._name)
        self.table = self.spark.table(self._name)
        drop_table(self.spark, path)

    def __enter__(self) -> PackedCells:
        return self

    def __exit__(self, *_) -> None:
        for _, _, sent in self._held.values():
            sent.unpersist()
        self._held = {}
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name}")
        drop_table(self.spark, self._path)

    def _block(self, index: Column, salt: Column) -> Column:
        return F.pmod(F.xxhash64(index.cast("long"), salt), F.lit(self.blocks)).cast("int")

    def _sent(self, mode: int, f: Factor):
        """A small factor as an array in every worker, rows that it lacks as NaN; it is sent again only when it has changed."""
        held = self._held.get(mode)
        if held is None or held[0] is not f:
            if held is not None:
                held[2].unpersist()
            rows = f.df.select("idx", *f.columns).toArrow()
            array = np.full((f.rank, f.rows), np.nan)
            at = rows["idx"].to_numpy()
            for c, name in enumerate(f.columns):
                array[c, at] = rows[name].to_numpy()
            self._held[mode] = held = (f, array.shape, self.spark.sparkContext.broadcast(array))
        return held[2]

    def _lists(self, f: Factor) -> DataFrame:
        """(block, rows): the rows of the longest mode's factor that each block needs."""
        salts = F.explode(F.when(F.col("idx").isin(self._large), F.sequence(F.lit(0).cast("long"), F.lit(self.buckets - 1).cast(
            "long"))).otherwise(F.array(F.lit(0).cast("long")))) if self._large else F.lit(0).cast("long")
        rows = f.df.select("idx", *f.columns, salts.alias("salt"))
        rows = rows.select(self._block(F.col("idx"), F.col("salt")).alias("block"), F.struct("idx", *f.columns).alias("row"))
        return rows.repartition(self.buckets, "block").groupBy("block").agg(F.collect_list("row").alias("rows"))

    def sums(self, factors: list[Factor], mode: int, ratio: bool, name: str) -> DataFrame:
        """(idx, ``name``0, ...): per index of ``mode`` the sums of ``block_sums``."""
        home, order, rank = self.home, self.tensor.order, factors[mode].rank
        long = not factors[home].is_small()
        sent = {m: self._sent(m, f) for m, f in enumerate(factors) if m != home or not long}
        blocks = self.table.join(self._lists(factors[home]).hint("shuffle_hash"), "block") if long else self.table
        columns, names = ["n", "ids", *[f"at{m}" for m in range(order)], "v"], ["idx", *[f"{name}{c}" for c in range(rank)]]
        rows = self.tensor.shape[mode]

        def own(ids, listed):
            """The factor's rows of the longest mode that a block holds, in the order of its ids."""
            if not long:
                return sent[home].value[:, ids]
            table, found = np.full((rank, len(ids)), np.nan), listed.values.flatten()
            at = found[0].to_numpy()
            place = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
            known = ids[place] == at
            for c in range(rank):
                table[c, place[known]] = found[1 + c].to_numpy()[known]
            return table

        def batch_of(idx, sums):
            kept = np.any([s != 0 for s in sums], axis=0)  # an index without a row counts as 0
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x)[kept]) for x in (idx, *sums)], names=names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((rank, rows)) if mode != home else None
            for batch in batches:
                for row in zip(*batch.columns):
                    ids, at, v = unpacked(row[0].as_py(), row[1:len(columns)])
                    tables = [own(ids, row[-1]) if m == home else sent[m].value for m in range(order)]
                    found = block_sums(at, v, tables, mode, ratio)
                    if mode == home:
                        yield batch_of(ids, found)
                    else:
                        total += found
            if total is not None:
                yield batch_of(np.arange(rows), total)

        made = blocks.select(*columns, *(["rows"] if long else [])).mapInArrow(
            run, ", ".join(f"{n} {'bigint' if n == 'idx' else 'double'}" for n in names))
        if mode == home and not self._large:
            return made  # every index lies in one block
        return made.groupBy("idx").agg(*[F.sum(n).alias(n) for n in names[1:]])

    def mttkrp(self, factors: list[Factor], mode: int) -> Factor:
        """Unfolding times the Khatri-Rao product of the other factors."""
        return Factor(self.sums(factors, mode, False, "f"), self.tensor.shape[mode], factors[mode].rank)

    def norm(self) -> float:
        return self._norm
