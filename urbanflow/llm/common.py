"""What the text operators share: session set-up, Arrow batch helpers and word expressions."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanflow.session import checkpointed

#: Characters that separate words in the word-based operators: blank and \t \n \v \f \r.
BLANKS = r"\x20\x09-\x0D"
#: Rows in one Arrow batch; texts are long, so the default of 10,000 rows would hold hundreds of megabytes.
ROWS_PER_BATCH = 256
#: Characters of text that the keys of one cache may have together.
CACHED_CHARACTERS = 1 << 24
#: Bits of a bit table: 8 MB whatever the data.
FILTER_BITS = 26
#: White space as the tokenizer pattern means it (Unicode White_Space), written out because engines differ on \s.
WHITE = "\t-\r \x85\xa0  -     　"
#: A run of other characters with at most one blank before it, white space before white space, or one white character.
#: Byte-level tokenizer patterns never match across the ends of these pieces.
SAFE_PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small for texts; a smaller setting of the caller stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that a result column would clash with, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def append_columns(df: DataFrame, source: str, added: list[tuple[str, T.DataType]],
                   compute: Callable[[pa.Array], list]) -> DataFrame:
    """``df`` with columns that ``compute`` makes from the values of column ``source`` of one Arrow batch.

    ``compute`` gets the values as an Arrow array and returns one list or array per added column.  Columns of
    ``df`` with the name of an added one are replaced.
    """
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n, _ in added}]
    at = free_name(df, "source_value")
    inner = df.select(*[quoted(c) for c in kept], quoted(source).alias(at))
    schema = T.StructType([inner.schema[c] for c in kept] + [T.StructField(n, t) for n, t in added])
    types = [arrow_type(t) for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = compute(batch.column(len(kept)))
            arrays = [m if isinstance(m, pa.Array) else pa.array(m, t) for m, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*kept, *[n for n, _ in added]])
            pa.default_memory_pool().release_unused()  # Arrow keeps what batches used, in idle workers too
        give_back()

    return inner.mapInArrow(run, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    simple = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
              "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.list_(arrow_type(t.elementType)) if isinstance(t, T.ArrayType) else simple[t.simpleString()]


def word_array(text: Column) -> Column:
    """The words of a text, ``[^ \\t\\n\\v\\f\\r]+``, as an array; null counts as no text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")


def _slot(key: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << bits))


def bit_table(keys: DataFrame, key: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """A written table of at most ``2 ** bits`` bits, in which the bit of every key's hash is set."""
    slots = keys.select(_slot(key, bits).alias("slot"))
    return checkpointed(slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("filter_bucket"))
                        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("filter_bits")))


def with_bit(rows: DataFrame, key: list[str], table: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a flag: whether the bit of their key is set.  Rows stay where they are, the table is broadcast.

    Keys that are in the table always have their bit set; others have it by chance, the more the fuller the table is.
    """
    at = free_name(rows, "filter_slot")
    bucket, held = (free_name(rows, n) for n in table.columns)
    rows = rows.withColumn(at, _slot(key, bits))
    small = F.broadcast(table.toDF(bucket, held))  # its size is bounded by the number of bits
    joined = rows.join(small, F.expr(f"bitmap_bucket_number({at})") == F.col(bucket), "left")
    position = f"bitmap_bit_position({at})"
    byte = f"ascii(decode(substring({held}, cast({position} div 8 + 1 as int), 1), 'ISO-8859-1'))"
    set_bit = F.expr(f"coalesce((shiftright({byte}, cast({position} % 8 as int)) & 1) = 1, false)")
    return joined.withColumn(name, set_bit).drop(at, bucket, held)


def give_back() -> None:
    """Return freed memory to the system: Arrow and the C library keep it otherwise, in idle workers too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


_KEPT: dict[str, dict] = {}


def serve(operator: str) -> dict:
    """What ``operator`` has kept in this Python worker.

    A worker serves the operators of a pipeline one after the other, so what others kept is dropped first: it holds the
    tables of one operator, not those of all.
    """
    if operator not in _KEPT:
        _KEPT.clear()
        gc.collect()  # tables and the functions that fill them refer to each other
        give_back()
        _KEPT[operator] = {}
    return _KEPT[operator]


def kept(operator: str, key, make: Callable):
    """What ``operator`` makes once in a Python worker and keeps for the tasks that follow."""
    own = serve(operator)
    if key not in own:
        own[key] = make()
    return own[key]


class Memo(dict):
    """A dictionary that computes missing values and keeps about the ``limit`` values used last.

    Values live in two generations of half the limit each: when the young one is full it becomes the old one, and
    what is then asked for again moves back.  Text keys also count by their length, so that long ones fill a generation
    sooner: ``characters`` bounds both together.
    """

    def __init__(self, compute: Callable | None, limit: int, characters: int | None = None):
        super().__init__()
        self._compute, self._half, self._old = compute, max(1, limit // 2), {}
        self._room = None if characters is None else characters // 2
        self._held = 0

    def _age(self) -> None:
        if len(self) >= self._half or (self._room is not None and self._held >= self._room):
            self._old = dict(self)
            self.clear()
            self._held = 0

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        self._age()
        if self._room is not None:
            self._held += len(key)
        self[key] = value
        return value

    def absent(self, keys: set) -> list:
        """Those of ``keys`` without a value; the others have theirs until the next call."""
        self._age()
        found, old = [], self._old
        for key in keys:
            if key not in self:
                value = old.get(key)
                if value is None:
                    found.append(key)
                else:
                    self[key] = value
        if self._room is not None:
            self._held += sum(map(len, found))
        return found
