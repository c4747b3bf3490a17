"""Exact duplicates by progressive refinement, with DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z.  Three rounds narrow the candidates: texts whose
length in bytes occurs twice, then those whose length and first ``PREFIX`` characters occur twice, then those whose
SHA-256 occurs twice.  Only the survivors of the first two rounds have their whole text normalised and hashed.
What survives a round is kept as a bit table of fixed size (at most ``2 ** FILTER_BITS`` bits, 8 MB), which every
task gets; a bit set by chance only sends a text on to the next round, so the result is exact.  Counts combine before
the shuffle, so a group may hold any share of the rows; texts that survive no round are never shuffled.

Cases: a null text counts as empty, and empty texts are equal to each other.  Of equal texts the row with the largest
id stays; a null id is smaller than any other.  Rows that repeat both the id and the text of the row that stays:
exactly one of them stays.  An empty table gives an empty result.  Input columns named like a result column are
replaced by it; all others are kept.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.llm.common import FILTER_BITS, bit_table, free_name, quoted, with_bit, without
from urbanflow.session import checkpointed

PREFIX = 64
RESULT = ["keep_id", "group_size", "kept"]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def _repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """A bit table of the keys that occur at least twice."""
    return bit_table(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), key, FILTER_BITS)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``keep_id`` (the id of the row that stays), ``group_size`` and ``kept``."""
    rows = without(df, RESULT)
    columns = rows.columns
    body, length, prefix, full, share, maybe = (
        free_name(df, n) for n in ("body", "byte_length", "prefix_hash", "full_hash", "scan_task", "maybe_repeated"))
    rows = (rows.withColumn(body, F.coalesce(quoted(text_col), F.lit("")))
            .withColumn(length, F.octet_length(body))
            .withColumn(prefix, F.xxhash64(lower_ascii(F.substring(F.col(body), 1, PREFIX)))))
    lengths = _repeated(rows, [length])
    same_length = free_name(rows, "same_length")
    rows = with_bit(rows, [length], lengths, same_length, FILTER_BITS)
    prefixes = _repeated(rows.where(F.col(same_length)), [length, prefix])
    rows = with_bit(rows, [length, prefix], prefixes, maybe, FILTER_BITS).withColumn(maybe, F.col(maybe) & F.col(same_length))
    hashed = rows.where(F.col(maybe)).withColumn(full, F.sha2(lower_ascii(F.col(body)), 256))
    key = [length, prefix, full]
    keep, size, tied = (free_name(hashed, n) for n in ("group_keep", "group_rows", "rows_at_keep"))
    by_id = hashed.select(*key, quoted(id_col).alias(keep)).groupBy(*key, keep).agg(F.count("*").alias(tied))
    groups = checkpointed(by_id.groupBy(*key).agg(F.max(F.struct(keep, tied)).alias("last"), F.sum(tied).alias(size))
                          .where(F.col(size) > 1).select(*key, "last.*", size))
    found = hashed.join(groups, key, "left")
    single = F.col(size).isNull()
    stays = single | quoted(id_col).eqNullSafe(F.col(keep))
    if not groups.where(F.col(tied) > 1).isEmpty():
        # Rows that repeat an id and a text: number them within the tasks that read them, then across tasks.
        found = found.withColumn(share, F.when(stays & ~single, F.spark_partition_id()))
        order = F.xxhash64(*[quoted(c) for c in columns])
        first = free_name(found, "first_row")
        contest = [*key, F.col(share).isNull()]
        found = found.withColumn(first, F.row_number().over(Window.partitionBy(*contest, share).orderBy(order)))
        found = found.withColumn(first, F.when(F.col(first) == 1, F.struct(order, F.col(share))))
        winner = F.min(first).over(Window.partitionBy(*contest))
        stays = stays & (single | F.col(first).eqNullSafe(winner))
    keep_id = F.when(single, quoted(id_col)).otherwise(F.col(keep))
    kept_columns = [quoted(c) for c in columns]
    duplicates = found.select(*kept_columns, keep_id.alias("keep_id"),
                              F.coalesce(F.col(size), F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"))
    unique = rows.where(~F.col(maybe)).select(*kept_columns, quoted(id_col).alias("keep_id"),
                                              F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return unique.unionByName(duplicates)
