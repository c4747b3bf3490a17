"""Merkle manifest of a data set: leaf coordinates by bitmap ranks, levels by slot arrays, proofs and their verification.

Every row is a leaf: H of its fields, where H is lowercase hex SHA-256 of the inputs written one after the other, digests as
their hex text.  A null field is written ``-``, others as byte count, ``:`` and value.  The leaves of a group ascend by id;
while a group has several nodes, every ``FAN`` neighbours (the last run may be shorter, even one) become their H.  What
remains is the group's subroot; subroots in order of the group (null first, then bytewise) give the root the same way.

* Bitmap ranks.  The ids of a group are a bitmap of 64-bit words of which only those with a bit are kept; words merge by
  ``bit_or`` before the shuffle.  A popcount directory holds the leaves before each word: words are dealt to tasks by ranges,
  each range is summed, and a task adds what the ranges before it hold.  A leaf's coordinate is the directory's number and
  the set bits below its own, so leaves are never sorted.  Words with a repeated id, and leaves without an id, cannot say
  the order by bits; their leaves alone are numbered by ranges of (id, leaf).
* Slot arrays.  ``SLOT_LEVELS`` levels at a time, ``FAN ** SLOT_LEVELS`` neighbours are one row with an array of slots, and a
  task reduces them to a node; nodes are the leaves of the next round.  Then paths go down the same rows: each slot's
  siblings in its array, then those of the array's own node.  A row is a few hundred kilobytes whatever the data.

Cases: a null group is a group of its own, before the empty name; a null id comes before all others; rows that share group
and id ascend by their leaf, and rows that are equal are leaves of their own; null and empty texts are different leaves; very
long texts are hashed whole; an empty table gives an empty result.  The result has its own columns and the id only, so
nothing in the input can clash with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.llm.common import quoted, small_batches
from urbanflow.session import checkpointed

FAN = 2
SLOT_LEVELS = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: The word of leaves without an id; words of ids are at least -2 ** 57.
NO_WORD = -(1 << 63)
#: Marks of a path: the sibling stands to the left, to the right, or there is none.
LEFT, RIGHT, ALONE = "<", ">", "-"
#: Columns of the steps of a path.  Written out: Arrow would take the type of empty lists for null, and one task's batches
#: must all have the same.
STEPS = pa.schema([("tree", pa.string()), ("chunk", pa.int64()), ("steps", pa.list_(pa.string()))])


def written(field: Column) -> Column:
    """How a field enters its leaf."""
    text = field.cast("string")
    return F.when(field.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[written(f) for f in fields]), 256)


def running_total(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` as a table with ``name``: the sum of ``value`` over the rows before, in ``order`` within ``by`` (not null).

    Rows are dealt by ranges, so equal neighbours and large groups are spread; only one sum for each range and group goes
    on to the sum over ranges.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    dealt = checkpointed(rows.withColumn("amount", value.cast("long")).repartitionByRange(*keys)
                         .withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "range").agg(F.sum("amount").alias("held"))
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "range", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("earlier"))
    here = Window.partitionBy("range", *by).orderBy(*keys[len(by):]).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inside", F.coalesce(F.sum("amount").over(here), F.lit(0)))
    joined = inside.join(sums, [*by, "range"])
    return joined.withColumn(name, F.col("earlier") + F.col("inside")).drop("earlier", "inside", "range", "amount")


def coordinates(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (tree, id, leaf, order, ...) with ``at``, their place in the tree, and (tree, n), the size of each tree."""
    leaves = leaves.withColumn("word", F.coalesce(F.shiftright("id", 6), F.lit(NO_WORD)))
    bit = "cast(id & 63 as int)"
    words = leaves.groupBy("tree", "word").agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits"), F.count("*").alias("n"))
    directory = checkpointed(running_total(words, ["tree"], ["word"], F.col("n"), "before"))
    crowded = F.col("n") > F.coalesce(F.bit_count("bits"), F.lit(0))
    below = f"bit_count(bits & if({bit} = 0, 0L, shiftrightunsigned(-1L, 64 - {bit})))"
    plain = leaves.join(directory.where(~crowded), ["tree", "word"]).withColumn("at", F.col("before") + F.expr(below))
    shared = leaves.join(directory.where(crowded).select("tree", "word", "before"), ["tree", "word"])
    shared = running_total(shared, ["tree", "word"], ["id", "leaf", "order"], F.lit(1), "inside_word")
    shared = shared.withColumn("at", F.col("before") + F.col("inside_word"))
    kept = [c for c in leaves.columns if c not in ("word", "order")] + ["at"]
    return (plain.select(*kept).unionByName(shared.select(*kept)),
            checkpointed(directory.groupBy("tree").agg(F.sum("n").alias("n"))))


def slot_arrays(nodes: DataFrame, height: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for every ``FAN ** height`` places of a tree, as a table; ``nodes`` has (tree, n, at, digest) and ``extra``."""
    slots = FAN ** height
    slot = F.struct((F.col("at") % slots).cast("int").alias("slot"), "digest", *extra)
    return checkpointed(nodes.groupBy("tree", "n", F.expr(f"at div {slots}").alias("chunk")).agg(
        F.collect_list(slot).alias("slots")))


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def reduced(slots: list[str], n: int, height: int) -> list[list[str]]:
    """The levels of one slot array, from its slots up, in a tree that has ``n`` nodes at the lowest of them."""
    levels = [slots]
    for _ in range(min(height, (n - 1).bit_length())):
        below = levels[-1]
        levels.append([digest(*below[k:k + FAN]) for k in range(0, len(below), FAN)])
    return levels


def path(levels: list[list[str]], slot: int) -> list[str]:
    """The siblings of a slot, level by level, each with its mark."""
    found = []
    for level in levels[:-1]:
        other = slot ^ 1
        found.append((RIGHT if other > slot else LEFT) + level[other] if other < len(level) else ALONE)
        slot //= FAN
    return found


def folded(leaf: str, steps: list[str]) -> str:
    """The root that a leaf and the path of its place lead to."""
    for step in steps:
        mark, other = step[0], step[1:]
        leaf = digest(other, leaf) if mark == LEFT else digest(leaf, other)
    return leaf


def _placed(row: dict, field: str = "digest") -> list:
    """The values of a row's slots, each at its place."""
    placed = [None] * len(row["slots"])
    for slot in row["slots"]:
        placed[slot["slot"]] = slot[field]
    return placed


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that only one slot array is held as Python objects."""
    for batch in batches:
        for n in range(batch.num_rows):
            yield batch.slice(n, 1).to_pylist()[0]


def _next_nodes(arrays: DataFrame, height: int) -> DataFrame:
    """(tree, n, at, digest) of the nodes that slot arrays reduce to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            top = reduced(_placed(row), row["n"], height)[-1][0]
            yield pa.RecordBatch.from_pylist([{"tree": row["tree"], "n": -(-row["n"] // FAN ** height), "at": row["chunk"],
                                               "digest": top}])

    return arrays.select("tree", "n", "chunk", F.transform("slots", lambda s: F.struct(s["slot"], s["digest"])).alias("slots")
                         ).mapInArrow(run, "tree string, n bigint, at bigint, digest string")


def _paths_down(arrays: DataFrame, above: DataFrame | None, height: int) -> DataFrame:
    """(tree, chunk, steps): the path of every slot, which is the row of that number in the round below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            levels = reduced(_placed(row), row["n"], height)
            first = row["chunk"] * FAN ** height
            yield pa.RecordBatch.from_pylist([
                {"tree": row["tree"], "chunk": first + s, "steps": path(levels, s) + (row["steps"] or [])}
                for s in range(len(levels[0]))], schema=STEPS)

    return checkpointed(_with_steps(arrays, above).mapInArrow(run, "tree string, chunk bigint, steps array<string>"))


def _with_steps(arrays: DataFrame, above: DataFrame | None) -> DataFrame:
    if above is None:
        return arrays.withColumn("steps", F.array().cast("array<string>"))
    return arrays.join(above, ["tree", "chunk"], "left")


def reduce_trees(arrays: DataFrame, largest: int, height: int) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, digest) of the nodes that remain, and the slot arrays of every round; ``largest`` is the size of a tree."""
    rounds, nodes = [arrays], checkpointed(_next_nodes(arrays, height))
    while largest > FAN ** height:
        largest = -(-largest // FAN ** height)
        rounds.append(slot_arrays(nodes, height))
        nodes = checkpointed(_next_nodes(rounds[-1], height))
    return nodes.select("tree", "digest"), rounds


def paths_above(rounds: list[DataFrame], height: int) -> DataFrame | None:
    """(tree, chunk, steps) of the path above every slot array of the first round, None if there is nothing above."""
    above = None
    for arrays in reversed(rounds[1:]):
        above = _paths_down(arrays, above, height)
    return above


def manifest(df: DataFrame, fields: list[Column], claimed: list[Column] | None = None, id_col: str = "doc_id",
             group_col: str = "lang", height: int = SLOT_LEVELS) -> DataFrame:
    """For each row: ``id_col``, ``leaf``, ``place`` in its group, ``subroot``, ``root``, ``proof``, ``folded_root`` and
    ``verified``.

    ``fields`` make the leaf; ``claimed`` are the fields as somebody else presents them (the same ones by default), whose
    leaf is folded with the siblings of the manifest: ``verified`` says whether that gives the root.  ``proof`` has a
    step for every level, from the leaf to the root: the sibling's digest after its mark.
    """
    small_batches(df.sparkSession)
    tree = F.coalesce(F.concat(F.lit(":"), quoted(group_col).cast("string")), F.lit(""))
    leaves = checkpointed(df.select(
        tree.alias("tree"), quoted(id_col).cast("long").alias("id"), leaf_of(fields).alias("leaf"),
        leaf_of(claimed or fields).alias("claim")).withColumn("order", F.monotonically_increasing_id()))
    placed, sizes = coordinates(leaves)
    arrays = slot_arrays(placed.withColumnRenamed("leaf", "digest").join(sizes, "tree"), height, ("id", "claim"))
    subroots, rounds = reduce_trees(arrays, sizes.agg(F.max("n")).first()[0] or 0, height)
    groups = sizes.count()
    numbered = checkpointed(running_total(subroots.withColumn("all", F.lit("")), ["all"], ["tree"], F.lit(1), "at"))
    tops = numbered.select(F.lit("").alias("tree"), F.lit(groups).cast("long").alias("n"), "at", "digest")
    root, upper = reduce_trees(slot_arrays(tops, height), groups, height)
    # The subroots are the lowest slots of the upper tree, so their paths are one round further down.
    top_paths = _paths_down(upper[0], paths_above(upper, height), height)
    found = root.first()
    named = numbered.join(top_paths.select(F.col("chunk").alias("at"), F.col("steps").alias("top_steps")), "at").select(
        "tree", F.col("digest").alias("subroot"), F.lit(found["digest"] if found else None).alias("root"), "top_steps")
    rows = _with_steps(arrays, paths_above(rounds, height)).join(named, "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            levels = reduced(_placed(row), row["n"], height)
            above = (row["steps"] or []) + row["top_steps"]
            out = {c: [] for c in ("id", "leaf", "place", "subroot", "root", "proof", "folded_root")}
            for slot in row["slots"]:
                proof = path(levels, slot["slot"]) + above
                values = (slot["id"], slot["digest"], row["chunk"] * FAN ** height + slot["slot"], row["subroot"], row["root"],
                          proof, folded(slot["claim"], proof))
                for column, value in zip(out.values(), values):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    strings = ("leaf", "subroot", "root", "folded_root")
    types = {"id": pa.int64(), "place": pa.int64(), "proof": pa.list_(pa.string()), **{c: pa.string() for c in strings}}
    order = ["id", "leaf", "place", "subroot", "root", "proof", "folded_root"]
    schema = pa.schema([(c, types[c]) for c in order])
    made = rows.mapInArrow(run, "id bigint, leaf string, place bigint, subroot string, root string, proof array<string>, "
                                "folded_root string")
    return made.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_col)


def proof_hash(proof: Column) -> Column:
    """H of the siblings of a proof."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.substring(step, 2, 64)), ""), 256)
