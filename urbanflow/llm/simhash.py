r"""Near duplicates by SimHash fingerprints, found with a byte-position inverted index and count filtering.

A fingerprint has 64 bits: bit k is 1 if it is set in more than half of the XXH64 values (seed 42) of the text's
shingles, ``SHINGLE`` words after lower-casing A-Z, repeats included.  Two fingerprints are linked if at most ``BITS``
bits differ.  Each differing bit spoils at most one of the 8 bytes, so linked fingerprints agree in at least
8 - ``BITS`` byte positions: the guaranteed number of matches.  Lists of single bytes would hold a 256th of all
fingerprints each, so the index keeps the lists of what that many positions hold together: one posting for each choice
of 8 - ``BITS`` positions.  A pair meets in as many lists as there are such choices among its equal bytes; it is
tallied in the first of them only, kept if the tally of equal bytes reaches the guaranteed number, and verified.

Equal fingerprints are one class, so copies cost nothing.  A list with more than ``LONG_LIST`` classes is not paired:
two fingerprints at most 4 bits apart have one within 2 bits of both, and any two within 2 bits of a third are at most
4 apart, so the members of such a list are linked through the fingerprints around them, which is linear in the list
and gives the same components.  Components come from ``graph.components``.

Cases: a null text has no words; texts without words have fingerprint 0, which is linked like any other; fewer words
than a shingle make one shingle of all of them.  Rows with a null id have a class but never name a component (its id
is null only if all its ids are).  Repeated rows share everything.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanflow.llm.common import append_columns, quoted, serve
from urbanflow.llm.graph import components
from urbanflow.session import checkpointed

SHINGLE, BITS, SEED = 4, 4, 42
LONG_LIST = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    hashed = xxhash.xxh64_intdigest
    values = [hashed(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:] or ends[-1:])]
    return _majority(np.array(values, np.uint64))


def _majority(values: np.ndarray, block: int = 1 << 16) -> int:
    """Bits set in more than half of the values; a block of values at a time, so that memory stays bounded."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), block):
        part = values[at:at + block].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``df`` with ``simhash``, a long."""

    def compute(texts: pa.Array) -> list:
        serve("simhash")  # it keeps nothing itself
        return [[fingerprint(text, shingle) for text in texts.to_pylist()]]

    return append_columns(df, text_col, [("simhash", T.LongType())], compute)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(classes: DataFrame, bits: int = BITS, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints ``f`` that link all which are at most ``bits`` bits apart."""
    need = 8 - bits
    masks = [sum(0xFF << 8 * (7 - p) for p in chosen) for chosen in combinations(range(8), need)]
    chosen = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    # Every class makes many postings, so the small table of classes is dealt to all tasks first.
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = classes.repartition(tasks, "f").select("f", F.posexplode(F.transform(chosen, lambda m: F.col("f").bitwiseAND(m))).alias("c", "held"))
    lists = postings.groupBy("c", "held").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes exploded rows as if they were not, and would broadcast 70 postings a class for small classes.
    shared = checkpointed(postings.join(lists.hint("shuffle_merge"), ["c", "held"]))
    short = shared.where(F.col("n") <= long_list).select("c", "held", "f")
    other = short.withColumnRenamed("f", "g")
    differing = F.col("f").bitwiseXOR(F.col("g"))
    # Bit p says that position p is equal.  Numbers and tables instead of 70 written-out conditions: the driver plans them.
    equal = F.expr(" | ".join(f"if(shiftright(f ^ g, {8 * (7 - p)}) & 255L = 0, {1 << p}, 0)" for p in range(8)))
    # The first choice of positions among the equal ones: up to its last position, those equal are those chosen.
    positions = list(combinations(range(8), need))
    up_to = F.get(F.array(*[F.lit((2 << p[-1]) - 1) for p in positions]), F.col("c"))
    own = F.get(F.array(*[F.lit(sum(1 << k for k in p)) for p in positions]), F.col("c"))
    first = equal.bitwiseAND(up_to) == own
    pairs = short.join(other.hint("shuffle_merge"), ["c", "held"]).where((F.col("f") < F.col("g")) & (F.bit_count(differing) <= bits))
    found = pairs.where((F.bit_count(equal) >= need) & first).select(F.col("f").alias("a"), F.col("g").alias("b"))
    return found.unionByName(_through_the_middle(shared.where(F.col("n") > long_list), bits))


def _flipped(value: str, times: int, after: int | str = -1) -> str:
    """SQL for the array of what a 64-bit value becomes when ``times`` bits, above the one at ``after``, are flipped."""
    if not times:
        return f"array({value})"
    at = f"p{times}"
    return (f"flatten(transform(sequence({after} + 1, {64 - times}), {at} -> "
            f"{_flipped(f'{value} ^ shiftleft(1L, {at})', times - 1, at)}))")


def _through_the_middle(members: DataFrame, bits: int) -> DataFrame:
    """Links inside long lists: every fingerprint within half the distance leads to the smallest one near it."""
    around = F.expr(f"concat({', '.join(_flipped('f', k) for k in range(bits // 2 + 1))})")
    near = members.select("f").distinct().select("f", F.explode(around).alias("middle"))
    least = near.groupBy("middle").agg(F.min("f").alias("a"), F.count("*").alias("n")).where("n > 1")
    return near.join(least.hint("shuffle_merge"), "middle").where("a < f").select("a", F.col("f").alias("b")).distinct()


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   bits: int = BITS, long_list: int = LONG_LIST) -> DataFrame:
    """The columns of ``df`` without the text, one row per row, with ``simhash``, ``group_root`` and ``component_id``.

    ``group_root`` is the smallest fingerprint that links lead to, ``component_id`` the smallest id.
    """
    result = ["simhash", "group_root", "component_id"]
    kept = [c for c in df.columns if c.lower() not in result and c != text_col]
    # Columns of the input go by number until the end, so that no name clashes.
    numbered = df.select(*[quoted(c).alias(f"in{n}") for n, c in enumerate(kept)], quoted(id_col).alias("id"),
                         quoted(text_col).alias("text"))
    rows = checkpointed(fingerprints(numbered, "text", shingle).drop("text"))
    classes = checkpointed(rows.groupBy("simhash").agg(F.min("id").alias("first"))
                           .select(F.col("simhash").alias("f"), "first"))
    roots = components(links(classes.select("f"), bits, long_list))
    rooted = classes.join(roots.withColumnRenamed("node", "f"), "f", "left").select(
        "f", "first", F.coalesce("root", "f").alias("group_root"))
    names = rooted.groupBy("group_root").agg(F.min("first").alias("component_id"))
    named = checkpointed(rooted.select("f", "group_root").join(names, "group_root"))
    found = rows.join(named, F.col("simhash") == F.col("f"), "left")
    return found.select(*[F.col(f"in{n}").alias(c) for n, c in enumerate(kept)], *result)
