r"""Divergence audit: how far the term distributions of a language's sources lie from each other, by a tree of term rows.

Terms are runs of characters other than ASCII ones that are no letters, with A-Z lower-cased.  Each language keeps the terms
that occur in at least ``LEAST_DOCS`` of its documents.  A term has ``p = 1 + floor(SCALE (count + PRIOR) / (N + PRIOR V))``
in a group (language, source) and in the language itself: V kept terms, N their occurrences there.  Sources are compared by
the sum over all kept terms of ``|p - q|``; a source's own terms are those with p above the language's q, by ``p - q``.
All numbers are integers.

A term row holds a term's sources in order with their counts, zero counts left out, so that

    sum |p - q| = V |p0 - q0| + single(g, h) + single(h, g) + both(g, h),

where p0 is the p of a zero count, ``single`` corrects for the terms of one source against the zero count of another, and
``both`` for the terms that two sources share.

* ``both`` comes from a frequent-pattern tree.  Equal rows are one path with a multiplicity; paths are dealt to tasks by
  ranges and sorted, so a task walks its part of the tree depth-first and rows with a common beginning share nodes.  A
  node's correction with each of its ancestors is computed once and counts as often as rows run through the node.  A range
  that ends inside a subtree only repeats the nodes on its border.  ``ROWS_AT_ONCE`` paths at a time are one block of
  arrays; sums of source pairs, which are fewer than the result's rows, leave a task as one row each.
* ``single`` needs no tree: running sums over a source's counts, with the zero counts of the other sources between them.

Terms are counted in tasks, whose tables are bounded by ``TERMS_AT_ONCE``, and again after one shuffle by language and term.

Cases: null text, language and source count as empty; a language without kept terms has pairs of value 0; an empty text still
makes its group; repeated rows count as often as they occur; very long texts are counted in blocks of ``BLOCK_BYTES``, cut
between terms, and their documents once; ties of value go by the item; an empty table gives an empty result.  The result
has its own columns only, so nothing in the input can clash with them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.llm.common import quoted, small_batches
from urbanflow.session import checkpointed

LEAST_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50
TERMS_AT_ONCE = 400_000
BLOCK_BYTES = 1 << 22
ROWS_AT_ONCE = 1 << 12

#: Bytes of the UTF-8 text: ASCII letters lower-cased, other ASCII characters blank, all others as they are.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def blocks(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a block at a time."""
    folded = (text or "").encode().translate(FOLD)
    start = 0
    while start < len(folded):
        end = start + BLOCK_BYTES
        if end < len(folded):
            end = folded.rfind(b" ", start, end) + 1 or folded.find(b" ", end) + 1 or len(folded)
        yield folded[start:end].split()
        start = end


def term_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str, terms_at_once: int) -> DataFrame:
    """(lang, source, term, docs, n) in parts that are still to be added up; a null term stands for the group itself."""
    small_batches(df.sparkSession)
    rows = df.select(*[F.coalesce(quoted(c), F.lit("")).alias(n) for c, n in
                       ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), (seen, docs) in groups.items():
                terms = [None, *seen]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *map(docs.__getitem__, seen)], pa.int64()),
                    pa.array([0, *seen.values()], pa.int64())], names=["lang", "source", "term", "docs", "n"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                held -= len(seen)
                once: set[bytes] = set()
                for terms in blocks(text):
                    seen.update(terms)
                    once.update(terms)
                docs.update(once)
                held += len(seen) + 1
                if held > terms_at_once:
                    yield from emit()
                    groups.clear()
                    held = 0
        yield from emit()

    return rows.mapInArrow(run, "lang string, source string, term string, docs bigint, n bigint")


def _share(count: str, n: str, terms: str) -> Column:
    """p of a count, exactly: products may be longer than 64 bits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(38,0)) * ({count} + {PRIOR})) div ({n} + {PRIOR} * {terms})")


def kept_terms(df: DataFrame, text_col: str, lang_col: str, source_col: str, least_docs: int,
               terms_at_once: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, source, term, n, total) of the kept terms, (lang, source, held, p0, terms) of all groups and (lang, held, terms)
    of all languages, as tables; ``held`` is N, ``terms`` is V and ``total`` the count in the language."""
    parts = term_counts(df, text_col, lang_col, source_col, terms_at_once)
    # A term's rows of a language come together once, for the sums by source and for those of the language.
    rows = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    rows = rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"),
                                            F.collect_list(F.struct("source", "n")).alias("sources"))
    # The row of the null term holds the groups themselves.
    rows = checkpointed(rows.where((F.col("docs") >= least_docs) | F.col("term").isNull()))
    counts = rows.where("term is not null").select("lang", "term", "total", F.explode("sources").alias("s")).select(
        "lang", "s.source", "term", "s.n", "total")
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    sizes = rows.groupBy("lang").agg(F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("total"))), F.lit(0)).alias("held"),
                                     F.count("term").alias("terms"))
    sizes = checkpointed(sizes)
    groups = rows.where("term is null").select("lang", F.explode("sources.source").alias("source"))
    groups = groups.join(held, ["lang", "source"], "left").join(sizes.select("lang", "terms"), "lang")
    groups = groups.withColumn("held", F.coalesce("held", F.lit(0))).withColumn(
        "p0", F.when(F.col("terms") > 0, _share("0", "held", "terms")).otherwise(F.lit(0)))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("number")
    return counts, checkpointed(groups.select("*", number)), sizes


def term_rows(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, path, times): the different rows of a language and how many terms have them, as a table.

    A step of a path is a source's number, its p for the count, and its p0.
    """
    steps = counts.join(groups.select("lang", "source", "held", "terms", "p0", "number"), ["lang", "source"]).select(
        "lang", "term", F.struct("number", _share("n", "held", "terms").alias("p"), "p0").alias("step"))
    paths = steps.groupBy("lang", "term").agg(F.array_sort(F.collect_list("step")).alias("path"))
    return checkpointed(paths.groupBy("lang", "path").agg(F.count("*").alias("times")))


def _tree_sums(number: np.ndarray, p: np.ndarray, p0: np.ndarray, times: np.ndarray, sums: dict[tuple[int, int], int]) -> None:
    """Adds the corrections of sorted paths to ``sums``; paths are rows of arrays, filled up with number -1.

    A node is a place in a row whose beginning differs from that of the row before; as many terms run through it as
    through the rows up to the next node of its depth or less.
    """
    depth = number.shape[1]
    new = np.ones(number.shape, bool)
    same = (number[1:] == number[:-1]) & (p[1:] == p[:-1])
    new[1:] = ~np.logical_and.accumulate(same, axis=1)
    for d in range(1, depth):
        starts = np.flatnonzero(new[:, d])
        through = np.add.reduceat(times, starts)
        real = number[starts, d] >= 0
        starts, through = starts[real], through[real]
        if not len(starts):
            continue
        mine, mine0, own = p[starts, d], p0[starts, d], number[starts, d]
        for a in range(d):
            other, other0 = p[starts, a], p0[starts, a]
            gain = (np.abs(mine - other) - np.abs(mine - other0) - np.abs(mine0 - other) + np.abs(mine0 - other0)) * through
            pair = number[starts, a] * (1 << 31) + own
            keys, at = np.unique(pair, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, gain)
            for key, value in zip(keys.tolist(), total.tolist()):
                one = (key >> 31, key & ((1 << 31) - 1))
                sums[one] = sums.get(one, 0) + value


def both(paths: DataFrame) -> DataFrame:
    """(lang, a, b, value): the corrections for the terms that sources number a < b share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}

        def emit() -> pa.RecordBatch:
            a, b = zip(*sums) if sums else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([now] * len(sums), pa.string()), pa.array(a, pa.int64()),
                                               pa.array(b, pa.int64()), pa.array(list(sums.values()), pa.int64())],
                                              names=["lang", "a", "b", "value"])

        for block in _blocks_of(batches):
            langs = block.column("lang").to_pylist()
            starts = [n for n in range(len(langs)) if n == 0 or langs[n] != langs[n - 1]] + [len(langs)]
            for first, last in zip(starts, starts[1:]):
                if langs[first] != now:
                    if now is not None:
                        yield emit()
                    now, sums = langs[first], {}
                _tree_sums(*_filled(block.slice(first, last - first)), sums)
        if now is not None:
            yield emit()

    ordered = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    sums = ordered.mapInArrow(run, "lang string, a bigint, b bigint, value bigint")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``ROWS_AT_ONCE`` or a little more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= ROWS_AT_ONCE:
            yield pa.concat_batches(held)
            held, size = [], 0
    if size:
        yield pa.concat_batches(held)


def _filled(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The steps of a batch's paths as arrays with a row for each path."""
    paths = batch.column("path")
    sizes = paths.value_lengths().to_numpy(zero_copy_only=False)
    steps = paths.flatten()
    inside = np.arange(int(sizes.max()))[None, :] < sizes[:, None]
    out = []
    for field, empty in (("number", -1), ("p", 0), ("p0", 0)):
        filled = np.full(inside.shape, empty, np.int64)
        filled[inside] = steps.field(field).to_numpy(zero_copy_only=False)
        out.append(filled)
    return (*out, batch.column("times").to_numpy(zero_copy_only=False).astype(np.int64))


def single(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): what the terms of source number a change against the zero count of source number b."""
    known = counts.join(groups.select("lang", "source", "held", "terms", "number"), ["lang", "source"])
    values = known.groupBy("lang", "number", _share("n", "held", "terms").alias("p")).agg(F.count("*").alias("times"))
    own = groups.select("lang", F.col("number").alias("a"), F.col("p0").alias("own0"))
    zeros = groups.select("lang", F.col("number").alias("b"), F.col("p0").alias("other0"))
    marks = own.join(zeros, "lang").where("a != b")  # as many rows as the result has
    null = F.lit(None).cast("bigint")
    line = values.select("lang", F.col("number").alias("a"), F.col("p").alias("at"), "times", F.lit(None).cast("int").alias("b"),
                         null.alias("own0")).unionByName(
        marks.select("lang", "a", F.col("other0").alias("at"), F.lit(0).cast("bigint").alias("times"), "b", "own0"))
    whole = Window.partitionBy("lang", "a")
    below = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    amount = F.col("times") * F.col("at")
    line = line.select("*", F.sum("times").over(whole).alias("all_times"), F.sum(amount).over(whole).alias("all_sum"),
                       F.sum("times").over(below).alias("low_times"), F.sum(amount).over(below).alias("low_sum"))
    far = F.expr("at * low_times - low_sum + (all_sum - low_sum) - at * (all_times - low_times)")
    value = far - F.col("all_times") * F.abs(F.col("own0") - F.col("at"))
    return line.where("b is not null").select("lang", "a", "b", value.alias("value"))


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          least_docs: int = LEAST_DOCS, top: int = TOP, terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of every group by distance (``pair``), and the ``top`` terms
    that it has more of than its language (``term``)."""
    counts, groups, sizes = kept_terms(df, text_col, lang_col, source_col, least_docs, terms_at_once)
    pairs = both(term_rows(counts, groups))
    alone = single(counts, groups)
    added = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")).unionByName(
        alone).unionByName(alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    zeros = groups.select("lang", "source", "number", "p0", "terms")
    base = zeros.join(zeros.select("lang", F.col("number").alias("b"), F.col("source").alias("item"), F.col("p0").alias("q0")),
                      "lang").where("number != b")
    sums = added.groupBy("lang", F.col("a").alias("number"), "b").agg(F.sum("value").alias("more"))
    found = base.join(sums, ["lang", "number", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        (F.col("terms") * F.abs(F.col("p0") - F.col("q0")) + F.coalesce("more", F.lit(0))).alias("value"))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = found.withColumn("rank", F.row_number().over(ranks).cast("int"))
    terms = counts.join(groups.select("lang", "source", "held", "terms"), ["lang", "source"]).join(
        sizes.select("lang", F.col("held").alias("all_held")), "lang")
    gap = _share("n", "held", "terms") - _share("total", "all_held", "terms")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap.alias("value"))
    terms = terms.where("value > 0").withColumn("rank", F.row_number().over(ranks).cast("int")).where(F.col("rank") <= top)
    return found.unionByName(terms)
