"""Mixing sources to target weights by Pareto order sampling.

Sources take weights in turn, in the order of their names by code point, null last.  The words of all sources are
shared by weight; a target stops at ``cap`` times the words of its source, and what it leaves is shared among the
others by weight until no target is above.  Every document of a source is wanted target / size times: the whole
part of that is allocated as certain copies, and a document's inclusion odds for one copy more are those of the
fraction times sqrt(mean size / its size), so that a single long document is less likely to decide a small target.
Documents are ranked by (u / (1 - u)) / (inclusion odds) with u a hash of the row in (0, 1) and taken in that order up
to the first one that does not fit into what the source still needs.  The rest is filled from further down the ranks:
from the largest size that fits to the smallest, as many of each size as fit, those with the lowest ranks; at last the
smallest document left is taken if that comes nearer to the target than to leave it.

No source is ever sorted in one task: two histograms of ``BINS`` bins find the bin in which the target is reached,
and only the rows of that bin, about one in ``BINS`` squared, are put in order.  What is left to fill is less than one
document, so filling needs the number of documents of each size below that, and a few documents of each.

Cases: a null text has size 0; a document without words is never taken beyond its certain copies and takes no words;
u depends on the id, the source and the text, so reruns agree; rows that repeat all three are one document, which is
taken or left as a whole, and counts with the words of all its rows.  Very long texts are counted whole.  An empty
table gives an empty result.  A source without words has target 0.  Columns named like a result column are replaced,
all others are kept.  The number of sources is taken to be small beside that of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.llm.common import quoted, word_array
from urbanflow.session import checkpointed

BINS = 4096
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
RESULT = ["size", "source_size", "target", "copies", "taken"]


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, size) of documents -> (source, source_size, target), one row per source."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    weighed = weighed.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    filling = every.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    sharing = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = weighed.withColumn("level", left / sharing).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return leveled.select("source", "source_size",
                          F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def _edge(rows: DataFrame, nth: int) -> DataFrame:
    """Per source the first bin in which its words reach what is needed, and what is needed inside that bin."""
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("needed").alias("needed"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    reached = bins.withColumn("running", running).where("running >= needed")
    first = reached.groupBy("source").agg(F.min(F.struct("bin", "running", "words", "needed")).alias("at"))
    return first.select("source", F.col("at.bin").alias(f"edge{nth}"),
                        F.expr("at.needed - (at.running - at.words)").alias(f"open{nth}"))


def _bin(nth: int):
    return F.floor(F.col("rank") * float(BINS ** nth)).cast("long")


def _cut(ranked: DataFrame) -> DataFrame:
    """Per source the rank below which documents get one copy more, and the words that are then open."""
    def inside(rows: DataFrame, edge: DataFrame, nth: int) -> DataFrame:
        other = edge.withColumnRenamed("source", "edge_source")
        joined = rows.join(other, F.col("source").eqNullSafe(F.col("edge_source"))).where(f"bin = edge{nth}")
        return joined.select("source", "size", "rank", F.col(f"open{nth}").alias("needed"))

    coarse = ranked.withColumn("bin", _bin(1))
    fine = checkpointed(inside(coarse, _edge(coarse, 1), 1)).withColumn("bin", _bin(2))
    last = inside(fine, _edge(fine, 2), 2).groupBy("source", "rank").agg(
        F.sum("size").alias("words"), F.first("needed").alias("needed"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("rank"))
    open_before = F.col("needed") - (running - F.col("words"))
    reached = last.withColumn("open", open_before).where("open > 0")
    edge = checkpointed(reached.groupBy("source").agg(F.max(F.struct("rank", "open")).alias("at")).select(
        F.col("source").alias("cut_source"), F.col("at.rank").alias("cut"), F.col("at.open").alias("open")))
    return edge


def _fill(ranked: DataFrame, edge: DataFrame) -> DataFrame:
    """(source, rank) of the documents behind the cut that fill what is open; equal ranks are one document."""
    same = F.col("source").eqNullSafe(F.col("cut_source"))
    behind = ranked.join(edge, same).where("rank >= cut").groupBy("source", "rank").agg(
        F.sum("size").alias("size"), F.first("open").alias("open"))
    # A document of twice what is open or more never comes nearer than none.
    behind = checkpointed(behind.where("size < 2 * open"))
    sizes = behind.groupBy("source", "size").agg(F.count("*").alias("n"), F.first("open").alias("open"))
    lists = sizes.groupBy("source").agg(F.first("open").alias("open"), F.sort_array(
        F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))

    def step(state, entry):
        fits = F.least(entry["n"], F.floor(state["open"] / entry["size"]).cast("long"))
        left = entry["n"] > fits
        # The smallest document left: the one it is, and how many of its size are taken before it.
        return F.struct((state["open"] - fits * entry["size"]).alias("open"),
                        F.when(left, entry["size"]).otherwise(state["last"]).alias("last"),
                        F.when(left, fits).otherwise(state["last_fits"]).alias("last_fits"),
                        F.when(fits > 0, F.concat(state["taken"], F.array(F.struct(entry["size"].alias("size"), fits.alias("k")))))
                        .otherwise(state["taken"]).alias("taken"))

    start = F.struct(F.col("open").cast("double").alias("open"), F.lit(None).cast("long").alias("last"),
                     F.lit(0).cast("long").alias("last_fits"), F.array().cast("array<struct<size:bigint,k:bigint>>").alias("taken"))
    done = lists.select("source", F.aggregate("sizes", start, step).alias("state"))
    nearer = F.col("state.last").isNotNull() & (F.col("state.last") - F.col("state.open") < F.col("state.open"))
    one_more = F.when(nearer, F.array(F.struct(F.col("state.last").alias("size"), (F.col("state.last_fits") + 1).alias("k"))))
    wanted = done.select(F.col("source").alias("want_source"), F.explode(F.concat(
        "state.taken", F.coalesce(one_more, F.array().cast("array<struct<size:bigint,k:bigint>>")))).alias("w"))
    wanted = checkpointed(wanted.groupBy("want_source", F.col("w.size").alias("want_size")).agg(F.max("w.k").alias("k")))
    most = wanted.agg(F.max("k")).first()[0] or 0
    numbered = F.row_number().over(Window.partitionBy("source", "size").orderBy("rank"))
    # The bound on the number lets every task keep only its lowest ranks of a size before they meet.
    first = behind.withColumn("number", numbered).where(F.col("number") <= int(most))
    chosen = first.join(wanted, F.col("source").eqNullSafe(F.col("want_source")) & (F.col("size") == F.col("want_size")))
    return chosen.where("number <= k").select(F.col("source").alias("fill_source"), F.col("rank").alias("fill_rank"))


def _ranked(rows: DataFrame, hash_col: str, source_col: str, goals: DataFrame) -> DataFrame:
    """``rows`` with the goal of their source and the Pareto rank, moved into (0, 1)."""
    u = (F.shiftrightunsigned(F.col(hash_col), 11) + 0.5) / float(1 << 53)
    inclusion = F.col("p") / (1 - F.col("p")) * F.sqrt(F.col("mean_size") / F.greatest("size", F.lit(1)))
    odds = (u / (1 - u)) / inclusion
    joined = rows.join(goals, quoted(source_col).eqNullSafe(F.col("goal_source")))
    return joined.withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 7) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` (words of its source), ``copies`` and ``taken`` words."""
    kept = [c for c in df.columns if c.lower() not in RESULT]
    words = F.size(word_array(quoted(text_col))).cast("long")
    hashed = F.xxhash64(F.lit(seed), quoted(id_col), quoted(source_col), F.coalesce(quoted(text_col), F.lit("")))
    # Columns of the input go by number until the end, so that no name clashes.
    rows = df.select(*[quoted(c).alias(f"in{n}") for n, c in enumerate(kept)], quoted(source_col).alias("source"),
                     words.alias("size"), hashed.alias("hash"))
    narrow = checkpointed(rows.select("source", "size", "hash"))
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    counted = narrow.where("size > 0").groupBy(F.col("source").alias("count_source")).agg(F.avg("size").alias("mean_size"))
    goals = targets(narrow, weights, cap).withColumn("rate", rate)
    goals = checkpointed(goals.join(counted, F.col("source").eqNullSafe(F.col("count_source")), "left").drop("count_source")
                         .withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("int"))
                         .withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
                         .withColumn("needed", F.col("p") * F.col("source_size"))
                         .withColumnRenamed("source", "goal_source"))
    ranked = _ranked(narrow, "hash", "source", goals).where("p > 0 and size > 0").select("source", "size", "needed", "rank")
    edge = _cut(ranked)
    filled = checkpointed(_fill(ranked.select("source", "size", "rank"), edge))
    goals = goals.join(edge, F.col("goal_source").eqNullSafe(F.col("cut_source")), "left")
    found = _ranked(rows, "hash", "source", checkpointed(goals.drop("cut_source")))
    # One row for every document that fills: less than one document's words for each source.
    found = found.join(filled, F.col("source").eqNullSafe(F.col("fill_source")) & (F.col("rank") == F.col("fill_rank")), "left")
    more = (F.col("size") > 0) & F.coalesce((F.col("rank") < F.col("cut")) | F.col("fill_rank").isNotNull(), F.lit(False))
    copies = (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int")
    return found.select(*[F.col(f"in{n}").alias(c) for n, c in enumerate(kept)], "size", "source_size", "target",
                        copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
