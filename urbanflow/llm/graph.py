"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from urbanflow.session import checkpoint_table, drop_table


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that can be reached.

    Rounds of large-star and small-star steps: in turn, every node hands its smallest neighbour to its larger and
    to its smaller neighbours.  Each step is a minimum per node, combined before the shuffle, and a join of the links
    with these minima, which are one row a node; a node with very many links is therefore spread over tasks.  The
    links of each step are a written table, so that no plan holds more than one step, and rounds end when the links no
    longer change, which their count and the sum of their hashes tell, taken while they are written.
    """
    spark = links.sparkSession
    now, path, seen = _written(_canonical(links.select("a", "b")))
    before = None
    while seen != before:
        half, half_path, _ = _written(_large_star(now))
        drop_table(spark, path)
        now, path, following = _written(_small_star(half))
        drop_table(spark, half_path)
        before, seen = seen, following
    # Links now join every node with its root.
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _written(links: DataFrame) -> tuple[DataFrame, str, dict]:
    """The links as a table, its path, and what identifies them."""
    seen = Observation()
    table, path = checkpoint_table(links.observe(seen, F.count("*").alias("n"),
                                                 F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")))
    return table, path, seen.get


def _both(first: tuple[str, str], second: tuple[str, str], names: tuple[str, str]) -> str:
    """SQL that gives two rows with columns ``names`` for each row."""
    return f"stack(2, {', '.join(first + second)}) as ({', '.join(names)})"


def _canonical(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.selectExpr(_both(("a", "b"), ("b", "a"), ("n", "v")))
    least = both.groupBy("n").agg(F.least("n", F.min("v")).alias("m"))
    # Seen from each node, its larger neighbours.
    return _canonical(links.join(least, F.col("b") == F.col("n")).select("a", F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    return _canonical(links.join(least, F.col("a") == F.col("n")).selectExpr(_both(("b", "m"), ("a", "m"), ("a", "b"))))
