"""From raw documents to token ids: the stages, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanflow.llm import bpe, exact, mixing, quality, simhash
from urbanflow.llm.common import documents, labels, quoted
from urbanflow.session import checkpointed

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Score from which a document counts as good, words in a shingle, and bits in which near duplicates differ at most.
GOOD, SHINGLE, BITS = 0.3, 4, 4
#: Columns that the stages read; all others only travel along.
READ = ["doc_id", "text", "source"]


def _kept(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``stage`` returns, with the columns of ``docs`` as they were.

    Columns that no stage reads go by number meanwhile, so a column named like one that an operator adds keeps its values.
    """
    numbers = {c: c if c in READ else f"column_{n}" for n, c in enumerate(docs.columns)}
    found = stage(docs.select(*[quoted(c).alias(n) for c, n in numbers.items()]))
    return found.select(*[F.col(n).alias(c) for c, n in numbers.items()])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are judged by the bias alone, very long ones whole; a score of exactly ``GOOD`` is accepted;
    repeated rows are judged alike; an empty table stays empty; the caller's columns keep their values.
    """
    weights = quality.train(docs.select(*READ), labels(spark, sf_dir))
    return _kept(docs, lambda rows: quality.score(rows, weights).where(F.col("score") >= GOOD))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z: the one with the largest id.

    Null and empty texts are one group; very long texts are compared whole; of rows that repeat the largest id one stays;
    an empty table stays empty; the caller's columns keep their values.
    """
    return _kept(docs, lambda rows: exact.exact_dedup(rows).where("kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: the smallest id (null first), then the smallest hash of the text.

    Texts without words have one fingerprint and so are one group; very long texts are hashed whole; rows that repeat the
    id and text that stays all stay; an empty table stays empty; the caller's columns keep their values.
    """
    key = F.xxhash64("text")
    rows = checkpointed(simhash.simhash_groups(docs.select("doc_id", "text", key.alias("text_key")), shingle=SHINGLE,
                                               bits=BITS).select("doc_id", "text_key", "group_root"))
    own = F.struct("doc_id", "text_key")
    first = rows.groupBy("group_root").agg(F.min(own).alias("first"))
    leave = rows.join(first, "group_root").where(~own.eqNullSafe(F.col("first"))).select(
        F.col("doc_id").alias("leave_id"), F.col("text_key").alias("leave_key")).distinct()

    def others(found: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col("leave_id")) & key.eqNullSafe(F.col("leave_key"))
        return found.join(leave, same, "left_anti")

    return _kept(docs, others)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and are taken as certain copies only; very long texts count whole; rows that repeat
    id, source and text are taken together; an empty table stays empty; the caller's columns keep their values.
    """
    return _kept(docs, lambda rows: mixing.mix(rows).where("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), "copies"))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by decoding them.

    Null and empty texts have none; very long texts are encoded whole; repeated rows stay repeated; an empty table stays
    empty.
    """
    found = bpe.round_trip(docs.select("doc_id", "source", "text"), RANKS, public_tokenizers.PATTERN)
    return found.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("simhash", without_near_copies),
          ("mixing", mixed), ("byte_bpe", tokens)]
#: Training, fingerprints and byte-pair merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
