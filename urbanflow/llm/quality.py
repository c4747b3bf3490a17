r"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Tokens are runs of word characters and runs of other visible characters (``\w+|[^\w\s]+``), as they stand.  Tokens and
pairs of neighbours are hashed into ``2 ** BITS`` buckets; a text is the vector of 1 + log(count) over its buckets,
scaled to length ``LENGTH``, and its score the logistic function of the sparse dot product with the weights plus a bias.

Training takes a bounded sample: at most ``SAMPLE`` labelled rows, those with the smallest hashes of their id.  It is
cut into ``SHARDS`` shards; in each of ``ROUNDS`` rounds every shard goes through its rows once, one update a row,
starting from the mean of all shards' states after the round before.  A state is two arrays of ``2 ** BITS`` numbers,
whatever the data, so neither a task nor the driver holds more than a few of them and one batch of texts.

Cases: null and empty texts have the zero vector and score the bias; a label that is neither 0 nor 1 or has no id is not
used; an id with two labels has the larger; of rows with the same id one text (the smallest) is trained on; without any
label every score is 0.5.  Columns named ``score`` are replaced, all others are kept; repeated rows score alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanflow.llm.common import Memo, append_columns, give_back, kept, quoted, serve, small_batches
from urbanflow.session import checkpointed

BITS = 18
SAMPLE = 20_000
SHARDS = 4
ROUNDS = 6
#: Length of the vector of a text.
LENGTH = 4.0
#: FTRL-proximal: learning rate, its offset, and the L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.01, 0.0
TOKEN_LIMIT = 200_000

_TOKENS = re.compile(r"\w+|[^\w\s]+").findall


class Features:
    """Texts as sparse vectors."""

    def __init__(self):
        import xxhash
        self._hashes = Memo(lambda token: xxhash.xxh64_intdigest(token.encode(), 17), TOKEN_LIMIT)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = _TOKENS(text or "")
        single = np.fromiter(map(self._hashes.__getitem__, tokens), np.uint64, len(tokens))
        pairs = (single[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (single[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        pairs ^= pairs >> np.uint64(29)
        pairs *= np.uint64(0xBF58476D1CE4E5B9)
        buckets = (np.concatenate([single, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)
        where, counts = np.unique(buckets, return_counts=True)
        values = 1 + np.log(counts)
        return where, values * (LENGTH / (np.sqrt(values @ values) or 1.0))


@dataclass
class Ftrl:
    """State of follow-the-regularised-leader updates; the last place is the bias."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def fresh(cls) -> Ftrl:
        return cls(np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def update(self, where: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(where, 1 << BITS), np.append(values, 1.0)
        w = self.weights(at)
        g = (logistic(w @ x) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def held_out(id_col: str) -> Column:
    """Rows that training must not see: the CRC-32 of the id as text is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(shard, turn, label, text) of the sample, as a table."""
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("turn", F.xxhash64("id"))
    sample = checkpointed(known.orderBy("turn", "id").limit(SAMPLE))  # at most SAMPLE rows, so it may be broadcast
    texts = df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "label", "turn").agg(F.min("text").alias("text"))
    return checkpointed(rows.select(F.pmod("turn", F.lit(SHARDS)).cast("int").alias("shard"), "turn", "label", "text"))


def _one_round(rows: DataFrame, state: Ftrl) -> Ftrl:
    """The mean of the shards' states after each has gone through its rows."""
    z0, n0 = state.z, state.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("quality")  # training is the first to run after the tables of another run's last operator
        features, shard, own = Features(), None, None

        def result():
            return pa.RecordBatch.from_pydict({"z": [own.z.tobytes()], "n": [own.n.tobytes()]})

        for batch in batches:
            for now, label, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "label", "text"))):
                if now != shard:
                    if own is not None:
                        yield result()
                    shard, own = now, Ftrl(z0.copy(), n0.copy())
                own.update(*features.vector(text), label)
        if own is not None:
            yield result()
        features = own = None
        give_back()

    ordered = rows.repartitionByRange(SHARDS, "shard").sortWithinPartitions("shard", "turn")
    found = ordered.mapInArrow(run, "z binary, n binary").collect()
    if not found:
        return state
    return Ftrl(*(np.mean([np.frombuffer(r[c]) for r in found], axis=0) for c in ("z", "n")))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> np.ndarray:
    """Weights of the buckets, then the bias."""
    small_batches(df.sparkSession)
    rows = training_rows(df, labels, id_col, text_col, label_col)
    state = Ftrl.fresh()
    for _ in range(ROUNDS):
        state = _one_round(rows, state)
    return state.weights().astype(np.float32)


def score(df: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` from 0 to 1."""

    def compute(texts: pa.Array) -> list:
        features = kept("quality", None, Features)
        vectors = (features.vector(text) for text in texts.to_pylist())
        return [logistic(np.array([float(weights[at] @ x) for at, x in vectors]) + weights[-1]).tolist()]

    return append_columns(df, text_col, [("score", T.DoubleType())], compute)
