r"""Toxicity by compression distance: windows of a text compressed with a dictionary of toxic and one of ordinary text.

A window is one word (a run of letters, lower-cased; runs over ``WINDOW_BYTES`` bytes are several windows) between blanks,
followed by ``PAD`` because Zstandard starts no match in the last 8 bytes of its input.  It is compressed twice, once with
each dictionary; its cell is its own length and the two compressed lengths.  A window from toxic text is short with the
toxic dictionary and long with the ordinary one.

Training takes a bounded sample: at most ``SAMPLE`` labelled rows, those with the smallest hashes of their id.

* One half of it gives the dictionaries.  Labels mark documents, not words, so the toxic passages are the words whose share
  of toxic documents is at least ``CONTRAST`` times that of the others (``LEAST`` documents at least, ``TOXIC_WORDS`` words
  at most, those in most toxic documents first); ordinary ones are the words that occur again in other documents
  (``ORDINARY_WORDS`` at most).  Zstandard trains each dictionary on windows of its words, as often as they occur up to
  ``REPEATS`` times.  Both serve as plain content, so that literals cost the same under both.
* The other half, which the dictionaries have not seen, calibrates: a cell's evidence is the log ratio of its rates in toxic
  and in ordinary documents, and a text's score the logistic function of its strongest windows, their sums and its mean.

Word counts, cells and features are computed in tasks; the driver sees the words and cells named above and one short row
for each sampled document, all bounded by the sample, and trains on them.

Cases: null and empty texts have no windows and score like a text without evidence; very long texts are scored whole, in
blocks of ``BLOCK`` words; a label that is neither 0 nor 1 or has no id is not used; an id with two labels has the
larger; of rows with the same id one text (the smallest) is trained on; if either half has no toxic or no ordinary row,
every score is 0.5; repeated rows score alike; an empty table gives an empty result.  A column named ``score`` is
replaced, all others are kept.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanflow.llm.common import Memo, append_columns, kept, quoted, small_batches
from urbanflow.llm.quality import held_out, logistic
from urbanflow.session import checkpointed

SAMPLE = 20_000
TOXIC_BYTES, ORDINARY_BYTES = 1 << 14, 1 << 16
TOXIC_WORDS, ORDINARY_WORDS = 2_000, 30_000
CONTRAST, LEAST, REPEATS = 12.0, 3, 50
LEVEL = 3
WINDOW_BYTES = 64
PAD = b"\n" * 8
#: Lengths above these share the last cell of their axis.
LENGTHS = (96, 64, 64)
#: Windows added to each side of a cell's rates, spread like all windows.
SMOOTHING = 20.0
BLOCK = 1 << 16
KNOWN_LIMIT = 200_000

_WORDS = re.compile(rb"[a-z\x80-\xff]+").findall


def words(text: str | None) -> list[bytes]:
    found = _WORDS((text or "").lower().encode())
    if max(map(len, found), default=0) <= WINDOW_BYTES:
        return found
    return [w[n:n + WINDOW_BYTES] for w in found for n in range(0, len(w), WINDOW_BYTES)]


def window(word: bytes) -> bytes:
    return b" " + word + b" " + PAD


def train_dictionary(counts: list[tuple[bytes, int]], size: int) -> bytes:
    """Content that Zstandard's trainer picks from windows of words, each as often as its count says."""
    import zstandard
    samples = [window(w) for w, n in sorted(counts) for _ in range(min(n, REPEATS))]
    random.Random(7).shuffle(samples)
    # The trainer wants several times as much text as it returns.
    samples *= max(1, -(-100_000 // max(1, sum(map(len, samples)))))
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few different words to choose from
        return b"".join(window(w) for w, _ in sorted(counts))[-size:]


class Cells:
    """Words to the numbers of their cells."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self._toxic, self._ordinary = self._compressor(toxic), self._compressor(ordinary)
        self._known = Memo(self._cell, KNOWN_LIMIT)

    @staticmethod
    def _compressor(content: bytes):
        import zstandard
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False,
                                        write_dict_id=False).compress

    def _cell(self, word: bytes) -> int:
        text = window(word)
        at = 0
        for length, limit in zip((len(text), len(self._ordinary(text)), len(self._toxic(text))), LENGTHS):
            at = at * limit + min(length, limit - 1)
        return at

    def of(self, text: str | None) -> Iterator[np.ndarray]:
        """The cells of a text's windows, a block at a time."""
        found = words(text)
        for n in range(0, len(found), BLOCK):
            block = found[n:n + BLOCK]
            yield np.fromiter(map(self._known.__getitem__, block), np.int64, len(block))


@dataclass
class Model:
    """Two dictionaries, the evidence of each cell (sorted cells), and the weights of the features."""

    toxic: bytes
    ordinary: bytes
    cells: np.ndarray
    evidence: np.ndarray
    weights: np.ndarray

    def features(self, cells: Iterator[np.ndarray]) -> list[float]:
        """Strongest window, three strongest, evidence above two thresholds, mean evidence, length; the last is 1."""
        top, above, total, n = np.zeros(0), np.zeros(2), 0.0, 0
        for block in cells:
            at = np.minimum(np.searchsorted(self.cells, block), len(self.cells) - 1)
            value = np.where(self.cells[at] == block, self.evidence[at], 0.0)
            top = np.sort(np.concatenate([top, value]))[-3:]
            above += [np.maximum(value - t, 0).sum() for t in (0.7, 1.5)]
            total, n = total + value.sum(), n + len(value)
        return [float(top[-1]) if n else 0.0, float(top.sum()), *np.sqrt(above).tolist(), total / max(n, 1),
                float(np.log1p(n)), 1.0]


def _sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(half, label, text) of the sampled rows, as a table."""
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("turn", F.xxhash64("id", F.lit(13)))
    chosen = checkpointed(known.orderBy("turn", "id").limit(SAMPLE))  # at most SAMPLE rows, so it may be broadcast
    texts = df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label", "turn").agg(F.min("text").alias("text"))
    return checkpointed(rows.select(F.pmod(F.shiftright("turn", 7), F.lit(2)).cast("int").alias("half"), "label", "text"))


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, ordinary, seen): documents of each kind with the word, and its occurrences in ordinary ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                here: dict[bytes, int] = {}
                for word in words(text):
                    here[word] = here.get(word, 0) + 1
                for word, n in here.items():
                    kept = found.setdefault(word, [0, 0, 0])
                    kept[1 - label] += 1
                    kept[2] += n * (1 - label)
            columns = list(zip(*found.values())) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), *[pa.array(c, pa.int64()) for c in columns]],
                                             names=["word", "toxic", "ordinary", "seen"])

    parts = rows.select("label", "text").mapInArrow(run, "word binary, toxic bigint, ordinary bigint, seen bigint")
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "ordinary", "seen")])


def _dictionaries(rows: DataFrame, toxic_rows: int, ordinary_rows: int) -> tuple[bytes, bytes]:
    counts = checkpointed(_word_counts(rows))
    share = (F.col("toxic") + 0.5) / (toxic_rows + 1) / ((F.col("ordinary") + 0.5) / (ordinary_rows + 1))
    toxic = (F.col("toxic") >= LEAST) & (share >= CONTRAST)
    bad = counts.where(toxic).orderBy(F.desc("toxic"), "word").limit(TOXIC_WORDS).collect()
    good = counts.where(~toxic & (F.col("seen") > 1)).orderBy(F.desc("seen"), "word").limit(ORDINARY_WORDS).collect()
    return (train_dictionary([(bytes(r["word"]), r["toxic"]) for r in bad], TOXIC_BYTES),
            train_dictionary([(bytes(r["word"]), r["seen"]) for r in good], ORDINARY_BYTES))


def _cell_counts(rows: DataFrame, toxic: bytes, ordinary: bytes) -> list:
    """(label, cell, n): windows in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, found = Cells(toxic, ordinary), {}
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                for block in cells.of(text):
                    for cell, n in zip(*(a.tolist() for a in np.unique(block, return_counts=True))):
                        found[label, cell] = found.get((label, cell), 0) + n
        label, cell = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(cell, pa.int64()),
                                          pa.array(list(found.values()), pa.int64())], names=["label", "cell", "n"])

    parts = rows.select("label", "text").mapInArrow(run, "label int, cell bigint, n bigint")
    return parts.groupBy("label", "cell").agg(F.sum("n").alias("n")).collect()


def _evidence(counts: list) -> tuple[np.ndarray, np.ndarray]:
    cells = np.array(sorted({r["cell"] for r in counts}), np.int64)
    n = np.zeros((2, len(cells)))
    for r in counts:
        n[r["label"], np.searchsorted(cells, r["cell"])] = r["n"]
    sums = n.sum(axis=1, keepdims=True)
    rates = np.log((n + SMOOTHING * sums / sums.sum()) / np.maximum(sums, 1))
    return cells, rates[1] - rates[0]


def _fit_weights(rows: DataFrame, model: Model) -> np.ndarray:
    """Logistic regression on the features of the calibration half, by Newton steps with a unit penalty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(model.toxic, model.ordinary)
        for batch in batches:
            made = [model.features(cells.of(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(made, pa.list_(pa.float64()))],
                                             names=["label", "x"])

    found = rows.select("label", "text").mapInArrow(run, "label int, x array<double>").collect()
    found.sort(key=lambda r: (r["x"], r["label"]))  # sums in the same order in every run
    x, y = np.array([r["x"] for r in found]), np.array([r["label"] for r in found], float)
    mean, size = x.mean(axis=0), x.std(axis=0)
    mean[-1], size[-1] = 0.0, 1.0
    size[size == 0] = 1.0
    z, w = (x - mean) / size, np.zeros(x.shape[1])
    for _ in range(30):
        p = logistic(z @ w)
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (y - p) - w)
    w /= size
    w[-1] -= mean @ w
    return w


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model | None:
    """The model, or None if a half of the sample lacks toxic or ordinary rows."""
    small_batches(df.sparkSession)
    rows = _sample(df, labels, id_col, text_col, label_col)
    n = {(r["half"], r["label"]): r["count"] for r in rows.groupBy("half", "label").count().collect()}
    if len(n) < 4:
        return None
    first, second = rows.where("half = 0"), rows.where("half = 1")
    toxic, ordinary = _dictionaries(first, n[0, 1], n[0, 0])
    if not toxic or not ordinary:
        return None
    cells, evidence = _evidence(_cell_counts(second, toxic, ordinary))
    if not len(cells):
        return None
    model = Model(toxic, ordinary, cells, evidence, np.zeros(0))
    model.weights = _fit_weights(second, model)
    return model


def score(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` from 0 to 1."""

    def compute(texts: pa.Array) -> list:
        if model is None:
            return [[0.5] * len(texts)]
        cells = kept("toxicity", None, dict)
        key = (model.toxic, model.ordinary)
        if key not in cells:
            cells.clear()
            cells[key] = Cells(*key)
        x = np.array([model.features(cells[key].of(text)) for text in texts.to_pylist()])
        return [logistic(x @ model.weights).tolist()]

    return append_columns(df, text_col, [("score", T.DoubleType())], compute)
