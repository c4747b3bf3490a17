"""Substring dedup: repeated passages found through difference-cover anchors.

A window is ``window`` consecutive words of one document.  Words that lie in a window whose words also start earlier
(in a document with a smaller id, or earlier in the same one) are removed; windows are judged on the input.

A difference cover of a period v is a set of places modulo v such that any two places can be moved by the same
distance, less than v, into the set.  So if two windows are equal, some distance below v puts both on cover places, and
the ``window`` - v + 1 words from there, which still lie inside both windows, are equal: an anchor they share.  Only
these places are hashed (4 of 13 for windows of 20 words).  The steps:

1. Anchors that occur once are dropped.  Within a chunk of documents repeats are settled before the shuffle, and only
   one row goes on for each hash, so a passage in any share of the documents sends few rows to one place.
2. Around the shared anchors, the windows that contain one are hashed (96 bits).  Again a chunk settles its own
   repeats; what is left is compared by hash, and all but the first of equal windows are marked.
3. Marks meet their document, and words are removed.

Texts travel compressed, and only those that have shared anchors (to meet them) or marks (to meet those).  Which have
is looked up in a bit table of fixed size; a bit set by chance only sends a text that would not have had to go.

Cases: a null text has no words; texts shorter than a window lose nothing; a null id counts as the smallest.  Rows that
share id and text are one document, so neither is earlier than the other; rows that share only the id are ordered by a
hash of their texts.  An empty table gives an empty result.  Columns named like a result column are replaced, all others
are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanflow.llm.common import bit_table, quoted, small_batches, with_bit
from urbanflow.session import checkpointed

#: Difference covers by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Anchors or windows that a task gathers before it settles repeats among them.
CHUNK = 400_000
RESULT = ["n_words", "n_removed", "kept_text"]


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves an anchor at least a third of the window."""
    period = max(v for v in COVERS if v <= 1 + 2 * window // 3)
    return period, COVERS[period]


class Words:
    """The words of a text and where they lie in their joined form."""

    def __init__(self, text: bytes):
        self.words = text.split()  # of bytes: ASCII white space only
        self.joined = b" ".join(self.words)
        self.ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if self.words else self.ends

    def runs(self, at: np.ndarray, length: int) -> Iterator[bytes]:
        """The texts of ``length`` words from each place."""
        joined = self.joined
        return (joined[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + length - 1].tolist()))


def _packed(df: DataFrame, text: str, others: list[str]) -> DataFrame:
    """``others`` and the text as a compressed binary ``packed``."""
    rows = df.select(*others, F.col(text).alias("text"))
    schema = T.StructType([rows.schema[c] for c in others] + [T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = pa.array([pack((t or "").encode()) for t in batch.column(len(others)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*others, "packed"])

    return rows.mapInArrow(run, schema)


def _unpacker():
    import zstandard
    return zstandard.ZstdDecompressor().decompress


def _shared_anchors(rows: DataFrame, window: int) -> DataFrame:
    """(doc, tag, places): the cover places of each document whose anchor occurs elsewhere."""
    period, cover = cover_of(window)
    length = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        digest = xxhash.xxh3_64_intdigest
        chunk, size = [], 0
        for batch in batches:
            for doc, tag, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = Words((text or "").encode())
                n = len(words.words)
                if n < window:
                    continue
                places = np.arange(n - length + 1, dtype=np.int32)
                places = places[np.isin(places % period, cover)]
                hashes = np.fromiter(map(digest, words.runs(places, length)), np.uint64, len(places)) >> np.uint64(16)
                chunk.append((doc, tag, places, hashes))
                size += len(places)
                if size >= CHUNK:
                    yield from settle(chunk)
                    chunk, size = [], 0
        yield from settle(chunk)

    def settle(chunk: list) -> Iterator[pa.RecordBatch]:
        if not chunk:
            return
        counts = [len(c[2]) for c in chunk]
        doc, tag = (np.repeat(np.array([c[n] for c in chunk], kind), counts) for n, kind in ((0, np.int64), (1, np.int32)))
        place, hashed = (np.concatenate([c[n] for c in chunk]) for n in (2, 3))
        known, which, seen = np.unique(hashed, return_inverse=True, return_counts=True)
        shared = seen[which] > 1
        # Shared here: travels by its document.  Alone here: travels by its hash.  One row says what is shared here.
        marks = known[seen > 1]
        key = np.concatenate([np.where(shared, doc.astype(np.uint64), hashed), marks]).view(np.int64)
        extra = len(marks)
        yield pa.RecordBatch.from_arrays([
            pa.array(key), pa.array(np.concatenate([doc, np.zeros(extra, np.int64)])),
            pa.array(np.concatenate([tag, np.zeros(extra, np.int32)])),
            pa.array(np.concatenate([place, np.full(extra, -1, np.int32)])),
            pa.array(np.concatenate([shared, np.zeros(extra, bool)]))], names=["key", "doc", "tag", "place", "shared"])

    sent = rows.select("doc", "tag", "text").mapInArrow(run, "key bigint, doc bigint, tag int, place int, shared boolean")
    same = Window.partitionBy("key", "shared")
    counted = sent.select("*", F.count("*").over(same).alias("n"), F.min("place").over(same).alias("least"))
    found = counted.where("place >= 0 and (shared or n > 1 or least < 0)")
    return found.groupBy("doc", "tag").agg(F.collect_list("place").alias("places"))


def _repeated_windows(met: DataFrame, window: int) -> DataFrame:
    """(doc, tag, runs): runs (start, count) of windows that also start earlier; ``met`` has packed and places."""
    period, _ = cover_of(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        unpack, digest, chunk, size = _unpacker(), xxhash.xxh3_128_digest, [], 0
        for batch in batches:
            for doc, tag, packed, places in zip(*(c.to_pylist() for c in batch.columns)):
                words = Words(unpack(packed))
                last = len(words.words) - window
                change = np.zeros(last + 2, np.int32)
                at = np.array(places)
                # A window contains the anchor at p if it starts in [p - period + 1, p].
                np.add.at(change, np.clip(at - period + 1, 0, last + 1), 1)
                np.add.at(change, np.minimum(at, last) + 1, -1)
                starts = np.flatnonzero(np.cumsum(change)[:last + 1] > 0).astype(np.int32)
                hashes = np.frombuffer(b"".join(map(digest, words.runs(starts, window))), "<i8").reshape(-1, 2)
                hashes = np.stack([hashes[:, 0], hashes[:, 1] >> 32], axis=1)
                chunk.append((doc, tag, starts, hashes))
                size += len(starts)
                if size >= CHUNK:
                    yield from settle(chunk)
                    chunk, size = [], 0
        yield from settle(chunk)

    def settle(chunk: list) -> Iterator[pa.RecordBatch]:
        if not chunk:
            return
        chunk.sort(key=lambda c: c[:2])
        counts = [len(c[2]) for c in chunk]
        doc, tag = (np.repeat(np.array([c[n] for c in chunk], kind), counts) for n, kind in ((0, np.int64), (1, np.int32)))
        start, hashes = (np.concatenate([c[n] for c in chunk]) for n in (2, 3))
        order = np.argsort(hashes[:, 0], kind="stable")  # equal windows stay in the order of documents
        by_hash = hashes[order]
        head = np.ones(len(order), bool)
        head[1:] = (by_hash[1:] != by_hash[:-1]).any(axis=1)
        first = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        later = (doc[order] != doc[first]) | (tag[order] != tag[first]) | (start[order] != start[first])
        repeated = np.zeros(len(order), bool)
        repeated[order[later]] = True
        send = np.sort(order[head])  # in the order of documents, in which ids take little room
        # Repeated here: runs of neighbouring windows travel by their document.  The first ones travel by their hash.
        at = np.flatnonzero(repeated)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (start[at[1:]] != start[at[:-1]] + 1) | (doc[at[1:]] != doc[at[:-1]]) | (
            tag[at[1:]] != tag[at[:-1]])
        heads = np.flatnonzero(fresh)
        runs, length = at[heads], np.diff(np.append(heads, len(at))).astype(np.int32)
        both = np.concatenate([send, runs])
        count = np.concatenate([np.zeros(len(send), np.int32), length])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.where(count > 0, doc[both], hashes[both, 0])),
            pa.array(np.where(count > 0, 0, hashes[both, 1]).astype(np.int32)),
            pa.array(doc[both]), pa.array(tag[both]), pa.array(start[both]), pa.array(count)],
            names=["w1", "w2", "doc", "tag", "start", "count"])

    sent = met.select("doc", "tag", "packed", "places").mapInArrow(
        run, "w1 bigint, w2 int, doc bigint, tag int, start int, count int")
    own = F.struct("doc", "tag", "start")
    same = Window.partitionBy("w1", "w2", F.col("count") > 0)
    marked = sent.select("*", F.min(own).over(same).alias("first")).where((F.col("count") > 0) | (own > F.col("first")))
    return marked.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", F.greatest("count", F.lit(1)).alias("count"))).alias("runs"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed`` and ``kept_text``, the words that stay joined by blanks."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in RESULT]
    tag = F.pmod(F.xxhash64(quoted(text_col)), F.lit((1 << 31) - 1)).cast("int")
    doc = F.coalesce(quoted(id_col).cast("long"), F.lit(-(1 << 63)))
    # Where every id has one text, the id alone names a document.
    twice = df.select(doc.alias("doc"), tag.alias("tag")).groupBy("doc").agg(F.min("tag").alias("a"), F.max("tag").alias("b"))
    if twice.where("a <> b").isEmpty():
        tag = F.lit(0)
    # Columns of the input go by number until the end, so that no name clashes.
    carried = [f"in{n}" for n, c in enumerate(kept) if c != text_col]
    rows = df.select(*[quoted(c).alias(f"in{n}") for n, c in enumerate(kept) if c != text_col], doc.alias("doc"),
                     tag.alias("tag"), quoted(text_col).alias("text"))
    key = ["doc", "tag"]
    places = checkpointed(_shared_anchors(rows, window))
    sharing = with_bit(rows.select(*key, "text"), key, bit_table(places, key), "sharing").where("sharing")
    met = _packed(sharing, "text", key).join(places, key)
    runs = checkpointed(_repeated_windows(met, window))
    rows = with_bit(rows.withColumn("no_text", F.col("text").isNull()), key, bit_table(runs, key), "marked")
    marked = _packed(rows.where("marked"), "text", [*carried, *key, "no_text"]).join(runs, key, "left")
    whole = rows.where("not marked").select(
        *carried, "no_text", F.coalesce("text", F.lit("")).cast("binary").alias("body"), F.lit(None).cast("binary").alias(
            "packed"), F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    cut = marked.select(*carried, "no_text", F.lit(None).cast("binary").alias("body"), "packed", "runs")
    schema = T.StructType([rows.schema[c] for c in carried] + [
        T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpacker()
        for batch in batches:
            texts, n_words, n_removed, left = [], [], [], []
            for absent, text, packed, found in zip(*(batch.column(c).to_pylist() for c in ("no_text", "body", "packed", "runs"))):
                text = unpack(packed) if text is None else text
                words = text.split()
                if found:
                    change = np.zeros(len(words) + 1, np.int64)
                    for r in found:
                        change[r["start"]] += 1
                        change[r["start"] + r["count"] - 1 + window] -= 1
                    gone = np.cumsum(change[:-1]) > 0
                    stay = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    stay = words
                texts.append(None if absent else text.decode())
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
                left.append(b" ".join(stay).decode())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()),
                 pa.array(n_removed, pa.int64()), pa.array(left, pa.string())], names=schema.names)

    done = whole.mapInArrow(run, schema).unionByName(cut.mapInArrow(run, schema))
    return done.select(*[(F.col("text") if c == text_col else F.col(f"in{n}")).alias(c) for n, c in enumerate(kept)], *RESULT)
