"""Token ids on disk, compressed by a Re-Pair grammar per shard, with random access.

Documents are put into ranges of their id, in ascending order, and encoded with the library of the vocabulary file;
every document ends with id ``end``.  A task cuts its range into shards of whole documents with about ``SHARD_IDS``
ids and compresses each one by itself: in every round, neighbouring pairs that are frequent in the shard are replaced by nonterminals (of overlapping
pairs the more frequent one), until no pair occurs ``LEAST`` times, which is when a rule saves more than it takes, or a
round saves less than ``GAIN`` of the symbols.  All pairs of a round are counted and replaced at once; hashed counts
choose among overlapping pairs, exact counts decide which pairs become rules.

File format: Parquet, one row per shard: ``part`` and ``shard`` (their order is that of the ids), ``start`` (ids
of the part before the shard), ``doc_ids`` and
``doc_ends`` (ids of the shard before the end of each document), ``rules`` (two little-endian unsigned 32-bit symbols
per nonterminal; symbols from ``base`` on are nonterminals), ``lengths`` (ids that each nonterminal stands for) and
``symbols`` (the compressed sequence).  ``lengths`` lets a reader find any place of a shard and expand only what it
wants: ``Shard.read``.

Cases: null and empty texts are the end id alone; rows that share an id follow each other in the order of their
texts' hashes; rows with a null id come first; an empty table writes files without rows and reads back as no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanflow.llm.common import CACHED_CHARACTERS, WHITE, kept, quoted, small_batches
from urbanflow.llm.counts import CALL_BYTES, Library

SHARD_IDS = 1 << 19
#: The least count of a pair (its rule takes two symbols and a length), and the share of symbols that a round must save.
LEAST, GAIN = 4, 0.001
COUNT_BITS = 20
KNOWN_LIMIT = 1_000_000
#: Bytes of text that are encoded together: parts repeat more in more text.
BATCH_BYTES = 1 << 23

FILE_SCHEMA = ("part int, shard int, start bigint, doc_ids array<bigint>, doc_ends array<bigint>, base bigint, rules binary, "
               "lengths binary, symbols binary")


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols) of ids below ``base``."""
    symbols = ids.astype(np.uint32)
    rules, lengths, made = [], [np.zeros(0, np.uint32)], 0
    while len(symbols) > 1:
        left, right = symbols[:-1], symbols[1:]
        slot = (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) >> np.uint32(32 - COUNT_BITS)
        counts = np.bincount(slot, minlength=1 << COUNT_BITS).astype(np.int32)[slot]
        # A pair is replaced where no overlapping pair is more frequent; in a run of equally frequent ones, every other.
        best = counts >= LEAST
        best[1:] &= counts[1:] >= counts[:-1]
        best[:-1] &= counts[:-1] >= counts[1:]
        at = np.flatnonzero(best)
        head = np.ones(len(at), bool)
        head[1:] = at[1:] != at[:-1] + 1
        at = at[(at - at[head][np.cumsum(head) - 1]) % 2 == 0] if len(at) else at
        at, pairs, which, seen = _grouped(at, left[at], right[at])
        often = seen >= LEAST
        used = often[which]
        if not used.any() or used.sum() < GAIN * len(symbols):
            break
        number = np.cumsum(often) - 1 + base + made
        at, pairs = at[used], pairs[often]
        rule = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        known = np.concatenate(lengths)
        size = np.ones(rule.shape, np.uint32)
        inner = rule >= base
        size[inner] = known[rule[inner] - base]
        rules.append(rule)
        lengths.append(size.sum(axis=1, dtype=np.uint32))
        made += len(rule)
        symbols = symbols.copy()
        symbols[at] = number[which[used]].astype(np.uint32)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), np.concatenate(lengths), symbols


def _grouped(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of their pairs, the distinct pairs, which of them stands at each place, and their counts."""
    shift = int(max(left.max(initial=0), right.max(initial=0))).bit_length()
    place = len(at).bit_length()
    if 2 * shift + place <= 64:  # the place fits beside the pair, and numbers sort faster than their order is found
        key = (left.astype(np.uint64) << np.uint64(shift) | right) << np.uint64(place) | np.arange(len(at), dtype=np.uint64)
        key.sort()
        at = at[(key & np.uint64((1 << place) - 1)).astype(np.int64)]
        codes = key >> np.uint64(place)
    else:
        codes = left.astype(np.uint64) << np.uint64(shift) | right
        order = np.argsort(codes)
        at, codes = at[order], codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    first = np.flatnonzero(new)
    pairs = codes[first] >> np.uint64(shift) << np.uint64(32) | codes[first] & np.uint64((1 << shift) - 1)
    return at, pairs, np.cumsum(new) - 1, np.diff(np.append(first, len(codes)))


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for; every pass opens one level of nonterminals."""
    while True:
        inner = symbols >= base
        if not inner.any():
            return symbols
        wide = np.repeat(symbols, 1 + inner)
        first = np.flatnonzero(inner) + np.arange(inner.sum())
        opened = rules[symbols[inner] - base]
        wide[first], wide[first + 1] = opened[:, 0], opened[:, 1]
        symbols = wide


@dataclass
class Shard:
    base: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Shard:
        rules, lengths, symbols = (np.frombuffer(row[c], "<u4") for c in ("rules", "lengths", "symbols"))
        return cls(row["base"], rules.reshape(-1, 2), lengths, symbols)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to before ``stop``; only the symbols that cover them are expanded."""
        size = np.ones(len(self.symbols), np.int64)
        inner = self.symbols >= self.base
        size[inner] = self.lengths[self.symbols[inner] - self.base]
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, [start, stop - 1], side="right")
        before = ends[a - 1] if a else 0
        return expand(self.symbols[a:b + 1], self.rules, self.base)[start - before:stop - before]

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.base)


#: The bytes of each white character.
_WHITE = [c.encode() for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c)]
_ONE_BYTE = np.isin(np.arange(256), [c[0] for c in _WHITE if len(c) == 1])
_FIRST_BYTES = sorted({c[0] for c in _WHITE if len(c) > 1})


def part_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Whether a part starts at each byte of UTF-8 texts that follow each other, cut as ``SAFE_PIECE`` cuts each text.

    ``texts`` holds the places where texts start and, last, where they end.
    """
    white = _ONE_BYTE[data]
    for lead in _FIRST_BYTES:
        at = np.flatnonzero(data == lead)
        for tail in [c[1:] for c in _WHITE if len(c) > 1 and c[0] == lead] if len(at) else []:
            found = at[np.all([data[at + k] == byte for k, byte in enumerate(tail, 1)], axis=0)]
            for k in range(len(tail) + 1):
                white[found + k] = True
    starts = np.zeros(len(data) + 1, bool)
    starts[texts] = True
    change = np.flatnonzero(white[1:] != white[:-1]) + 1
    ends_white = change[~white[change] & ~starts[change]]  # white space that ends a text stays together
    last = ends_white - 1  # the first byte of the last white character
    for _ in range(2):
        last -= (data[last] & 0xC0) == 0x80
    starts[change[white[change]]] = True
    starts[last] = True
    starts[ends_white[data[last] != ord(" ")]] = True
    return starts[:-1]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each large string starts, with the end of the last one, and the bytes of all."""
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, places, held = texts.buffers()
    places = np.frombuffer(places, np.int64, len(texts) + 1, 8 * texts.offset)
    return places - places[0], np.frombuffer(held or b"", np.uint8)[places[0]:places[-1]]


def _by_bytes(parts: pa.Array, limit: int) -> list[pa.Array]:
    """Neighbouring parts, together, up to about ``limit`` bytes; a longer part alone."""
    ends = np.cumsum(pc.binary_length(parts).to_numpy())
    cuts = np.flatnonzero(np.diff(ends // limit, prepend=-1)) if len(parts) else []
    return [parts.slice(a, b - a) for a, b in zip(cuts, [*cuts[1:], len(parts)])]


def _runs(sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of the items of groups ``which``, where groups of these sizes follow each other."""
    taken = sizes[which]
    run = np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(taken) - taken), taken)
    run += np.arange(len(run))
    return run


class Encoder:
    """Ids of texts as the library gives them; parts between safe boundaries that come again are not encoded again.

    Parts that start with a blank before a character that is not white are encoded many at a time, as one text: the next
    such part always starts a new piece.  The bytes of the tokens then tell where each part ends.  Parts and their ids are
    Arrow and numpy tables, so that no Python object stands for a part.
    """

    def __init__(self, path: str):
        self._library = Library(path)
        tokenizer = self._library.tokenizer
        self.size = tokenizer.get_vocab_size(with_added_tokens=True)
        # A byte-level vocabulary writes every byte as one character.
        self._bytes = np.zeros(self.size, np.int64)
        for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
            self._bytes[number] = len(token)
        #: Parts that have been met, the number of ids of each, and their ids one after the other.
        self._known = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow array, one after the other, and the number of ids of each."""
        parts, first = self._parts(texts)
        coded = parts.dictionary_encode()
        which = self._places(coded.dictionary)[coded.indices.to_numpy()]
        _, sizes, ids = self._known
        after = np.concatenate([[0], np.cumsum(sizes[which])])
        return ids[_runs(sizes, which)], np.diff(after[first])

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where distinct parts stand in the table of known ones; those that are not there are encoded and put there."""
        words, sizes, ids = self._known
        found = pc.index_in(parts, value_set=words)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        at = found.fill_null(0).to_numpy().astype(np.int64)
        if len(words) + len(new) > KNOWN_LIMIT or words.nbytes > CACHED_CHARACTERS:
            # Of the known parts, those of this batch stay.
            met = np.setdiff1d(np.arange(len(at)), new, assume_unique=True)
            words, sizes, ids = parts.take(pa.array(met)), sizes[at[met]], ids[_runs(sizes, at[met])]
            at[met] = np.arange(len(met))
        joinable = self._joinable(parts.take(pa.array(new)))
        tables = [(words, sizes, ids)]
        for own, encode in ((new[joinable], self._joined), (new[~joinable], self._alone)):
            at[own] = sum(len(t[0]) for t in tables) + np.arange(len(own))
            tables += [(some, *encode(some)) for some in _by_bytes(parts.take(pa.array(own)), CALL_BYTES)]
        words, *numbers = zip(*tables)
        self._known = pa.concat_arrays(words), *map(np.concatenate, numbers)
        return at

    def _joinable(self, parts: pa.Array) -> np.ndarray:
        if not self._library.safe:
            return np.zeros(len(parts), bool)
        head = pc.utf8_slice_codeunits(parts, 0, 2)
        after = pc.utf8_slice_codeunits(head, 1, 2)
        white = pc.is_in(after, value_set=pa.array(["", *[c.decode() for c in _WHITE]], pa.large_string()))
        return pc.and_(pc.starts_with(head, " "), pc.invert(white)).to_numpy(zero_copy_only=False)

    def _alone(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each part, and the ids of all."""
        found = [e.ids for e in self._library.tokenizer.encode_batch_fast(parts.to_pylist(), add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.uint32)

    def _joined(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_alone``, from the ids of all parts together unless a token crosses the end of a part."""
        places, data = _bytes_of(parts)
        text = data.tobytes().decode()
        ids = np.array(self._library.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(self._bytes[ids])
        at = np.searchsorted(ends, places[1:])
        if not len(ids) or at[-1] != len(ids) - 1 or not np.array_equal(ends[at], places[1:]):
            return self._alone(parts)
        return np.diff(at, prepend=-1), ids

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts, and the places among them where texts start, with the place after the last one."""
        places, data = _bytes_of(texts.cast(pa.large_string()).fill_null(""))
        if self._library.added is None:
            starts = np.zeros(len(data), bool)
            starts[places[places < len(data)]] = True
        else:
            starts = part_starts(data, places)
            for n in self._with_added(data, places):
                a, b = places[n], places[n + 1]
                cut = self._library.cut(data[a:b].tobytes().decode())
                starts[a:b] = False
                starts[a + np.cumsum([0, *[len(p.encode()) for p in cut if p][:-1]])] = True
        at = np.flatnonzero(starts)
        # An empty text has no part: it starts where the next text does.
        offsets = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
        parts = pa.LargeStringArray.from_buffers(len(at), offsets, pa.py_buffer(data))
        return parts, np.searchsorted(at, places)

    def _with_added(self, data: np.ndarray, places: np.ndarray) -> list[int]:
        """The texts that hold an added string."""
        found, held = set(), data.tobytes()
        for string in self._library.added:
            found |= {int(np.searchsorted(places, m.start(), "right")) - 1 for m in re.finditer(re.escape(string.encode()), held)}
        return sorted(found)


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """The ids and texts of batches of about ``BATCH_BYTES``."""
    docs, texts, size = [], [], 0
    for batch in batches:
        docs += batch.column(0).to_pylist()
        texts.append(batch.column(1).cast(pa.large_string()))
        size += texts[-1].nbytes
        if size >= BATCH_BYTES:
            yield docs, pa.concat_arrays(texts)
            docs, texts, size = [], [], 0
    if docs:
        yield docs, pa.concat_arrays(texts)


def pack(df: DataFrame, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the file format, in order of ``part`` and ``shard``."""
    small_batches(df.sparkSession)
    texts = df.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    turn = F.xxhash64("text")
    ordered = texts.withColumn("turn", turn).repartitionByRange(F.col("id").asc_nulls_first(), "turn").sortWithinPartitions(
        F.col("id").asc_nulls_first(), "turn").select("id", "text")
    names = [c.split()[0] for c in FILE_SCHEMA.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = kept("packing", path, lambda: Encoder(path)), TaskContext.get().partitionId(), 0
        base = max(encoder.size, end + 1)
        ids, found, size, start = [], [], 0, 0

        def row():
            rules, lengths, symbols = compress(np.concatenate(found), base)
            values = [part, shard, start, ids, np.cumsum([len(f) for f in found]).tolist(), base,
                      *[a.astype("<u4").tobytes() for a in (rules, lengths, symbols)]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for docs, texts in _larger(batches):
            encoded, sizes = encoder.encode(texts)
            ends = np.cumsum(sizes + 1)
            encoded = np.insert(encoded, np.cumsum(sizes), np.uint32(end))
            for doc, a, b in zip(docs, (ends - sizes - 1).tolist(), ends.tolist()):
                ids.append(doc)
                found.append(encoded[a:b])
                size += b - a
                if size >= SHARD_IDS:
                    yield row()
                    ids, found, size, shard, start = [], [], 0, shard + 1, start + size
        if ids:
            yield row()

    return ordered.mapInArrow(run, FILE_SCHEMA)


def write(df: DataFrame, path: str, folder: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of ``text_col`` to ``folder``."""
    pack(df, path, end, id_col, text_col).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids, ids_crc32) of every document in ``folder``; start counts the ids of all documents before.

    A shard knows its place in its part; the places of parts are sums over one row for every task that wrote.
    """
    stored = spark.read.schema(FILE_SCHEMA).parquet(folder)
    sizes = stored.groupBy("part").agg(F.sum(F.element_at("doc_ends", -1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                first = row["before"] + row["start"]
                ids, ends = Shard.of(row).all().astype("<u4"), [0, *row["doc_ends"]]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array([first + e for e in ends[:-1]], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))),
                    pa.array(crc, pa.int64())], names=["doc_id", "start", "ids", "ids_crc32"])

    # One row for each task that wrote, so it may be broadcast; the stored rows stay where they are.
    return stored.join(F.broadcast(parts), "part").mapInArrow(run, "doc_id bigint, start bigint, ids array<int>, ids_crc32 bigint")
