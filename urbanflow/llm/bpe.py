r"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A token sequence is what the merges give exactly if every two neighbours are *compatible*: merging the bytes of
both together gives these two tokens again.  Every prefix of a text therefore has one sequence of tokens, and the
encoder can be a transducer.  Its nondeterministic form walks the byte trie of the vocabulary; at a node that is a
token compatible with the token before, it may emit that token and start at the root again.  The deterministic
form follows all live walks at once: a state is a set of (trie node, token before, tokens not emitted yet), and
whatever all walks agree on is emitted.  No walk is longer than the longest token, so a token leaves the transducer
after a bounded lookahead.  States and transitions are made when a text first needs them and are dropped when there
are ``STATE_LIMIT`` of them, so memory stays bounded; the text itself is read once, in linear time.

Cases: a null or empty text has no tokens; ids that are not in the vocabulary raise; a null list of ids decodes to an
empty text; bytes that are not UTF-8 decode to U+FFFD; rows keep their other columns, repeated rows stay repeated.
"""

from __future__ import annotations

import base64
import codecs
import gc
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from urbanflow.llm.common import CACHED_CHARACTERS, Memo, append_columns, kept

STATE_LIMIT = 200_000
PIECE_LIMIT = 600_000
PAIR_LIMIT = 400_000
NEVER = 1 << 60
#: Ids joined to bytes at a time when decoding.
DECODE_CHUNK = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes byte strings by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._children: list[dict[int, int]] = [{}]
        self._token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self._children[node]
                if byte not in below:
                    below[byte] = len(self._token_at)
                    self._token_at.append(-1)
                    self._children.append({})
                node = below[byte]
            self._token_at[node] = rank
        leaf: dict[int, int] = {}
        self._children = [below or leaf for below in self._children]
        self._history = Memo(lambda key: self._edge_history(*key), 2 * len(ranks))
        self._compatible = Memo(self._merges_to_itself, PAIR_LIMIT)
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self._states = [start]
        self._numbers = {start: 0}
        self._steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, text: bytes, stop: int = 1) -> list[bytes]:
        """Apply the merges in order of rank until ``stop`` parts are left; quadratic, only for single tokens."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > stop:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge_history(self, side: int, rank: int) -> list[tuple[bytes, int]] | None:
        """What stands at one edge of a token while it is merged: each part with the rank that merges it away.

        ``side`` 0 is the left edge, -1 the right one; None if the merges never make this token.
        """
        token, ends = self.tokens[rank], NEVER
        history = []
        while True:
            history.append((token, ends))
            if len(token) == 1:
                return history[::-1]
            ends = self.ranks[token]
            halves = self.merged(token, 2)
            if len(halves) > 2 or any(half not in self.ranks for half in halves):
                return None
            token = halves[side]

    def _merges_to_itself(self, pair: tuple[int, int]) -> bool:
        """Whether no merge crosses the border between two tokens while both are made, and none joins them."""
        left = self._history[-1, pair[0]] if pair[0] >= 0 else ()
        right = self._history[0, pair[1]]
        if left is None or right is None:
            return False
        i = j = 0
        while i < len(left):
            (a, a_ends), (b, b_ends) = left[i], right[j]
            rank = self.ranks.get(a + b, NEVER)
            if rank < a_ends and (rank < b_ends or rank == b_ends < NEVER):
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1
        return True

    def _determinise(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        walks, boundary, children = [], None, self._children
        for node, before, waiting in self._states[state]:
            child = children[node].get(byte)
            if child is None:
                continue
            token = self._token_at[child]
            if boundary is None and token >= 0 and self._compatible[before, token]:
                boundary = (0, token, (*waiting, token))
            if children[child]:
                walks.append((child, before, waiting))
        if boundary is None:
            raise ValueError("the vocabulary lacks a single byte")
        walks.append(boundary)
        emitted = boundary[2]
        for walk in walks:
            agreed = 0
            for ours, theirs in zip(emitted, walk[2]):
                if ours != theirs:
                    break
                agreed += 1
            emitted = emitted[:agreed]
            if not emitted:
                break
        else:
            agreed = len(emitted)
            walks = [(node, before, waiting[agreed:]) for node, before, waiting in walks]
        following = tuple(walks)
        number = self._numbers.get(following)
        if number is None:
            number = self._numbers[following] = len(self._states)
            self._states.append(following)
        self._steps[state << 8 | byte] = found = (number, emitted)
        return found

    def encode(self, text: bytes) -> list[int]:
        out: list[int] = []
        state, steps = 0, self._steps
        for byte in text:
            step = steps.get(state << 8 | byte)
            if step is None:
                if len(self._states) >= STATE_LIMIT:
                    here = self._states[state]
                    self._reset()
                    steps = self._steps
                    state = self._numbers.setdefault(here, len(self._states))
                    if state == len(self._states):
                        self._states.append(here)
                step = self._determinise(state, byte)
            state = step[0]
            if step[1]:
                out.extend(step[1])
        if text:
            out.extend(self._states[state][-1][2])
        return out


class TextEncoder:
    """Splits a text by the pattern of the vocabulary and encodes each match separately."""

    def __init__(self, path: str, pattern: str):
        import regex
        self._split = regex.compile(pattern).findall
        machine = Transducer(read_ranks(path))
        self._pieces = Memo(lambda piece: np.array(machine.encode(piece.encode()), "<i4").tobytes(),
                            PIECE_LIMIT, CACHED_CHARACTERS)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._pieces.__getitem__, self._split(text or ""))), "<i4")


class Utf8Stream:
    """Incremental UTF-8 decoding: bytes of an unfinished character wait for the next call."""

    def __init__(self):
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, chunk: bytes) -> str:
        return self._machine.decode(chunk)

    def close(self) -> str:
        return self._machine.decode(b"", final=True)


def decode_stream(ids: Iterable[int], tokens: dict[int, bytes], chunk: int = DECODE_CHUNK) -> Iterator[str]:
    """Texts that become certain while ids arrive; they join to the decoded text."""
    stream = Utf8Stream()
    for some in batched(ids, chunk):
        yield stream.feed(b"".join(map(tokens.__getitem__, some)))
    yield stream.close()


def _once(key: tuple, make):
    """One encoder or vocabulary per Python worker, shared by the tasks it runs."""

    def made():
        # The tables hold millions of small tuples and no cycles; the collector would walk them again and again.
        gc.set_threshold(1_000_000, 20, 100)
        return make()

    return kept("bpe", key, made)


def _encoded(texts: pa.Array, path: str, pattern: str) -> pa.ListArray:
    encoder = _once(("encode", path, pattern), lambda: TextEncoder(path, pattern))
    found = [encoder.encode(text) for text in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))


def _decoded(rows: pa.ListArray, path: str) -> list[str]:
    tokens = _once(("decode", path), lambda: {rank: token for token, rank in read_ranks(path).items()})
    rows = rows.fill_null([]) if rows.null_count else rows
    ids, ends = rows.values.to_numpy(), rows.offsets.to_numpy()
    return ["".join(decode_stream(ids[a:b].tolist(), tokens)) for a, b in zip(ends, ends[1:])]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text_col`` as an array of int."""
    return append_columns(df, text_col, [(ids_col, T.ArrayType(T.IntegerType()))],
                          lambda texts: [_encoded(texts, path, pattern)])


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids of ``ids_col`` stand for."""
    return append_columns(df, ids_col, [(text_col, T.StringType())], lambda rows: [_decoded(rows, path)])


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
               decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the token ids of ``text_col`` and the text they stand for, in one pass of the Python workers."""

    def compute(texts: pa.Array) -> list:
        ids = _encoded(texts, path, pattern)
        return [ids, _decoded(ids, path)]

    return append_columns(df, text_col, [(ids_col, T.ArrayType(T.IntegerType())), (decoded_col, T.StringType())], compute)
