"""Token counts: batches encoded in Arrow functions that return lengths only.

Texts are cut at safe boundaries, places where the tokenizer always starts a new piece, so the counts of the parts add
up to the count of the whole.  For a byte-level BPE those are the ends of ``SAFE_PIECE``: its own pattern never matches
across them.  Parts that a batch repeats are encoded once; the rest goes to the library in calls of about
``CALL_BYTES`` bytes, longest parts first, so that no call is much larger than another.  Vocabularies of other kinds
have no boundary that holds for every text; their texts are encoded whole.

Cases: null and empty texts have no tokens; special strings inside a text count as the library counts them by default;
rows keep their other columns, and columns named like a result column are replaced.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanflow.llm.common import CACHED_CHARACTERS, SAFE_PIECE, Memo, append_columns, kept, quoted

CALL_BYTES = 1 << 18
KNOWN_LIMIT = 1_000_000


class Library:
    """The library that belongs to a vocabulary file: how to cut a text, and how many tokens each part has."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece
            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths: Callable[[list[str]], list[int]] = lambda parts: [
                len(ids) for ids in processor.encode(parts, num_threads=1)]
            self.cut: Callable[[str], list[str]] = lambda text: [text]
            self.safe, self.added = False, None
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.lengths = lambda parts: [len(e) for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as source:
            definition = json.load(source)
        self.safe = byte_level(definition)
        #: Added strings, which are cut out first; None where texts are not cut.
        self.added = _added(definition)
        self.cut = _cutter(self.added)


def byte_level(definition: dict) -> bool:
    """Whether a tokenizer file splits texts by the byte-level pattern and leaves them as they are."""
    pre = definition.get("pre_tokenizer") or {}
    return (definition.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space"))


def _added(definition: dict) -> list[str] | None:
    """The added strings of a tokenizer file, or None if its texts must be encoded whole."""
    added = definition.get("added_tokens") or []
    if not byte_level(definition) or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
        return None
    return [a["content"] for a in added]


def _cutter(strings: list[str] | None) -> Callable[[str], list[str]]:
    """How to cut texts, given the added strings; those are cut out first, as the library does."""
    if strings is None:
        return lambda text: [text]
    pieces = SAFE_PIECE.findall
    if not strings:
        return pieces
    special = re.compile("(" + "|".join(re.escape(s) for s in sorted(strings, key=len, reverse=True)) + ")")

    def cut(text: str) -> list[str]:
        if not any(s in text for s in strings):
            return pieces(text)
        return [p for n, part in enumerate(special.split(text)) for p in ([part] if n % 2 else pieces(part))]

    return cut


class Counter:
    def __init__(self, path: str):
        self._library = Library(path)
        self._known = Memo(None, KNOWN_LIMIT, CACHED_CHARACTERS)

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text of a batch."""
        known, parts = self._known, [self._library.cut(text) if text else [] for text in texts]
        unknown = sorted(known.absent(set(chain.from_iterable(parts))), key=len, reverse=True)
        for call in by_bytes(unknown, CALL_BYTES):
            known.update(zip(call, self._library.lengths(call)))
        return [sum(map(known.__getitem__, cut)) for cut in parts]


def by_bytes(parts: list[str], limit: int) -> list[list[str]]:
    """Neighbouring parts, together, up to ``limit`` bytes; a longer part alone."""
    calls, size = [], limit + 1
    for part in parts:
        n = len(part.encode())
        if size + n > limit:
            calls.append([])
            size = 0
        calls[-1].append(part)
        size += n
    return calls


def count_tokens(df: DataFrame, path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""

    def compute(texts: pa.Array) -> list:
        return [kept("counts", path, lambda: Counter(path)).counts(texts.to_pylist())]

    counted = append_columns(df, text_col, [("n_tokens", T.LongType())], compute)
    return counted.withColumns({"n_bytes": F.coalesce(F.octet_length(quoted(text_col)), F.lit(0)).cast("long"),
                                "over_limit": F.col("n_tokens") > limit})
