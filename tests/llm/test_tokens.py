"""Byte-level BPE, token counts and packed ids against the libraries."""

import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from urbanflow.llm import bpe, common, counts, packing, quality

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
ENCODER = bpe.TextEncoder(RANKS, PATTERN)
PLAIN = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
TOKENS = {rank: token for token, rank in bpe.read_ranks(RANKS).items()}
LIBRARY = Tokenizer.from_file(FILE)
ODD_PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\xa0", "　", "a", "the", "é", "ß", "🙂", "'s", "!", "**", "0", "12",
             "<|endoftext|>", "あ", "́"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(ODD_PARTS), max_size=40).map("".join)))
def test_transducer_equals_library(text):
    ids = ENCODER.encode(text).tolist()
    assert ids == PLAIN.encode_ordinary(text)
    assert "".join(bpe.decode_stream(ids, TOKENS, chunk=3)) == text


@pytest.mark.parametrize("text", ["a" * 50000, "ab" * 20000, "0" * 30000, "=" * 3000 + "-" * 2000, "é" * 9999])
def test_transducer_on_long_pieces(text):
    assert ENCODER.encode(text).tolist() == PLAIN.encode_ordinary(text)


def test_transducer_with_few_states(monkeypatch):
    monkeypatch.setattr(bpe, "STATE_LIMIT", 5)
    machine = bpe.Transducer(bpe.read_ranks(RANKS))
    for piece in ["unhappiness", " straightforwardly", "ééé", "a" * 300]:
        assert machine.encode(piece.encode()) == PLAIN.encode_ordinary(piece)
        assert len(machine._states) <= 8


def test_lookahead_is_bounded():
    machine = bpe.Transducer(bpe.read_ranks(RANKS))
    longest = max(map(len, machine.ranks))
    machine.encode(b"a" * 500 + b"the quick brown fox" * 50)
    assert all(sum(len(machine.tokens[t]) for t in walk[2]) <= longest + 1 for state in machine._states for walk in state)


def test_utf8_stream_keeps_unfinished_characters():
    stream = bpe.Utf8Stream()
    assert [stream.feed(b) for b in (b"\xf0\x9f", b"\x99", b"\x82a\xff")] == ["", "", "🙂a�"]
    assert stream.feed(b"\xc3") + stream.close() == "�"


def test_encode_and_decode_rows(odd, empty):
    ids = bpe.encode(odd, RANKS, PATTERN)
    rows = bpe.decode(ids, RANKS).collect()
    assert len(rows) == odd.count() and {"doc_id", "score", "KEPT", "size"} <= set(ids.columns)
    assert all(r["ids"] == PLAIN.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "") for r in rows)
    again = bpe.decode(ids.selectExpr("doc_id", "ids", "'old' as DECODED"), RANKS)
    assert again.columns == ["doc_id", "ids", "decoded"]
    assert bpe.decode(ids.selectExpr("cast(null as array<int>) as ids").limit(2), RANKS).collect() == [(None, "")] * 2
    assert bpe.decode(bpe.encode(empty, RANKS, PATTERN), RANKS).count() == 0


def test_safe_boundaries():
    rng, counter = random.Random(4), counts.Counter(FILE)
    texts = ["".join(rng.choice(ODD_PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert counter.counts(texts) == [len(LIBRARY.encode(t, add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_for_each_vocabulary(name, odd, empty):
    path = public_tokenizers.path(name)
    if path.endswith(".model"):
        import sentencepiece
        one = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        def one(text, tokenizer=Tokenizer.from_file(path)):
            return tokenizer.encode(text, add_special_tokens=False).ids
    rows = counts.count_tokens(odd.withColumnRenamed("KEPT", "N_TOKENS"), path, limit=30).collect()
    assert all(r["n_tokens"] == len(one(r["text"] or "")) for r in rows)
    assert all(r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 30) for r in rows)
    assert counts.count_tokens(empty, path).count() == 0


def test_calls_are_balanced_by_bytes():
    calls = counts.by_bytes(["x" * 50, "é" * 10, "a", "b", "c" * 9], 22)
    assert calls == [["x" * 50], ["é" * 10, "a", "b"], ["c" * 9]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(1, 40))
def test_grammar_round_trip(some, times):
    ids = np.array(some * times, np.uint32)
    rules, lengths, symbols = packing.compress(ids, 7)
    assert packing.expand(symbols, rules, 7).tolist() == ids.tolist()
    assert all(lengths[n] == len(packing.expand(np.array([7 + n], np.uint32), rules, 7)) for n in range(len(rules)))
    shard = packing.Shard(7, rules, lengths, symbols)
    for a in range(0, len(ids), max(1, len(ids) // 7)):
        assert shard.read(a, min(len(ids), a + 5)).tolist() == ids[a:a + 5].tolist()


def test_grammar_saves_symbols():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    rules, _, symbols = packing.compress(ids, 50257)
    assert len(symbols) + 2 * len(rules) < len(ids) / 8


@settings(max_examples=40, deadline=None)
@given(st.lists(st.none() | st.text("ab1<' \t\n\r\x85\xa0\u1680\u2003\u2028\u3000é世🙂", max_size=30)
                | st.lists(st.sampled_from(["<|endoftext|>", " the", "\n", " ", "<|endof", "text|>"]), max_size=6).map("".join), max_size=8),
       st.integers(0, 2))
def test_batches_encode_as_the_library(texts, limit):
    packing_limit, packing.KNOWN_LIMIT = packing.KNOWN_LIMIT, (3, 40, 1_000_000)[limit]
    try:
        encoder = packing.Encoder(FILE)
        for batch in (texts, texts[::-1], texts[1:]):
            ids, sizes = encoder.encode(pa.array(batch, pa.string()))
            want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in batch]
            assert sizes.tolist() == [len(w) for w in want]
            assert ids.tolist() == [n for w in want for n in w]
    finally:
        packing.KNOWN_LIMIT = packing_limit


def test_known_parts_are_not_encoded_again():
    encoder = packing.Encoder(FILE)
    batch = pa.array(["the same words\n\nagain and again", None, "again the same"])
    first = encoder.encode(batch)
    encoder._alone = encoder._joined = None  # a part that goes to the library again fails
    assert all(np.array_equal(a, b) for a, b in zip(first, encoder.encode(batch)))
    assert isinstance(encoder._known[0], pa.LargeStringArray)  # one table, no Python object for a part


def test_packed_files(spark, odd, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_IDS", 300)
    packing.write(odd, FILE, str(tmp_path / "a"))
    rows = sorted(packing.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids + [0])
                  for r in odd.collect())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in rows) == want
    order = [r["doc_id"] if r["doc_id"] is not None else -1 for r in rows]
    assert order == sorted(order)
    assert [r["start"] for r in rows] == np.cumsum([0, *[len(r["ids"]) for r in rows]])[:-1].tolist()
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    packing.write(empty, FILE, str(tmp_path / "b"))
    assert packing.read(spark, str(tmp_path / "b")).count() == 0


def test_worker_keeps_the_tables_of_one_operator():
    texts = pa.array(["the quick brown fox", None])
    ids = bpe._encoded(texts, RANKS, PATTERN)
    encoder = weakref.ref(common.kept("bpe", ("encode", RANKS, PATTERN), lambda: pytest.fail("made again")))
    assert bpe._decoded(ids, RANKS) == ["the quick brown fox", ""]
    assert encoder() is not None
    features = common.kept("quality", None, quality.Features)
    assert encoder() is None
    assert common.kept("quality", None, quality.Features) is features
